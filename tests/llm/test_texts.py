"""Extraction, classifier, mixing, packing, stores, fingerprints, licences and scores on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import bitplane_store, cross_entropy, curriculum_mix, gga_packing, html_blocks, html_crf, html_samples, kernels, license_rules, oph_fingerprint, queries, subword_quality, token_ids

LARGER = "/root/testdata/sf0.01"  # the smallest tables have a dozen held-out labels
ODD = [None, "", " ", "one", "Ünï cödé ß 日本語 text", "a b c", "tab\tand\nline  two   blanks", "<|endoftext|> x", "don't 12,345.67 e-mail", "x" * 5000, "same text here", "same text here"]


def frame_of(spark, texts):
    """Documents with columns that clash with those of results."""
    return spark.createDataFrame([(i, t, "s", i, "y") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long, part string")


def encoded(name):
    tokenizer = Tokenizer.from_file(token_ids.vocabulary_path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_tokenizer(name):
    import pyarrow as pa

    texts = ODD + [" ".join(random.Random(i).choices(["Hello", "world", "don't", "naïve", "x1", "(a)", "B.C.", "3.14", "…", "😀"], k=50)) for i in range(20)]
    encode = encoded(name)
    ids, at = token_ids.Encoder(token_ids.vocabulary_path(name)).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encode(t) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_odd_texts(name):
    """Odd white space, joiners, marks, and the strings of added tokens."""
    import pyarrow as pa

    parts = ["a", "B", "don't", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1d", "\x1f", "\x85", "\u3000", "\u00a0", "\u2009", "\u200b", "\u200d", "\u0301", "e\u0301", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "12", "ß", "İ", "日本", "'S", "…", "x" * 300, " word,", " THE", "\x00"]
    r, encode = random.Random(1), encoded(name)
    encoder = token_ids.Encoder(token_ids.vocabulary_path(name))
    for _ in range(40):
        texts = ["".join(r.choices(parts, k=r.choice([1, 2, 3, 5, 20, 60]))) for _ in range(40)] + ["\x1c b", "<|endoftext|> x"]
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encode(t) for t in texts]


def test_long_words_have_their_own_hash():
    """Two words of 4096 letters on which sums modulo a power of two agree."""
    import pyarrow as pa

    word = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    raw, offsets = kernels.text_buffer(pa.array([f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word.upper()}"]))
    hashes, _ = kernels.word_hashes(raw, offsets, lower=True)
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_store_round_trip(spark):
    encode = encoded("word_bpe_49k.json")
    for bits in (False, True):
        folder = bitplane_store.write(frame_of(spark, ODD), token_ids.vocabulary_path("word_bpe_49k.json"), 2, bits)
        at = 0
        for row in bitplane_store.read(spark, folder).orderBy("doc_id").collect():
            ids = [*encode(ODD[row.doc_id]), 2]
            assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)
    folder = bitplane_store.write(frame_of(spark, ODD).limit(0), token_ids.vocabulary_path("word_bpe_49k.json"), 2)
    assert bitplane_store.read(spark, folder).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 50_000, 70_001).astype(np.uint32)
    assert (bitplane_store.unpack_block(bitplane_store.pack_block(ids, bits), len(ids), bits) == ids).all()


def test_packing_is_whole_and_tight(spark):
    r = random.Random(2)
    texts = ODD + [" ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=r.choice([3, 30, 300, 1200, 5000]))) for _ in range(60)]
    encode = encoded("byte_bpe_50k.json")
    rows = gga_packing.pack_documents(frame_of(spark, texts), token_ids.vocabulary_path("byte_bpe_50k.json")).collect()
    by_doc, bins = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        bins.setdefault(x.sequence_id, []).append(x)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc_id, own in by_doc.items():
        ids, at = [*encode(texts[doc_id]), 0], 0
        assert len(own) == -(-len(ids) // 2048)
        for piece, x in enumerate(sorted(own, key=lambda x: x.piece)):
            assert (x.piece, x.start, x.ids_crc32) == (piece, at, zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes()))
            assert piece == 0 or x.length == 2048
            at += x.length
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    free = []  # a plain best fit of the longest first: the genetic algorithm must not need more
    for size in sorted((x.length for x in rows), reverse=True):
        fitting = [k for k in range(len(free)) if free[k] >= size]
        k = min(fitting, key=free.__getitem__, default=len(free))
        free[k:k] = [2048] if k == len(free) else []
        free[k] -= size
    assert len(bins) <= len(free)
    assert gga_packing.pack_documents(frame_of(spark, []), token_ids.vocabulary_path("byte_bpe_50k.json")).count() == 0


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2000, 200)
    (_, a), = gga_packing.evolve(lengths, [], 1)[:1]
    b = gga_packing.mutate(a, lengths, 2048, rng)
    child = gga_packing.crossover(a, b, lengths, 2048, rng)
    assert len(child) == 200 and child.min() >= 0 and np.bincount(child, weights=lengths).max() <= 2048


def test_evolution_beats_best_fit_on_hard_instances():
    """Full bins of three pieces each, which best fit, the longest first, can't find again."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        parts = [rng.multinomial(2048 - 1500, [0.4, 0.35, 0.25]) + 500 for _ in range(60)]
        lengths = rng.permutation(np.concatenate(parts))
        bins = [-1] * len(lengths)
        gga_packing.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), bins, [], 2048)
        (_, found), = gga_packing.evolve(lengths, [], seed, generations=400, patience=400)[:1]
        fill = np.bincount(found, weights=lengths)
        assert fill.max() <= 2048 and fill.sum() == lengths.sum()
        assert len({*found.tolist()}) < max(bins) + 1


def test_classifier_learns_and_scores_every_row(spark):
    documents, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    rows = queries.op4_subword_quality(spark, LARGER).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tested = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    good, bad = [s for s, y in tested if y == 1], [s for s, y in tested if y == 0]
    assert np.mean([float(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.85


def test_classifier_without_labels_and_odd_texts(spark):
    documents = frame_of(spark, ODD)
    none = spark.createDataFrame([(999, 1), (None, 0), (0, 7)], "doc_id long, quality int")
    assert {r.score for r in subword_quality.classify(documents, none).collect()} == {0.5}
    assert subword_quality.keep_good(documents, none).columns == documents.columns
    assert subword_quality.classify(documents.limit(0), none).count() == 0


def plain_bag(text):
    """Features of a text by name: words, pairs, pieces within words with blanks at their edges."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = Counter(("word", w) for w in words)
    out.update(("pair", a, b) if a != b else ("again",) for a, b in zip(words, words[1:], strict=False))
    for w in words:
        data = b" " + w.encode() + b" "
        out.update(("piece", data[k : k + n]) for n in (3, 4, 5) for k in range(len(data) - n + 1))
    return out


@pytest.mark.parametrize("segment", [1 << 18, 50])
def test_features_equal_plain_ones(segment, monkeypatch):
    """The number of features of each kind, and of each repeated feature, whatever the cuts of long texts."""
    monkeypatch.setattr(kernels, "SEGMENT", segment)
    r = random.Random(12)
    for text in ["", " ", "one", "a a a b", "tab\tand\nline", "é " * 40, "x" * 400, *(" ".join(r.choices(["go", "went", "Gone,", "über", "no"], k=200)) for _ in range(5))]:
        plain = plain_bag(text)
        buckets, shares = subword_quality.bag(text)
        total = sum(plain.values())
        assert sorted((shares * total).round().astype(int).tolist()) == sorted(plain.values())
        assert (subword_quality.REPEATED in buckets) == (("again",) in plain)


def test_scores_do_not_depend_on_cuts_or_neighbours():
    import pyarrow as pa

    model = subword_quality.train(["good words here", "bad bad bad bad"] * 20, [1, 0] * 20)
    long = " ".join(random.Random(3).choices(["good", "bad", "words", "here\tand", "x" * 3000], k=2000))
    alone, beside = model.probabilities(pa.array([long])), model.probabilities(pa.array(["good", long, None]))
    assert alone[0] == beside[1] and model.probabilities(pa.array(["bad bad"]))[0] < 0.5 < model.probabilities(pa.array(["good words"]))[0]


def test_learning_equals_plain_steps():
    """The same updates in plain loops over dense vectors."""
    texts, labels = ["a b c", "c c d", "a d", "b b b"], [1, 0, 1, 0]
    model = subword_quality.train(texts, labels, seed=9)
    rng = np.random.default_rng(9)
    vectors = rng.uniform(-1 / 8, 1 / 8, (subword_quality.BUCKETS, 8)).astype(np.float32)
    layer, bias, done = np.zeros((8, 2), np.float32), np.zeros(2, np.float32), 0
    for _ in range(subword_quality.EPOCHS):
        for i in rng.permutation(4):
            rate = subword_quality.RATE * (1 - done / (4 * subword_quality.EPOCHS))
            done += 1
            buckets, shares = subword_quality.bag(texts[i])
            mean = sum(s * vectors[b] for b, s in zip(buckets, shares, strict=True))
            e = np.exp(mean @ layer + bias)
            gradient = e / e.sum() - np.eye(2)[labels[i]]
            back = layer @ gradient
            layer, bias = layer - rate * np.outer(mean, gradient), bias - rate * gradient * 0.1
            for b, s in zip(buckets, shares, strict=True):
                vectors[b] -= rate * 20 * min(s, 0.05) * back
    used = np.unique(np.concatenate([subword_quality.bag(t)[0] for t in texts]))
    assert model.weight[used] == pytest.approx((vectors @ (layer[:, 1] - layer[:, 0]))[used], abs=1e-4)


def test_mix_meets_its_targets(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * r.randint(0, 30)), r.choice(["b", "a", None, "ä", "Z"])) for i in range(300)]
    mixed = curriculum_mix.mix(spark.createDataFrame([*rows, (300, None, "a")], "doc_id long, text string, source string")).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for x in mixed:
        assert x.taken <= 2 * x.size and x.taken == sum(p.words for p in x.passes)
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
    weight = dict(zip(["Z", "a", "b", "ä", None], [5, 2, 1, 5, 2], strict=True))
    expected, open_ = {}, set(weight)
    while True:  # water filling, source by source
        level = (1.5 * sum(sizes.values()) - sum(expected.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        expected |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    expected |= {s: level * weight[s] for s in open_}
    assert target == pytest.approx(expected)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_training_order_keeps_columns_and_words(spark):
    rows = frame_of(spark, ["a b c d", "e f", None, "", "g h i j k l"])
    got = curriculum_mix.training_order(rows)
    assert got.columns == rows.columns
    words = sum(len(r.text.split()) for r in got.collect())
    assert words == sum(r.taken for r in curriculum_mix.mix(rows).collect()) == 18
    assert curriculum_mix.training_order(rows.limit(0)).count() == 0


def test_fingerprints_estimate_similarity(spark):
    words = [f"w{i}" for i in range(5000)]
    r = random.Random(6)
    texts = [*ODD, " ".join(words[:1000]), " ".join(words[:950] + words[2000:2050]), " ".join(r.choices(words, k=800))]
    got = {x.doc_id: x for x in oph_fingerprint.fingerprints(frame_of(spark, texts)).collect()}
    assert sorted(got) == list(range(len(texts)))
    plain = [t or "" for t in texts]
    for i, text in enumerate(plain):
        following = plain[(i + 1) % len(plain)]
        half = len(text) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest() and got[i].n_chars == len(text)
    assert got[10].fingerprint == got[11].fingerprint and got[10].near_next == 1.0
    exact = (946 - 0) / (996 + 50)
    assert abs(got[len(ODD)].near_next - exact) < 0.08 and got[len(ODD) + 1].near_next < 0.08
    assert oph_fingerprint.fingerprints(frame_of(spark, [])).count() == 0


def test_licences_by_sentence_rules(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n"
    texts = [mit, "Some prose. Licensed under CC BY-SA 4.0. More prose.", "The licence of poets is no license.", None, "", "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."]
    got = {r.doc_id: r for r in license_rules.scan(frame_of(spark, texts)).collect()}
    assert [got[i].licenses for i in range(6)] == [["MIT"], ["CC-BY-SA-4.0"], [], [], [], ["Apache-2.0"]]
    assert texts[1][got[1].matches[0].start : got[1].matches[0].end] == "Licensed under CC BY-SA 4.0."
    assert len(got[5].matches) == 1


def test_every_known_wording_is_recognised():
    """Alone, after prose and before a comment's end, and wrapped as in a source header."""
    single = {names[0]: license_name for license_name, names in license_rules.ALL_RULES if len(names) == 1}
    for wording, name in license_rules.KNOWN_WORDINGS.items():
        words = wording.split()
        wrapped = "/* Some prose.\n" + "\n".join(" * " + " ".join(words[k : k + 6]) for k in range(0, len(words), 6)) + "\n */"
        for text in (wording, f"Some prose. {wording}\n*/\n\nMore prose.", wrapped):
            matches, n = license_rules.recognise(text)
            assert n == 1, text
            assert [m[0] for m in matches] == ([single[name]] if name in single else []), text


def test_rules_equal_plain_matching():
    """Identifiers in any order against every rule tried at every place."""
    r = random.Random(4)
    names = ["mit-named", "mit-grant", "mit-notice", "mit-warranty", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "gnu-verbatim", None, None]
    rules = sorted(license_rules.ALL_RULES, key=lambda x: -len(x[1]))
    for _ in range(60):
        line = [r.choice(names) for _ in range(30)]
        text = "\n\n".join(license_rules.SENTENCES[n][0] if n else "Some other prose stands here." for n in line)
        plain, at = [], 0
        while at < len(line):
            for license_name, wanted in rules:
                place, upto = at, at + 1
                for name in wanted if wanted[0] == line[at] else ("no",):
                    hit = next((k for k in range(place, min(len(line), upto)) if line[k] == name), None)
                    if hit is None:
                        break
                    place, upto = hit + 1, hit + license_rules.GAP + 2
                else:
                    plain.append(license_name)
                    at = place - 1
                    break
            at += 1
        assert [m[0] for m in license_rules.recognise(text)[0]] == plain


def test_many_statements_take_linear_time():
    import time

    began = time.monotonic()
    matches, n = license_rules.recognise("MIT License\n" * 20_000)
    assert (len(matches), n) == (20_000, 20_000) and time.monotonic() - began < 20


WHOLE_TEXTS = {"GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.parametrize("name", WHOLE_TEXTS)
def test_whole_licence_texts_are_one_match(name):
    """The texts that Linux distributions carry, where they are there: the notice within is no licence of its own."""
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("no licence texts on this machine")
    text = path.read_text()
    matches, _ = license_rules.recognise("Some prose.\n\n" + text)
    assert [m[0] for m in matches] == [WHOLE_TEXTS[name]] and matches[0][2] - matches[0][1] > 0.8 * len(text)
    both, _ = license_rules.recognise(text + "\n\nReleased under the MIT License.\n\n" + text)
    assert [m[0] for m in both] == [WHOLE_TEXTS[name], "MIT", WHOLE_TEXTS[name]]


def test_statements_within_a_whole_licence():
    """A title without an end is the title's rule alone; an end belongs to the title right before it; many titles take linear time."""
    import time

    title, notice, end = (license_rules.SENTENCES[n][0] for n in ("gpl3-title", "gpl3-later", "mit-named"))
    close = license_rules.ENDS["terms-end"][0]
    text = f"{title}\n\nProse.\n\n{notice}\n\nProse.\n\n{close}\n\nProse.\n\n{end}"
    assert [m[0] for m in license_rules.recognise(text)[0]] == ["GPL-3.0", "MIT"]
    assert [m[0] for m in license_rules.recognise(text.replace(close, "Prose."))[0]] == ["GPL-3.0", "GPL-3.0-or-later", "MIT"]
    assert [m[0] for m in license_rules.recognise(f"{title}\n\n{notice}\n\n{text}")[0]] == ["GPL-3.0", "GPL-3.0-or-later", "GPL-3.0", "MIT"]
    assert license_rules.recognise(close)[1] == 0
    began = time.monotonic()
    assert len(license_rules.recognise(f"{title}\n\n" * 5000)[0]) == 5000 and time.monotonic() - began < 20


def test_wrapped_licence_text_is_one_match():
    notice = [w for n in ("gpl2-later", "gpl-warranty") for w in license_rules.SENTENCES[n][:1]]
    text = "\n".join(line for w in notice for line in re.findall(r"\S.{0,60}(?=\s|$)", w))
    assert license_rules.recognise(text) == ([("GPL-2.0-or-later", 0, len(text))], 2)


def test_cross_entropy_equals_plain_counts(spark):
    """Against counts in dictionaries; the few words here have classes of their own."""
    r = random.Random(8)
    texts = [" ".join(r.choices(["Red", "green", "blue", "cyan"], k=r.randint(1, 30))) for _ in range(30)] + [None, "", "alone"]
    documents = frame_of(spark, texts)
    target = spark.createDataFrame([(i, "x") for i in range(0, 30, 3)] + [(None, "x"), (500, "x")], "doc_id long, text string")
    got = {x.doc_id: x for x in cross_entropy.score(documents, target).collect()}
    words = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    pairs = [list(zip(["<s>", *w], w, strict=False)) for w in words]

    def loss(own, members):
        others = [k for k in members if k != own]
        c1, c2, h = Counter(), Counter(), Counter()
        for k in others:
            c1.update(words[k])
            c2.update(pairs[k])
            h.update(a for a, _ in pairs[k])
        n = sum(c1.values())
        p = lambda w: (c1[w] + 0.1) / (n + 0.1 * 2**20)
        return np.mean([-math.log((c2[a, b] + 64 * p(b)) / (h[a] + 64)) for a, b in pairs[own]])

    for i, own in enumerate(words):
        assert got[i].n_tokens == len(own)
        if not own:
            assert got[i].score is None
            continue
        inside, background = loss(i, range(0, 30, 3)), loss(i, range(len(texts)))
        assert got[i].target_loss == pytest.approx(inside) and got[i].score == pytest.approx(inside - background)
    assert cross_entropy.score(documents.limit(0), target).count() == 0


def test_cross_entropy_of_a_large_vocabulary(spark, monkeypatch):
    """More pairs than 2 ** 17, over several chunks and parts, against exact counts."""
    monkeypatch.setattr(cross_entropy, "CHUNK", 1 << 18, raising=False)
    monkeypatch.setattr(cross_entropy, "PART", 1 << 14, raising=False)
    r = random.Random(9)
    texts = [" ".join(f"w{int(r.paretovariate(0.3)) % 200_000}" for _ in range(1000)) for _ in range(300)]
    got = {x.doc_id: x for x in cross_entropy.score(frame_of(spark, texts), frame_of(spark, texts[:60])).collect()}
    words = [t.split() for t in texts]
    pairs = [list(zip([None, *w], w, strict=False)) for w in words]
    for column, members in (("target_loss", 60), ("background_loss", 300)):
        c1, c2, h = Counter(), Counter(), Counter()
        for w, p in zip(words[:members], pairs[:members], strict=True):
            c1.update(w)
            c2.update(p)
            h.update(a for a, _ in p)
        for k in (0, 59, 60, 299):
            own = [Counter(words[k]), Counter(pairs[k]), Counter(a for a, _ in pairs[k])] if k < members else [Counter()] * 3
            n = members * 1000 - sum(own[0].values())
            p = lambda w: (c1[w] - own[0][w] + 0.1) / (n + 0.1 * 2**20)  # noqa: B023, E731
            loss = np.mean([-math.log((c2[a, b] - own[1][a, b] + 64 * p(b)) / (h[a] - own[2][a] + 64)) for a, b in pairs[k]])
            assert got[k][column] == pytest.approx(loss, rel=1e-9)


def test_page_blocks_and_main_text(spark):
    page = "<html><body><nav class=menu><a href=x>Home</a></nav><article><h1>The title &amp; more</h1><p>First   paragraph of the article, with <b>bold</b> words.</p><p>Second paragraph, which goes on for a while and ends.</p></article><div class='comments'><p>Nice post!</p></div><script>var x = '<p>no</p>';</script><footer>&copy; 2024</footer></body></html>"
    assert [b.text() for b in html_blocks.blocks(page)] == ["Home", "The title & more", "First paragraph of the article, with bold words.", "Second paragraph, which goes on for a while and ends.", "Nice post!", "© 2024"]
    rows = spark.createDataFrame([(1, "u", page, "old"), (2, "u", None, "old"), (3, None, "", "old"), (4, "u", "<p", "old")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_crf.extract(rows).collect()}
    assert got[1].text == "The title & more First paragraph of the article, with bold words. Second paragraph, which goes on for a while and ends."
    assert got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text) == ("", "", "")


def test_page_labels_on_unseen_sites():
    """Blocks of generated pages that training has not seen."""
    chain, maker = html_crf.default_chain(), html_samples.Pages(999)
    hits = total = 0
    for _ in range(60):
        parts = maker.page()
        _, labels = html_crf.labelled(parts)
        found = [(b, t) for b in html_blocks.blocks("".join(x for _, x in parts), chain.weigh) if (t := b.text())]
        assert len(found) == len(labels)
        states = chain.decode([chain.emission(b, t) for b, t in found])
        hits += sum(a == b for a, b in zip(states, labels, strict=True))
        total += len(labels)
    assert total > 500 and hits / total > 0.95


def plain_path(page, k):
    """The signs around the k-th leaf of a well-formed page, read from its nesting alone."""
    import xml.etree.ElementTree as tree

    leaves = []

    def walk(node, above, own):
        mine = html_blocks.signs(node.tag, "".join(f' {a}="{v}"' for a, v in node.attrib.items()))
        own, above = (mine, above | {*mine}) if node.tag in html_blocks.BLOCK else (own, above | {s for s in mine if not s.startswith("tag=")})
        if node.text and node.text.strip():
            leaves.append((node.text.strip(), above | {f"own:{s}" for s in own}))
        for child in node:
            walk(child, above, own)

    walk(tree.fromstring(page), set(), ())
    return leaves[k]


def test_signs_around_blocks_equal_plain_ones():
    page = '<html><body class="site"><div id="mainContent" class="post-body wide"><p>One</p><ul><li class="x">Two</li><li><span class="y">Three</span></li></ul></div><footer role="contentinfo"><p style="display:none">Four</p></footer></body></html>'
    for k, block in enumerate(html_blocks.blocks(page)):
        assert (block.text(), {*block.path}) == plain_path(page, k)
    chain = html_crf.default_chain()
    for plain, weighed in zip(html_blocks.blocks(page), html_blocks.blocks(page, chain.weigh), strict=True):
        assert weighed.weight == pytest.approx(sum(map(chain.weigh, plain.path)))


def test_broken_pages_are_read_once():
    """Unclosed and unmatched markup of a megabyte, in a few seconds each; and what such markup hides."""
    import time

    texts = lambda page: [b.text() for b in html_blocks.blocks(page)]
    assert texts("<p>a<svg/>b</p><p>c</p><svg><path/></svg>d") == ["ab", "c", "d"]
    assert texts("<p>a</p><script>var x = 1") == ["a"]
    assert texts("<p>a</p><noscript><p>b</p>") == ["a", "b"]
    assert texts('<p title="a > b">c</p><p title=it\'s>d</p>') == ["c", "d"]
    assert texts("<p>a<!-- x -- > y -->b<!-->c</p><p") == ["abc"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<p>f") == ["a", "b", "c", "d", "e", "f"]
    chain = html_crf.default_chain()
    for part in ("<a ", "<div>", "</b>", "<svg>", "<a b='", '<a ">', "<i>x</b>", "<!--", "<div class=c>t", "<td><li>", "&am", "<p>x <b>"):
        began = time.monotonic()
        chain.extract(part * (1_000_000 // len(part)))
        assert time.monotonic() - began < 20, part


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    chain = html_crf.Chain({}, rng.normal(size=(2, 2)), rng.normal(size=2))
    for _ in range(20):
        e = rng.normal(size=6).tolist()
        score = lambda p: chain.start[p[0]] + sum(x for x, s in zip(e, p, strict=True) if s) + sum(chain.moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(chain.decode(e)) == max(itertools.product((0, 1), repeat=6), key=score)
