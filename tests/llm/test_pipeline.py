"""The corpus pipeline, stage by stage and as a whole, against plain versions; and rows of odd shapes in every operator."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import bitplane_store, bottomk_dedup, cross_entropy, curriculum_mix, egrid_join, gga_packing, html_crf, kernels, license_rules, oph_fingerprint, queries, subword_quality, token_ids

from .test_near_duplicates import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def corpus():
    """Prose and junk of three sources, copies and near copies, null and empty texts, one of 30,000 words."""
    r = random.Random(21)
    words = [f"{a}{b}" for a in ("ta", "me", "lo", "ri", "su", "den") for b in ("ka", "n", "rel", "to", "s", "ven", "ma")]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(20, 120))) + "." for _ in range(60)]
    texts += [" ".join([r.choice(words)] * r.randint(20, 90)) for _ in range(30)]  # junk
    texts += [texts[3], texts[3].upper(), texts[4] + " more", texts[5].replace(".", ""), None, "", "  ", "one"]
    texts.append(" ".join(r.choice(words) for _ in range(30_000)))
    rows = [(i, t, "en", r.choice(["a", "a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 60), 0) for i in range(90)] + [(5, 1, 0), (None, 1, 0), (9999, 0, 1), (7, None, 0)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_plain_versions(spark, folder, tmp_path):
    rows, labels = corpus()
    texts = {r[0]: r[1] for r in rows}
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns

    kept = stages["quality classifier"](spark, docs, folder).collect()
    known = sorted({(i, q) for i, q, _ in labels if i in texts and q is not None and zlib.crc32(str(i).encode()) % 5})
    model = subword_quality.train([texts[i] or "" for i, _ in known], [q for _, q in known])
    good = {i for i, t in texts.items() if model.probabilities(pa.array([t or ""]))[0] >= 0.3}
    assert {r.doc_id for r in kept} == good and len(kept) == len(good) and kept[0].__fields__ == names
    assert good.issuperset(range(60)) and not good & set(range(60, 90))

    kept = stages["near duplicates"](spark, spark.createDataFrame(kept, docs.schema), folder).collect()
    groups = brute([(i, texts[i]) for i in good], 5)
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert all(r.text == texts[r.doc_id] for r in kept) and kept[0].__fields__ == names

    spark.createDataFrame(kept, docs.schema).coalesce(1).write.parquet(f"{tmp_path}/kept")
    mixed = stages["mixture"](spark, spark.read.parquet(f"{tmp_path}/kept"), folder).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/kept/*.parquet')")
    taken = {i: n for i, n in db.execute(f"SELECT doc_id, taken FROM ({queries.ORACLE_SQL['op5_curriculum_mix']})").fetchall() if n}
    got: dict[int, int] = {}
    for r in mixed:
        assert (texts[r.doc_id].split())[: len(r.text.split())] == r.text.split() and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == taken and mixed[0].__fields__ == names

    packed = stages["packing"](spark, spark.createDataFrame(mixed, docs.schema), folder).collect()
    tokenizer = Tokenizer.from_file(token_ids.vocabulary_path("byte_bpe_50k.json"))
    expected = []
    for r in mixed:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        at, size, piece = 0, (len(ids) - 1) % 2048 + 1, 0
        while at < len(ids):
            expected.append((r.doc_id, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at, size, piece = at + size, 2048, piece + 1
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(expected)
    fill: dict[int, list] = {}
    for r in packed:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        ends = [0, *itertools.accumulate(length for _, length in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048

    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted(expected)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_odd_shapes(spark):
    """Null and repeated ids with other texts, null texts, columns named like those of results: each row has its result."""
    rows = [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (None, None, None), (1, "x y z", "s"), (1, "x y z", "s"), (1, "p q", None), (2, "", "t"), (3, "long " * 3000, "s")]
    frame = spark.createDataFrame([(*r, 1, "x", "y", 0.5, "z") for r in rows], "doc_id long, text string, source string, part int, score string, sequence_id string, size double, fingerprint string")
    names = sorted(str(r[0]) for r in rows)
    vocabulary = token_ids.vocabulary_path("word_bpe_49k.json")
    ids = lambda found: sorted(str(r.doc_id) for r in found.collect())
    assert ids(bottomk_dedup.near_duplicates(frame)) == names
    assert ids(oph_fingerprint.fingerprints(frame)) == names
    assert ids(license_rules.scan(frame)) == names
    assert ids(curriculum_mix.mix(frame)) == names
    assert ids(subword_quality.classify(frame, frame.limit(0).select("doc_id", frame.part.alias("quality")))) == names
    assert ids(cross_entropy.score(frame, frame.select("doc_id").limit(1))) == names
    assert ids(bitplane_store.read(spark, bitplane_store.write(frame, vocabulary, 2))) == names
    packed = gga_packing.pack_documents(frame, token_ids.vocabulary_path("byte_bpe_50k.json"))
    assert ids(packed.where("start = 0")) == names
    pages = spark.createDataFrame([(None, None, None, "a"), (None, "u", "<p>x", "a"), (1, "u", "<p>x", "a"), (1, "u", "<p>x", "a")], "page_id long, url string, html string, text string")
    assert sorted(str(r.page_id) for r in html_crf.extract(pages).collect()) == ["1", "1", "None", "None"]
    vectors = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1), (1, [1.0], 2), (2, None, 3)], "vec_id long, embedding array<float>, component_id int")
    assert sorted((str(r.vec_id), r.n_links) for r in egrid_join.near_vectors(vectors).collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]


def plain_fingerprint(text):
    """Bins of one pass over the shingles' hashes, empty ones filled along their probes, four low bits kept; None without words."""
    raw, offsets = kernels.text_buffer(pa.array([text]))
    words, before = kernels.word_hashes(raw, offsets, lower=False)
    values, _ = kernels.shingle_hashes(words, before, 5)
    bins: dict[int, int] = {}
    for v in values.tolist():
        bins[v >> 55] = min(v, bins.get(v >> 55, 1 << 64))
    if not bins:
        return None
    low = lambda v: int(kernels.mix(np.array([v], np.uint64))[0]) & 15
    out = []
    for k in range(512):
        source, attempt = k, 0
        while source not in bins:
            source = int(kernels.mix(np.array([k * 1_000_003 + attempt], np.uint64))[0] >> np.uint64(55))
            attempt += 1
        out.append(low(bins[source]))
    return out


def test_fingerprints_equal_plain_ones(spark):
    r = random.Random(5)
    texts = ["", None, "one", "a b c d", "a b c d e f", *(" ".join(r.choices(["go", "went", "ü", "x1", "Y"], k=n)) for n in (3, 50, 400, 3000)), "same again here now ok", "same again here now ok"]
    got = {x.doc_id: x for x in oph_fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    plain = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 2] + plain[(i + 1) % len(plain)][: len(t) // 2] for i, t in enumerate(plain)]
    codes, other = [plain_fingerprint(t) for t in plain], [plain_fingerprint(t) for t in edited]

    def likeness(a, b):
        if a is None or b is None:
            return float(a is None and b is None)
        same = sum(x == y for x, y in zip(a, b, strict=True)) / 512
        return min(1.0, max(0.0, (same - 1 / 16) / (1 - 1 / 16)))

    for i in range(len(texts)):
        assert got[i].fingerprint == "".join(f"{c:x}" for c in codes[i] or [])
        assert got[i].edited_fingerprint == "".join(f"{c:x}" for c in other[i] or [])
        assert got[i].near_edited == pytest.approx(likeness(codes[i], other[i]))
        assert got[i].near_next == pytest.approx(likeness(codes[i], codes[(i + 1) % len(codes)]))


def test_chain_is_trained_as_by_enumeration(monkeypatch):
    """Two pages, one epoch: every step's expectations summed over all ways to label a page."""
    monkeypatch.setattr(html_crf, "EPOCHS", 1)
    pages = [([["a", "b"], ["b"], ["c"]], [1, 0, 1]), ([["a"], ["c", "d"], ["b", "d"], ["a"]], [0, 1, 1, 0])]
    chain = html_crf.train(pages, seed=4)
    weights, moves, start = dict.fromkeys("abcd", 0.0), np.zeros((2, 2)), np.zeros(2)
    for done, k in enumerate(np.random.default_rng(4).permutation(2)):
        rate = html_crf.RATE * (1 - 0.9 * done / 2)
        features, labels = pages[k]
        ways = list(itertools.product((0, 1), repeat=len(labels)))
        score = lambda w: start[w[0]] + sum(weights[f] for fs, s in zip(features, w, strict=True) if s for f in fs) + sum(moves[a, b] for a, b in itertools.pairwise(w))  # noqa: B023, E731
        mass = [math.exp(score(w)) for w in ways]
        share = lambda test: sum(m for w, m in zip(ways, mass, strict=True) if test(w)) / sum(mass)  # noqa: B023, E731
        step = {f: sum(rate * (labels[i] - share(lambda w, i=i: w[i])) for i, fs in enumerate(features) if f in fs) for f in weights}
        first = [0.1 * rate * ((labels[0] == s) - share(lambda w, s=s: w[0] == s)) for s in (0, 1)]
        turn = np.array([[sum((labels[i - 1], labels[i]) == (s, t) for i in range(1, len(labels))) - sum(share(lambda w, i=i, s=s, t=t: (w[i - 1], w[i]) == (s, t)) for i in range(1, len(labels))) for t in (0, 1)] for s in (0, 1)])
        weights = {f: w * (1 - rate * html_crf.DECAY) + step[f] for f, w in weights.items()}
        moves, start = moves + 0.1 * rate * turn, start + first
    assert chain.weights == pytest.approx(weights) and np.allclose(chain.moves, moves) and np.allclose(chain.start, start)
