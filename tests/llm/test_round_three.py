"""Piece encoding, ranked search and conversation tries against the library and plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece

from lectern.llm import piece_agenda, queries, tiered_search, token_ids, turn_trie

MODEL = token_ids.vocabulary_path("piece_bpe_32k.model")
PARTS = ["a", "B", "don't", " ", "  ", "\t", "\n", "▁", "▁▁", "\x00", "😀", "é", "é", "日本", "ﬁ", "<s>", "<0x41>", "x" * 70, " the ", " in", "　", "\x85", "\U000e0001", "....", "0123", " " * 40, "ing ", "tion"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_agenda_equals_the_library(library):
    """Odd white space, characters without a piece, units in step and units with a heap of their own."""
    r, words = random.Random(1), piece_agenda.Vocabulary(MODEL)
    for _ in range(60):
        texts = ["".join(r.choices(PARTS, k=r.choice([0, 1, 2, 3, 5, 20, 60]))) for _ in range(40)] + [None, "", " "]
        ids, at = words.encode(pa.array(texts, pa.string()))
        got, want = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], library.encode([x or "" for x in texts])
        assert [x.tolist() for x in got] == want
        assert [words.decode(x) for x in got] == library.decode(want)


def test_agenda_in_step_and_by_heap_agree():
    r, words = random.Random(2), piece_agenda.Vocabulary(MODEL)
    for _ in range(200):
        unit = words._symbols(pa.array([0x2581, *map(ord, r.choices("thineoraéß☃", k=r.randint(1, 45)))]).to_numpy())
        alone, _ = words._in_step(unit.copy(), pa.array([len(unit)]).to_numpy())
        assert alone.tolist() == words._by_heap(unit.tolist())


def test_long_texts_go_in_parts(library, monkeypatch):
    r, words = random.Random(3), piece_agenda.Vocabulary(MODEL)
    text = " ".join("".join(r.choices("abcdeéthin ", k=r.randint(0, 9))) for _ in range(20000)) + " ▁ x" + "y" * 3000
    monkeypatch.setattr(piece_agenda, "PART", 1000)
    monkeypatch.setattr(piece_agenda, "DECODED", 500)
    ids = words.encode_long(text)
    assert ids.tolist() == library.encode(text)
    assert words.decode(ids) == library.decode(ids.tolist())


def test_a_wrong_piece_is_an_error():
    words = piece_agenda.Vocabulary(MODEL)
    words.join_ids = words.join_ids.copy()
    words.join_ids[:] = words.join_ids[0]
    with pytest.raises(ValueError, match="otherwise"):
        words.encode(pa.array(["the thing"]))


def test_digests(spark, library):
    texts = [None, "", "the thing", "the thing", "▁a", "  two  ", "é😀\x00", " ".join(["word"] * 5000)]
    frame = spark.createDataFrame([(i if i != 3 else 2, t, [1], "x") for i, t in enumerate(texts)] + [(None, "null id", [1], "x")], "doc_id long, text string, ids array<int>, part string")
    got = sorted(piece_agenda.digests(frame, MODEL).collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.n_tokens))
    want = []
    for row in frame.collect():
        ids = library.encode(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is not None, r[0], r[1]))
    assert piece_agenda.digests(frame.limit(0), MODEL).collect() == []
    whole = piece_agenda.encode(frame, MODEL)
    assert whole.columns == frame.columns and whole.where("part = 'x'").count() == len(texts) + 1
    assert queries.op11_piece_agenda(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def plain_nodes(rows):
    """All nodes by listing every prefix of every rebuilt conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    first = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in first.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = first.get(c - c % 5, [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    members[()] = []
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (max(len(m) - 1, 0) * len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in children[p])
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((min(m, default=None), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0] or 0))


@pytest.mark.parametrize("least, most", [(256, 50_000), (5, 20)])
def test_tries_equal_all_prefixes(spark, least, most):
    """Shared first turns, copies, one long conversation, nulls and missing families; with and without oversized first turns."""
    r, rows = random.Random(1), []
    for c in range(300):
        if c % 37:
            for t in range(r.choice([1, 2, 3, 3, 9, 12])):
                rows.append((c * (1 if c < 200 else 7), None if r.random() < 0.02 else t, None if r.random() < 0.1 else "user", "hello" if t == 0 and r.random() < 0.6 else r.choice(["a", "b", "é", None]) if t < 4 else r.choice("xy"), 1))
    rows += [(3001, t, "user", "hello" if t == 0 else "z", 1) for t in range(400)]
    rows += [(c, t, "user", x, 1) for c in range(5000, 5200) for t, x in enumerate(["hello", "same", "same"])]
    rows += [(None, 0, "user", "hello", 1), (7777, 0, None, None, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int").repartition(5)
    got = turn_trie.prefix_nodes(frame, least, most)
    assert sorted((tuple(x) for x in got.collect()), key=lambda x: (x[1], x[0])) == plain_nodes([x[:4] for x in rows])


def test_tries_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in turn_trie.prefix_nodes(empty).collect()] == plain_nodes([])


def plain_ranks(documents, items, top=20):
    """Every document's score for every item."""
    def terms(text):
        return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]

    docs = [(d, terms(t)) for d, t in documents]
    docs = [(d, Counter(t), len(t)) for d, t in docs if t]
    total, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, tf, _ in docs for t in tf)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for d, tf, n in docs:
            m = 75 + (25 * n * total) // length
            score = sum(k * weight[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, k in asked.items() if t in tf)
            scores.append((-score, (d is not None, d or 0), d))
        for rank, (score, _, d) in enumerate(sorted(s for s in scores if s[0] < 0)[:top], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[3]))


@pytest.mark.parametrize("first, top", [(1000, 20), (3, 20), (1, 4), (40, 2)])
def test_ranks_equal_a_full_scan(spark, monkeypatch, first, top):
    """Ties, repeated rows, null texts and ids, odd characters, an item without a known term; proofs at every tier."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["ÄÖ", "K", "日本", "x-y", "İ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    documents = [(k, " ".join(r.choices(words, weights, k=r.choice([1, 3, 10, 40, 200])))) for k in range(300)]
    documents += [(300, None), (301, ""), (302, "..."), (None, "w1 w2 w3 rare"), (303, "same words here"), (304, "same words here"), (305, "SAME words HERE"), (306, "w5 " * 3000)]
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 2, 6, 30])))) for k in range(40)] + [(100, None), (101, "nowhere"), (102, "same, Words: here rare"), (None, "w1 rare"), (103, "W0 w0 w0")]
    monkeypatch.setattr(tiered_search, "FIRST", first)
    monkeypatch.setattr(tiered_search, "PARTS", (30, 3))
    got = tiered_search.rank_all(spark.createDataFrame([(*d, 1) for d in documents], "doc_id long, text string, rank int").repartition(3), spark.createDataFrame(items, "item_id long, text string"), top).collect()
    rows = sorted(((x.item_id, x["rank"], x.doc_id, x.score) for x in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[3]))
    assert rows == plain_ranks(documents, items, top)
    if first == 1:
        assert len({x.tier for x in got}) > 1


def test_ranks_of_nothing(spark):
    documents, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tiered_search.rank_all(documents.limit(0), items).collect() == []
    assert tiered_search.rank_all(documents, items.limit(0)).collect() == []
    assert [tuple(x)[:3] for x in tiered_search.rank_all(documents, items).collect()] == [(1, 1, 1)]


def test_whole_index_serves_any_item(spark):
    """An index of all terms gives what an index of the items' terms gives."""
    documents, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    index, _ = tiered_search.build(documents)
    assert sorted(map(tuple, tiered_search.search(index, items).collect())) == sorted(map(tuple, tiered_search.rank_all(documents, items).collect()))
    assert index.terms.count() > 1000 and index.postings.select("row").distinct().count() == index.documents
