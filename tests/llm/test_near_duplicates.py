"""Bottom-k near-duplicates and the epsilon grid order join against brute force."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from lectern.llm import bottomk_dedup, dense, egrid_join, graph, kernels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, source string, n_shingles int, root string"


def components(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def word_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width):
    sets = {i: word_set(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


def corpus(seed, groups=8, size=12):
    """Groups of texts that each change a few words of the one before, copies, and odd texts."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        text = [r.choice(words) for _ in range(r.choice([6, 40, 150, 900]))]
        for _ in range(size):
            text = list(text)
            for _ in range(r.randint(0, max(1, len(text) // 60))):
                text[r.randrange(len(text))] = r.choice(words)
            texts.append(" ".join(text))
    texts += [None, "", " \t\n", "One", "one", "one two three", "One Two three", texts[0], texts[0].upper(), "x" * 100_000, "é ß"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "width"), [(1, 4), (2, 5)])
def test_groups_equal_brute_force(spark, seed, width):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, "s", 7, "x") for i, t in rows], DOCUMENTS)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in bottomk_dedup.near_duplicates(frame, width).collect()}
    assert got == brute(rows, width)


def test_large_family_is_compared_in_blocks(spark, monkeypatch):
    """Lists longer than COLD and families of several blocks, without a cut-off."""
    monkeypatch.setattr(bottomk_dedup, "COLD", 3)
    monkeypatch.setattr(bottomk_dedup, "TILE", 4)
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([w if r.random() > 0.03 else f"n{r.random()}" for w in base])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in bottomk_dedup.near_duplicates(frame, 4).collect()}
    assert got == brute(rows, 4)


def test_repeated_ids_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in bottomk_dedup.near_duplicates(frame).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]
    assert sorted(str(r.doc_id) for r in bottomk_dedup.keep_one(frame).collect()) == ["1", "None"]
    assert bottomk_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_rows_that_share_an_id_are_linked_by_their_texts(spark):
    """A row of another text under the same doc_id is lost by no stage, and links with its own copies."""
    one, two, three = "a b c d e f", "p q r s t u", "v w x y z"
    rows = [(1, one, "s"), (1, two, "s"), (2, two, "t"), (3, one, "t"), (4, three, "u"), (4, three, "t"), (5, None, "s"), (5, None, "s"), (None, one, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in bottomk_dedup.near_duplicates(frame).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("4", "4"), ("5", "5"), ("5", "5"), ("None", "None")]
    kept = sorted((str(r.doc_id), str(r.text), r.source) for r in bottomk_dedup.keep_one(frame).collect())
    assert kept == [("1", one, "s"), ("1", two, "s"), ("4", three, "t"), ("5", "None", "s"), ("5", "None", "s"), ("None", one, "s")]


def test_keep_one_keeps_the_columns(spark):
    frame = spark.createDataFrame([(i, t, "s", 7, "x") for i, t in corpus(3, groups=2)], DOCUMENTS)
    kept = bottomk_dedup.keep_one(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in brute(corpus(3, groups=2), 5).items() if i == c}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{j: 100 for j in range(100, 140)}}


def test_lists_meet_for_every_linked_pair():
    """A linked set shares at least ``least_common`` retained values, so leading values suffice."""
    assert [bottomk_dedup.least_common(n) for n in (1, 5, 10, 128)] == [1, 4, 8, 103]
    assert kernels.shingle_sets(__import__("pyarrow").array([None, ""]), 5, True)[0].size == 0


def test_pairs_on_both_sides_of_the_sketch(spark):
    """Texts of more than SKETCH shingles and their cut copies of at most as many, without a third copy."""
    rows = []
    sizes = [(n, m) for n in range(100, 136, 3) for m in (n + 1, n * 9 // 8, n * 5 // 4)] * 3
    for small, large in [(128, 160)] * 15 + [(128, 158)] * 15 + [(127, 158)] * 15 + sizes:
        words = [f"{len(rows)}x{k}" for k in range(large + 4)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: small + 4]))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in bottomk_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == brute(rows, 5)


def test_counts_over_many_batches(spark):
    """A table of few slots and more rows than it has, counted over several tasks; none, rare and frequent ones."""
    frame = spark.range(40_000).selectExpr("CAST(CASE WHEN id % 7 = 0 THEN 5 WHEN id < 3 THEN 9 ELSE 130000 + id % 2 END AS long) AS slot").repartition(4)
    got = dense.counts(frame, lambda batch: np.asarray(batch.column(0)), 1 << 18)
    times = {}
    for k in range(40_000):
        slot = 5 if k % 7 == 0 else 9 if k < 3 else 130_000 + k % 2
        times[slot] = times.get(slot, 0) + 1
    assert {k: int(got[k]) for k in np.flatnonzero(got)} == {k: math.ceil(6 * math.log2(1 + n)) for k, n in times.items()}


def vectors(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    data = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.3, 0.6], (n, 1))
    return [[float(x) for x in row] for row in data.astype(np.float32)]


def brute_vectors(rows, limit=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64))
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] >= limit]
    count = {i: sum(i in p for p in links) for i, _ in rows}
    return {i: (count[i], c) for i, c in components([i for i, _ in rows], links).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_equal_brute_force(spark, seed):
    made = vectors(seed)
    made += [made[0], made[0], [2 * x for x in made[0]], None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 2.0], [1.0, 2.0], [None] + [1.0] * 23]
    rows = list(enumerate(made))
    frame = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in egrid_join.near_vectors(frame, block=32, fan=3).collect()}
    assert got == brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_vectors_empty_table_and_null_id(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in egrid_join.near_vectors(frame).collect()) == [("1", 0, True), ("None", 0, True)]
    assert egrid_join.near_vectors(frame.limit(0)).count() == 0


def test_distant_blocks_are_skipped(spark):
    """Clustered vectors: many pairs of blocks are never compared, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24)) * np.array([4, 3, 2, *[1] * 21])
    data = (centres[rng.integers(0, 12, 400)] + 0.15 * rng.normal(size=(400, 24))).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    compared, pairs = egrid_join.interval_pairs(frame, block=16, fan=4)
    assert pairs > 300 and compared < pairs / 2
    got = {r.vec_id: (r.n_links, r.component_id) for r in egrid_join.near_vectors(frame, block=16, fan=4).collect()}
    assert got == brute_vectors(rows)


def test_vectors_that_share_an_id(spark):
    """Two vectors of one vec_id are counted apart."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.9, 0.1, 0.0]), (4, [0.0, 1.0, 0.02]), (5, [0.0, 0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in egrid_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 1), (5, 0, 5)]
