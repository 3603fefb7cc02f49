"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is that of its distinct word shingles, as 64-bit hashes. Its sketch keeps
the ``SKETCH`` least hashes (their leading 32 bits), so a set of at most that size is kept
whole. Two documents are linked when ``100 * |A n B| >= 80 * |A u B|``, which is confirmed
on the whole sets; components of links are the groups.

1. Documents with equal sets are one document from here on (a group of copies, however
   large, is one grouped minimum).
2. Inverted lists of retained values. Values are ordered by a count table of fixed size,
   the rare ones first. Linked documents share so many retained values that they meet in
   the list of one of the first ``prefix`` values; only those are listed. For two
   sets kept whole the number is exact; where one may be larger it allows for 5.5 standard
   deviations of the sketch.
3. Each list's least document is compared with the others of the list: the number of
   comparisons is the number of entries. Their links nearly always join whole groups.
4. Only pairs in one list that no link joins so far are left. In lists of at most ``COLD``
   entries they are compared pair by pair. Longer lists that share documents form a family.
   Documents of a family's largest group so far never meet each other; all others are cut into
   blocks and meet every block, each pair of blocks in one task, which returns a spanning forest
   of links instead of pairs. Nothing is dropped.

Before the whole sets are compared, the two sketches' union must estimate a similarity near
the threshold (see ``likely``).

Defined results: ``A-Z`` is lower-cased; a document with fewer words than a shingle has its
word sequence as its one shingle; documents without words, null ones too, have an empty set
and are linked with nothing. Rows that share a doc_id are documents of their own, linked only
by their texts, and a null doc_id takes no part in links (it is returned as its own component).
Ties go to the least doc_id. An empty table gives an empty result. Columns besides doc_id and
text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import dense, graph, kernels, shared

SKETCH = 128
COLD = 64
TILE = 256
BITS = 22
THRESHOLD = 80

_SKETCHES = "doc_id long, mark long, n_shingles long, signature binary, sketch array<int>"


def sketch_table(documents: DataFrame, width: int, lower: bool = True) -> DataFrame:
    """A row for each document with a hash of its text (``mark``), and the size, a 128-bit signature and the sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for block in kernels.blocks(batches, "text"):
            sets = kernels.shingle_sets(block.column(block.schema.get_field_index("text")), width, lower)
            kept = [(s[:SKETCH] >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            at = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            yield pa.record_batch({
                **{c: block.column(block.schema.get_field_index(c)) for c in ("doc_id", "mark")}, "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "signature": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                "sketch": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))),
            })

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(run, _SKETCHES)


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of a list column."""
    at = np.asarray(column.offsets, dtype=np.int64)
    return np.asarray(column.values)[at[0] : at[-1]], at - at[0]


def _slots(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint32) >> np.uint32(32 - BITS)).astype(np.int64)


def least_common(size: int, threshold: int = THRESHOLD) -> int:
    """Retained values that a linked document must share with one whose set has ``size`` values."""
    if size <= SKETCH:
        return max(1, -(-threshold * size // 100))
    share = threshold / 100
    return max(1, math.floor(SKETCH * share - 5.5 * math.sqrt(SKETCH * share * (1 - share))))


def _prefix(size: int, threshold: int = THRESHOLD) -> int:
    """How many of a document's rarest retained values are listed.

    A set kept whole whose partner may be larger than SKETCH shares only what the partner's
    sketch retains, so it is listed as for a larger set.
    """
    common = least_common(size, threshold)
    if 100 * size >= threshold * (SKETCH + 1):
        common = min(common, least_common(SKETCH + 1, threshold))
    return min(size, SKETCH) - common + 1


def postings(sketches: DataFrame, threshold: int, held: list[Broadcast]) -> DataFrame:
    """Entries (value, rep, n) of the inverted lists of each document's rarest retained values.

    Broadcast tables are appended to ``held``, to be freed when the result is written.
    """
    table = dense.counts(sketches.select("sketch"), lambda batch: _slots(_list_parts(batch.column(0))[0]), 1 << BITS)
    shared_counts = sketches.sparkSession.sparkContext.broadcast(table)
    held.append(shared_counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared_counts.value
        for batch in batches:
            rep, n = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("rep", "n"))
            values, at = _list_parts(batch.column(batch.schema.get_field_index("sketch")))
            owner = np.repeat(np.arange(len(rep)), np.diff(at))
            order = np.lexsort((values, count[_slots(values)], owner))
            place = np.arange(len(values)) - at[:-1][owner]
            prefix = np.array([_prefix(int(x), threshold) for x in n], dtype=np.int64)
            kept = order[place < prefix[owner]]
            yield pa.record_batch({"value": pa.array(values[kept]), "rep": pa.array(rep[owner[kept]]), "n": pa.array(n[owner[kept]])})

    return sketches.select("rep", "n", "sketch").mapInArrow(run, "value int, rep long, n long")


def likely(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int, threshold: int = THRESHOLD) -> bool:
    """Whether the sketches (unsigned, ascending) allow a similarity at the threshold.

    The least SKETCH values of the union are a sample of it; the share of them that both
    sides hold estimates the similarity. Sets kept whole leave room only for equal leading
    bits of different hashes, larger ones for 5.5 standard deviations.
    """
    share = threshold / 100
    union = np.union1d(a, b)
    room = 0.03 if max(size_a, size_b) <= SKETCH else 5.5 * math.sqrt(share * (1 - share) / SKETCH)
    if max(size_a, size_b) > SKETCH:
        union = union[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    hits = int(np.searchsorted(both, union[-1], side="right")) if len(union) else 0
    return hits >= (share - room) * len(union) - 1


def _estimated(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that the estimate lets pass."""
    one = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            na, nb = np.asarray(col("na")), np.asarray(col("nb"))
            (va, ia), (vb, ib) = _list_parts(col("sa")), _list_parts(col("sb"))
            va, vb = va.view(np.uint32), vb.view(np.uint32)
            good = [likely(np.unique(va[ia[k] : ia[k + 1]]), int(na[k]), np.unique(vb[ib[k] : ib[k + 1]]), int(nb[k]), threshold) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([col("a"), col("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long")


def whole_sets(documents: DataFrame, wanted: DataFrame, width: int, lower: bool, held: list[Broadcast]) -> DataFrame:
    """The whole sets (rep, values) of the documents in ``wanted``, from one pass over the texts.

    A table of fixed size tells most other documents apart before their texts are read;
    a join then leaves exactly the wanted ones.
    """
    shared_marks = documents.sparkSession.sparkContext.broadcast(dense.marks(wanted, "doc"))
    held.append(shared_marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for block in kernels.blocks(dense.marked(batches, shared_marks.value), "text"):
            sets = kernels.shingle_sets(block.column(block.schema.get_field_index("text")), width, lower)
            yield pa.record_batch({"doc": block.column(block.schema.get_field_index("doc_id")), "signature": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), "values": pa.array([s.tobytes() for s in sets], pa.binary())})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", dense.slot(F.col("doc_id").cast("long")).alias("slot"))
    sets = rows.where(F.col("doc_id").isNotNull()).mapInArrow(run, "doc long, signature binary, values binary")
    # of rows that share a doc_id, those whose set is wanted; of equal rows one is enough
    return sets.join(wanted.select("rep", "doc", "signature"), ["doc", "signature"]).select("rep", "values").dropDuplicates(["rep"])


def _among(sketches: DataFrame, ids: DataFrame, held: list[Broadcast]) -> DataFrame:
    """The sketches of the ids and few others, found without moving a sketch."""
    shared_marks = sketches.sparkSession.sparkContext.broadcast(dense.marks(ids, "rep"))
    held.append(shared_marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in dense.marked(batches, shared_marks.value):
            yield batch.select(["rep", "doc", "n", "signature", "sketch"])

    return sketches.select("rep", "doc", "n", "signature", "sketch", dense.slot(F.col("rep")).alias("slot")).mapInArrow(run, "rep long, doc long, n long, signature binary, sketch array<int>")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            good = []
            for x, y in zip(col("va"), col("vb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([col("a"), col("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("rep").alias("a"), F.col("values").alias("va"))
    two = sets.select(F.col("rep").alias("b"), F.col("values").alias("vb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The documents (rep, doc, signature) of the pairs."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    return sketches.select("rep", "doc", "signature").join(ids, "rep")


def _fitting(pairs_na: str, pairs_nb: str, threshold: int):
    """Set sizes that allow a similarity at the threshold."""
    return F.least(pairs_na, pairs_nb) * 100 >= F.greatest(pairs_na, pairs_nb) * threshold


def _tiles(entries: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between components among the documents of each family: a forest for each pair of blocks.

    ``entries`` has family, rep, n, root, each document once.
    """
    # a family's largest group, whose documents are joined already: its blocks follow the others' and skip each other
    groups = entries.groupBy("family", "root").agg(F.count("*").alias("size"))
    sizes = groups.groupBy("family").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("inner"), F.sum("size").alias("all"))
    blocks = lambda n: F.ceil(n / TILE).cast("int")
    sizes = sizes.where(F.col("all") > F.col("inner")).select("family", "main", blocks(F.col("all") - F.col("inner")).alias("n_outer"), blocks(F.col("inner")).alias("n_inner"))
    members = entries.join(sizes, "family")
    outer, hashed = F.col("root") != F.col("main"), F.xxhash64("rep")
    members = members.withColumn("block", F.when(outer, F.pmod(hashed, F.col("n_outer"))).otherwise(F.col("n_outer") + F.pmod(hashed, F.col("n_inner"))).cast("int"))
    with_set = members.join(sets, "rep")
    last = F.col("n_outer") + F.when(outer, F.col("n_inner")).otherwise(0) - 1
    tiled = with_set.select("family", "rep", "root", "values", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    tiled = tiled.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "root", "values", "block")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        rep, root, block = (table.column(c).to_numpy() for c in ("rep", "root", "block"))
        sets_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("values")]
        low, high = key[1].as_py(), key[2].as_py()
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        if not len(first) or not len(second):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        _, ids = np.unique(np.concatenate(sets_), return_inverse=True)
        length = np.array([len(s) for s in sets_])
        begin = np.cumsum(length) - length
        flat = np.concatenate([ids[begin[k] : begin[k] + length[k]] for k in second])
        at = np.cumsum(length[second]) - length[second]
        mark = np.zeros(int(ids.max()) + 1, np.int32)
        _, group = np.unique(root, return_inverse=True)
        up = list(range(int(group.max()) + 1))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out: list[tuple[int, int]] = []
        for k in first.tolist():
            own = ids[begin[k] : begin[k] + length[k]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat], at)
            mark[own] = 0
            hit = 100 * common >= threshold * (length[k] + length[second] - common)
            for j in second[hit & (root[second] != root[k])].tolist():
                x, y = top(int(group[k])), top(int(group[j]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((int(rep[k]), int(rep[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return tiled.groupBy("family", "low", "high").applyInArrow(compare, "a long, b long")


def grouped(documents: DataFrame, width: int = 5, lower: bool = True, threshold: int = THRESHOLD) -> DataFrame:
    """For every document row doc_id, mark, n_shingles, root and component_id.

    Within these, documents of equal sets have one number (``rep``), given once; ``root`` is the
    number of the group, null where there are no words or there is no doc_id.
    """
    spark = documents.sparkSession
    held: list[Broadcast] = []
    sketched, _ = shared.at_path(sketch_table(documents, width, lower), "sketches")
    usable = sketched.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # step 1: one document for each set
    alike = usable.groupBy("signature").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("x"))
    reps, _ = shared.at_path(alike.select(F.monotonically_increasing_id().alias("rep"), F.col("x.doc_id").alias("doc"), F.col("x.n_shingles").alias("n"), "signature", F.col("x.sketch").alias("sketch")), "sets")
    # step 2: lists of two entries at least
    entries = postings(reps, threshold, held)
    lists = entries.groupBy("value").agg(F.count("*").alias("length"), F.min(F.struct("rep", "n")).alias("pivot")).where("length > 1")
    entries, entries_path = shared.at_path(entries.join(lists, "value").select("value", "rep", "n", "length", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "lists")
    listed, listed_path = shared.at_path(_among(reps, entries.select("rep").distinct(), held), "listed")
    # step 3: each list's least document against the others
    stars = entries.where((F.col("rep") != F.col("pivot")) & _fitting("n", "pivot_n", threshold)).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    stars, stars_path = shared.at_path(_estimated(stars, listed, threshold), "pairs")
    sets, sets_path = shared.at_path(whole_sets(documents, _ends(stars, listed), width, lower, held), "sets")
    links, links_path = shared.at_path(_confirmed(stars, sets, threshold), "links")
    for path in (stars_path, sets_path):
        shared.remove(spark, path)
    roots = graph.components(links)
    # step 4: what no link joins
    rooted = entries.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", "n", "length", F.coalesce("root", "rep").alias("root"))
    mixed = rooted.groupBy("value").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("value")
    rooted, rooted_path = shared.at_path(rooted.join(mixed, "value"), "mixed")
    cold = rooted.where(F.col("length") <= COLD)
    left = cold.select("value", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    right = cold.select("value", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs = left.join(right, "value").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _fitting("na", "nb", threshold)).select("a", "b").distinct()
    pairs, pairs_path = shared.at_path(_estimated(pairs, listed, threshold), "pairs")
    hot = rooted.where(F.col("length") > COLD)
    families = graph.components(hot.select("rep", (-2 - F.col("value").cast("long") - F.lit(1 << 32)).alias("list")), "rep", "list")
    in_family = hot.select("rep", "n", "root").distinct().join(families.select(F.col("node").alias("rep"), F.col("root").alias("family")), "rep")
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(in_family.select("rep")).distinct()
    wanted = listed.select("rep", "doc", "signature").join(ids, "rep")
    sets, sets_path = shared.at_path(whole_sets(documents, wanted, width, lower, held), "sets")
    more, more_path = shared.at_path(_confirmed(pairs, sets, threshold).unionByName(_tiles(in_family, sets, threshold)), "links")
    # a link between what links have joined before is one between their roots
    again = graph.components(_between_roots(more, roots))
    for path in (entries_path, listed_path, sets_path, links_path, rooted_path, pairs_path, more_path):
        shared.remove(spark, path)
    for table in held:
        table.destroy()
    joined = roots.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "root").alias("root"))
    numbered = reps.select("signature", "rep", "doc").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("signature", "doc", F.coalesce("root", "rep").alias("root"))
    least = numbered.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("sets")).where("sets > 1").select("root", "component_id")
    numbered = numbered.join(least, "root", "left").select("signature", "root", F.coalesce("component_id", "doc").alias("component_id"))
    found = usable.select("doc_id", "mark", "signature", "n_shingles").join(numbered, "signature").select("doc_id", "mark", "n_shingles", "root", "component_id")
    bare = sketched.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    return found.unionByName(bare.select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id")))


def _between_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The links (a, b) with both ends replaced by their roots."""
    for end, other in (("a", "b"), ("b", "a")):
        at = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        links = links.join(at, F.col(end) == F.col("_node"), "left").select(F.coalesce("_root", end).alias(end), other)
    return links


def near_duplicates(documents: DataFrame, width: int = 5, lower: bool = True, threshold: int = THRESHOLD) -> DataFrame:
    """For every document row doc_id, n_shingles, component_id, kept; see the module's text."""
    found = grouped(documents, width, lower, threshold)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without their near duplicates: of each group one row of its least doc_id stays.

    Where several texts of a group share that doc_id, the one of the least hash stays; of rows
    equal in doc_id and text, the one whose other columns come first. Rows without words or
    without a doc_id all stay.
    """
    names = documents.columns
    found = grouped(documents, width, threshold=threshold).where(F.col("root").isNotNull())
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select(F.col("x.doc_id").alias("_doc"), F.col("x.mark").alias("_mark"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    rows = documents.where(has_words).select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_mark"), F.struct(*names).alias("_row"))
    once = rows.join(kept, ["_doc", "_mark"]).groupBy("_doc", "_mark").agg(F.min("_row").alias("_row"))
    return once.select(*(F.col(f"_row.`{c}`").alias(c) for c in names)).unionByName(documents.where(~has_words))
