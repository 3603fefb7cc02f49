"""Prefix tries of conversations that share their first turns.

A turn is its digest and its text's bytes; texts themselves are never moved. Conversations with
equal turns are one sequence with a weight. Sequences are dealt out by the digest of their first
turn, and each bucket of first turns builds its dictionary tries inside ``applyInPandas``: a node
points to its children by their turns' digests, and sums over subtrees follow in one pass from
children to parents, without recursion. A first turn whose sequences have more turns than an even
share of one task is oversized: it becomes a node by grouped sums, and its sequences are dealt out
anew by their next turn, again and again where need be. Sums over the nodes above come from all
tries below by their paths of keys. One sequence that is oversized all by itself is a chain of
nodes, for which no trie is needed.

Places of turns come from ranges of (conversation, turn), so one long conversation is many tasks'
work; what range borders cut apart is counted in at most one row for each range.

Defined results: turns of a conversation are ordered by turn (null first), equal ones by role and
text (by their digest); a repeated row is a turn of its own. Null role or text is empty. Rows
without a conv_id belong to no conversation and are left out. For ids below zero the remainders
have the sign of the id, as in SQL. An empty table gives the root alone, without a conv_id and
members. Other columns are ignored. The list of one node's ends is hashed in order, hence by one
task, from parts that other tasks have joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import ordering, shared

#: Ids of one family share their first turns: those of its first conversation, up to ``SHARED`` turns.
FAMILY = 5
SHARED = 9
#: Turns of a bucket that one task builds tries of: an even share of all, within these bounds.
LEAST, MOST = 256, 50_000
#: Ids of a node's ends that are joined before they meet.
RUN = 4096
ROOT = "r"
_NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digest(*parts: Column) -> Column:
    """16 bytes that stand for all parts in their order."""
    return F.substring(F.unhex(F.sha2(F.concat(*[x.cast("binary") for x in parts]), 256)), 1, 16)


def turns(conversations: DataFrame) -> DataFrame:
    """Conversation, turn, digest of role and text, and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest(F.octet_length(role).cast("string"), F.lit(" "), role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )


def numbered(rows: DataFrame) -> DataFrame:
    """The turns with their place ``k`` in their conversation, from 1."""
    order = ["turn", "digest"]
    ranged = rows.repartitionByRange(ordering.partitions(rows), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")).withColumn("part", F.spark_partition_id())
    placed, path = shared.at_path(ranged.withColumn("k", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), *order[1:])).cast("long")), "places")
    counts = placed.groupBy("conv_id", "part").agg(F.max("k").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0")
    both = placed.join(F.broadcast(before.drop("n")), ["conv_id", "part"], "left")  # at most one row for each range
    out, _ = shared.at_path(both.select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "digest", "bytes"), "numbered")
    shared.remove(rows.sparkSession, path)
    return out


def rebuilt(numbers: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: ``conv_id, pos, digest, bytes``, and a row of place 0 for each conversation."""
    convs = numbers.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    firsts = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(firsts, "base", "left").select("conv_id", "base", "h", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).alias("given"))
    own = numbers.join(convs, "conv_id").where("k > h").select("conv_id", (F.col("given") + F.col("k") - F.col("h")).alias("pos"), "digest", "bytes")
    lent = numbers.where((F.col("conv_id") % FAMILY == 0) & (F.col("k") < SHARED)).withColumnRenamed("conv_id", "base")
    given = lent.join(convs, "base").where("k <= h").select("conv_id", F.col("k").alias("pos"), "digest", "bytes")
    return own.unionByName(given).unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes")))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's runs, which come one after another; memory holds one run."""
    now, state = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch({"rep": pa.array([now], pa.int64()), "ends": pa.array([state.hexdigest()])})

    for batch in batches:
        for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rep != now:
                if state is not None:
                    yield done()
                now, state = rep, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if state is not None:
        yield done()


def sequences(rows: DataFrame) -> DataFrame:
    """Distinct sequences of turns: ``rep`` (least conversation), ``n`` turns, ``weight`` conversations, ``ends`` (hash of their ids)."""
    spark = rows.sparkSession
    place = F.xxhash64("pos", "digest"), F.xxhash64(F.lit(7), "digest", "pos")
    convs, path = shared.at_path(rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.bit_xor(place[0]).alias("s1"), F.bit_xor(place[1]).alias("s2")), "signatures")
    same = ["n", "s1", "s2"]
    groups = convs.groupBy(same).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"))
    runs = convs.join(groups.where("weight > 1"), same).groupBy("rep", F.floor(F.col("conv_id") / RUN).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = runs.repartition("rep").sortWithinPartitions("rep", "run").select("rep", "ids").mapInArrow(_joined_ids, "rep long, ends string")
    out = groups.join(ends, "rep", "left").select("rep", "n", "weight", F.coalesce("ends", F.sha2(F.col("rep").cast("string").cast("binary"), 256)).alias("ends"))
    found, _ = shared.at_path(out, "sequences")
    shared.remove(spark, path)
    return found


def tries(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of all tries of one bucket, with the path above a trie's top node.

    ``rows``: a turn each of a sequence, from the place ``depth`` on at which its trie begins.
    """
    rows = rows.sort_values(["key", "rep", "pos"], kind="stable")
    children: list[dict[bytes, int]] = []
    conv, depth, above, weight, size, ends, path, parent = [], [], [], [], [], [], [], []
    now_key, now_rep, at, top = None, None, -1, {}
    for r in rows.itertuples(index=False):
        if r.key != now_key:
            now_key, now_rep, top = r.key, None, {}
        if r.rep != now_rep:
            now_rep, at = r.rep, -1
        points = top if at < 0 else children[at]
        node = points.get(r.digest)
        if node is None:
            node = points[r.digest] = len(children)
            children.append({})
            conv.append(r.rep)
            depth.append(r.pos)
            above.append(at)
            weight.append(0)
            size.append(r.bytes)
            ends.append(_NO_ENDS)
            path.append(r.path if at < 0 else None)
            parent.append(r.parent if at < 0 else conv[at])
        weight[node] += r.weight
        if r.pos == r.n:
            ends[node] = r.ends
        at = node
    leaves = [0 if c else 1 for c in children]
    saved = [(w - 1) * b for w, b in zip(weight, size, strict=True)]
    for node in range(len(children) - 1, -1, -1):  # a child is made after its parent, so this meets children first
        if above[node] >= 0:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    return pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": parent, "n_convs": weight, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "path": path})


def prefix_nodes(conversations: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    spark = conversations.sparkSession
    old: list[str] = []

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame, path = shared.at_path(frame, name)
        old.append(path)
        return frame

    all_rows = kept(rebuilt(numbered(kept(turns(conversations), "turns"))), "rebuilt")
    reps = sequences(all_rows)
    rows = kept(all_rows.where("pos > 0").withColumnRenamed("conv_id", "rep").join(reps, "rep").drop("n", "weight", "ends"), "rows")
    total, convs, first = reps.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0)), F.min("rep")).first()
    share = max(least, min(most, int(total) // ordering.partitions(rows)))

    heads = rows.where("pos = 1").select("rep", _digest(F.lit("1"), F.col("digest")).alias("key"), "bytes")
    open_now = reps.join(heads, "rep").select("rep", "n", "weight", "ends", F.hex("key").alias("key"), "bytes", F.lit(ROOT).alias("path"), F.lit(first).cast("long").alias("parent"), F.lit(1).cast("long").alias("depth"))
    levels = []
    while True:
        groups = open_now.groupBy("key").agg(F.sum(F.col("n") - F.col("depth") + 1).alias("size"), F.count("*").alias("several"), F.min("rep").alias("top"))
        kind = F.when(F.col("size") <= share, "trie").when(F.col("several") == 1, "chain").otherwise("split")
        levels.append(kept(open_now.join(groups, "key").withColumn("kind", kind).drop("size", "several"), "level"))
        going = levels[-1].where("kind = 'split' AND n > depth").drop("bytes")
        if going.isEmpty():
            break
        nexts = rows.where(F.col("pos") == len(levels) + 1).select("rep", "digest", "bytes")
        open_now = going.join(nexts, "rep").select(
            "rep", "n", "weight", "ends", F.hex(_digest(F.col("key"), F.col("digest"))).alias("key"), "bytes", F.concat_ws("/", "path", "key").alias("path"), F.col("top").alias("parent"), (F.col("depth") + 1).alias("depth")
        )
    dealt = levels[0]
    for level in levels[1:]:
        dealt = dealt.unionByName(level)

    buckets = max(1, int(total) // share) * 2
    small = dealt.where("kind = 'trie'").drop("bytes").join(rows, "rep").where("pos >= depth")
    small = small.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "path", "parent", "rep", "n", "weight", "ends", "pos", "digest", "bytes")
    built = small.groupBy("bucket").applyInPandas(tries, f"{NODES}, path string")

    alone = dealt.where("kind = 'chain'").drop("bytes").join(rows, "rep").where("pos >= depth")
    later = Window.partitionBy("rep").orderBy(F.col("pos").desc())
    chains = alone.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("weight").alias("n_convs"), F.when(F.col("pos") < F.col("n"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.sum((F.col("weight") - 1) * F.col("bytes")).over(later).alias("saved_tokens"), F.when(F.col("pos") == F.col("n"), F.col("ends")).otherwise(_NO_ENDS).alias("ends_sha256"), F.when(F.col("pos") == F.col("depth"), F.col("path")).alias("path")
    )
    below = kept(built.unionByName(chains), "tries")

    split = dealt.where("kind = 'split'").groupBy("key", "path", "depth", "parent").agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("bytes").alias("bytes"), F.max(F.when(F.col("n") == F.col("depth"), F.col("ends"))).alias("ends")
    )
    root_ends = reps.where("n = 0").agg(F.max("ends").alias("ends"))
    root = root_ends.select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(first).cast("long").alias("conv_id"), F.lit(int(convs)).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes"), "ends")
    upper = split.unionByName(root).withColumn("own", F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("bytes"))
    tops = below.where("path IS NOT NULL").select(F.split("path", "/").alias("keys"), F.lit(1).alias("child"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    inner = upper.where("path IS NOT NULL").select(F.split("path", "/").alias("keys"), F.lit(1).alias("child"), F.lit(0).cast("long").alias("leaves"), F.col("own").alias("saved"))
    sums = tops.unionByName(inner).select(F.posexplode("keys").alias("at", "key"), "keys", "child", "leaves", "saved").groupBy("key").agg(
        F.sum(F.when(F.col("at") == F.size("keys") - 1, F.col("child")).otherwise(0)).cast("long").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved")
    )
    above = upper.join(sums, "key", "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")
    )
    out = shared.written(below.drop("path").unionByName(above), "nodes")
    for path in old:
        shared.remove(spark, path)
    return out
