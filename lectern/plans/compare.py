"""Queries that compare texts and vectors, edit texts, and run as streams or by name."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import analysis, compare, edits, extraction, ledger, library, redaction, retrieval, skills
from lectern.plans import search, tables
from lectern.plans.search import HASHED
from lectern.plans.tables import LEDGER, QUESTION, table
from lectern.sources import folders
from lectern.streaming import audit

# ---- differences ---------------------------------------------------------------------------

#: Limits of the query ``word_diff``, which its SQL has too.
MOST_EDITS, MOST_WORDS = 1200, 20_000


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words with their numbers, and the same with every tenth one replaced; each fifteenth document is left as it is."""
    words = F.transform(T.words(F.col("text")), lambda w, i: F.concat(w, F.lit("_"), i.cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(words)).alias("w"))
    new = F.transform("w", lambda w, i: F.when((i % 10 == 3) & (F.col("doc_id") % 15 != 0), F.concat(F.lit("#edit"), i.cast("string"))).otherwise(w))
    return rows.select(F.col("doc_id").cast("string").alias("pair_id"), F.array_join("w", " ").alias("old"), F.array_join(new, " ").alias("new"))


def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that differ between each document and its edited text; too many edits give none."""
    found = compare.word_diff(_pairs(spark, sf_dir), MOST_EDITS, MOST_WORDS)
    return found.select("pair_id", "equal", "inserted", "deleted", "useful", F.size("changes").cast("long").alias("changes"))


def change_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many changes each window of 50 words holds, and the first of them; every document is compared whole."""
    changes = compare.word_diff(_pairs(spark, sf_dir)).select("pair_id", F.explode("changes").alias("c")).select("pair_id", F.col("c.at").alias("at"))
    # numbers behind the words don't change how many there are
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pair_id"), F.explode(F.array(F.size(T.words(F.col("text"))))).alias("n"))
    chunks = words.select("pair_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 50))).alias("chunk"))
    chunks = chunks.select("pair_id", "chunk", (F.col("chunk") * 50).alias("first"), (F.col("chunk") * 50 + 50).alias("last"))
    return compare.change_sources(changes, chunks).groupBy("pair_id", "chunk").agg(F.count("*").alias("changes"), F.min("at").cast("long").alias("first_at"))


def compare_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against their edited turns, as they are with their repeated words: some alike, some with new words, some with no word left; every pair is compared whole."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    words = F.transform(T.words(F.col("text")), lambda w, i: F.when((F.col("conv_id") % 3 == 2) | ((F.col("conv_id") % 3 == 1) & (i % 9 == 4)), F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit("-"), i.cast("string"))).otherwise(w))
    chunk = lambda side: F.concat(F.col("conv_id").cast("string"), F.lit(side), F.col("turn").cast("string")).alias("chunk_id")
    old = turns.select((F.col("conv_id") * 2).alias("doc_id"), chunk("a"), F.col("turn").alias("chunk_index"), "text")
    new = turns.select((F.col("conv_id") * 2 + 1).alias("doc_id"), chunk("b"), F.col("turn").alias("chunk_index"), F.array_join(words, " ").alias("text"))
    pairs = turns.select(F.col("conv_id").alias("pair_id"), (F.col("conv_id") * 2).alias("a"), (F.col("conv_id") * 2 + 1).alias("b")).distinct()
    found = compare.difference_read(pairs, old.unionByName(new), 100_000)
    return found.select("pair_id", "identical", F.col("added").cast("long").alias("added"), F.col("removed").cast("long").alias("removed"), "chunks_total", F.size(F.filter("cited", lambda c: c["doc_id"] % 2 == 1)).cast("long").alias("cited_new"), (F.length("redline") > 0).alias("marked"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("pair_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return rows.where("id % 4 = 0"), rows.where("id % 4 <> 0")


def nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label, the three nearest vectors of one side for each of the other."""
    return compare.nearest(*_sides(spark, sf_dir), 3).select("pair_id", "id", "other", "score", "rank")


def merged_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same side's vectors by their best score."""
    return compare.merged_candidates(compare.nearest(*_sides(spark, sf_dir), 3)).select("pair_id", "other", "score")


def align_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of orders and customers by a score, the best first."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("pair_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("p")).where("id % 5 = 0")
    c = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 10).alias("pair_id"), F.col("n_nationkey").alias("other"))
    scored = o.join(c, "pair_id").select("pair_id", "id", "other", F.round((F.col("id") * 7 + F.col("other") * 13) % 101 / 100, 2).alias("score"))
    return compare.aligned(scored)


def compare_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations read within one budget."""
    chunks = tables.chunks(spark, sf_dir).select("doc_id", F.col("page").alias("chunk_index"), "token_count")
    ids = chunks.select("doc_id").distinct()
    pairs = ids.where("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("long").alias("pair_id"), F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return retrieval.whole_pair(chunks, pairs, 300)


# ---- vectors -------------------------------------------------------------------------------


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as bytes and read back; a wrong length gives none."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", retrieval.encoded(F.col("embedding")).alias("data"), (F.size("embedding") + F.when(F.col("vec_id") % 9 == 0, 1).otherwise(0)).alias("n"))
    back = rows.select("vec_id", F.explode(F.array(retrieval.decoded(F.col("data"), F.col("n")))).alias("v"), F.length("data").cast("long").alias("n_chars"))
    return back.select("vec_id", "n_chars", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations nearest to a question by their first turn, as summary nodes."""
    nodes = table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("node_id"), "text")
    return retrieval.node_search(nodes, QUESTION, 10)


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: the best vectors in the order of a second score that some of them have."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    first = [float(x) for x in vectors.orderBy("chunk_id").limit(1).collect()[0].embedding]
    hits = retrieval.ranked(retrieval.similar(vectors, first), 12)
    second = vectors.where("chunk_id % 2 = 0").select("chunk_id", (F.col("chunk_id") % 7 / F.lit(10)).alias("second"))
    return retrieval.reranked(hits, second).select("chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a question by a stored index."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.top(retrieval.Index.build(docs, folders.new_path(spark, "index")).scores(QUESTION), 20)


# ---- edits ---------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown around each turn: a heading, text, a list with a child, a quote, a table, a fence with what looks like others."""
    flat = F.regexp_replace("text", r"\s+", " ")
    text = F.concat(F.lit("# Title\n"), flat, F.lit("\nsecond line\n- one\n  more\n- two\n\n> quote\n> on\n| a | b |\n| c | d |\n```\n# no\n- no\n```\n| lone\nend\n"), F.when(F.col("turn") % 2 == 0, "~~~\nopen").otherwise("1) last"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), text.alias("text"))


def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of answers."""
    return edits.answer_blocks(_answers(spark, sf_dir)).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "kind", "block_key")


def verified_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that hold, and those that are dropped."""
    docs = _answers(spark, sf_dir)
    wanted = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("number"), F.lit(find).alias("find"), F.lit(line).cast("int").alias("line"), F.lit(nth).cast("int").alias("nth"), F.lit(new).alias("replacement")) for n, (find, line, nth, new) in enumerate((("second line", None, None, "2nd line"), ("- no", None, 1, "+ yes"), ("nowhere at all", None, None, "x"), ("second", None, None, "overlaps"), ("| a | b |", 10, 1, "| A | B |"), ("| c | d |", 3, 1, "lost")))))).alias("e")).select("doc_id", "e.*")
    made = edits.edited(docs, wanted)
    return made.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("applied").cast("long").alias("applied"), F.col("dropped").cast("long").alias("dropped"))


def kept_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are the same but for white space after a rewrite."""
    new = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.regexp_replace("text", r"\s+", "\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", edits.keeps_text(F.col("text"), new).alias("kept"))


def summary_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of summary trees by level; a conversation's turns are its leaves."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.lit("word word word word").alias("text"))
    return analysis.tree(chunks, 10, 4).groupBy("doc_id", "level").agg(F.count("*").alias("nodes"), F.sum(F.size("children")).cast("long").alias("children"))


# ---- streams and tools ---------------------------------------------------------------------


def audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: the log that a stream of events leaves."""
    path = folders.new_path(spark, "audit")
    audit.bounded_log(audit.table_stream(spark, f"{sf_dir}/events.parquet"), path, 500, 50).awaitTermination()
    return audit.latest_version(spark, f"{path}/log").select("event_id", "event_type")


def _reply(text: str, attempt: int) -> str:
    """A stand-in for a model: prose around an array, cut at the first attempt for some texts and at both for others, or no array at all."""
    whole = "Here it is: " + json.dumps([{"type": "Party ", "value": f" {text[:3]} "}, {"type": "?", "value": str(len(text))}, {"type": "date", "value": " "}])
    kind = len(text) % 4
    if kind == 0 or (kind == 1 and attempt == 2):
        return f"```json\n{whole}\n```"
    return whole[: whole.index('"?"') + 3] if kind < 3 else "no array"


def extraction_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, R16, R17: markers and records of a stream of chunks; each chunk has its own, equal texts too."""
    path = folders.new_path(spark, "extraction")
    rows = audit.table_stream(spark, f"{sf_dir}/conversations.parquet", batch_bytes=audit.BATCH_BYTES).select("arrived", (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.when(F.col("turn") == 0, F.left("text", F.lit(5))).otherwise(F.col("text")).alias("text"))
    for _ in range(2):  # the second run finds nothing new
        audit.extracted(rows, path, _reply, "m1").awaitTermination()
    found = extraction.current(spark.read.parquet(f"{path}/records"))
    return found.groupBy("doc_id", "record_type", "normalized").agg(F.count("*").alias("n"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in event time, by a stream that runs until its input is used up."""
    path = folders.new_path(spark, "hourly")
    counts = audit.windowed_counts(audit.table_stream(spark, f"{sf_dir}/events.parquet"), "0 seconds", "1 day")
    audit.changes(counts, path).awaitTermination()
    return audit.settled(spark, path, ["start", "event_type"], "events").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def registry() -> skills.Registry:
    """The built-in tools over documents and ledgers."""
    known = skills.Registry()
    known.add(skills.Tool("count_selected_documents", lambda rows: rows.agg(F.count("*").alias("documents")), ("doc_id",), "documents long"))
    known.add(skills.Tool("summarize_cashflow", ledger.cashflow, ("statement", "cents", "currency"), "statement long, inflow long, outflow long, net long"))
    known.add(skills.Tool("categorize_transactions", lambda rows: rows.withColumn("category", ledger.category(F.col("description"), F.col("cents"))), ("statement", "pos", "description", "cents"), "statement long, pos int, category string"))
    known.add(skills.Tool("redact_documents", redaction.redacted, ("doc_id", "text"), "doc_id long, text string", exports=True))
    return known


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14: three tools run by name."""
    tools = registry()
    rows = tables.ledger(spark, sf_dir)
    counted = tools.run(spark, "count_selected_documents", table(spark, sf_dir, "documents")).select(F.lit("documents").alias("what"), F.col("documents").alias("n"))
    net = tools.run(spark, "summarize_cashflow", rows).agg(F.sum("net").alias("n")).select(F.lit("net").alias("what"), "n")
    kinds = tools.run(spark, "categorize_transactions", rows).groupBy("category").agg(F.count("*").alias("n")).select(F.col("category").alias("what"), "n")
    return counted.unionByName(net).unionByName(kinds)


def kept_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: rows left in a document's tables when some documents are deleted."""
    docs = table(spark, sf_dir, "documents")
    left = library.without({"labels": table(spark, sf_dir, "labels").select("doc_id"), "chunks": tables.chunks(spark, sf_dir).select("doc_id")}, docs.where("doc_id % 3 = 0"))
    made = None
    for name, rows in left.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        made = one if made is None else made.unionByName(one)
    return made


def segment_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring segments of one label joined; a conversation's turns are its segments."""
    from lectern.operators import chunking

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text", F.floor(F.col("turn") / 3).alias("label"), F.lit(None).cast("int").alias("page"))
    return chunking.coalesced(rows).select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


QUERIES = {f.__name__: f for f in (word_diff, change_chunks, compare_differences, nearest_neighbors, merged_neighbors, align_nodes, compare_chunks, stored_vectors, node_vectors, reranked_hits, keyword_index, answer_blocks, verified_edits, kept_text, summary_tree, audit_stream, extraction_stream, hourly_events, tool_runs, kept_derivatives, segment_chunks)}

_N = r"len(regexp_extract_all(text, '[^\t\n\v\f\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+'))"
_DIFF = f"""d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS pair_id, {_N} AS n, CASE WHEN doc_id % 15 = 0 THEN 0 ELSE (n + 6) // 10 END AS k FROM documents)"""
_COS = "round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 6)"
_NEAR = f"near AS (SELECT a.label AS pair_id, a.vec_id AS id, b.vec_id AS other, {_COS} AS score, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0)"
_TEXT = r"""answers AS (SELECT conv_id * 100 + turn AS doc_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS flat FROM conversations)"""
_BLOCKS = ("heading", "# Title"), ("paragraph", None), ("list_item", "- one\n  more"), ("list_item", "- two"), ("blockquote", "> quote\n> on"), ("table", "| a | b |\n| c | d |"), ("fence", "```\n# no\n- no\n```"), ("paragraph", "| lone"), ("paragraph", "end"), (None, None)
_kind = lambda i, k: f"'{k}'" if k else "CASE WHEN turn % 2 = 0 THEN 'fence' ELSE 'list_item' END"
_body = lambda i, t: "'" + t.replace("\n", "' || chr(10) || '") + "'" if t else ("flat || chr(10) || 'second line'" if i == 1 else "CASE WHEN turn % 2 = 0 THEN '~~~' || chr(10) || 'open' ELSE '1) last' END")

ORACLE_SQL = {
    "word_diff": f"WITH {_DIFF} SELECT pair_id, CASE WHEN n <= 20000 AND 2 * k <= 1200 THEN CAST(n - k AS INTEGER) END AS equal, CASE WHEN n <= 20000 AND 2 * k <= 1200 THEN CAST(k AS INTEGER) END AS inserted, CASE WHEN n <= 20000 AND 2 * k <= 1200 THEN CAST(k AS INTEGER) END AS deleted, n <= 20000 AND 2 * k <= 1200 AND (k = 0 OR (n > k AND 2 * k / (n + k) <= 0.5)) AS useful, CASE WHEN n <= 20000 AND 2 * k <= 1200 THEN k ELSE 0 END AS changes FROM d",
    "change_chunks": f"WITH {_DIFF}, c AS (SELECT pair_id, unnest(range(k)) * 10 + 3 AS place FROM d) SELECT pair_id, place // 50 AS chunk, count(*) AS changes, min(place) AS first_at FROM c GROUP BY ALL",
    "compare_differences": f"""WITH t AS (SELECT conv_id, turn, {_N} AS n, CASE conv_id % 3 WHEN 1 THEN ({_N} + 4) // 9 WHEN 2 THEN {_N} ELSE 0 END AS k FROM conversations)
      SELECT conv_id AS pair_id, sum(k) = 0 AS identical, CAST(sum(k) AS BIGINT) AS added, CAST(sum(k) AS BIGINT) AS removed, 2 * count(*) AS chunks_total, CASE WHEN sum(k) = 0 THEN 1 ELSE count(*) FILTER (k > 0) END AS cited_new, sum(k) > 0 AS marked FROM t GROUP BY conv_id""",
    "nearest_neighbors": f"WITH {_NEAR} SELECT CAST(pair_id AS INTEGER) AS pair_id, id, other, score, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 3",
    "merged_neighbors": f"WITH {_NEAR} SELECT pair_id, other, max(score) AS score FROM near WHERE rank <= 3 GROUP BY ALL",
    "align_nodes": """WITH RECURSIVE s AS (SELECT o_custkey % 10 AS pair_id, o_orderkey AS id, n_nationkey AS other, round((o_orderkey * 7 + n_nationkey * 13) % 101 / 100, 2) AS score FROM orders JOIN nation ON n_nationkey % 10 = o_custkey % 10 WHERE o_orderkey % 5 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, least(id, other), greatest(id, other), id) AS n FROM s WHERE score >= 0.5),
      m AS (SELECT pair_id, 0 AS n, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS others FROM (SELECT DISTINCT pair_id FROM r) UNION ALL
        SELECT r.pair_id, r.n, list_append(m.ids, r.id), list_append(m.others, r.other) FROM m JOIN r ON r.pair_id = m.pair_id AND r.n > m.n AND NOT list_contains(m.ids, r.id) AND NOT list_contains(m.others, r.other)
          QUALIFY row_number() OVER (PARTITION BY r.pair_id ORDER BY r.n) = 1)
      SELECT m.pair_id, r.id, CAST(r.other AS INTEGER) AS other, r.score FROM m JOIN r ON r.pair_id = m.pair_id AND r.n = m.n""",
    "compare_chunks": f"""WITH {tables.CHUNKS}, c AS (SELECT doc_id, page, token_count, CAST(ceil(token_count * 1.3::DOUBLE) AS BIGINT) AS cost FROM chunks), s AS (SELECT doc_id, CAST(sum(cost) AS BIGINT) AS total FROM c GROUP BY doc_id),
      p AS (SELECT x.doc_id // 2 AS pair_id, x.doc_id AS a, y.doc_id AS b, x.total AS ta, y.total AS tb, least(x.total, 150) AS fa, least(y.total, 150) AS fb FROM s x JOIN s y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 2 = 0), m AS (SELECT *, least(ta - fa, 300 - fa - fb) AS ma FROM p),
      q AS (SELECT pair_id, 0 AS side, a AS doc_id, greatest(1, fa + ma) AS share FROM m UNION ALL SELECT pair_id, 1, b, greatest(1, fb + least(tb - fb, 300 - fa - fb - ma)) FROM m),
      r AS (SELECT q.*, page AS chunk_index, row_number() OVER (PARTITION BY pair_id, side ORDER BY page) AS n, sum(cost) OVER (PARTITION BY pair_id, side ORDER BY page) AS spent FROM q JOIN c USING (doc_id))
      SELECT pair_id, side, doc_id, chunk_index, 'S' || row_number() OVER (PARTITION BY pair_id ORDER BY side, chunk_index) AS label FROM r WHERE n = 1 OR spent <= share""",
    "stored_vectors": "SELECT vec_id, CAST(4 * ceil(len(embedding) * 4 / 3.0) AS BIGINT) AS n_chars, CASE WHEN vec_id % 9 <> 0 THEN round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 6) END AS total FROM embeddings",
    "node_vectors": f"WITH chunks AS (SELECT conv_id AS chunk_id, text FROM conversations WHERE turn = 0), {HASHED} SELECT chunk_id AS node_id, score FROM hashed ORDER BY score DESC, chunk_id LIMIT 10",
    "keyword_index": search.ORACLE_SQL["keyword_search"],
    "reranked_hits": """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), h AS (SELECT vec_id AS chunk_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, q ORDER BY score DESC, chunk_id LIMIT 12),
      r AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, CASE WHEN chunk_id % 2 = 0 THEN chunk_id % 7 / 10 END AS second FROM h) SELECT chunk_id, coalesce(second, score) AS score, row_number() OVER (ORDER BY second DESC NULLS LAST, rank) AS rank FROM r""",
    "answer_blocks": f"WITH {_TEXT} " + " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS ordinal, {_kind(i, k)} AS kind, 'b{i}-' || {_kind(i, k)} || '-' || left(sha256({_body(i, t)}), 12) AS block_key FROM answers" for i, (k, t) in enumerate(_BLOCKS)),
    "verified_edits": f"""WITH {_TEXT} SELECT doc_id, md5(replace('# Title~', '~', chr(10)) || flat || replace('~2nd line~- one~  more~- two~~> quote~> on~| A | B |~| c | d |~```~# no~+ yes~```~| lone~end~', '~', chr(10)) || CASE WHEN turn % 2 = 0 THEN '~~~' || chr(10) || 'open' ELSE '1) last' END) AS text_md5, CAST(3 AS BIGINT) AS applied, CAST(3 AS BIGINT) AS dropped FROM answers""",
    "kept_text": r"SELECT doc_id, doc_id % 3 <> 0 AS kept FROM documents",
    "summary_tree": """WITH RECURSIVE n AS (SELECT conv_id AS doc_id, count(*) AS turns FROM conversations GROUP BY conv_id), l AS (SELECT doc_id, 1 AS level, CAST(ceil(turns / 2) AS BIGINT) AS nodes, turns AS children FROM n UNION ALL SELECT doc_id, level + 1, CAST(ceil(nodes / 2) AS BIGINT), nodes FROM l WHERE nodes > 1) SELECT doc_id, level, nodes, children FROM l""",
    "audit_stream": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT CASE WHEN (SELECT count(*) FROM events) > 550 THEN 500 ELSE 550 END",
    "extraction_stream": r"""WITH t AS (SELECT conv_id AS doc_id, CASE WHEN turn = 0 THEN left(text, 5) ELSE text END AS text FROM conversations), k AS (SELECT doc_id, text, length(text) % 4 AS k FROM t WHERE regexp_matches(text, '\S')),
      r AS (SELECT doc_id, '__scan__' AS record_type, CASE WHEN k = 3 THEN 'unparsed' ELSE 'ok' END AS normalized FROM k
        UNION ALL SELECT doc_id, 'party', trim(regexp_replace(lower(left(text, 3)), '\s+', ' ', 'g')) FROM k WHERE k < 3 AND regexp_matches(left(text, 3), '\S') UNION ALL SELECT doc_id, 'generic', CAST(length(text) AS VARCHAR) FROM k WHERE k < 2)
      SELECT doc_id, record_type, normalized, count(*) AS n FROM r GROUP BY ALL""",
    "hourly_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL",
    "tool_runs": f"WITH {LEDGER} SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'net', CAST(sum(cents) AS BIGINT) FROM ledger UNION ALL SELECT CASE WHEN cents > 0 THEN 'Income' WHEN cents < 0 THEN 'Spending' ELSE 'Uncategorized' END, count(*) FROM ledger GROUP BY 1",
    "kept_derivatives": "SELECT 'labels' AS table_name, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT 'chunks', count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)",
    "segment_chunks": "SELECT conv_id AS doc_id, CAST(min(turn) AS BIGINT) AS seq, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id, turn // 3",
}
