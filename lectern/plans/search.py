"""Text, chunk and retrieval queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunking, retrieval
from lectern.plans import tables
from lectern.plans.tables import CHUNKS, QUESTION, table

#: Fixed values for SQL: the engine's white space and spaceless scripts in RE2's notation.
_WS = r"\t\n\v\f\r \x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_CJK = r"\x{0e00}-\x{0e7f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}"
_COST = f"(len(regexp_extract_all(text, '[{_CJK}]')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '[^{_WS}{_CJK}]+'), lambda w: CASE WHEN length(w) <= 16 THEN 1 ELSE CAST(ceil(length(w) / 4) AS BIGINT) END)), 0))"
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate tokens by language and source."""
    rows = table(spark, sf_dir, "documents").select("lang", "source", T.token_count(F.col("text")).alias("n"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("longest"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys and how many documents share them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


def message_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation titles and snippets from each first user message."""
    rows = tables.messages(spark, sf_dir).where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "seq").alias("text"))
    return rows.select("conv_id", T.title_of(F.col("text")).alias("title"), T.snippet(F.col("text"), 40).alias("snippet"))


def context_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt tokens by conversation."""
    rows = tables.messages(spark, sf_dir).select("conv_id", T.message_tokens(F.col("text")).alias("n"))
    return rows.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.count("*").alias("messages"))


def chunk_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all documents that count every word as one."""
    made = chunking.simple_chunks(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "chunk_index", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def chunk_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all documents."""
    made = chunking.chunks(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "chunk_index", "token_count", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _overlap(chunked: DataFrame) -> DataFrame:
    made = chunking.without_overlap(chunked)
    return made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("shared").cast("long").alias("shared_chars"), F.sum(F.ceil(T.token_count(F.col("text")) * 1.3)).cast("long").alias("prompt_tokens"))


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that each chunk repeats from the one before, and what is left, in windows that count every word as one."""
    return _overlap(chunking.simple_chunks(table(spark, sf_dir, "documents"), 100, 20))


def chunk_overlap_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in windows of tokens."""
    return _overlap(chunking.chunks(table(spark, sf_dir, "documents"), 100, 20))


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for a question by BM25."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.top(retrieval.bm25(docs, QUESTION), 20)


def keyword_search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within one source; statistics stay those of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = retrieval.bm25(docs.select(F.col("doc_id").alias("chunk_id"), "text"), QUESTION)
    scope = docs.where("source = 'src3'").select(F.col("doc_id").alias("chunk_id"))
    return retrieval.top(scored.join(scope, "chunk_id", "left_semi"), 20)


_BM25 = f"""
listed AS MATERIALIZED (SELECT chunk_id, {_TERMS} AS ts FROM base),
stats AS MATERIALIZED (SELECT count(*) AS n, avg(len(ts)) AS average FROM listed),
asked AS MATERIALIZED (SELECT term, count(*) AS times FROM (SELECT unnest(list_slice(regexp_extract_all(lower('{QUESTION}'), '[\\p{{L}}\\p{{N}}]+'), 1, 32)) AS term) GROUP BY term),
terms AS (SELECT chunk_id, len(ts) AS dl, unnest(list_filter(ts, lambda t: t IN ({', '.join(repr(t) for t in sorted(set(QUESTION.split())))}))) AS term FROM listed),
hits AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf, first(dl) AS dl FROM terms GROUP BY chunk_id, term),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm25 AS (SELECT chunk_id, round(sum(round(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average)), 9)), 6) AS score
  FROM hits JOIN dfs USING (term) JOIN asked USING (term), stats GROUP BY chunk_id)"""


def _question_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).collect()[0]
    return [float(x) for x in row.embedding]


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to the first one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.top(retrieval.similar(vectors, _question_vector(spark, sf_dir), most=25), 25)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for one label, above a floor."""
    vectors = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.top(retrieval.similar(vectors, _question_vector(spark, sf_dir), floor=0.0, most=25), 25)


def vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over fifty times as many vectors, each turned by 0 to 49 places."""
    turned = table(spark, sf_dir, "embeddings").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(49))))
    vectors = turned.select((F.col("vec_id") * 50 + F.col("k")).alias("chunk_id"), F.concat(F.slice("embedding", F.col("k") + 1, F.lit(64)), F.slice("embedding", F.lit(1), F.col("k"))).alias("embedding"))
    return retrieval.top(retrieval.similar(vectors, _question_vector(spark, sf_dir), most=25), 25)


_COSINE = """(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"""


def hash_embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks by hash embedding."""
    return retrieval.top(retrieval.hash_similar(tables.chunks(spark, sf_dir).select("chunk_id", "text"), QUESTION), 25)


HASHED = f"""
q AS (SELECT 0 AS chunk_id, '{QUESTION}' AS text),
both_texts AS (SELECT chunk_id, text, 0 AS side FROM chunks UNION ALL SELECT chunk_id, text, 1 FROM q),
ht AS (SELECT side, chunk_id, term, count(*) AS tf FROM (SELECT side, chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM both_texts) GROUP BY ALL),
hp AS (SELECT side, chunk_id, CAST(('0x' || substr(sha256(term), 10 * k + 1, 8)) AS BIGINT) % 384 AS position, sum(tf * CASE WHEN CAST(('0x' || substr(sha256(term), 10 * k + 10, 1)) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS weight
  FROM ht, range(6) r(k) GROUP BY ALL),
hv AS (SELECT side, chunk_id, sqrt(sum(CAST(weight AS DOUBLE) * weight)) AS norm FROM hp WHERE weight <> 0 GROUP BY side, chunk_id),
hashed AS (SELECT v.chunk_id, round(coalesce(d.dot, 0) / (v.norm * (SELECT norm FROM hv WHERE side = 1)), 6) AS score FROM hv v LEFT JOIN
  (SELECT a.chunk_id, sum(a.weight * b.weight) AS dot FROM hp a JOIN hp b ON a.position = b.position AND a.side = 0 AND b.side = 1 GROUP BY a.chunk_id) d ON d.chunk_id = v.chunk_id WHERE v.side = 0)"""

_RRF = f"""
vr AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS v_rank FROM hashed WHERE score >= 0 QUALIFY v_rank <= 12),
kr AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS k_rank FROM bm25 QUALIFY k_rank <= 12),
fused AS (SELECT coalesce(vr.chunk_id, kr.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + k_rank), 0), 9) AS rrf, least(v_rank, k_rank) AS best_rank, score AS cosine FROM vr FULL JOIN kr ON vr.chunk_id = kr.chunk_id)"""


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused ranks of both searches."""
    chunks = tables.chunks(spark, sf_dir)
    return retrieval.fuse(retrieval.ranked(retrieval.hash_similar(chunks, QUESTION).where("score >= 0"), 12), retrieval.ranked(retrieval.bm25(chunks, QUESTION), 12))


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship, a question's cited passages."""
    return retrieval.retrieve(tables.chunks(spark, sf_dir), QUESTION)


def page_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label the vector nearest to the first one."""
    vectors = table(spark, sf_dir, "embeddings")
    scored = vectors.join(retrieval.similar(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), _question_vector(spark, sf_dir)), F.col("vec_id") == F.col("chunk_id"))
    rows = scored.select("chunk_id", F.lit(0).alias("doc_id"), F.col("label").alias("page"), "score", (-F.col("score")).alias("rank0"))
    return retrieval.one_per_page(rows.withColumn("rank", F.struct("rank0", "chunk_id"))).select("chunk_id", "page", "score")


def context_budget_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the leading turns within a budget, with labels."""
    rows = tables.chunks(spark, sf_dir).select("doc_id", "chunk_id", "token_count", F.col("page").alias("rank"))
    return retrieval.within_budget(rows, budget=400, final=6, by=("doc_id",)).select("doc_id", "chunk_id", "label", "spent")


def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by their best hit."""
    chunks = tables.chunks(spark, sf_dir).where("role <> 'system'")
    hits = retrieval.bm25(chunks, QUESTION).join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    best = hits.groupBy("doc_id").agg(F.max("score").alias("score"), F.min_by("chunk_id", F.struct(-F.col("score"), F.col("chunk_id"))).alias("chunk_id"), F.count("*").alias("hits"))
    return best.orderBy(F.col("score").desc(), "doc_id").limit(40)


def embedded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits that have a vector under the active model."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    return retrieval.top(retrieval.bm25(docs, QUESTION).join(vectors, "chunk_id"), 30)


QUERIES = {f.__name__: f for f in (token_stats, content_hashes, message_titles, context_usage, chunk_closed_form, chunk_general, chunk_overlap, chunk_overlap_general, keyword_search, keyword_search_scoped, vector_topk, vector_topk_filtered, vector_scan, hash_embed_topk, rrf_fusion, hybrid_retrieve, page_dedup, context_budget_trim, conversation_search, embedded_hits)}

_FLAT = f"trim(regexp_replace(text, '[{_WS}]+', ' ', 'g'))"
_WORDS = f"regexp_extract_all(text, '[^{_WS}]+')"
_WINDOWS = lambda size, step: f"""pieces AS (SELECT doc_id, CAST(k AS INT) AS chunk_index, list_slice(w, k * step + 1, k * step + size) AS part
  FROM (SELECT doc_id, {_WORDS} AS w, {size} AS size, {step} AS step FROM documents WHERE len({_WORDS}) > 0), LATERAL (SELECT unnest(range(CAST(1 + greatest(0, ceil((len(w) - size) / step)) AS BIGINT))) AS k))"""  # noqa: E731


def _general(size: int, overlap: int) -> str:
    """Windows of tokens: from each atom the last one that fits, and from there the first one that is repeated, by sums up to each atom."""
    step = math.gcd(size, overlap)
    cost = f"(len(regexp_extract_all(w, '[{_CJK}]')) + coalesce(list_sum(list_transform(regexp_extract_all(w, '[^{_CJK}]+'), lambda x: CASE WHEN length(x) <= 16 THEN 1 ELSE CAST(ceil(length(x) / 4) AS BIGINT) END)), 0))"
    return f"""words AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM documents), priced AS (SELECT *, CAST({cost} AS BIGINT) AS c FROM words),
      cut AS (SELECT doc_id, i, k, CASE WHEN c <= {size} THEN w ELSE substr(w, k * {step} + 1, {step}) END AS w, CASE WHEN c <= {size} THEN c WHEN length(substr(w, k * {step} + 1, {step})) <= 16 THEN 1 ELSE CAST(ceil(length(substr(w, k * {step} + 1, {step})) / 4) AS BIGINT) END AS c
        FROM priced, LATERAL (SELECT unnest(range(CASE WHEN c <= {size} THEN 1 ELSE CAST(ceil(length(w) / {step}) AS BIGINT) END)) AS k)),
      atoms AS (SELECT doc_id, row_number() OVER o AS a, w, c, k > 0 AS glued, CAST(sum(c) OVER o AS BIGINT) AS upto FROM cut WINDOW o AS (PARTITION BY doc_id ORDER BY i, k)),
      reach AS (SELECT *, greatest(a, max(a) OVER (PARTITION BY doc_id ORDER BY upto - c RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING)) AS loose, min(a) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {overlap} PRECEDING AND CURRENT ROW) AS back, max(a) OVER (PARTITION BY doc_id) AS n FROM atoms),
      fits AS (SELECT r.doc_id, r.a, r.n, coalesce((SELECT max(x.a) FROM atoms x WHERE x.doc_id = r.doc_id AND x.a BETWEEN r.a AND r.loose AND x.upto <= r.upto - r.c + {size}), r.a) AS stop FROM reach r),
      hops AS (SELECT f.doc_id, f.a, f.n, f.stop, greatest(f.a + 1, least(b.back + 1, f.stop + 1)) AS again FROM fits f JOIN reach b ON b.doc_id = f.doc_id AND b.a = f.stop),
      starts AS (SELECT doc_id, a, stop, n, again, 0 AS chunk_index FROM hops WHERE a = 1 UNION ALL SELECT h.doc_id, h.a, h.stop, h.n, h.again, s.chunk_index + 1 FROM starts s JOIN hops h ON h.doc_id = s.doc_id AND h.a = s.again WHERE s.stop < s.n),
      pieces AS (SELECT s.doc_id, s.chunk_index, CAST(sum(c) AS BIGINT) AS token_count, string_agg(CASE WHEN glued OR x.a = s.a THEN w ELSE ' ' || w END, '' ORDER BY x.a) AS text FROM starts s JOIN atoms x ON x.doc_id = s.doc_id AND x.a BETWEEN s.a AND s.stop GROUP BY s.doc_id, s.chunk_index)"""


_LEFT = _COST.replace("text", "rest")
_SHARED = f"""pairs AS (SELECT doc_id, chunk_index, text, right(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index), 400) AS before FROM texts),
  found AS (SELECT doc_id, text, CASE WHEN before IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(1, 1 + least(400, length(text), length(before))), lambda n: left(text, n) = right(before, n))), 0) END AS most FROM pairs),
  kept AS (SELECT doc_id, CASE WHEN most >= length(text) THEN 0 ELSE most END AS shared, CASE WHEN most > 0 AND most < length(text) THEN regexp_replace(substr(text, most + 1), '^[{_WS}]+', '') ELSE text END AS rest FROM found)
  SELECT doc_id, count(*) AS chunks, CAST(sum(shared) AS BIGINT) AS shared_chars, CAST(sum(ceil({_LEFT} * 1.3::DOUBLE)) AS BIGINT) AS prompt_tokens FROM kept GROUP BY doc_id"""
_BASE_DOCS = "base AS (SELECT doc_id AS chunk_id, text FROM documents)"

ORACLE_SQL = {
    "token_stats": f"SELECT lang, source, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS BIGINT) AS longest FROM (SELECT lang, source, CAST({_COST} AS BIGINT) AS n FROM documents) GROUP BY lang, source",
    "content_hashes": "SELECT sha256(text || chr(0) || 'v1') AS content_hash, count(*) AS documents, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "message_titles": f"SELECT conv_id, CASE WHEN {_FLAT} = '' THEN 'New conversation' ELSE left({_FLAT}, 60) END AS title, CASE WHEN length(trim(text)) > 40 THEN rtrim(left(trim(text), 40)) || '…' ELSE trim(text) END AS snippet FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)",
    "context_usage": f"SELECT conv_id, CAST(sum(ceil({_COST} * 1.3::DOUBLE * 1.5::DOUBLE) + 8) AS BIGINT) AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id",
    "chunk_closed_form": f"WITH {_WINDOWS(500, 420)} SELECT doc_id, chunk_index, CAST(len(part) AS BIGINT) AS token_count, md5(array_to_string(part, ' ')) AS text_md5 FROM pieces",
    "chunk_general": f"WITH RECURSIVE {_general(500, 80)} SELECT doc_id, chunk_index, token_count, md5(text) AS text_md5 FROM pieces",
    "chunk_overlap": f"WITH {_WINDOWS(100, 80)}, texts AS (SELECT doc_id, chunk_index, array_to_string(part, ' ') AS text FROM pieces), {_SHARED}",
    "chunk_overlap_general": f"WITH RECURSIVE {_general(100, 20)}, texts AS (SELECT * FROM pieces), {_SHARED}",
    "keyword_search": f"WITH {_BASE_DOCS}, {_BM25} SELECT chunk_id, score FROM bm25 ORDER BY score DESC, chunk_id LIMIT 20",
    "keyword_search_scoped": f"WITH {_BASE_DOCS}, {_BM25} SELECT chunk_id, score FROM bm25 WHERE chunk_id IN (SELECT doc_id FROM documents WHERE source = 'src3') ORDER BY score DESC, chunk_id LIMIT 20",
    "vector_topk": f"SELECT vec_id AS chunk_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, {_COSINE} ORDER BY score DESC, chunk_id LIMIT 25",
    "vector_topk_filtered": f"SELECT * FROM (SELECT vec_id AS chunk_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, {_COSINE} WHERE label = 3) WHERE score >= 0 ORDER BY score DESC, chunk_id LIMIT 25",
    "vector_scan": f"WITH t AS (SELECT vec_id * 50 + k AS chunk_id, list_concat(embedding[k + 1:], embedding[:k]) AS embedding FROM embeddings, range(50) r(k)) SELECT chunk_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)), 6) AS score FROM t, {_COSINE} ORDER BY score DESC, chunk_id LIMIT 25",
    "hash_embed_topk": f"WITH {CHUNKS}, {HASHED} SELECT chunk_id, score FROM hashed ORDER BY score DESC, chunk_id LIMIT 25",
    "rrf_fusion": f"WITH {CHUNKS}, base AS (SELECT chunk_id, text FROM chunks), {_BM25}, {HASHED}, {_RRF} SELECT * FROM fused",
    "hybrid_retrieve": f"""WITH {CHUNKS}, base AS (SELECT chunk_id, text FROM chunks), {_BM25}, {HASHED}, {_RRF},
      placed AS (SELECT f.*, c.doc_id, c.page, c.token_count, c.text, row_number() OVER (ORDER BY rrf DESC, best_rank, chunk_id) AS rank FROM fused f JOIN chunks c USING (chunk_id)),
      paged AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY rank) = 1),
      spent AS (SELECT *, row_number() OVER (ORDER BY rank) AS place, sum(ceil(token_count * 1.3::DOUBLE)) OVER (ORDER BY rank) AS total FROM paged)
      SELECT 'S' || place AS label, chunk_id, doc_id, page, coalesce(cosine, rrf) AS score, rrf, CASE WHEN length(trim(text)) > 600 THEN rtrim(left(trim(text), 600)) || '…' ELSE trim(text) END AS snippet FROM spent WHERE (place = 1 OR total <= 2500) AND place <= 6""",
    "page_dedup": f"SELECT chunk_id, page, score FROM (SELECT vec_id AS chunk_id, label AS page, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(q, lambda x: x::DOUBLE)), 6) AS score FROM embeddings, {_COSINE}) QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, chunk_id) = 1",
    "context_budget_trim": f"WITH {CHUNKS}, spent AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS place, CAST(sum(ceil(token_count * 1.3::DOUBLE)) OVER (PARTITION BY doc_id ORDER BY page) AS BIGINT) AS spent FROM chunks) SELECT doc_id, chunk_id, 'S' || place AS label, spent FROM spent WHERE (place = 1 OR spent <= 400) AND place <= 6",
    "conversation_search": f"WITH {CHUNKS}, base AS (SELECT chunk_id, text FROM chunks WHERE role <> 'system'), {_BM25}, h AS (SELECT bm25.chunk_id, score, doc_id FROM bm25 JOIN chunks USING (chunk_id)) SELECT doc_id, max(score) AS score, (SELECT h2.chunk_id FROM h h2 WHERE h2.doc_id = h.doc_id ORDER BY h2.score DESC, h2.chunk_id LIMIT 1) AS chunk_id, count(*) AS hits FROM h GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 40",
    "embedded_hits": f"WITH {_BASE_DOCS}, {_BM25} SELECT chunk_id, score, label FROM bm25 JOIN embeddings ON vec_id = chunk_id ORDER BY score DESC, chunk_id LIMIT 30",
}
