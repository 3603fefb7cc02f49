"""The driver's tables as the engine's model: documents, chunks, messages and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "the stand of onthe thatwh and ing restheng and the tion"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out over all cores: a small file is one task, however much work its rows are later."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a chunk: the conversation is its document, the turn its page."""
    rows = table(spark, sf_dir, "conversations")
    return rows.select((F.col("conv_id") * (1 << 32) + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).cast("long").alias("token_count"))


CHUNKS = r"""chunks AS (SELECT conv_id * 4294967296 + turn AS chunk_id, conv_id AS doc_id, turn AS page, role, text,
  CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS BIGINT) AS token_count FROM conversations)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages (conv_id, seq, role, text)."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a status, a lifecycle and times.

    Very short texts failed to import; toxic ones are archived, unlabelled ones have no
    lifecycle; the id stands for the time of creation, the length for that of the update.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.select("doc_id", "source", "lang", "n_chars").join(labels, "doc_id", "left")
    return rows.select(
        "doc_id", F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("title"), "source", "lang",
        F.when(F.col("n_chars") < 60, "failed").otherwise("indexed").alias("status"),
        F.when(F.col("toxic") == 1, "archived").when(F.col("toxic") == 0, "permanent").alias("lifecycle"),
        (F.col("n_chars") * 1024).alias("size_bytes"), F.col("doc_id").alias("created_at"), (F.col("doc_id") + F.col("n_chars")).alias("updated_at"),
        F.when(F.col("lang") == "de", "audio/wav").otherwise("text/plain").alias("mime_type"), "quality",
    )


LIBRARY = """library AS (SELECT d.doc_id, 'Report ' || d.doc_id || '.txt' AS title, source, lang,
  CASE WHEN n_chars < 60 THEN 'failed' ELSE 'indexed' END AS status, CASE toxic WHEN 1 THEN 'archived' WHEN 0 THEN 'permanent' END AS lifecycle,
  n_chars * 1024 AS size_bytes, d.doc_id AS created_at, d.doc_id + n_chars AS updated_at,
  CASE WHEN lang = 'de' THEN 'audio/wav' ELSE 'text/plain' END AS mime_type, quality
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of documents: their source, a project if its name has two digits; and their language, for long texts."""
    docs = table(spark, sf_dir, "documents")
    by_source = docs.select("doc_id", F.col("source").alias("collection"), F.when(F.length("source") > 4, "project").otherwise("builtin").alias("type"))
    by_language = docs.where("n_chars > 2000").select("doc_id", F.col("lang").alias("collection"), F.lit("project").alias("type"))
    return by_source.unionByName(by_language)


MEMBERSHIPS = """memberships AS (SELECT doc_id, source AS collection, CASE WHEN length(source) > 4 THEN 'project' ELSE 'builtin' END AS type FROM documents
  UNION ALL SELECT doc_id, lang, 'project' FROM documents WHERE n_chars > 2000)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each customer: orders in time as signed amounts in cents, with printed balances.

    Open orders are inflow. Every row prints the balance except those of urgent orders, and
    rows of one status print a wrong one when the total is above 300000.
    """
    o = table(spark, sf_dir, "orders")
    from pyspark.sql import Window as W

    cents = F.round(F.col("o_totalprice") * 100).cast("long") * F.when(F.col("o_orderstatus") == "O", 1).otherwise(-1)
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.withColumn("cents", cents).withColumn("pos", F.row_number().over(order)).withColumn("run", F.sum("cents").over(order.rowsBetween(W.unboundedPreceding, 0)))
    wrong = (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "F")
    printed = F.when(F.col("o_orderpriority").startswith("1"), None).when(wrong, F.col("run") + 1).otherwise(F.col("run"))
    return rows.select(F.col("o_custkey").alias("statement"), "pos", F.col("o_orderkey").alias("row_id"), "cents", printed.alias("balance"), F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderstatus")).alias("description"), F.lit("EUR").alias("currency"))


LEDGER = """ledger AS (SELECT o_custkey AS statement, pos, o_orderkey AS row_id, cents,
    CASE WHEN o_orderpriority LIKE '1%' THEN NULL WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN run + 1 ELSE run END AS balance,
    o_orderpriority || ' ' || o_orderstatus AS description, 'EUR' AS currency
  FROM (SELECT *, row_number() OVER w AS pos, CAST(sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run
    FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END AS cents FROM orders)
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)))"""
