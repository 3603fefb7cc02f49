"""Queries over documents, messages, events and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import conversation, ledger, library
from lectern.plans import tables
from lectern.plans.tables import LEDGER, LIBRARY, MEMBERSHIPS, table


def scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents of two collections or named by id, without archived ones."""
    return library.scope(tables.library(spark, sf_dir), tables.memberships(spark, sf_dir), ["src3", "fr"], [1, 5, 7]).select("doc_id", "title")


def scope_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the whole library, archived documents counted apart."""
    docs, members = tables.library(spark, sf_dir), tables.memberships(spark, sf_dir)
    active = library.scope(docs, members).groupBy("source").agg(F.count("*").alias("active"))
    every = library.scope(docs, members, archived=True).groupBy("source").agg(F.count("*").alias("every"))
    return every.join(active, "source", "left").fillna(0, ["active"])


def searchable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """indexed documents with chunks."""
    chunks = table(spark, sf_dir, "documents").where("n_chars > 200").select("doc_id")
    return library.searchable(tables.library(spark, sf_dir), chunks).select("doc_id", "status")


def project_only_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in one project alone."""
    return library.only_in(tables.memberships(spark, sf_dir), "src12")


def unfiled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in no project."""
    return library.unfiled(tables.library(spark, sf_dir), tables.memberships(spark, sf_dir)).select("doc_id", "source")


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document list with counts."""
    chunks = tables.chunks(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("chunk_id"))
    return library.listing(tables.library(spark, sf_dir), tables.memberships(spark, sf_dir), chunks, vectors).select("doc_id", "title", "status", "collections", "chunk_count", "embedded_count")


def smart_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in each smart view."""
    return library.smart_views(tables.library(spark, sf_dir), tables.memberships(spark, sf_dir))


def reindex_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whether the corpus lacks vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"))
    return library.needs_reindex(tables.library(spark, sf_dir), tables.chunks(spark, sf_dir), vectors)


def filename_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents that a question names."""
    return library.named_documents(tables.library(spark, sf_dir), "What does Report 12 say, and REPORT 3.txt?").select("doc_id", "title")


def generated_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every document as one made from its neighbours in the source."""
    docs = tables.library(spark, sf_dir)
    made = docs.select("doc_id", (F.col("created_at") + 2500).alias("made_at"), F.array(F.col("doc_id") - 1, F.col("doc_id") + 1).alias("sources"))
    return library.staleness(made, docs)


def upsert_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each key."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return library.latest(events, ["user_id", "event_type"], "event_id")


def membership_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships with a new collection for long documents, none twice."""
    members = tables.memberships(spark, sf_dir)
    fresh = table(spark, sf_dir, "documents").where("n_chars > 1000").select("doc_id", F.col("lang").alias("collection"), F.lit("project").alias("type"))
    return library.added(members, fresh, ["doc_id", "collection"])


def latest_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last message and the last user message of each conversation."""
    rows = tables.messages(spark, sf_dir)
    last, asked = conversation.latest(rows), conversation.latest(rows, "user")
    return last.select("conv_id", "seq", "role").join(asked.select("conv_id", F.col("seq").alias("user_seq")), "conv_id", "left")


def last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question before each answer."""
    return conversation.questions(tables.messages(spark, sf_dir))


def role_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating roles."""
    return conversation.alternating(tables.messages(spark, sf_dir)).select("conv_id", "seq", "role")


def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that fit a prompt."""
    return conversation.fitting(tables.messages(spark, sf_dir), 600)


def compaction_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations to compact."""
    return conversation.needs_compaction(tables.messages(spark, sf_dir), 600, keep=2, least=2)


def transcript_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown."""
    return conversation.transcript(tables.messages(spark, sf_dir)).select("conv_id", F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of events before a cursor."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    cursor = events.where("event_type = 'error'").agg(F.max(F.struct("ts", "event_id")).alias("m")).collect()[0].m
    return conversation.older_than(events, tuple(cursor) if cursor else (None, None), 50).select("event_id", "event_type")


def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8, ST4: the newest events that the log keeps."""
    return conversation.newest(table(spark, sf_dir, "events"), 5000, F.col("ts")).select("event_id", "event_type", "user_id")


def audit_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id", "event_id")
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.max("event_id").alias("last_event"))


def reconcile_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's status and expected balance."""
    return ledger.reconciled(tables.ledger(spark, sf_dir)).select("statement", "pos", "status", "expected")


def statement_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts, with the last printed balance as the closing one."""
    rows = tables.ledger(spark, sf_dir)
    closing = rows.groupBy("statement").agg(F.max_by("balance", "pos").alias("closing")).withColumn("opening", F.lit(0).cast("long"))
    return ledger.completeness(ledger.reconciled(rows), closing)


def reconciliation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: statements by their counts."""
    return ledger.reconciliation(ledger.reconciled(tables.ledger(spark, sf_dir)))


def cashflow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: in, out and net."""
    return ledger.cashflow(tables.ledger(spark, sf_dir))


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by category; part names stand for descriptions."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" transfer fee "), "p_type").alias("long_name"), "p_name")
    lines = table(spark, sf_dir, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey"))
    text = F.when(F.col("l_returnflag") == "R", F.col("long_name")).when(F.col("l_returnflag") == "A", F.concat(F.lit("ATM "), "p_name")).otherwise(F.concat(F.lit("coffee "), "p_name"))
    rows = lines.select(F.col("l_orderkey").alias("row_id"), (F.round(F.col("l_extendedprice") * 100) * F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)).cast("long").alias("cents"), text.alias("description"), F.col("l_linestatus").alias("currency"))
    return ledger.category_totals(rows.withColumn("category", ledger.category(F.col("description"), F.col("cents"))))


def invoice_total_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices of their lines."""
    line = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("invoice"), line.alias("cents"), F.round(line * F.col("l_tax")).cast("long").alias("tax"), "l_quantity")
    sums = lines.groupBy("invoice").agg(F.sum("cents").alias("net"), F.sum("tax").alias("tax0"), F.min("l_quantity").alias("q"))
    gross = F.round(F.col("o_totalprice") * 100).cast("long")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice"), gross.alias("printed"), "o_orderstatus")
    totals = orders.join(sums, "invoice", "left").select("invoice", (F.col("net") + F.when(F.col("q") < 3, 40).otherwise(0)).alias("net"), F.when(F.col("o_orderstatus") != "P", F.col("tax0")).alias("tax"), F.when(F.col("o_orderstatus") == "F", F.col("net") + F.col("tax0")).otherwise(F.col("printed")).alias("gross"), F.lit(4.0).alias("rate"))
    return ledger.invoice_checks(lines.select("invoice", "cents"), totals)


QUERIES = {f.__name__: f for f in (scope_union, scope_archived, searchable_documents, project_only_docs, unfiled_docs, list_documents, smart_views, reindex_needed, filename_scope, generated_staleness, upsert_settings, membership_insert, latest_message, last_user_turn, role_collapse, context_fit, compaction_due, transcript_export, audit_page, audit_retention, audit_daily, reconcile_running_balance, statement_completeness, reconciliation_counts, cashflow_summary, category_totals, invoice_total_checks)}

COST = "(CAST(ceil(coalesce(list_sum(list_transform(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'), lambda w: CASE WHEN length(w) <= 16 THEN 1 ELSE CAST(ceil(length(w) / 4) AS BIGINT) END)), 0) * 1.3::DOUBLE * 1.5::DOUBLE) AS BIGINT) + 8)"
_CHECKED = f"""{LEDGER}, sums AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY statement ORDER BY pos) AS BIGINT) AS total FROM ledger),
  lasts AS (SELECT *, last_value(balance IGNORE NULLS) OVER w AS lb, last_value(CASE WHEN balance IS NOT NULL THEN total END IGNORE NULLS) OVER w AS lt FROM sums WINDOW w AS (PARTITION BY statement ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  checked AS (SELECT *, lb + total - lt AS expected, CASE WHEN balance IS NULL OR lb IS NULL THEN 'unknown' WHEN balance = lb + total - lt THEN 'ok' ELSE 'mismatch' END AS status FROM lasts)"""

ORACLE_SQL = {
    "scope_union": f"WITH {LIBRARY}, {MEMBERSHIPS} SELECT doc_id, title FROM library WHERE (doc_id IN (SELECT doc_id FROM memberships WHERE collection IN ('src3', 'fr')) OR doc_id IN (1, 5, 7)) AND coalesce(lifecycle, 'permanent') <> 'archived'",
    "scope_archived": f"WITH {LIBRARY} SELECT source, count(*) AS every, count(*) FILTER (coalesce(lifecycle, 'permanent') <> 'archived') AS active FROM library GROUP BY source",
    "searchable_documents": f"WITH {LIBRARY} SELECT doc_id, status FROM library WHERE status = 'indexed' AND doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 200)",
    "project_only_docs": f"WITH {MEMBERSHIPS} SELECT doc_id FROM memberships GROUP BY doc_id HAVING bool_or(collection = 'src12') AND bool_and(collection = 'src12')",
    "unfiled_docs": f"WITH {MEMBERSHIPS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM memberships WHERE type = 'project')",
    "list_documents": f"""WITH {LIBRARY}, {MEMBERSHIPS}, {tables.CHUNKS} SELECT l.doc_id, title, status, coalesce((SELECT string_agg(DISTINCT collection, ',' ORDER BY collection) FROM memberships m WHERE m.doc_id = l.doc_id), '') AS collections,
      (SELECT count(*) FROM chunks c WHERE c.doc_id = l.doc_id) AS chunk_count, (SELECT count(DISTINCT vec_id) FROM embeddings e WHERE e.label = l.doc_id) AS embedded_count FROM library l""",
    "smart_views": f"""WITH {LIBRARY}, {MEMBERSHIPS}, s AS (SELECT count(*) FILTER (coalesce(lifecycle, 'permanent') = 'archived') AS archived, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM memberships WHERE type = 'project')) AS unfiled,
      count(*) FILTER (size_bytes >= 10485760) AS large, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (mime_type LIKE 'audio/%') AS audio FROM library)
      SELECT view, documents FROM s UNPIVOT (documents FOR view IN (archived, unfiled, large, failed, audio))""",
    "reindex_needed": f"WITH {LIBRARY}, i AS (SELECT doc_id FROM library WHERE status = 'indexed' AND doc_id IN (SELECT conv_id FROM conversations)) SELECT count(*) AS indexed, count(*) FILTER (doc_id IN (SELECT label FROM embeddings)) AS embedded, count(*) > 0 AND count(*) FILTER (doc_id IN (SELECT label FROM embeddings)) = 0 AS needs_reindex FROM i",
    "filename_scope": f"WITH {LIBRARY} SELECT doc_id, title FROM library WHERE title IN ('Report 12.txt', 'Report 3.txt')",
    "generated_staleness": f"""WITH {LIBRARY}, s AS (SELECT l.doc_id, l.created_at + 2500 AS made_at, unnest([l.doc_id - 1, l.doc_id + 1]) AS source_id FROM library l),
      j AS (SELECT s.*, l.doc_id AS found, l.updated_at, coalesce(l.lifecycle, 'permanent') AS life FROM s LEFT JOIN library l ON l.doc_id = s.source_id)
      SELECT doc_id, CASE WHEN bool_or(found IS NULL OR life = 'archived') THEN 'source-removed' WHEN bool_or(coalesce(updated_at > made_at, false)) THEN 'source-changed' END AS reason FROM j GROUP BY doc_id""",
    "upsert_settings": "SELECT user_id, max(event_id) AS event_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "membership_insert": f"WITH {MEMBERSHIPS} SELECT * FROM memberships UNION ALL SELECT doc_id, lang, 'project' FROM documents d WHERE n_chars > 1000 AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.doc_id = d.doc_id AND m.collection = d.lang)",
    "latest_message": "SELECT conv_id, max(turn) AS seq, arg_max(role, turn) AS role, max(turn) FILTER (role = 'user') AS user_seq FROM conversations GROUP BY conv_id",
    "last_user_turn": "SELECT conv_id, turn AS seq, (SELECT max(turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn < c.turn) AS question_seq FROM conversations c WHERE role = 'assistant'",
    "role_collapse": "SELECT conv_id, turn AS seq, role FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations) WHERE following IS NULL OR following <> role",
    "context_fit": f"""WITH c AS (SELECT conv_id, turn AS seq, role, {COST} AS cost FROM conversations),
      s AS (SELECT *, coalesce(sum(cost) FILTER (role = 'system') OVER (PARTITION BY conv_id), 0) AS fixed, coalesce(sum(cost) FILTER (role <> 'system') OVER (PARTITION BY conv_id ORDER BY seq DESC), 0) AS spent FROM c),
      k AS (SELECT * FROM s WHERE role = 'system' OR spent + fixed <= 600)
      SELECT conv_id, seq, role, cost FROM k WHERE role = 'system' OR EXISTS (SELECT 1 FROM k u WHERE u.conv_id = k.conv_id AND u.role = 'user' AND u.seq <= k.seq)""",
    "compaction_due": f"""WITH c AS (SELECT conv_id, turn, role, {COST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
      SELECT * FROM (SELECT conv_id, CAST(sum(cost) AS BIGINT) AS tokens, count(*) AS messages, max(turn) FILTER (back > 2 AND role = 'assistant') AS covers_through FROM c GROUP BY conv_id) WHERE tokens > 510 AND messages >= 4 AND covers_through IS NOT NULL""",
    "transcript_export": "SELECT conv_id, md5(string_agg('## ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || trim(text) || chr(10), chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY conv_id",
    "audit_page": "WITH c AS (SELECT ts, event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 1) SELECT event_id, event_type FROM events e WHERE (e.ts, e.event_id) < (SELECT (ts, event_id) FROM c) ORDER BY ts DESC, event_id DESC LIMIT 50",
    "audit_retention": "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000",
    "audit_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users, max(event_id) AS last_event FROM events GROUP BY ALL",
    "reconcile_running_balance": f"WITH {_CHECKED} SELECT statement, pos, status, expected FROM checked",
    "statement_completeness": f"""WITH {_CHECKED} SELECT statement, CASE WHEN bool_or(status = 'mismatch') THEN 'contradicted' WHEN last(balance ORDER BY pos) IS NULL THEN 'unverified' WHEN sum(cents) = last(balance ORDER BY pos) THEN 'complete' ELSE 'contradicted' END AS verdict FROM checked GROUP BY statement""",
    "reconciliation_counts": f"WITH {_CHECKED} SELECT statement, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'mismatch') AS mismatch, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'mismatch') = 0 AND count(*) FILTER (status = 'ok') > 0 AS reconciled FROM checked GROUP BY statement",
    "cashflow_summary": f"WITH {LEDGER} SELECT statement, CAST(coalesce(sum(cents) FILTER (cents > 0), 0) AS BIGINT) AS inflow, CAST(coalesce(-sum(cents) FILTER (cents < 0), 0) AS BIGINT) AS outflow, 'EUR' AS currency, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS net FROM ledger GROUP BY statement",
    "category_totals": """WITH r AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) * CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS BIGINT) AS cents, l_linestatus AS currency, l_returnflag, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)
      SELECT CASE l_returnflag WHEN 'R' THEN 'Fees' WHEN 'A' THEN 'Cash' ELSE CASE WHEN cents > 0 THEN 'Income' WHEN cents < 0 THEN 'Spending' ELSE 'Uncategorized' END END AS category, currency, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS rows, min(l_orderkey) AS first_row FROM r GROUP BY 1, 2""",
    "invoice_total_checks": """WITH l AS (SELECT l_orderkey AS invoice, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents, l_tax, l_quantity FROM lineitem),
      s AS (SELECT invoice, sum(cents) AS items, sum(CAST(round(cents * l_tax) AS BIGINT)) AS tax0, min(l_quantity) AS q, count(*) AS n FROM l GROUP BY invoice),
      t AS (SELECT o_orderkey AS invoice, items, n, items + CASE WHEN q < 3 THEN 40 ELSE 0 END AS net, CASE WHEN o_orderstatus <> 'P' THEN tax0 END AS tax, CASE WHEN o_orderstatus = 'F' THEN items + tax0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS gross, greatest(1.0, coalesce(n, 0) * 0.5) + 0.5 AS slack FROM orders LEFT JOIN s ON s.invoice = o_orderkey)
      SELECT invoice, CASE WHEN items IS NULL OR net IS NULL THEN 'unknown' WHEN abs(items - net) <= slack THEN 'ok' ELSE 'mismatch' END AS items_net,
        CASE WHEN net IS NULL OR tax IS NULL OR gross IS NULL THEN 'unknown' WHEN abs(net + tax - gross) <= slack THEN 'ok' ELSE 'mismatch' END AS net_gross,
        CASE WHEN net IS NULL OR tax IS NULL THEN 'unknown' WHEN abs(net * 4.0 / 100 - tax) <= slack THEN 'ok' ELSE 'mismatch' END AS rate_tax FROM t""",
}
