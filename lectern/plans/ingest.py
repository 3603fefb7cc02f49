"""Queries over files' parsers and over exports."""

from __future__ import annotations

import time
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import conversation
from lectern.plans import tables
from lectern.plans.tables import LEDGER, table
from lectern.sources import exports, files, folders, snapshots

_md5 = lambda c: F.md5(F.col(c).cast("binary"))


def parser_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by kind and state; every document as a file of its source's extension."""
    docs = table(spark, sf_dir, "documents")
    extension = F.element_at(F.array(*map(F.lit, ("txt", "MD", "csv", "pdf", "Log"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = docs.select(F.concat(F.lit("/in/"), "source", F.lit("/r"), "doc_id", F.lit("."), extension).alias("path"), (F.col("n_chars") * 400_000).alias("size_bytes"))
    return files.limited(rows.withColumn("kind", files.kind_of(F.col("path")))).groupBy("kind", "status", "error").agg(F.count("*").alias("files"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts as Markdown, cut into sections."""
    rows = conversation.transcript(tables.messages(spark, sf_dir)).select(F.col("conv_id").alias("doc_id"), F.col("markdown").alias("text"))
    found = files.markdown_segments(rows)
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "label", _md5("text").alias("text_md5"))


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: plain texts that aren't blank, without a byte order mark."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "﻿").otherwise(""), "text").alias("text"))
    return files.text_segments(rows).select("doc_id", _md5("text").alias("text_md5"))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file for each nation's customers, with quotes, breaks and cells beyond the header."""
    quoted = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit(', "" x'), F.when(F.col("c_custkey") % 2 == 0, "\n y").otherwise(""), F.lit('"'))
    line = F.concat(F.col("c_name"), F.lit(","), quoted, F.lit(", "), F.col("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, ",,more").otherwise(""))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("x"))
    texts = rows.select(F.col("c_nationkey").alias("doc_id"), F.concat(F.lit("name, segment,\r\n\r\n"), F.array_join("x.line", "\r\n")).alias("text"))
    return files.csv_segments(texts).select("doc_id", _md5("text").alias("text_md5"))


def preview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each document's lines, as segments."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("ordinal", "text"))
    return files.preview(rows, 1).select("doc_id", "ordinal", "pages")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows as transactions; every third statement has categories."""
    rows = tables.ledger(spark, sf_dir).withColumn("description", F.concat(F.when(F.col("pos") % 4 == 0, "=").otherwise(""), "description", F.when(F.col("pos") % 5 == 0, ', "x"').otherwise("")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    rows = rows.join(orders, "row_id").withColumn("value_date", F.when(F.col("pos") % 2 == 0, F.col("date"))).withColumn("page", F.col("pos").cast("int"))
    return rows.withColumn("category", F.when((F.col("statement") % 3 == 0) & (F.col("cents") > 0), "Income"))


def result_table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as CSV."""
    return exports.transactions_csv(_rows(spark, sf_dir)).select("statement", _md5("csv").alias("csv_md5"), "n_rows")


def statement_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as JSON; every second one has printed balances."""
    rows = _rows(spark, sf_dir)
    balances = rows.groupBy("statement").agg(F.lit(0).cast("long").alias("opening"), F.max_by("balance", "pos").alias("closing")).where("statement % 2 = 0")
    return exports.statement_json(rows, balances).select("statement", _md5("json").alias("json_md5"))


def invoice_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices in CSV, JSON and XML."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    invoices = o.select(
        F.col("o_orderkey").alias("invoice"), F.concat(F.lit("Smith & <Sons> "), "o_orderpriority").alias("vendor"), F.lit(None).cast("string").alias("recipient"), F.concat(F.lit('No. "'), F.col("o_orderkey"), F.lit('"')).alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("due_date"), F.lit("EUR").alias("currency"), F.round(F.col("o_totalprice") * 100).cast("long").alias("net"), F.lit(None).cast("long").alias("tax"), F.lit(1900).cast("long").alias("rate"), F.when(F.col("o_orderstatus") == "O", F.round(F.col("o_totalprice") * 100).cast("long")).alias("gross"),
    )
    lines = li.select(F.col("l_orderkey").alias("invoice"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("pos"), F.concat("l_returnflag", F.lit(", it's <"), "l_linestatus", F.lit(">")).alias("description"), (F.col("l_quantity") * 100).cast("long").alias("quantity"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(1050).cast("long")).alias("unit_price"), F.when(F.col("l_linenumber") % 3 == 0, F.lit(700).cast("long")).alias("rate"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.lit("EUR").alias("currency"))
    made = exports.invoice_exports(invoices, lines)
    return made.select("invoice", _md5("csv").alias("csv_md5"), _md5("json").alias("json_md5"), _md5("xml").alias("xml_md5"))


def result_tables_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest table of each message; events stand for saved tables, users for messages."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("message_id"), F.col("event_id").alias("table_id"), F.col("ts").alias("created_at"), (F.col("event_id") % 13 * 1000).alias("n_rows"))
    return exports.result_tables(rows).select("message_id", "table_id", "n_rows")


def _pages(content: bytes) -> list[tuple[str, str]]:
    """Lines as pages; a text with odd bytes is an error, and one that begins with a number of seconds takes that long."""
    text = content.decode()
    if text.startswith("wait "):
        time.sleep(float(text[5:].split()[0]))
    return [(str(k), line) for k, line in enumerate(text.split("\n"))]


def _written(folder: str):
    """A function that writes each row (kind, value) as a file; a task that runs again writes the same names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist(), strict=True):
                path = Path(folder, f"kind={kind}", f"part-{task:05}-{n:08}.txt")
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(f"{value}\n".encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return run


def supplier_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder with a file for each supplier."""
    folder = folders.new_path(spark, "files")
    k = F.col("s_suppkey") % 8
    text = F.when(k == 0, F.repeat(F.lit("large "), 200)).when(k == 1, F.concat_ws("\n", F.array_repeat(F.col("s_name"), 30))).when(k == 2, "wait 60").when(k == 3, F.repeat(F.lit("long"), 150)).when(k == 4, "  ").otherwise(F.concat("s_name", F.lit("\n"), F.lit("more")))
    kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "LOG", "text", "txt", "csv", "xyz", "MarkDown"))), (k + 1).cast("int"))
    # a file for each row, in one folder of each kind: to write and list a folder for each file takes longer than all else
    rows = tables.spread(table(spark, sf_dir, "supplier").select(kind.alias("kind"), text.alias("value")))
    store, where = folders.system(spark, folder)
    if store.getScheme() == "file":  # Hadoop starts a process for the rights of each local file
        rows.mapInArrow(_written(where.toUri().getPath()), "files long").agg(F.sum("files")).collect()
    else:
        rows.write.partitionBy("kind").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)
    return folder


def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, of every kind of limit, read within the limits."""
    folder = supplier_files(spark, sf_dir)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size_bytes"), "content")
    found = found.withColumn("kind", files.kind_of(F.concat(F.lit("."), F.regexp_extract("path", r"/kind=([^/]+)/", 1))))
    # a task of many files has others to read while some wait
    found = found.coalesce(4 * spark.sparkContext.defaultParallelism)
    read = files.parsed(found, {"text": _pages, "markdown": _pages}, files.Limits(size=1000, text=500, pages=25, seconds=0.5))
    return read.groupBy("kind", "status", "error").agg(F.count("*").alias("files"), F.sum(F.size("pages")).cast("long").alias("pages"))


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, sizes and roots of documents replaced and deleted together, read before and after."""
    chunks = tables.chunks(spark, sf_dir).select("doc_id", "chunk_id", "token_count")
    sizes, roots = chunks.select("chunk_id", "doc_id", (F.col("token_count") * 2).alias("size")), chunks.groupBy("doc_id").agg(F.max("chunk_id").alias("root"))
    store = snapshots.Snapshots(spark, folders.new_path(spark, "snapshots"))
    store.change({"chunks": chunks, "sizes": sizes, "roots": roots})
    again = chunks.where("doc_id % 3 = 1 AND chunk_id % 2 = 0").withColumn("token_count", F.lit(1).cast("long"))
    store.change({"chunks": again, "sizes": again.select("chunk_id", "doc_id", F.lit(5).cast("long").alias("size"))}, chunks.where("doc_id % 3 = 1").select("doc_id"))
    store.delete(chunks.where("doc_id % 3 = 2").select("doc_id"))
    made = None
    for version in (1, 2, 3, store.compact()):
        for name, rows in store.read(version).items():
            value = {"chunks": "token_count", "sizes": "size", "roots": "root"}[name]
            one = rows.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.lit(version).alias("version"), F.lit(name).alias("table_name"), "n", "total")
            made = one if made is None else made.unionByName(one)
    return made


QUERIES = {f.__name__: f for f in (parser_kinds, markdown_sections, text_segments, csv_lines, preview_page, result_table_csv, statement_json, invoice_exports, result_tables_latest, parsed_files, snapshot_changes)}

_ROWS = f"""{LEDGER}, rows_ AS (SELECT l.* REPLACE (CASE WHEN pos % 4 = 0 THEN '=' ELSE '' END || description || CASE WHEN pos % 5 = 0 THEN ', "x"' ELSE '' END AS description), strftime(o_orderdate, '%Y-%m-%d') AS date,
    CASE WHEN pos % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value_date, CASE WHEN statement % 3 = 0 AND cents > 0 THEN 'Income' END AS category FROM ledger l JOIN orders ON o_orderkey = row_id),
  marked AS (SELECT *, bool_or(category IS NOT NULL) OVER (PARTITION BY statement) AS has FROM rows_)"""
_MONEY = "(CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0'))"
_money = _MONEY.format
_num = lambda c: f"coalesce(regexp_replace(regexp_replace({_money(c)}, '(\\.\\d)0$', '\\1'), '\\.0$', ''), 'null')"
_csv = lambda c: f"(CASE WHEN regexp_matches({c}, '^[=+@-]') THEN CASE WHEN regexp_matches({c}, '[\",]') THEN '\"''' || replace({c}, '\"', '\"\"') || '\"' ELSE '''' || {c} END WHEN regexp_matches({c}, '[\",]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END)"
_str = lambda c: f"coalesce('\"' || replace({c}, '\"', '\\\"') || '\"', 'null')"
_nl = "chr(10)"
_lines = lambda parts: f"concat_ws({_nl}, {', '.join(parts)})"
_esc = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_tag = lambda pad, name, value: f"'{' ' * pad}<{name}>' || {value} || '</{name}>'"

ORACLE_SQL = {
    "parsed_files": """SELECT CASE WHEN k IN (0, 2, 3, 4) THEN 'text' WHEN k IN (1, 7) THEN 'markdown' WHEN k = 5 THEN 'csv' END AS kind, CASE WHEN k = 7 THEN 'parsed' ELSE 'failed' END AS status,
        CASE k WHEN 0 THEN 'too-large' WHEN 1 THEN 'too-many-pages' WHEN 2 THEN 'timeout' WHEN 3 THEN 'too-much-text' WHEN 4 THEN 'no-text' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'unsupported' END AS error, count(*) AS files, CAST(sum(CASE WHEN k = 7 THEN 3 ELSE 0 END) AS BIGINT) AS pages
      FROM (SELECT s_suppkey % 8 AS k FROM supplier) GROUP BY ALL""",
    "snapshot_changes": f"""WITH {tables.CHUNKS}, s AS (SELECT *, doc_id % 3 AS r, chunk_id % 2 = 0 AS even FROM chunks),
      v AS (SELECT unnest([1, 2, 3, 4]) AS version),
      c AS (SELECT version, 'chunks' AS table_name, CASE WHEN version > 1 AND r = 1 THEN 1 ELSE token_count END AS x FROM s, v WHERE NOT (version > 1 AND r = 1 AND NOT even) AND NOT (version > 2 AND r = 2)
        UNION ALL SELECT version, 'sizes', CASE WHEN version > 1 AND r = 1 THEN 5 ELSE token_count * 2 END FROM s, v WHERE NOT (version > 1 AND r = 1 AND NOT even) AND NOT (version > 2 AND r = 2)
        UNION ALL SELECT version, 'roots', root FROM (SELECT doc_id % 3 AS r, max(chunk_id) AS root FROM chunks GROUP BY doc_id), v WHERE NOT (version > 1 AND r = 1) AND NOT (version > 2 AND r = 2))
      SELECT CAST(version AS INTEGER) AS version, table_name, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM c GROUP BY ALL""",
    "parser_kinds": """WITH f AS (SELECT doc_id % 5 AS k, n_chars * 400000 AS size FROM documents)
      SELECT CASE k WHEN 1 THEN 'markdown' WHEN 2 THEN 'csv' WHEN 3 THEN NULL ELSE 'text' END AS kind, CASE WHEN k = 3 OR size > 1073741824 THEN 'failed' ELSE 'queued' END AS status,
        CASE WHEN k = 3 THEN 'unsupported' WHEN size > 1073741824 THEN 'too-large' END AS error, count(*) AS files FROM f GROUP BY ALL""",
    "markdown_sections": r"""WITH t AS (SELECT conv_id AS doc_id, string_split_regex(string_agg('## ' || upper(left(role, 1)) || substr(role, 2) || chr(10) || chr(10) || trim(text) || chr(10), chr(10) ORDER BY turn), '\r?\n') AS lines FROM conversations GROUP BY conv_id),
      l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM t),
      m AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence, coalesce(sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
      h AS (SELECT *, NOT fence AND NOT inside AND regexp_matches(line, '^#{1,6}\s+.*$') AS heading FROM m),
      s AS (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
      g AS (SELECT doc_id, section, nullif(max(CASE WHEN heading THEN trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) END), '') AS label, trim(string_agg(line, chr(10) ORDER BY pos), chr(10) || ' ' || chr(9) || chr(13)) AS text FROM s GROUP BY ALL)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS ordinal, label, md5(text) AS text_md5 FROM g WHERE text <> ''""",
    "text_segments": r"SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE regexp_matches(text, '\S')",
    "csv_lines": """SELECT c_nationkey AS doc_id, md5(string_agg('name: ' || c_name || '; segment: ' || c_mktsegment || ', " x' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || ' y' ELSE '' END || '; : ' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '; col5: more' ELSE '' END, chr(10) ORDER BY c_custkey)) AS text_md5
      FROM customer GROUP BY c_nationkey""",
    "preview_page": "WITH s AS (SELECT doc_id, unnest(range(len(string_split(text, '.')))) AS ordinal, CAST(ceil(len(string_split(text, '.')) / 50) AS INTEGER) AS pages FROM documents) SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, pages FROM s WHERE ordinal BETWEEN 50 AND 99",
    "result_table_csv": f"""WITH {_ROWS}, lines AS (SELECT statement, pos, has, concat_ws(',', date, coalesce(value_date, ''), {_csv('description')}, {_money('cents')}, currency, coalesce({_money('balance')}, ''), pos) || CASE WHEN has THEN ',' || coalesce(category, '') ELSE '' END AS line FROM marked)
      SELECT statement, md5('date,valueDate,description,amount,currency,balanceAfter,sourcePage' || CASE WHEN any_value(has) THEN ',category' ELSE '' END || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY pos) || chr(13) || chr(10)) AS csv_md5, CAST(count(*) AS INTEGER) AS n_rows FROM lines GROUP BY statement""",
    "statement_json": f"""WITH {_ROWS}, items AS (SELECT *, '      "date": ' || {_str('date')} || ',' || {_nl} || '      "valueDate": ' || {_str('value_date')} || ',' || {_nl} || '      "description": ' || {_str('description')} || ',' || {_nl} || '      "amount": ' || {_num('cents')} || ',' || {_nl} || '      "currency": "EUR",' || {_nl} || '      "balanceAfter": ' || {_num('balance')} || ',' || {_nl} || '      "sourcePage": ' || pos || CASE WHEN has THEN ',' || {_nl} || '      "category": ' || {_str('category')} ELSE '' END AS item FROM marked),
      s AS (SELECT statement, string_agg('{{' || {_nl} || item || {_nl} || '    }}', ',' || {_nl} || '    ' ORDER BY pos) AS items, CAST(sum(greatest(cents, 0)) AS BIGINT) AS inflow, CAST(sum(greatest(-cents, 0)) AS BIGINT) AS outflow, count(*) AS n, last(balance ORDER BY pos) AS closing FROM items GROUP BY statement)
      SELECT statement, md5({_lines(["'{'", "'  \"openingBalance\": ' || CASE WHEN statement % 2 = 0 THEN '0' ELSE 'null' END || ','", "'  \"closingBalance\": ' || CASE WHEN statement % 2 = 0 THEN " + _num('closing') + " ELSE 'null' END || ','", "'  \"currency\": \"EUR\",'", "'  \"summary\": {'", "'    \"totalIn\": ' || " + _num('inflow') + " || ','", "'    \"totalOut\": ' || " + _num('outflow') + " || ','", "'    \"net\": ' || " + _num('(inflow - outflow)') + " || ','", "'    \"count\": ' || n || ','", "'    \"currency\": \"EUR\"'", "'  },'", "'  \"transactions\": ['", "'    ' || items", "'  ]'", "'}'"])}) AS json_md5 FROM s""",
    "invoice_exports": f"""WITH l AS (SELECT l_orderkey AS invoice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pos, l_returnflag || ', it''s <' || l_linestatus || '>' AS description, CAST(l_quantity * 100 AS BIGINT) AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN 1050 END AS unit_price, CASE WHEN l_linenumber % 3 = 0 THEN 700 END AS rate, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
      i AS (SELECT invoice, string_agg(concat_ws(',', {_csv('description')}, {_money('quantity')}, coalesce({_money('unit_price')}, ''), {_money('cents')}, 'EUR') || chr(13) || chr(10), '' ORDER BY pos) AS csv,
        string_agg('{{' || {_nl} || '      "description": ' || {_str('description')} || ',' || {_nl} || '      "quantity": ' || {_num('quantity')} || ',' || {_nl} || '      "unitPrice": ' || {_num('unit_price')} || ',' || {_nl} || '      "taxRatePercent": ' || {_num('rate')} || ',' || {_nl} || '      "lineTotal": ' || {_num('cents')} || ',' || {_nl} || '      "currency": "EUR"' || {_nl} || '    }}', ',' || {_nl} || '    ' ORDER BY pos) AS json,
        string_agg({_lines(["'    <lineItem>'", _tag(6, 'description', _esc('description')), _tag(6, 'quantity', _money('quantity')), _tag(6, 'unitPrice', _money('unit_price')), _tag(6, 'taxRatePercent', _money('rate')), _tag(6, 'lineTotal', _money('cents')), _tag(6, 'currency', "'EUR'"), "'    </lineItem>'"])}, {_nl} ORDER BY pos) AS xml FROM l GROUP BY invoice),
      o AS (SELECT o_orderkey AS invoice, 'Smith & <Sons> ' || o_orderpriority AS vendor, 'No. "' || o_orderkey || '"' AS number, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS due, CAST(round(o_totalprice * 100) AS BIGINT) AS net, CASE WHEN o_orderstatus = 'O' THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS gross FROM orders)
      SELECT o.invoice, md5('description,quantity,unitPrice,lineTotal,currency' || chr(13) || chr(10) || coalesce(csv, '')) AS csv_md5,
        md5({_lines(["'{'", "'  \"vendor\": ' || " + _str('vendor') + " || ','", "'  \"recipient\": null,'", "'  \"invoiceNumber\": ' || " + _str('number') + " || ','", "'  \"invoiceDate\": ' || " + _str('date') + " || ','", "'  \"dueDate\": ' || " + _str('due') + " || ','", "'  \"currency\": \"EUR\",'", "CASE WHEN json IS NULL THEN '  \"lineItems\": [],' ELSE '  \"lineItems\": [' || chr(10) || '    ' || json || chr(10) || '  ],' END", "'  \"totals\": {'", "'    \"netTotal\": ' || " + _num('net') + " || ','", "'    \"taxTotal\": null,'", "'    \"taxRatePercent\": 19,'", "'    \"grossTotal\": ' || " + _num('gross'), "'  }'", "'}'"])}) AS json_md5,
        md5({_lines(["'<?xml version=\"1.0\" encoding=\"UTF-8\"?>'", "'<invoice>'", _tag(2, 'vendor', _esc('vendor')), _tag(2, 'invoiceNumber', _esc('number')), _tag(2, 'invoiceDate', 'date'), _tag(2, 'dueDate', 'due'), _tag(2, 'currency', "'EUR'"), "'  <lineItems>'", 'xml', "'  </lineItems>'", "'  <totals>'", _tag(4, 'netTotal', _money('net')), _tag(4, 'taxRatePercent', "'19.00'"), _tag(4, 'grossTotal', _money('gross')), "'  </totals>'", "'</invoice>'", "''"])}) AS xml_md5
      FROM o LEFT JOIN i USING (invoice)""",
    "result_tables_latest": "SELECT user_id AS message_id, arg_max(event_id, (ts, event_id)) AS table_id, arg_max(event_id % 13 * 1000, (ts, event_id)) AS n_rows FROM events WHERE event_id % 13 * 1000 <= 10000 GROUP BY user_id",
}
