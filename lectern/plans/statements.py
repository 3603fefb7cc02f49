"""Queries that read printed figures, statements and invoices, and that mask personal data.

The texts are printed from the ledger and the orders in several notations, so that the SQL knows
what must be read from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import money as M
from lectern.operators import invoices, labels, ledger, redaction, skills, statement
from lectern.plans import tables
from lectern.plans.tables import LEDGER, table


def printed(cents: Column, style: Column) -> Column:
    """Cents in one of six notations: grouped by points, commas or apostrophes, the sign before, behind or as parentheses."""
    size = F.abs(cents)
    whole, rest = F.format_number(F.floor(size / 100), 0), F.lpad((size % 100).cast("string"), 2, "0")
    english, german, swiss = F.concat(whole, F.lit("."), rest), F.concat(F.replace(whole, F.lit(","), F.lit(".")), F.lit(","), rest), F.concat(F.replace(whole, F.lit(","), F.lit("’")), F.lit("."), rest)
    signed = lambda text: F.concat(F.when(cents < 0, "−").otherwise(""), text)
    return F.when(style == 0, signed(german)).when(style == 1, signed(english)).when(style == 2, signed(swiss)).when(style == 3, F.when(cents < 0, F.concat(F.lit("("), english, F.lit(")"))).otherwise(english)).when(style == 4, F.concat(german, F.when(cents < 0, "-").otherwise(""))).otherwise(F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(size / 100), F.lit(","), rest))


def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M3: order totals read back from their notations, and the figures of a line counted."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long") * F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)
    text = M.plain(printed(cents, F.col("o_orderkey") % 6))
    line = F.concat(F.lit("paid on 03.04.2021: "), text, F.lit(" of 17 or 1.5 and 2,50 EUR"))
    return table(spark, sf_dir, "orders").select("o_orderkey", M.amount(text).alias("cents"), F.size(M.figures(line)).cast("long").alias("figures"))


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6, M7: order dates read back; short ones take the year from an anchor, rolled over at new year."""
    d = F.col("o_orderdate")
    styles = [("yyyy-MM-dd", False), ("dd.MM.yyyy", False), ("MM/dd/yyyy", True), ("d.M.yyyy", False), ("dd.MM.yy", False), ("dd.MM.", False)]
    parsed = None
    for k, (form, month_first) in enumerate(styles):
        value = M.date(F.date_format(d, form), month_first, F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 11, 1).otherwise(0) if k == 5 else F.year("o_orderdate"), F.when(F.month("o_orderdate") >= 11, 1).otherwise(6) if k == 5 else 6)
        parsed = F.when(F.col("o_orderkey") % 7 == k, value) if parsed is None else parsed.when(F.col("o_orderkey") % 7 == k, value)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(parsed.otherwise(M.date(F.concat(F.lit("31.02."), F.year("o_orderdate")))), "yyyy-MM-dd").alias("day"))


def detect_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M8: the currency of a line, its total and its rate."""
    code = F.element_at(F.array(*map(F.lit, ("EUR", "NZD", "ABC", "CHF"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = F.concat(F.lit("INV "), F.col("o_orderkey"), F.lit(" at 19,5 % of "), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey"), F.lit(" $"))).otherwise(F.concat(printed(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(1)), F.lit(" "), code)))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return rows.select("o_orderkey", M.currency(F.col("line")).alias("currency"), M.total(F.col("line")).alias("cents"), M.percent(F.col("line")).alias("rate"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed statements: an opening line, a row for each order, the month first in every fourth, some with a second line, a closing line."""
    rows = tables.ledger(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderdate"), "row_id")
    us = F.col("statement") % 4 == 0
    day = F.when(us, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    style = F.when(us, 1).otherwise(0)
    line = F.concat(day, F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), day)).otherwise(""), F.lit(" Payment to shop  "), printed(F.col("cents"), style), F.coalesce(F.concat(F.lit("  "), printed(F.col("balance"), style)), F.lit("")), F.when(F.col("pos") % 5 == 0, "\n   reference of the card").otherwise(""))
    parts = rows.groupBy("statement").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"), F.sum("cents").alias("total"))
    money = lambda c: printed(c, F.when(us, 1).otherwise(0))
    text = F.concat(F.lit("Statement of account\nopening balance "), money(F.lit(0)), F.when(F.col("statement") % 3 == 0, " CHF").otherwise(" EUR"), F.lit("\n\n"), F.array_join("x.line", "\r\n"), F.lit("\nClosing balance "), money(F.col("total")), F.when(F.col("statement") % 3 == 0, " CHF").otherwise(" EUR"))
    return parts.select(F.col("statement").alias("doc_id"), text.alias("text"))


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of printed statements."""
    rows = statement.transactions(_statements(spark, sf_dir))
    return rows.select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("value_date", "yyyy-MM-dd").alias("value_date"), "description", "cents", "balance", "currency")


def statement_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing balances."""
    return statement.balances(_statements(spark, sf_dir))


def currency_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's currency."""
    return statement.currency_vote(statement.lines(_statements(spark, sf_dir)))


def date_order_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements write the month first, and whether they show it."""
    return statement.date_order(statement.lines(_statements(spark, sf_dir)))


def glyph_soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of scattered characters; every seventh has some lines of them."""
    docs = table(spark, sf_dir, "documents")
    soup = F.when(F.col("doc_id") % 7 == 0, "\nA r t\n1 0 % x\n\nS u m a b\nno t s o at all").otherwise("")
    return statement.glyph_soup(docs.select("doc_id", F.concat("text", soup).alias("text")))


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed invoices of orders: labelled header, lines with quantity and unit price, totals."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    line = F.concat(F.col("l_quantity").cast("int"), F.lit(" x Article "), "l_returnflag", "l_linestatus", F.lit("  "), printed(F.lit(1250).cast("long"), F.lit(0)), F.lit("  "), printed(cents, F.lit(0)))
    items = li.withColumn("pos", F.row_number().over(order)).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"), F.sum(cents).alias("net"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    head = F.concat(F.lit("Rechnung\nLieferant: Muster & Sohn\nKunde Nr. 7\nKunde: Customer "), "o_custkey", F.lit("\nRechnungsnummer: R-"), "o_orderkey", F.lit("\nDatum "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("\nzahlbar bis "), F.date_format("o_orderdate", "dd.MM.yyyy"))).otherwise(""))
    tail = F.concat(F.lit("\nNettobetrag EUR "), printed(F.col("net"), F.lit(0)), F.lit("\nUSt 20 % "), printed(F.round(F.col("net") * 0.2).cast("long"), F.lit(0)), F.lit("\nGesamtbetrag "), printed(F.round(F.col("net") * 1.2).cast("long"), F.lit(0)))
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.concat(head, F.lit("\n\n"), F.array_join("x.line", "\n"), tail).alias("text"))


def invoice_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled header of printed invoices."""
    rows = statement.invoice_header(_invoices(spark, sf_dir))
    return rows.select("doc_id", "vendor", "recipient", "number", F.date_format("date", "yyyy-MM-dd").alias("date"), F.date_format("due_date", "yyyy-MM-dd").alias("due_date"))


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of printed invoices."""
    found = invoices.items(invoices.classed(_invoices(spark, sf_dir), ("item",)))
    return found.select("doc_id", F.col("quantity").cast("long").alias("quantity"), "description", "unit_price", "cents")


def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of printed invoices."""
    return invoices.totals(invoices.classed(_invoices(spark, sf_dir), ("item", "totals")))


def _crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices whose columns run into the words, with totals of several labels in one line, in whole numbers that fit, or in such that don't."""
    li = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    q, unit = F.col("l_quantity").cast("int"), F.col("l_partkey") % 5000 + 100
    german = lambda c: printed(c.cast("long"), F.lit(0))
    rows = li.withColumn("pos", F.row_number().over(order)).withColumn("total", q * unit + F.when(F.col("pos") % 3 == 0, 1).otherwise(0))
    line = F.concat(F.col("pos").cast("string"), F.lit(" Part "), "l_returnflag", F.lit(" "), q, F.lit(" 20% "), german(unit), F.lit("  "), german(F.col("total")))
    line = F.concat(line, F.when(F.col("pos") % 4 == 0, "\n  in a second line\nand a third").otherwise(""), F.when(F.col("pos") == 2, "\nHosting 12,50 500\nWidget 10 100\nSumme 7,00 x\nSteuerberatung am 03.05.2026 500,00").otherwise(""))
    items = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"), F.sum("total").alias("net"))
    k, net = F.col("l_orderkey"), F.col("net")
    one = F.concat(F.lit("Netto "), german(net), F.lit(" MwSt 20,00 % "), german(F.round(net * 0.2)), F.lit(" Brutto "), german(net + F.round(net * 0.2)), F.lit(" EUR per 30.06.2026"))
    fits = F.concat(F.lit("Total (excl. tax) EUR "), k, F.lit("\nUSt 20% "), k * 2, F.lit(" EUR\nTotal (incl. tax) EUR "), k * 3)
    none = F.concat(F.lit("Net total € "), k, F.lit("\nTax 10% € 1,00\nTotal € "), k + 5)
    return items.select(k.alias("doc_id"), F.concat(F.lit("EUR\n"), F.array_join("x.line", "\n"), F.lit("\n"), F.when(k % 3 == 0, one).when(k % 3 == 1, fits).otherwise(none)).alias("text"))


def invoice_crowded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each figure of a line goes to its own label; weak totals stay only if the arithmetic lets them."""
    return invoices.totals(invoices.classed(_crowded(spark, sf_dir), ("item", "totals")))


def invoice_crowded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that run into the words, split off where quantity x price is the total, and what stays unread."""
    return invoices.items(invoices.classed(_crowded(spark, sf_dir), ("item",)), unread=True).drop("pos")


def currency_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: texts with two signs; the order of the table of signs decides, not that of the text."""
    sign = lambda d: F.element_at(F.array(*map(F.lit, ("€", "$", "£", "¥", "kr"))), (F.floor(F.col("o_orderkey") / d) % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("12 "), sign(1), F.lit(" or 11 "), sign(7)).alias("text"))
    return rows.select("o_orderkey", M.currency(F.col("text")).alias("currency"))


def categorize_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by rule of every part's name, with words in and at the edge of compounds."""
    text = F.concat("p_name", F.element_at(F.array(*map(F.lit, (" Kontogebühr", " feedback", " FEE!", " Mindestlohn", " Lohn 3", " SEPA-Zahlung", " xatm", " Bargeldbezug", " payroll"))), (F.col("p_partkey") % 9 + 1).cast("int")))
    cents = F.when(F.col("p_partkey") % 2 == 0, 100).otherwise(-100)
    return table(spark, sf_dir, "part").select("p_partkey", ledger.category(text, cents).alias("category"))


def transactions_with_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with the names of their categories; a row without one stays."""
    names = spark.createDataFrame([("O", "Income", 1), ("F", "Spending", 1)], "key string, name string, builtin int")
    rows = tables.ledger(spark, sf_dir).withColumn("category_id", F.right("description", F.lit(1)))
    return ledger.with_categories(rows, names.select(F.col("key").alias("category_id"), "name")).select("statement", "pos", "cents", F.col("name").alias("category"))


def taxonomy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of taxonomy files in several notations, some of them bad; and the file that a question names."""
    k = F.col("n_nationkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("Kategorie;Hinweis\n# note\nRent;flat, house;\n"), F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))), F.lit("\nRENT;twice\n"))).when(k % 5 == 1, "Food\tshop\nFun\n").when(k % 5 == 2, "Only one\n").when(k % 5 == 3, "Good,a,b\n1 bad\n").otherwise('"Food", "super market"\nTravel by train or ship\n')
    rows = table(spark, sf_dir, "nation").select(k.alias("doc_id"), text.alias("text"))
    ask = F.when(k % 3 == 0, 'Categorize by "in/my list.csv", please').when(k % 3 == 1, "kategorisiere nach (work\\\\k.csv").otherwise("open list.csv")
    asked = table(spark, sf_dir, "nation").select(k.alias("doc_id"), labels.taxonomy_file(ask).alias("file"))
    shown = F.array_join(F.transform("categories", lambda c: F.concat_ws("=", c["name"], c["gloss"])), "|")
    return labels.taxonomy(rows).select("doc_id", shown.alias("categories")).join(asked, "doc_id")


def _choose(descriptions: list[str]) -> list[str | None]:
    """A stand-in for a model: it fails on some batches and knows two words."""
    return [None if "5-" in d else "Rent" if "1-" in d else "Unknown" for d in descriptions]


def categorized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows categorised by a function within a set of one's own, with a derived column."""
    rows = labels.categorised(tables.ledger(spark, sf_dir).select("statement", "pos", "cents", "description"), ["Rent", "Food"], _choose)
    made = labels.enriched(rows, {"size": ["small", "large"]}, lambda name, batch: ["huge" if abs(r["cents"]) > 30_000_000 else "large" if abs(r["cents"]) > 10_000_000 else "small" for r in batch])
    return made.groupBy("category", "size").agg(F.count("*").alias("n"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter for each customer with data of every kind, some of it not quite right."""
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("Dear "), "c_name", F.lit(", write to cust."), k, F.lit("@mail.example.com or see https://shop.example.com/c?id="), k, F.lit(" (no@mail). Pay to DE89 3704 0044 0532 0130 00 with card "),
        F.when(k % 2 == 0, "4111 1111 1111 1111").otherwise("4111 1111 1111 1112"), F.lit(" by "), F.when(k % 3 == 0, "2024-02-30").otherwise("31.12.2024"), F.lit(" or 2024-13-45, call +49 171 234567"), F.when(k % 5 == 0, " or (555) 123-4567").otherwise(" or 12345"), F.lit("."),
    )
    return tables.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name")).select(k.alias("doc_id"), text.alias("text"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked letters and what was masked."""
    return redaction.redacted(_personal(spark, sf_dir))


def redact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names swept at every place, then all other data."""
    letters = _personal(spark, sf_dir)
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(F.struct(F.col("c_name").alias("entity"), F.lit("name").alias("category")), F.struct(F.lit("card").alias("entity"), F.lit("other").alias("category")), F.struct(F.lit("Nobody").alias("entity"), F.lit("org").alias("category")), F.struct(F.lit("no").alias("entity"), F.lit("org").alias("category")))).alias("e")).select("doc_id", "e.*")
    found = redaction.redacted_with(letters, entities)
    return found.select("doc_id", F.left("text", F.lit(24)).alias("start"), "name", "org", "other", "masked", "dropped", "email")


SQL_TOOLS = [
    skills.SqlTool("personal_data", redaction.found, ("string",), "kind string, at int, length int, found string", rows=True),
    skills.SqlTool("mask_personal", lambda text: redaction.redact(text or "")[0], ("string",), "string"),
    skills.SqlTool("text_hash", lambda text, key: f"{key}:{len(text)}", ("string", "bigint"), "string"),
]


def sql_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.14: a user's functions in SQL text, one of rows and two of values."""
    skills.register_sql(spark, SQL_TOOLS)
    _personal(spark, sf_dir).createOrReplaceTempView("letters_for_tools")
    return spark.sql("""SELECT l.doc_id, p.kind, count(*) AS n, min(p.at) AS first_at, max(p.length) AS longest, min(p.found) AS found, max(mask_personal(l.text)) AS masked, max(text_hash(l.text, l.doc_id)) AS key
      FROM letters_for_tools l, LATERAL personal_data(l.text) p GROUP BY l.doc_id, p.kind""").select("doc_id", "kind", "n", "first_at", "longest", "found", F.md5(F.col("masked").cast("binary")).alias("masked"), "key")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: addresses and links of every document, by language."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("lang", *redaction.counts(F.col("text"))).groupBy("lang").agg(F.sum("emails").alias("emails"), F.sum("urls").alias("urls"))


QUERIES = {f.__name__: f for f in (parse_amount, parse_date, detect_currency, statement_rows, statement_balances, currency_vote, date_order_vote, glyph_soup, invoice_header, invoice_items, invoice_totals, invoice_crowded_totals, invoice_crowded_items, currency_signs, categorize_rules, transactions_with_categories, taxonomy_files, categorized_rows, redact_text, redact_entities, sql_tools, pii_counts)}

_DAYS = f"""{LEDGER}, days AS (SELECT l.*, o_orderdate AS d, l.statement % 4 = 0 AS us FROM ledger l JOIN orders ON o_orderkey = row_id),
  votes AS (SELECT statement, bool_or(us AND day(d) > 12) AS month_first, bool_or(day(d) > 12) AS shown FROM days GROUP BY statement)"""

_CROWDED = """r AS (SELECT l_orderkey AS k, l_returnflag AS flag, CAST(l_quantity AS BIGINT) AS q, l_partkey % 5000 + 100 AS unit, CAST(l_quantity AS BIGINT) * (l_partkey % 5000 + 100) + CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS total, pos
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS pos FROM lineitem))"""

ORACLE_SQL = {
    "parse_amount": "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS cents, CAST(2 AS BIGINT) AS figures FROM orders",
    "parse_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "detect_currency": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE ['EUR', 'NZD', NULL, 'CHF'][o_orderkey % 4 + 1] END AS currency, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 100 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS cents, 19.5::DOUBLE AS rate FROM orders",
    "statement_rows": f"""WITH {_DAYS}, r AS (SELECT d.*, CASE WHEN NOT us OR month_first THEN d.d WHEN us THEN make_date(year(d.d), day(d.d), month(d.d)) END AS parsed FROM days d JOIN votes USING (statement))
      SELECT statement AS doc_id, strftime(parsed, '%Y-%m-%d') AS date, CASE WHEN pos % 3 = 0 THEN strftime(parsed, '%Y-%m-%d') END AS value_date, 'Payment to shop' || CASE WHEN pos % 5 = 0 THEN ' reference of the card' ELSE '' END AS description, cents, balance, CASE WHEN statement % 3 = 0 THEN 'CHF' ELSE 'EUR' END AS currency FROM r""",
    "statement_balances": f"WITH {LEDGER} SELECT statement AS doc_id, CAST(0 AS BIGINT) AS opening, CAST(sum(cents) AS BIGINT) AS closing FROM ledger GROUP BY statement",
    "currency_vote": f"WITH {LEDGER} SELECT DISTINCT statement AS doc_id, CASE WHEN statement % 3 = 0 THEN 'CHF' ELSE 'EUR' END AS doc_currency FROM ledger",
    "date_order_vote": f"WITH {_DAYS} SELECT statement AS doc_id, month_first, CASE WHEN shown THEN 'evidence' ELSE 'default' END AS inferred FROM votes",
    "glyph_soup": r"""WITH l AS (SELECT doc_id, trim(unnest(string_split_regex(text || CASE WHEN doc_id % 7 = 0 THEN E'\nA r t\n1 0 % x\n\nS u m a b\nno t s o at all' ELSE '' END, '\r?\n')), E' \t') AS line FROM documents),
      w AS (SELECT doc_id, line, string_split_regex(line, '\s+') AS w FROM l WHERE line <> ''),
      s AS (SELECT doc_id, regexp_matches(line, '(?:^|\s)\S\s+\S\s+\S(?:\s|$)') OR (len(w) >= 6 AND len(list_filter(w, lambda x: length(x) = 1)) / len(w) >= 0.45) AS scattered FROM w)
      SELECT doc_id, count(*) AS lines, count(*) FILTER (scattered) AS scattered, count(*) FILTER (scattered) >= 3 AND count(*) FILTER (scattered) / count(*) >= 0.2 AS suspect FROM s GROUP BY doc_id""",
    "invoice_header": "SELECT o_orderkey AS doc_id, 'Muster & Sohn' AS vendor, 'Customer ' || o_custkey AS recipient, 'R-' || o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS due_date FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "invoice_items": "SELECT l_orderkey AS doc_id, CAST(l_quantity AS BIGINT) AS quantity, 'Article ' || l_returnflag || l_linestatus AS description, CAST(1250 AS BIGINT) AS unit_price, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    "invoice_totals": "WITH n AS (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS net FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey AS doc_id, net, CAST(round(net * 0.2::DOUBLE) AS BIGINT) AS tax, CAST(round(net * 1.2::DOUBLE) AS BIGINT) AS gross, 20.0::DOUBLE AS rate FROM n WHERE l_orderkey IN (SELECT o_orderkey FROM orders)",
    "invoice_crowded_totals": f"""WITH {_CROWDED}, n AS (SELECT k, CAST(sum(total) AS BIGINT) AS net, count(*) + 1 AS n FROM r GROUP BY k),
      t AS (SELECT *, CAST(round(net * 0.2::DOUBLE) AS BIGINT) AS tax FROM n)
      SELECT k AS doc_id, CASE k % 3 WHEN 0 THEN net WHEN 1 THEN k * 100 ELSE CASE WHEN abs(k * 10 - 100) <= greatest(1.0, n * 0.5) + 0.5 OR k = net + 50000 THEN k * 100 END END AS net,
        CASE k % 3 WHEN 0 THEN tax WHEN 1 THEN k * 200 ELSE 100 END AS tax, CASE k % 3 WHEN 0 THEN net + tax WHEN 1 THEN k * 300 END AS gross, CASE k % 3 WHEN 1 THEN 20.0::DOUBLE WHEN 2 THEN 10.0::DOUBLE END AS rate FROM t""",
    "invoice_crowded_items": f"""WITH {_CROWDED}, i AS (
        SELECT k, CASE WHEN pos % 3 = 0 THEN pos || ' Part ' || flag || ' ' || q || ' 20%' ELSE 'Part ' || flag END || CASE WHEN pos % 4 = 0 THEN ' in a second line' ELSE '' END AS description,
          CASE WHEN pos % 3 <> 0 THEN CAST(q AS DOUBLE) END AS quantity, CASE WHEN pos % 3 <> 0 THEN 20.0::DOUBLE END AS tax_rate, unit AS unit_price, total AS cents FROM r
        UNION ALL SELECT k, 'Steuerberatung am 03.05.2026', NULL, NULL, NULL, 50000 FROM r WHERE pos = 2)
      SELECT k AS doc_id, description, quantity, tax_rate, unit_price, cents, 'EUR' AS currency, CAST(CASE WHEN k IN (SELECT k FROM r WHERE pos = 2) THEN 2 ELSE 0 END AS BIGINT) AS dropped FROM i""",
    "currency_signs": "SELECT o_orderkey, ['EUR', 'USD', 'GBP', 'JPY', NULL][least(o_orderkey % 5, o_orderkey // 7 % 5) + 1] AS currency FROM orders",
    "categorize_rules": "SELECT p_partkey, ['Fees', NULL, 'Fees', NULL, 'Income', 'Transfer', NULL, 'Cash', 'Income'][p_partkey % 9 + 1] AS c, coalesce(c, CASE WHEN p_partkey % 2 = 0 THEN 'Income' ELSE 'Spending' END) AS category FROM part",
    "transactions_with_categories": f"WITH {LEDGER} SELECT statement, pos, cents, CASE right(description, 1) WHEN 'O' THEN 'Income' WHEN 'F' THEN 'Spending' END AS category FROM ledger",
    "taxonomy_files": r"""SELECT n_nationkey AS doc_id, CASE n_nationkey % 5 WHEN 0 THEN 'Rent=flat, house|' || (SELECT string_agg(upper(left(w, 1)) || lower(substr(w, 2)), ' ') FROM (SELECT unnest(string_split(replace(n_name, '_', ' '), ' ')) AS w)) WHEN 1 THEN 'Food=shop|Fun' END AS categories,
      CASE n_nationkey % 3 WHEN 0 THEN 'my list.csv' WHEN 1 THEN 'k.csv' END AS file FROM nation""",
    "categorized_rows": f"WITH {LEDGER} SELECT CASE WHEN description LIKE '1-%' THEN 'Rent' ELSE 'Uncategorized' END AS category, CASE WHEN abs(cents) > 30000000 THEN '' WHEN abs(cents) > 10000000 THEN 'large' ELSE 'small' END AS size, count(*) AS n FROM ledger GROUP BY ALL",
    "redact_text": """SELECT c_custkey AS doc_id, 'Dear ' || c_name || ', write to [EMAIL] or see [URL] (no@mail). Pay to [IBAN] with card ' || CASE WHEN c_custkey % 2 = 0 THEN '[CARD]' ELSE '4111 1111 1111 1112' END || ' by [DATE] or 2024-13-45, call [PHONE]' || CASE WHEN c_custkey % 5 = 0 THEN ' or [PHONE].' ELSE ' or 12345.' END AS text,
      1 AS email, 1 AS url, 1 AS iban, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS card, 1 AS date, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS phone FROM customer""",
    "redact_entities": "SELECT c_custkey AS doc_id, left('Dear [NAME], write to [EMAIL]', 24) AS start, 1 AS name, 0 AS org, 1 AS other, 2 AS masked, 2 AS dropped, 1 AS email FROM customer",
    "sql_tools": """WITH t AS (SELECT c_custkey AS k, 'Dear ' || c_name || ', write to cust.' AS a, c_custkey || '@mail.example.com' AS m, ' or see ' AS b, 'https://shop.example.com/c?id=' || c_custkey AS u, ' (no@mail). Pay to ' AS c, 'DE89 3704 0044 0532 0130 00' AS i, ' with card ' AS d,
        CASE WHEN c_custkey % 2 = 0 THEN '4111 1111 1111 1111' ELSE '4111 1111 1111 1112' END AS card, ' by ' AS e, CASE WHEN c_custkey % 3 = 0 THEN '2024-02-30' ELSE '31.12.2024' END AS day, ' or 2024-13-45, call ' AS f, '+49 171 234567' AS p, CASE WHEN c_custkey % 5 = 0 THEN ' or ' ELSE ' or 12345' END AS g, CASE WHEN c_custkey % 5 = 0 THEN '(555) 123-4567' ELSE '' END AS q FROM customer),
      w AS (SELECT *, a || m || b || u || c || i || d || card || e || day || f || p || g || q || '.' AS whole, regexp_replace(a, 'cust\\.$', '') || '[EMAIL]' || b || '[URL]' || c || '[IBAN]' || d || CASE WHEN k % 2 = 0 THEN '[CARD]' ELSE card END || e || '[DATE]' || f || '[PHONE]' || g || CASE WHEN q = '' THEN '' ELSE '[PHONE]' END || '.' AS masked FROM t),
      r AS (SELECT k, 'email' AS kind, length(a) - 5 AS place, 'cust.' || m AS found FROM w UNION ALL SELECT k, 'url', length(a || m || b), u FROM w UNION ALL SELECT k, 'iban', length(a || m || b || u || c), i FROM w
        UNION ALL SELECT k, 'card', length(a || m || b || u || c || i || d), card FROM w WHERE k % 2 = 0 UNION ALL SELECT k, 'date', length(a || m || b || u || c || i || d || card || e), day FROM w
        UNION ALL SELECT k, 'phone', length(a || m || b || u || c || i || d || card || e || day || f), p FROM w UNION ALL SELECT k, 'phone', length(a || m || b || u || c || i || d || card || e || day || f || p || g), q FROM w WHERE q <> '')
      SELECT r.k AS doc_id, kind, count(*) AS n, CAST(min(place) AS INTEGER) AS first_at, CAST(max(length(found)) AS INTEGER) AS longest, min(found) AS found, md5(any_value(masked)) AS masked, any_value(whole) AS whole FROM r JOIN w ON r.k = w.k GROUP BY r.k, kind""",
    "pii_counts": r"""WITH e AS (SELECT lang, text, len(regexp_extract_all(text, '[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,63}')) AS emails,
        len(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,63}', '[EMAIL]', 'g'), '(?i)\b(?:https?://|www\.)[^\s<>(),;]+')) AS urls FROM documents)
      SELECT lang, CAST(sum(emails) AS BIGINT) AS emails, CAST(sum(urls) AS BIGINT) AS urls FROM e GROUP BY lang""",
}
ORACLE_SQL["categorize_rules"] = f"SELECT p_partkey, category FROM ({ORACLE_SQL['categorize_rules']})"
ORACLE_SQL["sql_tools"] = f"SELECT doc_id, kind, n, first_at, longest, found, masked, doc_id || ':' || length(whole) AS key FROM ({ORACLE_SQL['sql_tools']})"
