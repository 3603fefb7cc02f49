"""Tables, statements and invoices as CSV, JSON and XML texts, and result tables of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

MOST_ROWS = 10_000


def two_places(cents: Column) -> Column:
    """Whole cents as a number with two decimals and a point."""
    return F.when(cents.isNotNull(), F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(F.abs(cents) / 100).cast("string"), F.lit("."), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0")))


def cell(value: Column, kind: str) -> Column:
    """A CSV cell: ``money`` is in whole cents, ``integer`` bare, ``text`` made harmless; null is empty."""
    made = two_places(value) if kind == "money" else value.cast("string") if kind == "integer" else T.csv_field(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), made), F.lit(""))


def table_csv(rows: DataFrame, columns: list[tuple[str, str, str]], key: str, order: str) -> DataFrame:
    """A CSV text (key, csv, n_rows) for each key; ``columns`` lists (column, label, kind).

    Lines end with CR LF, the last one too. A table is one text, so it must be of a size for one.
    """
    lines = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, csv_line(columns).alias("line")))).alias("x"))
    return lines.select(key, csv_text(columns, F.col("x.line")).alias("csv"), F.size("x").alias("n_rows"))


def csv_line(columns: list[tuple[str, str, str]]) -> Column:
    """A row as a line of CSV."""
    return F.concat_ws(",", *(cell(F.col(c), kind) for c, _, kind in columns))


def csv_text(columns: list[tuple[str, str, str]], lines: Column) -> Column:
    """A CSV text of finished lines under the labels."""
    head = F.concat_ws(",", *(T.csv_field(F.lit(label)) for _, label, _ in columns))
    return F.concat(F.array_join(F.concat(F.array(head), lines), "\r\n"), F.lit("\r\n"))


TRANSACTION = [("date", "date", "text"), ("value_date", "valueDate", "text"), ("description", "description", "text"), ("cents", "amount", "money"), ("currency", "currency", "text"), ("balance", "balanceAfter", "money"), ("page", "sourcePage", "integer")]


def transactions_csv(rows: DataFrame, key: str = "statement", order: str = "pos") -> DataFrame:
    """Each statement's rows as CSV; the column category only where a row of the statement has one."""
    has = F.max(F.col("category").isNotNull()).over(W.partitionBy(key))
    marked = rows.withColumn("_has", has)
    plain = table_csv(marked.where("NOT _has"), TRANSACTION, key, order)
    return plain.unionByName(table_csv(marked.where("_has"), [*TRANSACTION, ("category", "category", "text")], key, order))


def _number(cents: Column) -> Column:
    """A JSON number as it is written: no zeros behind the last decimal."""
    text = two_places(cents)
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, r"(\.\d)0$", "$1"), r"\.0$", ""), F.lit("null"))


def _string(value: Column) -> Column:
    """A JSON string or null."""
    made = F.to_json(F.struct(value.cast("string").alias("v")))
    quoted = F.substr(made, F.lit(len('{"v":') + 1), F.length(made) - len('{"v":}'))
    return F.when(value.isNull(), "null").otherwise(quoted)


def _object(fields: list[tuple[str, Column]], indent: int) -> Column:
    """A JSON object over several lines, its names ``indent`` blanks from the left."""
    pad = " " * indent
    lines = F.array(*(F.concat(F.lit(f'{pad}"{name}": '), value) for name, value in fields))
    return F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n" + pad[2:] + "}"))


def _list(items: Column, indent: int) -> Column:
    """A JSON array over several lines of finished items; empty as []."""
    pad = " " * indent
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[\n" + pad), F.array_join(items, ",\n" + pad), F.lit("\n" + pad[2:] + "]")))


def statement_json(rows: DataFrame, balances: DataFrame, key: str = "statement", order: str = "pos") -> DataFrame:
    """Each statement as JSON: balances, summary and transactions, absent fields null, two blanks a level."""
    shared = F.max(F.col("category").isNotNull()).over(W.partitionBy(key))
    fields = [("date", _string(F.col("date"))), ("valueDate", _string(F.col("value_date"))), ("description", _string(F.col("description"))), ("amount", _number(F.col("cents"))), ("currency", _string(F.col("currency"))), ("balanceAfter", _number(F.col("balance"))), ("sourcePage", F.coalesce(F.col("page").cast("string"), F.lit("null")))]
    item = F.when(F.col("_has"), _object([*fields, ("category", _string(F.col("category")))], 6)).otherwise(_object(fields, 6))
    one = F.when(F.min("currency") == F.max("currency"), F.min("currency"))
    made = rows.withColumn("_has", shared).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(order, item.alias("item")))).alias("x"), F.sum(F.when(F.col("cents") > 0, F.col("cents")).otherwise(0)).alias("inflow"), F.sum(F.when(F.col("cents") < 0, -F.col("cents")).otherwise(0)).alias("outflow"), one.alias("currency"),
    )
    made = made.join(balances.select(key, "opening", "closing"), key, "left")
    currency = _string(F.col("currency"))
    summary = _object([("totalIn", _number(F.col("inflow"))), ("totalOut", _number(F.col("outflow"))), ("net", _number(F.col("inflow") - F.col("outflow"))), ("count", F.size("x").cast("string")), ("currency", currency)], 4)
    whole = _object([("openingBalance", _number(F.col("opening"))), ("closingBalance", _number(F.col("closing"))), ("currency", currency), ("summary", summary), ("transactions", _list(F.col("x.item"), 4))], 2)
    return made.select(key, whole.alias("json"))


LINE_ITEM = [("description", "description", "text"), ("quantity", "quantity", "money"), ("unit_price", "unitPrice", "money"), ("cents", "lineTotal", "money"), ("currency", "currency", "text")]
#: Columns of an invoice's header and totals with the names they are exported under.
HEADER = [("vendor", "vendor"), ("recipient", "recipient"), ("number", "invoiceNumber"), ("date", "invoiceDate"), ("due_date", "dueDate"), ("currency", "currency")]
TOTALS = [("net", "netTotal"), ("tax", "taxTotal"), ("rate", "taxRatePercent"), ("gross", "grossTotal")]


def _escaped(value: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        value = F.replace(value, F.lit(sign), F.lit(f"&{name};"))
    return value


def invoice_exports(invoices: DataFrame, lines: DataFrame, key: str = "invoice", order: str = "pos") -> DataFrame:
    """Each invoice as CSV of its lines, as JSON and as XML.

    ``invoices`` has the columns of HEADER and TOTALS, ``lines`` description, quantity, unit_price,
    rate, cents and currency; figures are in hundredths, nulls where not printed.
    """
    json_item = _object([("description", _string(F.col("description"))), ("quantity", _number(F.col("quantity"))), ("unitPrice", _number(F.col("unit_price"))), ("taxRatePercent", _number(F.col("rate"))), ("lineTotal", _number(F.col("cents"))), ("currency", _string(F.col("currency")))], 6)
    element = lambda name, value, indent: F.concat(F.lit(" " * indent + f"<{name}>"), value, F.lit(f"</{name}>"))
    inner = [element("description", _escaped(F.col("description")), 6), *(element(n, two_places(F.col(c)), 6) for c, n in (("quantity", "quantity"), ("unit_price", "unitPrice"), ("rate", "taxRatePercent"), ("cents", "lineTotal"))), element("currency", _escaped(F.col("currency")), 6)]
    xml_item = F.concat_ws("\n", F.lit("    <lineItem>"), *inner, F.lit("    </lineItem>"))
    # the three texts of a line go through one grouping
    items = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, csv_line(LINE_ITEM).alias("line"), json_item.alias("json"), xml_item.alias("xml")))).alias("x"))
    rows = invoices.join(items, key, "left")
    found = F.coalesce(F.col("x"), F.array().cast(rows.schema["x"].dataType))
    totals = _object([(n, _number(F.col(c))) for c, n in TOTALS], 4)
    json = _object([*((n, _string(F.col(c))) for c, n in HEADER), ("lineItems", _list(F.transform(found, lambda i: i["json"]), 4)), ("totals", totals)], 2)
    xml = F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit("<invoice>"), *(element(n, _escaped(F.col(c)), 2) for c, n in HEADER), F.lit("  <lineItems>"),
        F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda i: i["xml"]), "\n")), F.lit("  </lineItems>"), F.lit("  <totals>"), *(element(n, two_places(F.col(c)), 4) for c, n in TOTALS), F.lit("  </totals>"), F.lit("</invoice>"), F.lit(""),
    )
    return rows.select(key, csv_text(LINE_ITEM, F.transform(found, lambda i: i["line"])).alias("csv"), json.alias("json"), xml.alias("xml"))


def result_tables(tables: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """What is kept of result tables (message_id, table_id, created_at, n_rows, ...): the newest of each message, none that is too long."""
    rank = F.row_number().over(W.partitionBy("message_id").orderBy(F.col("created_at").desc(), F.col("table_id").desc()))
    return tables.where(F.col("n_rows") <= most_rows).withColumn("_n", rank).where("_n = 1").drop("_n")
