"""Statements and invoices: balances, totals, categories and checks. Amounts are whole cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

# The built-in category rules, in order (category, word, may stand within a compound).
CATEGORY_RULES: tuple[tuple[str, str, bool], ...] = (
    ("Fees", "fee", False), ("Fees", "gebühr", True), ("Fees", "charge", False),
    ("Income", "salary", False), ("Income", "gehalt", True), ("Income", "lohn", False), ("Income", "payroll", False),
    ("Transfer", "transfer", False), ("Transfer", "überweisung", True), ("Transfer", "sepa", False),
    ("Cash", "atm", False), ("Cash", "bargeld", True), ("Cash", "withdrawal", False),
)


def reconciled(rows: DataFrame) -> DataFrame:
    """Rows (statement, pos, cents, balance, currency) with status and expected balance.

    A printed balance is expected to be the last one printed before plus all amounts since.
    The first printed one only sets the baseline; with several currencies nothing is known.
    """
    order = W.partitionBy("statement").orderBy("pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("cents").over(order.rowsBetween(W.unboundedPreceding, 0))
    found = rows.withColumn("total", total)
    found = found.withColumn("last_balance", F.last("balance", ignorenulls=True).over(before)).withColumn("last_total", F.last(F.when(F.col("balance").isNotNull(), F.col("total")), ignorenulls=True).over(before))
    found = found.withColumn("expected", F.col("last_balance") + F.col("total") - F.col("last_total"))
    mixed = F.min("currency").over(W.partitionBy("statement")) != F.max("currency").over(W.partitionBy("statement"))
    status = F.when(mixed | F.col("balance").isNull() | F.col("expected").isNull(), "unknown").when(F.col("balance") == F.col("expected"), "ok").otherwise("mismatch")
    return found.withColumn("status", status).drop("total", "last_balance", "last_total")


def reconciliation(checked: DataFrame) -> DataFrame:
    """Per statement how many rows tie, and whether it is reconciled."""
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return checked.groupBy("statement").agg(count("ok"), count("mismatch"), count("unknown")).withColumn("reconciled", (F.col("mismatch") == 0) & (F.col("ok") > 0))


def completeness(checked: DataFrame, balances: DataFrame) -> DataFrame:
    """Whether a statement is complete, given its opening and closing balance."""
    sums = checked.groupBy("statement").agg(F.sum("cents").alias("total"), F.max((F.col("status") == "mismatch").cast("int")).alias("bad"), (F.min("currency") != F.max("currency")).alias("mixed"))
    rows = sums.join(balances, "statement", "left")
    verdict = F.when(F.col("mixed"), "unverified").when(F.col("bad") == 1, "contradicted").when(F.col("opening").isNull() | F.col("closing").isNull(), "unverified").when(F.col("opening") + F.col("total") == F.col("closing"), "complete").otherwise("contradicted")
    return rows.select("statement", verdict.alias("verdict"))


def cashflow(rows: DataFrame) -> DataFrame:
    """Inflow, outflow and net by statement; the currency only if there is one."""
    inflow, outflow = (F.sum(F.when(c, F.abs("cents")).otherwise(0)) for c in (F.col("cents") > 0, F.col("cents") < 0))
    found = rows.groupBy("statement").agg(inflow.alias("inflow"), outflow.alias("outflow"), F.when(F.min("currency") == F.max("currency"), F.min("currency")).alias("currency"), F.count("*").alias("rows"))
    return found.withColumn("net", F.col("inflow") - F.col("outflow"))


def category(description: Column, cents: Column) -> Column:
    """The first matching rule's category; else income, spending or none by the sign."""
    low = F.lower(description)
    found = None
    for name, word, compound in CATEGORY_RULES:
        hit = low.rlike(T.word_pattern(word, compound))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found.when(cents > 0, "Income").when(cents < 0, "Spending").otherwise("Uncategorized")


def category_totals(rows: DataFrame) -> DataFrame:
    """Totals by category and currency, in the order in which they first occur."""
    return rows.groupBy("category", "currency").agg(F.sum("cents").alias("cents"), F.count("*").alias("rows"), F.min("row_id").alias("first_row"))


def invoice_checks(lines: DataFrame, totals: DataFrame, keys: str = "invoice") -> DataFrame:
    """Per invoice: do the items make the net, net and tax the gross, and the rate the tax?

    ``lines`` has cents, ``totals`` net, tax, gross in cents and rate in percent, nulls where
    not printed. The tolerance is a cent, or half a cent for each line where that is more,
    and half a cent on top.
    """
    sums = lines.groupBy(keys).agg(F.sum("cents").alias("items"), F.count("*").alias("n"))
    rows = totals.join(sums, keys, "left")
    slack = F.greatest(F.lit(1.0), F.coalesce("n", F.lit(0)) * 0.5) + 0.5
    check = lambda have, want: F.when(have.isNull() | want.isNull(), "unknown").when(F.abs(have - want) <= slack, "ok").otherwise("mismatch")
    net, tax, gross = F.col("net"), F.col("tax"), F.col("gross")
    return rows.select(keys, check(F.col("items"), net).alias("items_net"), check(net + tax, gross).alias("net_gross"), check(net * F.col("rate") / 100, tax).alias("rate_tax"))


def with_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Transactions with the name of their category (category_id, name); null for one that is unknown or not given."""
    return rows.join(categories.select("category_id", "name"), "category_id", "left")
