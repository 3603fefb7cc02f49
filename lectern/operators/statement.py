"""Bank statement rows and invoice headers out of text lines.

Lines are exploded with their position, and each is read by expressions alone; what depends
on the whole document (its currency, its date order, whether balances are printed) is a
grouped vote that joins back. Nothing is guessed: a line without figure, description or
currency is no row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import money as M
from lectern.functions import text as T

# Labels of balance lines, lower case.
OPENING = ("opening balance", "balance brought forward", "previous balance", "starting balance", "alter kontostand", "alter saldo", "anfangssaldo", "saldovortrag", "kontostand alt", "saldo alt")
CLOSING = ("closing balance", "balance carried forward", "new balance", "ending balance", "final balance", "neuer kontostand", "neuer saldo", "endsaldo", "schlusssaldo", "kontostand neu", "saldo neu")
PERIOD = ("kontostand per", "kontostand am", "kontostand zum")


def lines(documents: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, line) that aren't blank."""
    rows = documents.select("doc_id", F.posexplode(F.split(M.plain(F.col("text")), r"\r?\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "")


def _any(labels: tuple[str, ...]):
    return F.lower("line").rlike("|".join(labels))


def _vote() -> Column:
    """The currency that a line votes for: that of what follows its first figure or of a code right before it, else of the line."""
    figure = F.regexp_extract(M.without_dates(F.col("line")), f"((?:[A-Z]{{3}}|[€$£¥])?\\s?{M.FIGURE}.*)$", 1)
    return M.currency(M.once(figure, lambda f: F.when(f != "", f).otherwise(F.col("line"))))


def _orders(has: Column | None = None) -> Column:
    """How many dates of a line show the month first (us), the day first (eu), or either (open); lines with figures have their leading dates only."""
    has = F.size(M.figures(F.col("line"))) > 0 if has is None else has
    part = F.when(has, F.regexp_extract("line", rf"^\s*((?:{M.DATE})(?:\s+(?:{M.DATE}))?)", 1)).otherwise(F.col("line"))
    pairs = F.transform(F.regexp_extract_all(part, F.lit(r"(?<![\d.])(\d{1,2}[./]\d{1,2})[./]"), F.lit(1)), lambda d: F.transform(F.split(d, "[./]"), lambda n: n.cast("int")))

    def counted(found: Column) -> Column:
        count = lambda test: F.size(F.filter(found, lambda p: test(p[0], p[1]))).cast("long")
        return F.struct(count(lambda a, b: (b > 12) & (b <= 31) & (a <= 12)).alias("us"), count(lambda a, b: (a > 12) & (a <= 31) & (b <= 12)).alias("eu"), count(lambda a, b: (a <= 12) & (b <= 12)).alias("open"))

    return M.once(pairs, counted)


def with_currency(rows: DataFrame) -> DataFrame:
    """Lines (doc_id, pos, ...) with ``doc_currency``, as ``currency_vote`` gives it, by windows over lines that are dealt out once."""
    rows = M.settled(rows, _vote=_vote())
    same = W.partitionBy("doc_id", "_vote")
    rows = rows.withColumn("_n", F.count("_vote").over(same)).withColumn("_first", F.min("pos").over(same))
    return rows.withColumn("doc_currency", F.max_by("_vote", F.when(F.col("_vote").isNotNull(), F.struct("_n", -F.col("_first")))).over(W.partitionBy("doc_id"))).drop("_vote", "_n", "_first")


def currency_vote(rows: DataFrame) -> DataFrame:
    """Each document's currency: that of most lines, the earliest on a tie."""
    votes = rows.select("doc_id", "pos", _vote().alias("currency")).where("currency IS NOT NULL")
    counted = votes.groupBy("doc_id", "currency").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("doc_id").agg(F.max_by("currency", F.struct("n", -F.col("first"))).alias("doc_currency"))


def date_order(rows: DataFrame) -> DataFrame:
    """Whether a document writes the month first, and whether its dates show it; documents without such dates are left out."""
    votes = rows.select("doc_id", _orders().alias("o")).groupBy("doc_id").agg(*(F.sum(f"o.{k}").alias(k) for k in ("us", "eu", "open"))).where("us + eu + open > 0")
    clean = (F.col("us") > 0) != (F.col("eu") > 0)
    return votes.select("doc_id", F.expr("us > 0 AND eu = 0").alias("month_first"), F.when(~clean & (F.col("open") > 0), "default").otherwise("evidence").alias("inferred"))


def _of_first_figure(dateless: Column, cut: Column) -> Column:
    """What follows the first figure of a line without line breaks, and a code right before it."""
    return F.concat(F.regexp_extract(F.right(cut[0], F.lit(4)), r"((?:[A-Z]{3}|[€$£¥])?\s?)\z", 1), dateless.substr(F.length(cut[0]) + 1, F.length(dateless)))


def _read(documents: DataFrame) -> DataFrame:
    """Lines with all that can be read from a line alone; dates are blanked and figures searched once."""
    leading = rf"^\s*({M.DATE})?(?:\s+({M.DATE}))?"
    column = F.col
    rows = lines(documents).withColumn("dateless", M.without_dates(column("line"))).withColumn("cut", M.cut(column("dateless")))
    lower = F.lower("line")
    # the stems spare most lines the labels
    balance = (lower.contains("balance") | lower.contains("saldo") | lower.contains("kontostand")) & lower.rlike("|".join(OPENING + CLOSING + PERIOD))
    broken = column("line").rlike("[\r\u0085\u2028\u2029]")
    rows = rows.select("*", balance.alias("balance"), broken.alias("broken"), (F.size("cut") > 1).alias("has"), *(F.regexp_extract("line", leading, i).alias(n) for i, n in ((0, "head"), (1, "first"), (2, "second"))))
    vote = F.when(column("broken"), _vote()).otherwise(M.currency(F.when(column("has"), _of_first_figure(column("dateless"), column("cut"))).otherwise(column("line"))))
    words = ~column("has") & ~column("balance") & (M.first_date(column("line")) == "")
    rest = column("line").substr(F.length("head") + 1, F.length("line"))
    rows = rows.withColumn("rest", F.when(~column("balance") & (column("first") != ""), rest)).select("*", vote.alias("vote"), _orders(column("has")).alias("o"), F.when(words, F.trim("line")).alias("words"))
    # behind a blank the rest of a line has the figures and the currency that the line has; else it is read anew
    same = ~column("broken") & column("rest").rlike(r"^(?:\s|\z)")
    blanked = F.length("head") - F.length("first") + 1 - F.when(column("second") != "", F.length("second") - 1).otherwise(0)
    whole = F.struct(column("cut"), column("cut")[0].substr(blanked + 1, F.length(column("cut")[0])).alias("before"), column("vote").alias("currency"))

    def anew(dateless: Column) -> Column:
        region = F.regexp_extract(dateless, f"((?:(?:[A-Z]{{3}}|[€$£¥])\\s?)?{M.FIGURE}.*)$", 1)
        return M.once(M.cut(dateless), lambda cut: F.struct(cut.alias("cut"), cut[0].alias("before"), M.currency(region).alias("currency")))

    rows = rows.withColumn("read", F.when(same, whole).when(column("rest").isNotNull(), M.once(M.without_dates(column("rest")), anew)))
    size, description = F.size("read.cut"), F.trim(F.regexp_replace("read.before", r"\s*(?:[A-Z]{3}|[€$£¥])\s*$", ""))
    figure = lambda k: column("read.cut")[size - 2 * k]
    body = F.struct(description.alias("description"), (size > 3).alias("many"), figure(1).alias("last"), F.when(size > 3, figure(2)).alias("other"), column("read.currency").alias("currency"), "first", "second")
    return rows.select("doc_id", "pos", M.first_full_date(column("line")).alias("full"), "vote", "o", "words", F.when(size > 1, body).alias("row"))


def transactions(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, date, value_date, description, cents, balance, currency) of all statements.

    The last figure is the balance where a line has two; the description ends before the
    first. A row with one figure whose description ends in a bare number could be either; it
    is dropped if any row of its statement prints a balance.
    """
    own, order = W.partitionBy("doc_id"), W.partitionBy("doc_id").orderBy("pos")
    # what depends on the whole document comes from windows over its lines, which are dealt out once;
    # a line of words alone right behind a row goes on with its description
    rows = _read(documents).withColumn("more", F.lead("words").over(order))
    rows = rows.select("doc_id", "pos", F.min_by("full", F.when(F.col("full").isNotNull(), F.col("pos"))).over(own).alias("full"), "vote", *(F.sum(f"o.{k}").over(own).alias(k) for k in ("us", "eu")), "more", "row")
    same = W.partitionBy("doc_id", "vote")
    rows = rows.withColumn("n", F.count("vote").over(same)).withColumn("earliest", F.min("pos").over(same))
    rows = rows.withColumn("doc_currency", F.max_by("vote", F.when(F.col("vote").isNotNull(), F.struct("n", -F.col("earliest")))).over(own)).withColumn("month_first", F.expr("us > 0 AND eu = 0"))
    body = rows.where(F.col("row").isNotNull()).select("doc_id", "pos", "full", "month_first", "more", "doc_currency", "row.*").where("description <> ''")
    # dates with a full year need no anchor
    short = ~F.col("first").rlike(r"\d{4}") | ((F.col("second") != "") & ~F.col("second").rlike(r"\d{4}"))
    body = body.withColumn("anchor", F.when(short, M.date(F.col("full"), F.col("month_first"))))
    parse = lambda c: M.date(F.col(c), F.col("month_first"), F.year("anchor"), F.month("anchor"))
    body = M.settled(body, date=parse("first"), value_date=F.when(F.col("second") != "", parse("second")), currency=F.coalesce("currency", "doc_currency")).where("date IS NOT NULL AND currency IS NOT NULL")
    doubtful = ~F.col("many") & F.col("description").rlike(r"(?:^|\s)\d+$")
    body = M.settled(body, cents=M.amount(F.when(F.col("many"), F.col("other")).otherwise(F.col("last"))), balance=F.when(F.col("many"), M.amount(F.col("last"))))
    body = body.select("doc_id", "pos", "date", "value_date", F.concat_ws(" ", "description", "more").alias("description"), "cents", "balance", "currency", doubtful.alias("_doubtful"))
    printed = F.max(F.col("balance").isNotNull()).over(W.partitionBy("doc_id"))
    return body.withColumn("_printed", printed).where(~(F.col("_doubtful") & F.col("_printed"))).drop("_printed", "_doubtful")


def balances(documents: DataFrame) -> DataFrame:
    """Opening and closing balance (doc_id, opening, closing) in cents; explicit labels win over period ones."""
    rows = lines(documents).withColumn("figure", M.amount(F.try_element_at(M.figures(F.col("line")), F.lit(-1)))).where("figure IS NOT NULL")
    date_of = F.regexp_extract("line", rf"({M.DATE})", 1)
    parsed = M.date(date_of)
    kinds = rows.withColumn("opening_", _any(OPENING)).withColumn("closing_", _any(CLOSING)).withColumn("day", F.when(_any(PERIOD), parsed))
    found = kinds.groupBy("doc_id").agg(
        F.min_by(F.when(F.col("opening_"), F.col("figure")), F.when(F.col("opening_"), F.col("pos"))).alias("o"), F.max_by(F.when(F.col("closing_"), F.col("figure")), F.when(F.col("closing_"), F.col("pos"))).alias("c"),
        F.min_by("figure", "day").alias("first"), F.max_by("figure", "day").alias("last"), F.countDistinct("day").alias("days"),
    )
    return found.select("doc_id", F.coalesce("o", F.when(F.col("days") > 1, F.col("first"))).alias("opening"), F.coalesce("c", F.when(F.col("days") > 0, F.col("last"))).alias("closing")).where("opening IS NOT NULL OR closing IS NOT NULL")


# Labels that begin the header and total lines of an invoice, lower case.
HEADER = {
    "vendor": ("vendor", "lieferant", "seller", "verkäufer", "supplier", "rechnungssteller", "from"),
    "recipient": ("rechnungsempfänger", "empfänger", "bill to", "billed to", "invoice to", "kunde", "customer", "rechnung an"),
    "number": ("invoice number", "invoice no", "invoice #", "rechnungsnummer", "rechnungs-nr", "rechnung nr", "rechnung-nr"),
    "due_date": ("due date", "fälligkeitsdatum", "fällig", "payment due", "zahlbar bis", "due"),
    "date": ("invoice date", "rechnungsdatum", "datum", "date"),
}
TOTALS = {
    "net": ("net total", "net amount", "nettobetrag", "nettosumme", "netto", "subtotal", "zwischensumme", "summe netto"),
    "tax": ("vat", "mehrwertsteuer", "umsatzsteuer", "mwst", "steuerbetrag", "ust", "tax total", "tax", "steuer"),
    "gross": ("gross total", "gross amount", "gesamtbetrag", "rechnungsbetrag", "rechnungssumme", "gesamtsumme", "endsumme", "endbetrag", "gesamt", "brutto", "amount due", "zu zahlen", "zahlbetrag", "summe", "total"),
}


def glyph_soup(documents: DataFrame) -> DataFrame:
    """Per document its lines, how many are scattered single characters, and whether the text is suspect.

    A line is scattered with three single characters in a row, or if it has six words at least, 45 in
    a hundred of one character. Three such lines at least, and one in five, make a text suspect.
    """
    rows = documents.select("doc_id", F.explode(F.split("text", r"\r?\n")).alias("line")).select("doc_id", F.split(T.stripped(F.col("line")), r"\s+").alias("w")).where("w[0] <> ''")
    single = F.size(F.filter("w", lambda w: F.length(w) == 1))
    scattered = F.array_join("w", " ").rlike(r"(?:^|\s)\S\s\S\s\S(?:\s|$)") | ((F.size("w") >= 6) & (single / F.size("w") >= 0.45))
    found = rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(scattered.cast("long")).alias("scattered"))
    return found.withColumn("suspect", (F.col("scattered") >= 3) & (F.col("scattered") / F.col("lines") >= 0.2))


def invoice_header(documents: DataFrame) -> DataFrame:
    """Vendor, recipient, number, date and due date: the first labelled line of each, without a figure."""
    # most lines have neither a label nor a date, and are spared what follows; both kinds are dealt out once
    titles = "|".join(re.escape(x) for labels in HEADER.values() for x in labels)
    titled = F.trim("line").rlike(rf"(?i)^(?:{titles})(?![\p{{L}}\p{{N}}])")
    rows = M.settled(lines(documents), titled=titled, dated=F.col("line").rlike(r"\d[./]\d{1,2}[./]")).where("titled OR dated")
    rows = M.settled(rows, o=F.when(F.col("dated"), _orders()))
    rows = rows.withColumn("month_first", F.expr("sum(o.us) OVER (PARTITION BY doc_id) > 0 AND sum(o.eu) OVER (PARTITION BY doc_id) = 0"))
    rows = M.settled(rows.where("titled"), plain=F.size(M.figures(F.col("line"))) == 0).where("plain")
    value = lambda kind: F.regexp_extract(F.trim("line"), rf"(?i)^(?:{'|'.join(re.escape(x) for x in HEADER[kind])})(?![\p{{L}}\p{{N}}])[\s.:#-]*(\S.*)$", 1)
    day = lambda kind: M.date(F.regexp_extract(value(kind), rf"({M.DATE})", 1), F.coalesce("month_first", F.lit(False)))
    kinds, taken = {}, F.lit(False)
    for kind in HEADER:  # a line is of the first kind that it fits
        got = day(kind) if "date" in kind else F.nullif(F.trim(value(kind)), F.lit(""))
        if kind == "recipient":
            got = F.when(~got.rlike(r"(?i)^(?:number|no|nr|nummer|reference|ref|id)\b"), got)
        kinds[kind] = F.when(~taken, got)
        taken = taken | F.col(kind).isNotNull()
    marked = rows
    for k, c in kinds.items():
        marked = M.settled(marked, **{k: c})
    return marked.groupBy("doc_id").agg(*(F.min_by(k, F.when(F.col(k).isNotNull(), F.col("pos"))).alias(k) for k in HEADER))
