"""Categories and derived columns: taxonomies given as text, and values that a user's function adds to rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lectern.functions import text as T
from lectern.operators import ledger

LEAST, MOST, GLOSS = 2, 40, 120
#: Rows that a function sees at once, and derived columns at most.
CATEGORY_BATCH, ENRICH_BATCH, MOST_COLUMNS = 20, 12, 4

# First cells that mark a header line, lower case; and the form of a label.
HEADER_CELLS = ("kategorie", "kategorien", "category", "categories", "name", "label")
LABEL = r"^\p{L}[\p{L}\p{N}&+\-/. ]{0,39}$"
# How a question asks to categorise, and how it names a CSV file, in quotes or bare.
ASKS = r"(?i)\b(?:kategorisier\w*|categori[sz]e\w*|categori[sz]ation)\b"
QUOTED_FILE = "(?i)[\"'„“«]([^\"'„“«»\\n]{1,160}?\\.csv)[\"'“«»]"
BARE_FILE = "(?i)(?:^|\\s)([^\\s\"'„“«»]{1,160}\\.csv)\\b"


def taxonomy(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """The categories (key, categories: array of name and gloss) of taxonomy texts; null where a label is bad or there are too few or many.

    Blank lines and those with # are left out. Cells are parted by semicolons, if there are any, else
    tabs, else commas; the first is the label, the others its gloss. A label that is there already,
    whatever its case, counts once.
    """
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), T.stripped), lambda x: (x != "") & ~x.startswith("#"))
    rows = files.select(key, F.explode(F.array(lines)).alias("lines")).withColumn("d", F.when(F.exists("lines", lambda x: x.contains(";")), ";").when(F.exists("lines", lambda x: x.contains("\t")), "\t").otherwise(","))
    cells = F.transform("lines", lambda x: F.transform(F.split(x, F.concat(F.lit("["), F.col("d"), F.lit("]"))), lambda c: T.stripped(F.regexp_replace(c, "^[\"'„“]+|[\"'“”]+$", ""))))
    rows = rows.select(key, F.explode(F.array(cells)).alias("cells"))
    headed = F.lower(F.coalesce(F.get(F.get("cells", F.lit(0)), F.lit(0)), F.lit(""))).isin(*HEADER_CELLS)
    rows = rows.select(key, F.explode(F.array(F.when(headed, F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells")))).alias("cells"))
    name = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    good = F.forall("cells", lambda c: name(c).rlike(LABEL) & (F.size(F.split(name(c), r"\s+")) <= 4))
    gloss = lambda c: F.left(F.array_join(F.filter(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x: x != ""), ", "), F.lit(GLOSS))
    once = F.filter("cells", lambda c, i: ~F.exists(F.slice("cells", F.lit(1), i), lambda b: F.lower(name(b)) == F.lower(name(c))))
    found = F.transform(once, lambda c: F.struct(name(c).alias("name"), F.nullif(gloss(c), F.lit("")).alias("gloss")))
    made = rows.select(key, good.alias("good"), F.explode(F.array(found)).alias("found"))
    return made.select(key, F.when(F.col("good") & F.size("found").between(LEAST, MOST), F.col("found")).alias("categories"))


def taxonomy_file(question: Column) -> Column:
    """The base name of the CSV file that a question to categorise names; null without one."""
    asked, quoted, bare = question.rlike(ASKS), F.regexp_extract(question, QUOTED_FILE, 1), F.regexp_extract(question, BARE_FILE, 1)
    name = F.regexp_extract(F.trim(F.regexp_replace(F.when(quoted != "", quoted).otherwise(bare), r"^[(\[{]+", "")), r"([^/\\]*)$", 1)
    return F.when(asked, F.nullif(name, F.lit("")))


def categorised(rows: DataFrame, categories: list[str] | None = None, choose: Callable[[list[str]], list[str | None]] | None = None, failed: str | None = None) -> DataFrame:
    """Rows (description, cents, ...) with a category: by rule, by a user's function over batches of descriptions, or none of a given set.

    Without a function, and where it fails or names no category of the set, the rules decide; of a set of one's own such rows are Uncategorized.
    ``failed`` names a column that tells the rows of batches on which the function failed; ``failures`` counts them.
    """
    by_rule = F.lit("Uncategorized") if categories else ledger.category(F.col("description"), F.col("cents"))
    ruled = rows.withColumn("category", by_rule)
    if failed:
        ruled = ruled.withColumn(failed, F.lit(None).cast("string"))
    return ruled if choose is None else _batched(ruled, "category", CATEGORY_BATCH, lambda frame: frame.description.tolist(), choose, categories, failed)


def failures(rows: DataFrame, failed: str) -> DataFrame:
    """What went wrong in batches (reason, rows)."""
    return rows.where(F.col(failed).isNotNull()).groupBy(F.col(failed).alias("reason")).agg(F.count("*").alias("rows"))


def _batched(rows: DataFrame, column: str, size: int, given: Callable[[pd.DataFrame], list], make: Callable[[list], list], allowed: list[str] | None, failed: str | None = None) -> DataFrame:
    """The rows with what a function makes of each batch of what it is given; an answer of another length, an error, or a value not allowed leaves the column as it is.

    Of the first two ``failed``, a column of the rows, gets the reason.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values, column_values, reasons = given(frame), frame[column].tolist(), [None] * len(frame)
            for low in range(0, len(frame), size):
                part, reason = values[low : low + size], None
                n = len(part)
                try:
                    made = list(make(part))
                except Exception as error:  # a user's function may fail on any batch; its rows keep what they have
                    made, reason = None, type(error).__name__
                if made is not None and len(made) != n:
                    reason = "length"
                if reason is None:
                    column_values[low : low + n] = [m if isinstance(m, str) and (allowed is None or m in allowed) else old for m, old in zip(made, column_values[low : low + n], strict=True)]
                reasons[low : low + n] = [reason] * n
            # tables of a batch each would cost more than what most functions do
            frame[column] = pd.Series(column_values, index=frame.index, dtype=object)
            if failed:
                frame[failed] = pd.Series(reasons, index=frame.index, dtype=object)
            yield frame

    return rows.mapInPandas(run, rows.schema)


def enriched(rows: DataFrame, columns: dict[str, list[str] | None], derive: Callable[[str, list[dict]], list[str]], failed: str | None = None) -> DataFrame:
    """Rows with derived text columns (name and allowed values), by a user's function over batches; unknown values are blank.

    More than four columns, or one that is there already, is an error. ``failed`` begins the names of columns that
    tell, for each derived one, the rows of batches on which the function failed.
    """
    if len(columns) > MOST_COLUMNS or any(c in rows.columns for c in columns):
        raise ValueError(f"at most {MOST_COLUMNS} new columns can be derived")
    out, names = rows, rows.columns
    for name, allowed in columns.items():
        out = out.withColumn(name, F.lit("").cast(S.StringType()))
        mark = f"{failed}_{name}" if failed else None
        out = out.withColumn(mark, F.lit(None).cast("string")) if mark else out
        out = _batched(out, name, ENRICH_BATCH, lambda frame: frame[names].to_dict("records"), lambda batch, name=name: derive(name, batch), allowed, mark)
    return out
