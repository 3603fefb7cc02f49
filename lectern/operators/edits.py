"""Edits of texts: blocks of an answer, verified replacements, and splicing of spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

# How lines of Markdown blocks begin.
_FENCE = r"^ {0,3}(`{3,}|~{3,})"
_HEADING = r"^ {0,3}#{1,6}(?:\s|$)"
_QUOTE = r"^ {0,3}>"
_TABLE = r"^\s*\|"
_ITEM = r"^ {0,1}(?:[-*+]|[0-9]{1,9}[.)])\s+"


def _in_fence(lines: list[str]) -> list[int]:
    """For each line the number of its fence from 1, 0 outside; a fence ends at its mark, as long at least, or with the text."""
    out, open_, n = [], None, 0
    for line in lines:
        mark = re.match(_FENCE, line)
        if open_ is None and mark:
            open_, n = mark[1], n + 1
            out.append(n)
        elif open_ is not None:
            out.append(n)
            if re.match(rf"^ {{0,3}}{open_[0]}{{{len(open_)},}}\s*$", line):
                open_ = None
        else:
            out.append(0)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def fences(texts: pd.Series) -> pd.Series:
    """The number of the fence that each line is in; the only part that depends on all lines before."""
    return texts.map(lambda t: _in_fence(re.split(r"\r\n?|\n", t or "")))


def answer_blocks(answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks (key, ordinal, kind, text, block_key) of Markdown answers: paragraphs, list items, headings, fences, tables and quotes.

    A block begins where its kind does: a heading and a list item with each line that is one, a
    quote or table with its first line, a paragraph behind a blank line or another kind's end. A
    single table line is a paragraph.
    """
    lines = answers.select(key, F.posexplode(F.arrays_zip(F.split("text", r"\r\n?|\n").alias("line"), fences("text").alias("fence"))).alias("pos", "z")).select(key, "pos", "z.line", "z.fence")
    kind = F.when(F.col("fence") > 0, "fence").when(F.trim(F.regexp_replace("line", r"\s", " ")) == "", "blank").when(F.col("line").rlike(_HEADING), "heading").when(F.col("line").rlike(_QUOTE), "blockquote").when(F.col("line").rlike(_TABLE), "table").when(F.col("line").rlike(_ITEM), "list_item").otherwise("text")
    order = W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("kind", kind).withColumn("last", F.lag("kind").over(order)).withColumn("last_fence", F.lag("fence").over(order))
    own = F.col("kind").isin("heading", "list_item")
    same = (F.col("kind") == F.col("last")) & F.col("kind").isin("blockquote", "table", "text") | (F.col("kind") == "fence") & (F.col("fence") == F.col("last_fence"))
    goes_on = F.coalesce(same | ((F.col("kind") == "text") & (F.col("last") == "list_item")), F.lit(False))
    lines = lines.withColumn("start", (F.col("kind") != "blank") & (own | ~goes_on)).withColumn("block", F.sum(F.col("start").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = lines.where("kind <> 'blank'").groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "kind"))).alias("x"))
    first = F.col("x")[0]["kind"]
    name = F.when((first == "text") | ((first == "table") & (F.size("x") < 2)), "paragraph").otherwise(first)
    made = rows.select(key, (F.col("block") - 1).alias("ordinal"), name.alias("kind"), F.array_join("x.line", "\n").alias("text"))
    return made.withColumn("block_key", F.concat(F.lit("b"), "ordinal", F.lit("-"), "kind", F.lit("-"), F.left(F.sha2("text", 256), F.lit(12))))


def occurrences(text: str, needle: str) -> list[tuple[int, int]]:
    """(start, line) of all places of a string, none within another; lines count from 1."""
    return [(m.start(), text.count("\n", 0, m.start()) + 1) for m in re.finditer(re.escape(needle), text)] if needle else []


def spliced(text: Column, spans: Column) -> Column:
    """The text with spans (start from 0, length, replacement) replaced: by start, one that overlaps an earlier one or leaves the text left out.

    Gives a struct of the text and how many spans were applied.
    """
    nothing = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(state: Column, span: Column) -> Column:
        good = (span["length"] > 0) & (span["start"] >= state["at"]) & (span["start"] + span["length"] <= F.length(text))
        out = F.concat(state["out"], F.substr(text, state["at"] + 1, span["start"] - state["at"]), span["replacement"])
        return F.struct(F.when(good, out).otherwise(state["out"]).alias("out"), F.when(good, span["start"] + span["length"]).otherwise(state["at"]).alias("at"), (state["n"] + good.cast("int")).alias("n"))

    ordered = F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    return F.aggregate(ordered, nothing, step, lambda s: F.struct(F.concat(s["out"], F.substr(text, s["at"] + 1)).alias("text"), s["n"].alias("applied")))


def edited(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents after verified edits (doc_id, number, find, line, nth, replacement).

    An edit holds only where its string stands: at the nth place, within the line if one is given. All
    others, and those that overlap an earlier place, are dropped and counted.
    """

    @F.pandas_udf("array<struct<start:int,length:int,replacement:string>>")
    def located(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(text: str, own) -> Iterator[dict]:
            for e in sorted(own if own is not None else [], key=lambda e: e["number"]):
                wanted_line, nth = (None if pd.isna(e[c]) else int(e[c]) for c in ("line", "nth"))
                places = [s for s, line in occurrences(text or "", e["find"]) if wanted_line is None or line == wanted_line]
                nth = (nth or 1) - 1
                if 0 <= nth < len(places):
                    yield {"start": places[nth], "length": len(e["find"]), "replacement": e["replacement"]}

        return pd.Series([list(one(t, w)) for t, w in zip(texts, wanted, strict=True)])

    lists = edits.groupBy("doc_id").agg(F.collect_list(F.struct("number", "find", "line", "nth", "replacement")).alias("_e"))
    rows = documents.join(lists, "doc_id", "left").withColumn("_asked", F.coalesce(F.size("_e"), F.lit(0)))
    rows = rows.select("doc_id", "text", "_asked", F.explode(F.array(F.coalesce(located("text", "_e"), F.array()))).alias("_spans"))
    made = rows.select("doc_id", "_asked", spliced(F.col("text"), F.col("_spans")).alias("r"))
    return made.select("doc_id", F.col("r.text").alias("text"), F.col("r.applied").alias("applied"), (F.greatest("_asked", F.lit(0)) - F.col("r.applied")).alias("dropped"))


def keeps_text(before: Column, after: Column) -> Column:
    """Whether two texts are the same but for white space."""
    return F.regexp_replace(before, r"\s+", "") == F.regexp_replace(after, r"\s+", "")
