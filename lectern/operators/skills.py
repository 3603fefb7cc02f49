"""Tools that a question may start: triggers, scores, the kind of a question, and a registry of user functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

SCORED_HITS, KEYWORD, MIME, FILENAME = 2, 2, 1, 1
SUGGEST, AUTOMATIC = 2, 3

# Words of greetings, thanks and acknowledgements, and whole questions of small talk.
SMALL_TALK_WORDS = (
    "hi", "hii", "hiya", "hey", "heya", "hello", "yo", "sup", "howdy", "there", "hallo", "hallöchen", "servus", "moin", "na",
    "thanks", "thank", "you", "thx", "ty", "cheers", "please", "pls", "danke", "dankeschön", "merci", "vielen", "dank", "bitte",
    "very", "much", "so", "a", "lot", "sounds", "all", "good", "perfect", "sure", "dir", "dich", "schön", "lieben", "gut", "sehr", "genau", "perfekt",
    "bye", "goodbye", "cya", "ok", "okay", "okey", "k", "cool", "great", "nice", "awesome", "lol", "haha", "tschüss", "tschau", "ciao", "passt", "alles", "klar", "super",
)
SMALL_TALK_EXACT = (
    "how are you", "how are you doing", "how are you today", "how is it going", "hows it going", "how do you do", "whats up", "who are you", "what are you", "what can you do",
    "what can you help with", "what can you help me with", "tell me a joke", "nice to meet you", "good bot", "wie gehts", "wie geht es", "wie geht es dir", "wie geht es ihnen", "wer bist du", "was bist du",
    "was kannst du", "was kannst du tun", "erzähl mir einen witz", "schön dich kennenzulernen",
)
# Parts of questions that ask for a work on the whole document, and that look up one fact.
DELIVERABLE = (
    "summar", "brief", "overview", "recap", "minutes", "walk me through", "key point", "main point", "list all", "list every", "all the", "everything", "what changed", "what has changed", "compare",
    "review", "gist", "rundown", "breakdown", "analy", "tl;dr", "the whole", "entire document", "takeaway", "bottom line", "conclusion", "upshot", "big picture", "main idea", "in a nutshell",
    "in short", "purpose of", "point of the", "point of this", "message of", "about this document", "what is it about", "what is this about", "important point", "key insight", "verdict", "overall",
    "zusammenfass", "überblick", "protokoll", "sämtliche", "liste", "auflisten", "was hat sich geändert", "vergleich", "überprüf", "durchgehen", "wesentlich", "analyse", "ganze dokument",
    "fazit", "kernaussage", "kernpunkt", "quintessenz", "gesamteindruck", "inhalt", "worum geht", "wichtigste", "schlussfolgerung", "erkenntnis", "gesamtbild",
)
NEEDLE = (
    "how much", "how many", "how long", "when is", "when does", "when did", "when will", "when do", "where is", "where does", "where can i", "find the", "find a", "locate", "look up", "is there a",
    "are there any", "does it say", "does the document", "what's the", "what is the", "what was the", "wie viel", "wie viele", "wie lange", "wann ist", "wann muss", "wann wird", "wo ist", "wo steht",
    "gibt es", "steht im", "steht in", "was ist der", "was ist die", "was ist das",
)


def _has_any(low: Column, parts: tuple[str, ...]) -> Column:
    return low.rlike("|".join(re.escape(p) for p in parts))


def small_talk(question: Column) -> Column:
    """Whether a question is chatter as a whole."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(F.lower(question), "['’‘´`]", ""), "[^a-z0-9äöüß]+", " "))
    words = F.split(flat, " ")
    return (flat != "") & (flat.isin(*SMALL_TALK_EXACT) | F.forall(words, lambda w: w.isin(*SMALL_TALK_WORDS)))


def looks_up(question: Column) -> Column:
    """Whether a question looks up one fact and asks for no work on the whole document."""
    low = F.lower(question)
    return ~(_has_any(low, DELIVERABLE) | low.rlike(r"\balle\b")) & (_has_any(low, NEEDLE) | low.rlike(r"\bfinde\b"))


def glob_pattern(glob: Column) -> Column:
    """A pattern of file names, with ``*`` and ``?``, as a regular expression for lower-case names."""
    quoted = F.regexp_replace(F.lower(glob), r"([\\.\[\]{}()+^$|#&~-])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def triggered(skills: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Scores (question_id, skill_id, hits, score) of skills whose keywords a question has.

    ``skills`` lists keywords, mime_types and patterns of file names; ``documents`` has title and
    mime_type of the documents in scope. A keyword of one word must stand free of letters and
    digits; of keywords within longer ones that are there too only the longer count.
    """
    low = F.lower("question")
    words = skills.select("skill_id", F.explode("keywords").alias("k")).select("skill_id", F.lower(F.trim("k")).alias("k")).where("k <> ''")
    hits = questions.select("question_id", low.alias("q")).join(F.broadcast(words), F.instr("q", F.col("k")) > 0)  # skills are few: a registry
    free = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), "k", F.lit(r"\E(?![\p{L}\p{N}])"))
    at = F.when(F.col("k").rlike(r"\s"), F.instr("q", F.col("k"))).otherwise(F.regexp_instr("q", free))
    hits = hits.withColumn("at", at).where("at > 0").withColumn("upto", F.col("at") + F.length("k"))
    spans = hits.groupBy("question_id", "skill_id").agg(F.collect_set(F.struct("at", "upto")).alias("s"))
    outer = F.filter("s", lambda a: ~F.exists("s", lambda b: (b["at"] <= a["at"]) & (a["upto"] <= b["upto"]) & ((b["at"] != a["at"]) | (b["upto"] != a["upto"]))))
    counted = spans.select("question_id", "skill_id", F.size(outer).alias("hits"))
    docs = documents.select(F.lower("title").alias("title"), "mime_type")
    kinds = skills.select("skill_id", F.explode("mime_types").alias("m")).join(docs.select(F.col("mime_type").alias("m")).distinct(), "m", "left_semi").select("skill_id").distinct().withColumn("_mime", F.lit(MIME))
    globs = skills.select("skill_id", F.explode("patterns").alias("p")).where(F.trim("p") != "").select("skill_id", glob_pattern(F.trim("p")).alias("p"))
    named = docs.select("title").distinct().join(F.broadcast(globs), F.expr("title rlike p")).select("skill_id").distinct().withColumn("_name", F.lit(FILENAME))
    rows = counted.join(kinds, "skill_id", "left").join(named, "skill_id", "left")
    return rows.select("question_id", "skill_id", "hits", (F.least("hits", F.lit(SCORED_HITS)) * KEYWORD + F.coalesce("_mime", F.lit(0)) + F.coalesce("_name", F.lit(0))).alias("score"))


def chosen(scores: DataFrame, threshold: int = SUGGEST) -> DataFrame:
    """The best skill of each question from the threshold up, the least id on a tie."""
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.col("score").desc(), "skill_id"))
    return scores.where(F.col("score") >= threshold).withColumn("_n", rank).where("_n = 1").drop("_n")


@dataclass(frozen=True)
class Tool:
    """A user's function over DataFrames: what it reads, the schema it gives, and whether its results leave the engine."""

    name: str
    run: Callable[..., DataFrame]
    reads: tuple[str, ...]
    gives: str
    exports: bool = False


class Registry:
    """Tools by name; a run checks the columns that go in and come out."""

    def __init__(self):
        self._tools: dict[str, Tool] = {}

    def add(self, tool: Tool) -> None:
        if tool.name in self._tools:
            raise ValueError(f"there is a tool {tool.name} already")
        self._tools[tool.name] = tool

    def names(self) -> list[str]:
        return sorted(self._tools)

    def run(self, spark: SparkSession, name: str, rows: DataFrame, confirmed: bool = False, **options) -> DataFrame:
        """The tool's result with exactly the columns and types that it declares; one that exports must be confirmed."""
        if name not in self._tools:
            raise KeyError(f"no tool {name}")
        tool = self._tools[name]
        if missing := [c for c in tool.reads if c not in rows.columns]:
            raise ValueError(f"{name} needs the columns {', '.join(missing)}")
        if tool.exports and not confirmed:
            raise PermissionError(f"{name} exports data and must be confirmed")
        made = tool.run(rows.select(*tool.reads), **options)
        wanted = spark.createDataFrame([], tool.gives).schema
        if missing := [f.name for f in wanted if f.name not in made.columns]:
            raise ValueError(f"{name} gives no {', '.join(missing)}")
        return made.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted))


# ---- tools in SQL --------------------------------------------------------------------------


@dataclass(frozen=True)
class SqlTool:
    """A row's function for SQL: the types that it takes, and the type (of a value) or schema (of rows) that it gives."""

    name: str
    run: Callable
    takes: tuple[str, ...]
    gives: str
    rows: bool = False


def _table_function(tool: SqlTool):
    wanted = [DataType.fromDDL(t) for t in tool.takes]
    schema = StructType.fromDDL(tool.gives)
    width = len(schema.fields)

    class Rows:
        @staticmethod
        def analyze(*given: AnalyzeArgument) -> AnalyzeResult:
            """Types of a call, checked while SQL is planned."""
            types = [a.dataType for a in given]
            if types != wanted:
                raise ValueError(f"{tool.name} takes ({', '.join(tool.takes)}), not ({', '.join(t.simpleString() for t in types)})")
            return AnalyzeResult(schema)

        def eval(self, *values):
            for row in tool.run(*values):
                if len(row) != width:
                    raise ValueError(f"{tool.name} gives rows of {len(row)} values, not {tool.gives}")
                yield row

    return F.udtf(Rows)


def _values(tool: SqlTool, *columns: pd.Series) -> pd.Series:
    """What the tool gives for each row; a join repeats a row's values for all that it finds, and such a run is one call."""
    made, before = [], None
    for row in zip(*columns, strict=True):
        if before is None or any(a is not b and (a != b or type(a) is not type(b)) for a, b in zip(row, before, strict=True)):
            before, value = row, tool.run(*row)
        made.append(value)
    return pd.Series(made, dtype=object)


def _value_function(tool: SqlTool):
    def values(*columns: pd.Series) -> pd.Series:
        if len(columns) != len(tool.takes):
            raise ValueError(f"{tool.name} takes {len(tool.takes)} values")
        return _values(tool, *columns)

    return F.pandas_udf(values, tool.gives)


def register_sql(spark: SparkSession, tools: list[SqlTool]) -> None:
    """Make tools known to SQL: values by name, rows as table functions that a query calls with ``LATERAL``.

    A call with other types, or a row of another width than declared, is an error.
    """
    for tool in tools:
        if tool.rows:
            spark.udtf.register(tool.name, _table_function(tool))
        else:
            spark.udf.register(tool.name, _value_function(tool))
