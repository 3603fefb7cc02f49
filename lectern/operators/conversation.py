"""Messages: the latest, the question before an answer, and what fits a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T


def latest(messages: DataFrame, role: str | None = None) -> DataFrame:
    """The last message of each conversation, of one role if given."""
    rows = messages if role is None else messages.where(F.col("role") == role)
    return rows.groupBy("conv_id").agg(F.max_by(F.struct("seq", "role", "text"), "seq").alias("m")).select("conv_id", "m.*")


def questions(messages: DataFrame) -> DataFrame:
    """Every answer with the nearest user message before it."""
    before = W.partitionBy("conv_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("seq")), ignorenulls=True).over(before)
    return messages.withColumn("question_seq", asked).where("role = 'assistant'").select("conv_id", "seq", "question_seq")


def alternating(messages: DataFrame) -> DataFrame:
    """Messages of which of equal roles in a row the last stays."""
    following = F.lead("role").over(W.partitionBy("conv_id").orderBy("seq"))
    return messages.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next") != F.col("role"))).drop("_next")


def fitting(messages: DataFrame, budget: int) -> DataFrame:
    """What fits a prompt: system messages always, of the others the newest, not beginning with an answer."""
    cost = T.message_tokens(F.col("text"))
    rows = messages.withColumn("cost", cost).withColumn("fixed", F.sum(F.when(F.col("role") == "system", F.col("cost")).otherwise(0)).over(W.partitionBy("conv_id")))
    newest = W.partitionBy("conv_id").orderBy(F.col("seq").desc()).rowsBetween(W.unboundedPreceding, 0)
    spent = F.sum(F.when(F.col("role") != "system", F.col("cost")).otherwise(0)).over(newest)
    kept = rows.withColumn("spent", spent).where((F.col("role") == "system") | (F.col("spent") + F.col("fixed") <= budget))
    upto = W.partitionBy("conv_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    begun = F.max(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto)
    return kept.withColumn("begun", begun).where((F.col("role") == "system") | (F.col("begun") == 1)).select("conv_id", "seq", "role", "cost")


def needs_compaction(messages: DataFrame, window: int, share: float = 0.85, keep: int = 6, least: int = 6) -> DataFrame:
    """Conversations to compact, with the message up to which they are: an answer before the last ``keep``."""
    rows = messages.withColumn("cost", T.message_tokens(F.col("text"))).withColumn("back", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("seq").desc())))
    cut = F.max(F.when((F.col("back") > keep) & (F.col("role") == "assistant"), F.col("seq")))
    found = rows.groupBy("conv_id").agg(F.sum("cost").alias("tokens"), F.count("*").alias("messages"), cut.alias("covers_through"))
    return found.where((F.col("tokens") > window * share) & (F.col("messages") >= least + keep) & F.col("covers_through").isNotNull())


def transcript(messages: DataFrame) -> DataFrame:
    """Each conversation as Markdown, in order."""
    part = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.trim("text"), F.lit("\n"))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))), lambda m: m["part"]), "\n").alias("markdown"))


def older_than(events: DataFrame, cursor: tuple | None, size: int, time: str = "ts", key: str = "event_id") -> DataFrame:
    """A page of events, the newest first, strictly older than the cursor (time, key).

    Without a cursor the first page; a cursor of nulls, of an event that is not there, has none after it.
    """
    rows = events
    if cursor is not None and None in cursor:
        return rows.limit(0)
    if cursor is not None:
        rows = rows.where((F.col(time) < F.lit(cursor[0])) | ((F.col(time) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1]))))
    return rows.orderBy(F.col(time).desc(), F.col(key).desc()).limit(size)


def newest(events: DataFrame, keep: int, time: Column, key: str = "event_id") -> DataFrame:
    """The newest events that a bounded log keeps."""
    return events.orderBy(time.desc(), F.col(key).desc()).limit(keep)


def with_skills(messages: DataFrame, skills: DataFrame, result_tables: DataFrame) -> DataFrame:
    """Messages with the title of the skill that made them, and whether they have a result table."""
    has = result_tables.select("conv_id", "seq").distinct().withColumn("has_table", F.lit(True))
    rows = messages.join(skills.select("skill_id", F.col("title").alias("skill_title")), "skill_id", "left").join(has, ["conv_id", "seq"], "left")
    return rows.withColumn("has_table", F.coalesce("has_table", F.lit(False)))


def undone(messages: DataFrame, result_tables: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages and result tables without each conversation's last message, if an answer; and what was taken, to restore it by union."""
    last = latest(messages).where("role = 'assistant'").select("conv_id", "seq")
    taken = messages.join(last, ["conv_id", "seq"], "left_semi")
    return messages.join(last, ["conv_id", "seq"], "left_anti"), result_tables.join(last, ["conv_id", "seq"], "left_anti"), taken


def compacted(messages: DataFrame, due: DataFrame, summaries: DataFrame) -> DataFrame:
    """The messages with a checkpoint (role system, kind compaction) behind the last of each conversation that is due."""
    last = messages.groupBy("conv_id").agg(F.max("seq").alias("_last"))
    rows = due.join(summaries, "conv_id").join(last, "conv_id")
    made = rows.select("conv_id", (F.col("_last") + 1).cast(messages.schema["seq"].dataType).alias("seq"), F.lit("system").alias("role"), F.col("summary").alias("text"), F.lit("compaction").alias("kind"), "covers_through")
    return messages.unionByName(made, allowMissingColumns=True)


def citations(json: Column) -> Column:
    """Citations of a message as an array; null where the text is no such JSON."""
    found = F.from_json(json, "array<struct<label:string,sourceTitle:string,pageNumber:int,documentId:long>>")
    return F.when(F.trim(json).startswith("["), F.when(F.forall(found, lambda c: c.isNotNull()), found))
