"""Evidence of reviews: sources of citations, items and links, packs, and the context of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTEXT = 1200
SAMPLE = 4


def resolved(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Source snapshots of citations (review_id, ordinal, label, doc_id, title): which document each names.

    An id settles it, whether the document is there or not; without one, a title that exactly one
    document has. Labels that occur twice get the citation's number behind them.
    """
    by_id = documents.select("doc_id", F.col("title").alias("_title"), F.col("sha256").alias("_sha"))
    unique = documents.groupBy(F.col("title").alias("title")).agg(F.min("doc_id").alias("_only"), F.min("sha256").alias("_only_sha"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    rows = citations.join(by_id, "doc_id", "left").join(unique, "title", "left")
    known, there = F.col("doc_id").isNotNull(), F.col("_title").isNotNull()
    label = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.concat(F.lit("src"), (F.col("ordinal") + 1).cast("string")))
    rows = rows.withColumn("key", label)
    again = F.row_number().over(W.partitionBy("review_id", "key").orderBy("ordinal")) > 1
    return rows.select(
        "review_id", "ordinal", F.when(again, F.concat("key", F.lit("."), (F.col("ordinal") + 1).cast("string"))).otherwise(F.col("key")).alias("key"),
        F.when(known | F.col("_only").isNotNull(), "resolved").otherwise("unresolved").alias("identity"), F.coalesce("doc_id", "_only").alias("doc_id"), F.coalesce("_title", "title").alias("title"),
        F.when(known, F.col("_sha")).otherwise(F.col("_only_sha")).alias("sha256"), F.when(known, F.when(there, "available").otherwise("missing")).when(F.col("_only").isNotNull(), "available").alias("availability"),
    )


def items_of(reviews: DataFrame, items: DataFrame, links: DataFrame) -> DataFrame:
    """Items with their review's conversation and the keys they are linked with, in order."""
    held = links.groupBy("item_id").agg(F.array_sort(F.collect_set("evidence_key")).alias("keys"))
    rows = items.join(reviews.select("review_id", "conv_id"), "review_id").join(held, "item_id", "left")
    return rows.withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def pack_counts(items: DataFrame, states: DataFrame) -> DataFrame:
    """Per review: items by decision, and sources by how fresh they are."""
    kinds = ("supported", "partly_supported", "not_supported", "follow_up", "not_applicable", "not_reviewed")
    made = items.groupBy("review_id").agg(*(F.sum((F.col("decision") == k).cast("long")).alias(k) for k in kinds))
    fresh = states.groupBy("review_id").agg(*(F.sum((F.col("state") == k).cast("long")).alias(k) for k in ("current", "changed", "missing", "unverifiable")))
    return made.join(fresh, "review_id", "left").fillna(0)


#: Decisions and relations in the order in which a pack has them.
DECISIONS = ("supported", "partly_supported", "not_supported", "follow_up", "not_applicable", "not_reviewed")
RELATIONS = ("supports", "qualifies", "contradicts", "context")


def _filled(column: str) -> Column:
    """A text, null where it is blank."""
    return F.when(F.trim(column) != "", F.col(column))


def acknowledged(freshness: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Summaries of freshness (review_id, outdated, fingerprint, ...) with ``acknowledged_at``.

    An acknowledgement (review_id, fingerprint, acknowledged_at) holds for what differed then: any
    later difference lets it lapse, and a review that isn't outdated has none. The last of several counts.
    """
    last = acknowledgements.groupBy("review_id", "fingerprint").agg(F.max("acknowledged_at").alias("acknowledged_at"))
    rows = freshness.join(last, ["review_id", "fingerprint"], "left")
    return rows.withColumn("acknowledged_at", F.when(F.col("outdated"), F.col("acknowledged_at"))).select(*freshness.columns, "acknowledged_at")


def pack_model(reviews: DataFrame, items: DataFrame, links: DataFrame, sources: DataFrame, states: DataFrame, freshness: DataFrame, *, unreviewed: bool = True, notes: bool = True, excerpts: bool = True, hashes: bool = True) -> DataFrame:
    """Evidence packs (review_id, pack): one nested value for each review, from which it is rendered.

    ``reviews``: review_id, title, question, answer, answer_changed, coverage_changed. ``items``:
    review_id, item_id, ordinal, kind, block_kind, text, decision, note. ``links``: item_id, evidence_key,
    origin, relation. ``sources``: review_id, ordinal, key, identity, title, sha256, snippet, availability.
    ``states``: review_id, key, state now. ``freshness``: review_id, outdated, acknowledged_at.

    Sources are numbered from 1 in their order; of sources that share a key the first is meant by
    links. Relations of a source come from the links of all items, hidden ones too; unknown ones are
    null. Sources that were missing at the time are no new loss. A review without items or sources
    has empty lists.
    """
    state = states.groupBy("review_id", "key").agg(F.min("state").alias("state"))
    numbered = sources.withColumn("index", F.row_number().over(W.partitionBy("review_id").orderBy("ordinal", "key")))
    first = numbered.groupBy("review_id", "key").agg(F.min(F.struct("index", "title")).alias("x")).select("review_id", "key", F.col("x.index").alias("index"), F.col("x.title").alias("source_title"))
    known = F.when(F.col("relation").isin(*RELATIONS), F.col("relation"))
    held = items.select("review_id", "item_id").join(links.select("item_id", F.col("evidence_key").alias("key"), "origin", known.alias("relation")), "item_id").join(first, ["review_id", "key"], "left")
    relations = held.where("relation IS NOT NULL AND index IS NOT NULL").groupBy("review_id", "index").agg(F.collect_set("relation").alias("_found"))
    in_order = F.filter(F.array(*map(F.lit, RELATIONS)), lambda r: F.array_contains(F.coalesce("_found", F.array().cast("array<string>")), r))
    register = numbered.join(relations, ["review_id", "index"], "left").join(state, ["review_id", "key"], "left")
    entry = F.struct(
        "index", "key", "identity", F.col("title").alias("documentTitle"), (_filled("sha256") if hashes else F.lit(None).cast("string")).alias("documentSha256"), (_filled("snippet") if excerpts else F.lit(None).cast("string")).alias("snippet"),
        F.col("availability").alias("availabilityAtCreation"), F.coalesce("state", F.lit("unverifiable")).alias("currentState"), in_order.alias("relations"),
    )
    lost = (F.col("state") == "missing") & (F.coalesce("availability", F.lit("")) != "missing")
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("long"))
    evidence = register.groupBy("review_id").agg(
        F.array_sort(F.collect_list(entry)).alias("evidence"), count(F.col("identity") == "unresolved").alias("unresolved"), count(F.col("availability") == "missing").alias("missing"), count(F.col("state") == "changed").alias("changed"), count(lost).alias("lost")
    )

    link = F.struct("index", F.coalesce("source_title", "key").alias("label"), "origin", "relation", "key")
    by_item = held.groupBy("item_id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    rows = items.join(by_item, "item_id", "left")
    shown = F.lit(True) if unreviewed else F.col("decision") != "not_reviewed"
    no_links = F.array().cast(by_item.schema["links"].dataType)
    item = F.struct("ordinal", "kind", F.coalesce(F.col("block_kind") == "heading", F.lit(False)).alias("heading"), "text", "decision", (_filled("note") if notes else F.lit(None).cast("string")).alias("note"), F.coalesce("links", no_links).alias("links"))
    made = rows.groupBy("review_id").agg(
        F.array_sort(F.collect_list(F.when(shown, item))).alias("items"), count(~shown).alias("hidden"), F.array(*(F.struct(F.lit(d).alias("decision"), count(F.col("decision") == d).alias("count")) for d in DECISIONS)).alias("counts"), count(F.col("decision") == "follow_up").alias("follow_ups")
    )
    whole = reviews.join(made, "review_id", "left").join(evidence, "review_id", "left").join(freshness.select("review_id", "outdated", "acknowledged_at"), "review_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    listed = lambda frame, c: F.coalesce(c, F.array().cast(frame.schema[c].dataType)).alias(c)
    none = F.array(*(F.struct(F.lit(d).alias("decision"), F.lit(0).cast("long").alias("count")) for d in DECISIONS))
    pack = F.struct(
        F.lit(1).alias("schemaVersion"), "title", F.coalesce("outdated", F.lit(False)).alias("outdated"), _filled("question").alias("question"), "answer",
        F.struct(F.coalesce("counts", none).alias("decisionCounts"), zero("follow_ups").alias("followUps")).alias("summary"), listed(made, "items"), zero("hidden").alias("excludedItemCount"), listed(evidence, "evidence"),
        F.struct(zero("unresolved").alias("unresolvedSources"), zero("missing").alias("missingSources")).alias("honesty"),
        F.struct(F.coalesce("outdated", F.lit(False)).alias("outdated"), F.coalesce("answer_changed", F.lit(False)).alias("answerChanged"), F.coalesce("coverage_changed", F.lit(False)).alias("coverageChanged"), zero("changed").alias("sourcesChanged"), zero("lost").alias("sourcesMissingNow"), F.col("acknowledged_at").alias("acknowledgedAt")).alias("freshness"),
    )
    return whole.select("review_id", pack.alias("pack"))


def pack_html(pack: Column) -> Column:
    """A pack as a page: cover, question and answer, items with their sources, and the register of sources."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else safe(p) for p in parts))
    links = lambda item: F.array_join(F.transform(item["links"], lambda x: text(" [", F.coalesce(x["index"].cast("string"), x["label"]), "]")), "")
    notice = F.when(pack["outdated"], F.concat(F.lit('<p class="outdated">Outdated'), F.when(pack["freshness"]["acknowledgedAt"].isNotNull(), text(", acknowledged ", pack["freshness"]["acknowledgedAt"])).otherwise(""), F.lit("</p>"))).otherwise("")
    counts = F.array_join(F.transform(pack["summary"]["decisionCounts"], lambda c: text("<li>", c["decision"], ": ", c["count"], "</li>")), "")
    items = F.array_join(F.transform(pack["items"], lambda i: F.concat(text('<li class="', i["decision"], '">', i["text"]), links(i), F.when(i["note"].isNotNull(), text("<p>", i["note"], "</p>")).otherwise(""), F.lit("</li>"))), "")
    hidden = F.when(pack["excludedItemCount"] > 0, text("<p>", pack["excludedItemCount"], " items not shown</p>")).otherwise("")
    sources = F.array_join(F.transform(pack["evidence"], lambda e: F.concat(text("<li>[", e["index"], "] ", e["documentTitle"], " (", e["currentState"], ")"), F.when(F.size(e["relations"]) > 0, text(" ", F.array_join(e["relations"], ", "))).otherwise(""), F.when(e["snippet"].isNotNull(), text("<blockquote>", e["snippet"], "</blockquote>")).otherwise(""), F.lit("</li>"))), "")
    return F.concat(text("<!DOCTYPE html><html><head><title>", pack["title"], "</title></head><body><h1>", pack["title"], "</h1>"), notice, F.when(pack["question"].isNotNull(), text("<h2>", pack["question"], "</h2>")).otherwise(""), text("<p>", pack["answer"], "</p><ul>"), counts, F.lit("</ul><ol>"), items, F.lit("</ol>"), hidden, F.lit("<ol>"), sources, F.lit("</ol></body></html>"))


def appended(items: DataFrame, new: DataFrame) -> DataFrame:
    """The items with new ones (review_id, item_id, ...) behind the last of their review."""
    last = items.groupBy("review_id").agg(F.max("ordinal").alias("_last"))
    place = F.row_number().over(W.partitionBy("review_id").orderBy("item_id"))
    rows = new.join(last, "review_id", "left").withColumn("ordinal", (F.coalesce("_last", F.lit(-1)) + place).cast(items.schema["ordinal"].dataType)).drop("_last")
    return items.unionByName(rows, allowMissingColumns=True)


def linked(links: DataFrame, item: int | str, key: str, on: bool) -> DataFrame:
    """The links with one set or removed; setting one that is there changes nothing."""
    same = (F.col("item_id") == F.lit(item)) & (F.col("evidence_key") == F.lit(key))
    others = links.where(~same)
    if not on:
        return others
    made = links.sparkSession.createDataFrame([(item, key)], links.select("item_id", "evidence_key").schema)
    return others.unionByName(made, allowMissingColumns=True)


def purged(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents without those of the doomed keys, and children without those of the parents gone."""
    gone = parents.join(doomed.select(key).distinct(), key, "left_semi").select(parent_key).distinct()
    return parents.join(gone, parent_key, "left_anti"), children.join(gone, parent_key, "left_anti")


def source_context(chunks: DataFrame, cited: DataFrame, around: int = CONTEXT) -> DataFrame:
    """For each cited snippet (cite_id, doc_id, snippet) the first chunk (doc_id, chunk_index, text) that holds it, and the text before and behind it.

    Text of the neighbouring chunks fills up what the chunk itself has not.
    """
    order = W.partitionBy("doc_id").orderBy("chunk_index")
    rows = chunks.select("doc_id", "chunk_index", "text", F.coalesce(F.lag("text").over(order), F.lit("")).alias("_before"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("_behind"))
    hits = cited.join(rows, "doc_id").where((F.col("snippet") != "") & F.col("text").contains(F.col("snippet")))
    first = hits.groupBy("cite_id").agg(F.min_by(F.struct("chunk_index", "text", "_before", "_behind", "snippet"), "chunk_index").alias("x")).select("cite_id", "x.*")
    at = F.instr("text", F.col("snippet"))
    left = F.concat_ws("\n", F.nullif("_before", F.lit("")), F.substr("text", F.lit(1), at - 1))
    right = F.concat_ws("\n", F.substr("text", at + F.length("snippet")), F.nullif("_behind", F.lit("")))
    return first.select("cite_id", "chunk_index", F.right(left, F.lit(around)).alias("before"), F.left(right, F.lit(around)).alias("behind"))


def listing_refs(items: DataFrame, chunks: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The sources of listed values (key, chunk_ids) as text: page, section or number of up to ``most`` chunks in order, and an ellipsis for more."""
    label = F.when(F.col("page").isNotNull(), F.concat(F.lit("p. "), F.col("page").cast("string"))).when(F.trim(F.coalesce("section", F.lit(""))) != "", F.trim("section")).otherwise(F.concat(F.lit("§ "), (F.col("chunk_index") + 1).cast("string")))
    rows = items.select("key", F.size("chunk_ids").alias("n"), F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", "chunk_index", label.alias("label")), "chunk_id")
    found = rows.groupBy("key").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_index", "label"))).alias("x"))
    labels = F.slice(F.array_distinct("x.label"), 1, most)
    return found.select("key", F.concat(F.lit("("), F.array_join(labels, ", "), F.when(F.col("n") > F.size(labels), "…").otherwise(""), F.lit(")")).alias("refs"))


def badge_counts(rows: DataFrame, key: str) -> DataFrame:
    """How many rows each key has."""
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def sessions(kept: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with the number of their turns and the first question."""
    found = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.min_by("question", "seq").alias("first_question"))
    return kept.join(found, "session_id", "left").fillna(0, ["turns"])


def combined(speed: DataFrame, quality: DataFrame) -> DataFrame:
    """Speed figures with the quality figures of the same model; those stay null where it was not rated."""
    return speed.join(quality, "model_id", "left")
