"""Queries over evidence, extractions, scores, budgets, skills and the library's upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import analysis, budgets, conversation, evidence, extraction, library, skills, vocabulary
from lectern.plans import tables
from lectern.plans.records import COST
from lectern.plans.tables import LIBRARY, MEMBERSHIPS, table

# ---- evidence ------------------------------------------------------------------------------


def _citations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each turn as a citation, every second one by id; and documents of which some share a title."""
    rows = table(spark, sf_dir, "conversations")
    cited = rows.select(F.col("conv_id").alias("review_id"), F.col("turn").alias("ordinal"), F.when(F.col("turn") % 5 == 4, "").otherwise(F.concat(F.lit("S"), F.col("turn") % 3)).alias("label"), F.when(F.col("turn") % 2 == 0, F.col("conv_id") * 3 + F.col("turn")).alias("doc_id"), F.concat(F.lit("Report "), F.col("conv_id") + F.col("turn") * 40).alias("title"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 11 <> 0").select("doc_id", F.concat(F.lit("Report "), F.when(F.col("doc_id") < 120, F.col("doc_id")).otherwise(F.col("doc_id") % 120 + 100)).alias("title"), F.sha2("text", 256).alias("sha256"))
    return cited, docs


def source_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document each citation names."""
    return evidence.resolved(*_citations(spark, sf_dir))


def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots against the documents now, of which some have changed."""
    cited, docs = _citations(spark, sf_dir)
    now = docs.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("sha256")))
    return analysis.freshness_summary(analysis.freshness(evidence.resolved(cited, docs), now))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an item of a review."""
    kinds = F.array(*map(F.lit, ("supported", "not_reviewed", "follow_up", "partly_supported", "not_applicable", "not_supported")))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("review_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.col("turn").alias("ordinal"), F.when(F.col("turn") % 3 == 2, "source").otherwise("block").alias("kind"), F.when(F.col("turn") % 4 == 0, "heading").when(F.col("turn") % 4 == 1, "paragraph").alias("block_kind"), F.element_at(kinds, (F.length("text") % 6 + 1).cast("int")).alias("decision"))


def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's review as a nested pack, its counts, items, links, sources and freshness; some are acknowledged."""
    cited, docs = _citations(spark, sf_dir)
    sources = evidence.resolved(cited, docs).withColumn("snippet", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("<s> & "), F.col("key"))).otherwise(" "))
    now = docs.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("sha256")))
    states = analysis.freshness(sources, now, "key")
    summary = analysis.freshness_summary(states)
    acks = summary.select("review_id", F.when(F.col("review_id") % 2 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"), F.lit("2024-05-01").alias("acknowledged_at"))
    items = _items(spark, sf_dir).withColumn("text", F.concat(F.lit("turn "), "ordinal")).withColumn("note", F.when(F.col("ordinal") == 1, "look").otherwise(" "))
    relation = F.element_at(F.array(*map(F.lit, ("supports", "qualifies", "contradicts", "context", "odd"))), (F.col("ordinal") % 5 + 1).cast("int"))
    links = sources.where("ordinal > 0").select((F.col("review_id") * 100 + F.col("ordinal") - 1).alias("item_id"), F.when(F.col("ordinal") == 5, "gone").otherwise(F.col("key")).alias("evidence_key"), F.lit("machine").alias("origin"), relation.alias("relation"))
    reviews = items.select("review_id").distinct().select("review_id", F.concat(F.lit("Review "), "review_id").alias("title"), F.when(F.col("review_id") % 3 == 0, " ").otherwise("Why?").alias("question"), F.lit("Because").alias("answer"), (F.col("review_id") % 4 == 0).alias("answer_changed"), F.lit(None).cast("boolean").alias("coverage_changed"))
    packs = evidence.pack_model(reviews, items, links, sources, states, evidence.acknowledged(summary, acks), unreviewed=False)
    p = F.col("pack")
    shown = F.array_join(F.transform(p["items"], lambda i: F.concat_ws(":", i["ordinal"], i["decision"], i["heading"].cast("string"), i["note"], F.array_join(F.transform(i["links"], lambda x: F.concat_ws("/", x["index"], x["relation"])), "+"))), "|")
    known = F.array_join(F.transform(p["evidence"], lambda e: F.concat_ws(":", e["index"], e["key"], e["identity"], e["currentState"], e["snippet"], F.array_join(e["relations"], "+"))), "|")
    return packs.select("review_id", p["question"].alias("question"), p["excludedItemCount"].alias("hidden"), p["summary"]["followUps"].alias("follow_ups"), F.array_join(F.transform(p["summary"]["decisionCounts"], lambda c: c["count"].cast("string")), ",").alias("counts"), shown.alias("items"), known.alias("sources"),
                        p["honesty"]["unresolvedSources"].alias("unresolved"), p["honesty"]["missingSources"].alias("missing"), p["freshness"]["sourcesChanged"].alias("changed"), p["freshness"]["sourcesMissingNow"].alias("lost"), p["outdated"].alias("outdated"), p["freshness"]["answerChanged"].alias("answer_changed"), p["freshness"]["acknowledgedAt"].alias("acknowledged_at"))


def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to decide in each review, after headings are set aside in one go."""
    return analysis.ready_gate(analysis.bulk_decision(_items(spark, sf_dir), "headings"))


def pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: decisions and sources of each review."""
    cited, docs = _citations(spark, sf_dir)
    return evidence.pack_counts(_items(spark, sf_dir), analysis.freshness(evidence.resolved(cited, docs), docs.where("doc_id % 7 <> 0")))


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their conversation and their links."""
    items = _items(spark, sf_dir)
    links = items.where("ordinal % 2 = 0").select("item_id", F.explode(F.array(F.lit("S2"), F.concat(F.lit("S"), F.col("ordinal") % 5))).alias("evidence_key"))
    reviews = items.select("review_id").distinct().where("review_id % 4 <> 0").select("review_id", (F.col("review_id") + 1000).alias("conv_id"))
    return evidence.items_of(reviews, items, links).select("item_id", "conv_id", F.array_join("keys", ",").alias("keys"))


def review_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items added behind the last ones."""
    items = _items(spark, sf_dir).where("ordinal < 3")
    new = _items(spark, sf_dir).where("ordinal >= 3 AND decision <> 'supported'").drop("ordinal")
    return evidence.appended(items, new).select("review_id", "item_id", F.col("ordinal").cast("long").alias("ordinal"))


def source_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around a snippet of each conversation's third turn."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text")
    cited = rows.where("chunk_index = 2").select(F.col("doc_id").alias("cite_id"), "doc_id", F.substring("text", 5, 20).alias("snippet"))
    found = evidence.source_context(rows, cited, 60)
    return found.select("cite_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5(F.concat_ws("|", "before", "behind").cast("binary")).alias("around_md5"))


def image_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their turns and first question."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.left("text", F.lit(30)).alias("question"))
    kept = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return evidence.sessions(kept, turns)


def statement_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines left when some customers' orders are purged."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    doomed = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    left, rows = evidence.purged(orders, lines, doomed, "o_custkey", "o_orderkey")
    return left.agg(F.count("*").alias("n")).select(F.lit("orders").alias("table_name"), "n").unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("lines").alias("table_name"), "n"))


def model_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed with quality; suppliers stand for models."""
    s = table(spark, sf_dir, "supplier")
    return evidence.combined(s.select(F.col("s_suppkey").alias("model_id"), F.col("s_acctbal").alias("speed")), s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("model_id"), F.col("s_nationkey").alias("quality")))


def model_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model for some sizes of memory; parts stand for models."""
    p = table(spark, sf_dir, "part")
    models = p.select(F.col("p_partkey").alias("model_id"), (F.col("p_size") * 2).cast("double").alias("ram_gb"), F.col("p_size").cast("double").alias("min_ram_gb"), (F.col("p_partkey") % 4).alias("rank"), (F.col("p_retailprice") + F.col("p_partkey") / 1e6).alias("size_gb"))
    made = None
    for ram in (0.5, 1.5, 8.0, 64.0):
        one = analysis.recommended(models, ram).select(F.lit(ram).alias("ram"), "model_id")
        made = one if made is None else made.unionByName(one)
    return made


# ---- extraction ----------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records: words of four letters of each turn, and a marker for each turn scanned."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), "text", "turn")
    found = rows.select("doc_id", "chunk_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z]{4})"), F.lit(1))).alias("value")).withColumn("record_type", F.lit("party"))
    marks = rows.where("turn % 4 <> 3").select("doc_id", "chunk_id", F.when(F.col("turn") % 4 == 2, "unparsed").otherwise("ok").alias("value"), F.lit("__scan__").alias("record_type"))
    return found.unionByName(marks)


def extraction_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by how often they occur."""
    return analysis.listing(_records(spark, sf_dir), "party")


def listing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's words of four letters as a listing; some were read in part, some hardly at all."""
    turns = table(spark, sf_dir, "conversations")
    chunks = turns.select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("turn").alias("chunk_index"), F.when(F.col("turn") % 3 == 0, F.col("turn") + 1).alias("page"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" "), "role")).alias("section"), (F.col("conv_id") % 2 == 0).alias("whole"))
    rows = turns.select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), "turn", "text")
    values = rows.where("doc_id % 5 <> 4").select("doc_id", "chunk_id", F.lit("amount").alias("record_type"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?:^| )(th|on|an|in|re)(?= |$)"), F.lit(1))).alias("value"))
    marks = rows.where("turn < 3 OR doc_id % 3 > 0").select("doc_id", "chunk_id", F.lit("__scan__").alias("record_type"), F.when((F.col("doc_id") % 5 == 4) & (F.col("turn") > 0), "unparsed").otherwise("ok").alias("value"))
    return analysis.listing_answers(values.unionByName(marks), chunks, "amount", sums=True)


def collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: collections with a project renamed, each with its number of live documents."""
    members = tables.memberships(spark, sf_dir)
    collections = members.select(F.col("collection").alias("name"), "type").distinct()
    named, moved = library.renamed(collections, members, "de", "Deutsche Texte")
    return library.with_counts(named, moved, tables.library(spark, sf_dir))


def extraction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: chunks scanned and not understood."""
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"))
    return analysis.coverage(chunks, _records(spark, sf_dir))


def extraction_built_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that the built-in patterns find in letters, counted by type."""
    text = F.concat(F.lit("On 2024-05-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" we got "), F.col("c_custkey"), F.lit(" EUR from a"), F.col("c_custkey"), F.lit("@b.org for lot 77."))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("chunk_id"), text.alias("text"))
    return analysis.extracted(rows, {k: v for k, v in analysis.RECORDS.items() if k != "generic"}).groupBy("record_type", "value").agg(F.count("*").alias("n"))


def listing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four sources of each value."""
    chunks = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("turn").alias("chunk_index"), F.when(F.col("turn") % 3 == 0, F.col("turn") + 1).alias("page"), F.when(F.col("turn") % 3 == 1, F.col("role")).alias("section"), "conv_id")
    items = chunks.groupBy(F.col("conv_id").alias("key")).agg(F.collect_list("chunk_id").alias("chunk_ids"))
    return evidence.listing_refs(items, chunks)


def leaf_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that each conversation's tree of pairs reaches, in order, and its height."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn")
    low = turns.select("doc_id", (F.col("doc_id") * 10_000 + F.col("turn")).alias("child_id"), F.lit(True).alias("child_is_leaf"), (F.col("turn") % 2).alias("ordinal"), (F.col("doc_id") * 10_000 + 1000 + F.floor(F.col("turn") / 2)).alias("parent_id"))
    high = low.select("doc_id", F.col("parent_id").alias("child_id"), F.lit(False).alias("child_is_leaf"), (F.col("parent_id") % 1000).alias("ordinal"), (F.col("doc_id") * 10_000 + 2000).alias("parent_id")).distinct()
    loop = turns.select("doc_id", (F.col("doc_id") * 10_000 + 2000).alias("child_id"), F.lit(False).alias("child_is_leaf"), F.lit(9).cast("long").alias("ordinal"), (F.col("doc_id") * 10_000 + 1000).alias("parent_id")).distinct()
    nodes = turns.select("doc_id").distinct().select("doc_id", (F.col("doc_id") * 10_000 + 2000).alias("node_id"), F.lit(0).alias("ordinal"), F.lit(True).alias("is_root"))
    edges = low.unionByName(high).unionByName(loop)
    return analysis.leaves(nodes, edges).select("doc_id", "leaf_id", F.col("place").cast("long").alias("place"))


def coverage_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much summaries cover."""
    states = F.array(*map(F.lit, ("ready", "building", "stale", "failed", "pending")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.element_at(states, (F.col("doc_id") % 5 + 1).cast("int")).alias("tree_status"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).alias("truncated"), (F.col("n_chars") % 50).alias("leaves"), (F.col("n_chars") % 50 + 3).alias("chunks"))
    return analysis.coverage_mode(docs)


def missing_page_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without text."""
    pages = table(spark, sf_dir, "conversations").where("turn % 3 = 1").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.lit(12).alias("page_count"))
    return analysis.missing_pages(pages).select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def extraction_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, R16, R17: a run after one that read every second turn, and after one of another model; each chunk ends with its own marker."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.when(F.col("turn") < 2, F.left("text", F.lit(6))).otherwise(F.col("text")).alias("text"))
    early = rows.where("chunk_id % 1000 % 2 = 0")
    reply = lambda text, attempt: None if len(text) % 5 == 0 else f'[{{"type": "amount", "value": "{len(text)}"}}]'
    first = extraction.scanned(early, reply, "m1").unionByName(extraction.scanned(rows.where("chunk_id % 1000 = 1"), lambda text, attempt: "[]", "m0"))
    again = extraction.scanned(rows, lambda text, attempt: reply(text, attempt) or "[]", "m1", first)
    found = extraction.merged(first, again)
    return found.groupBy("doc_id", "record_type", "normalized").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


#: Words that turns have, beside those of the built-in skills.
_WORDS = (("a", "the", "word"), ("a", "tion", "stem"), ("a", "of the", "phrase"), ("b", "ung", "stem"), ("b", "die", "word"), ("b", "und", "word"), ("c", "que", "word"), ("c", "é", "stem"), ("c", "THE", "word"), ("d", "on, ", "phrase"), ("d", ".", "stem"), ("e", "zzz", "word"))


def skill_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills whose words each turn has; some turns ask for a change or for masking."""
    asked = F.concat("text", F.when(F.col("turn") == 1, " Ersetze, please: RENAME it").when(F.col("turn") == 2, " schwärzend irreplaceable Anonymisierung").when(F.col("turn") == 3, " sensitive data").otherwise(""))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), asked.alias("question"))
    own = spark.createDataFrame([(*row, "route") for row in _WORDS], "skill_id string, term string, match string, use string")
    return vocabulary.hits(turns, vocabulary.built_in(spark).unionByName(own)).select("question_id", "skill_id", F.array_join("terms", "|").alias("terms"))


#: The context window of the plans' stand-in model.
_CONTEXT = 2048


def compare_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls that comparing each conversation with another takes, and what its windows hold."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("ordinal"), "text")
    plan = budgets.compare_plan(turns, _CONTEXT)
    windows = budgets.compare_windows(turns, _CONTEXT).groupBy("pair_id").agg(F.sum("tokens").cast("long").alias("tokens"), F.max("tokens").cast("long").alias("longest"), F.sum(F.size("ordinals")).cast("long").alias("turns"))
    return plan.join(windows, "pair_id").select("pair_id", F.col("windows").cast("long").alias("windows"), "truncated", "answer_tokens", F.col("pair_words").cast("long").alias("pair_words"), F.col("steps").cast("long").alias("steps"), "tokens", "longest", "turns")


def translation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of conversations as documents whose every third page is empty, as are the last ones."""
    segments = table(spark, sf_dir, "conversations").where("turn % 3 <> 1").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), (F.col("turn") + 1).alias("page"), "text")
    blocks = budgets.translation_blocks(segments, segments.select("doc_id").distinct().withColumn("page_count", F.lit(10)), 8192)
    return blocks.select("doc_id", F.col("block").cast("long").alias("block"), "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def group_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: turns grouped for a summary tree, two at least in a group."""
    costs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.length("text").cast("long").alias("cost"))
    return analysis.grouped(costs, 400, 2)


def summary_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of a summary of each document's sentences."""
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("ordinal", "s")).select("doc_id", "ordinal", F.least(F.length("s").cast("long"), F.lit(200).cast("long")).alias("cost"))
    return budgets.summary_plan(parts, 1000)


def budget_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for calls of several kinds in windows of many sizes."""
    c, a, b = F.col("o_orderkey") % 9000, F.col("o_custkey"), F.col("o_orderkey") % 700
    first, second = budgets.split_budget(a, b, c / 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", budgets.summary_words(c).alias("summary"), budgets.translation_words(c).alias("translation"), first.alias("first"), second.alias("second"))


def changes_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading changes that fit a budget."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("ordinal"), F.length("text").cast("long").alias("cost"))
    return budgets.halved(rows, 300)


def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading words of each turn that cost at most eight tokens."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", budgets.shortened(F.col("text"), 8).alias("head"))


def marked_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around a hit in each turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", budgets.marked_snippet(F.col("text"), ["the", "und"]).alias("snippet"))


# ---- questions and answers -----------------------------------------------------------------

QUESTIONS = ("Compare these contracts", "How many invoices are there?", "Liste alle Fristen auf", "Group by vendor, sum per month", "Fasse das Dokument kurz zusammen", "Give me an overview", "When is the deadline?", "Wer ist die Partei?", "hello there, thanks!", "Was kostet es?", "What is the verdict?", "wo ich das finde", "How's it going", "Zähle die Kosten pro Kategorie", "")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("c_custkey") % len(QUESTIONS) + 1).cast("int")).alias("question"))


def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What answers a question, and what it asks for."""
    q, k = F.col("question"), F.col("c_custkey")
    return _questions(spark, sf_dir).select("c_custkey", analysis.route(q, k % 3, k % 2 == 0, k % 4 == 0).alias("route"), analysis.record_type(q).alias("record_type"), analysis.asks_aggregation(q).alias("aggregation"), skills.small_talk(q).alias("small_talk"), skills.looks_up(q).alias("looks_up"))


_SKILLS = (("app:bank", ["statement", "bank statement", "Kontoauszug"], ["text/csv"], ["statement_*.pdf"]), ("app:invoice", ["invoice", "rechnung"], ["text/plain"], ["report 1?.txt"]), ("user:all", ["all", "the"], [], ["*"]))


def skill_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skill that each turn suggests."""
    known = spark.createDataFrame(_SKILLS, "skill_id string, keywords array<string>, mime_types array<string>, patterns array<string>")
    ask = F.concat("text", F.when(F.col("turn") % 3 == 0, " my bank statement").when(F.col("turn") % 3 == 1, " Invoice?").otherwise(" pre-statement all"))
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.regexp_replace(ask, "(?i)the|all(?=[a-z])", "x").alias("question"))
    return skills.chosen(skills.triggered(known, asked, tables.library(spark, sf_dir)), skills.AUTOMATIC)


def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that answers cite outside code."""
    text = F.concat(F.lit("See [S2] and [S"), F.col("turn"), F.lit("]; `[S7]` no.\n```\n[S8]\n```\n[S2] [s3] [S10]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.citation_markers(text), ",").alias("markers"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as an answer to a question whose gold answer is its third to fifth word."""
    words = F.split(T.normalised(F.col("text")), " ")
    refusal = F.when(F.col("turn") % 4 == 3, "The report does not mention it.").when(F.col("turn") % 7 == 5, "Es gibt keine Angaben.").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 2 == 0, "de").otherwise("en").alias("lang"), refusal.alias("answer"), F.array_join(F.slice(words, 3, 3), " ").alias("gold"), (F.col("turn") % 5 == 4).alias("unanswerable"), F.array(F.concat(F.lit("d"), F.col("turn") % 3), F.lit("d9")).alias("cited"), F.when(F.col("turn") % 2 == 0, "d0").otherwise("d9").alias("gold_doc"))


def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of answers."""
    return analysis.scored(_answers(spark, sf_dir))


def qa_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of answers by language."""
    return analysis.rates(analysis.scored(_answers(spark, sf_dir)), "lang")


# ---- the library's upkeep ------------------------------------------------------------------


def conversation_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how many documents each conversation covers, by stored scopes of two kinds, some of them broken."""
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.col("conv_id") % 5
    rows = c.select("conv_id", F.when(k == 0, '{"collectionIds":["src3"],"documentIds":[1,2]}').when(k == 1, "{broken").when(k == 4, '{"collectionIds":[]}').alias("scope_json"), F.when((k == 1) | (k == 2), "[5,6,7]").when(k == 3, "[]").alias("ids_json"), F.when(k == 3, "src4").alias("project"))
    attached = c.select("conv_id", F.lit(3).cast("long").alias("doc_id"))
    members = tables.memberships(spark, sf_dir).select("doc_id", F.when(F.col("collection") == "src1", "Library").otherwise(F.col("collection")).alias("collection"))
    return library.scope_sizes(rows, members, attached)


def filtered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permanent unfiled documents that need no new vectors, the last changed first."""
    docs = tables.library(spark, sf_dir).withColumn("stale_embeddings", F.col("doc_id") % 3 == 0)
    stale = library.filtered(docs, tables.memberships(spark, sf_dir), "needsReindex", "permanent").select("doc_id", F.lit("needsReindex").alias("view"))
    return stale.unionByName(library.filtered(docs, tables.memberships(spark, sf_dir), "unfiled", None, "src1").select("doc_id", F.lit("unfiled").alias("view")))


def documents_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list for some documents."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("chunk_id"))
    return library.listed_by_ids(tables.library(spark, sf_dir), tables.memberships(spark, sf_dir), tables.chunks(spark, sf_dir), vectors, [1, 3, 5, 8, 13]).select("doc_id", "title", "collections", "chunk_count", "embedded_count")


def ordered_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: collections in the order of the list, by number."""
    rows = tables.memberships(spark, sf_dir).select(F.col("collection").alias("name"), "type").distinct()
    listed = library.ordered_collections(rows).agg(F.collect_list("name").alias("n"))
    return listed.select(F.posexplode("n").alias("place", "name"))


def category_seeding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in categories added to a user's own."""
    own = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("builtin"))
    return library.seeded(own, ["Fees", "Income", "Fees"]).where("builtin")


def filed_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where imports go."""
    kinds = F.array(*map(F.lit, ("library", "temporary", "project", "conversation")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("destination"), F.col("source").alias("target"))
    known = tables.memberships(spark, sf_dir).select(F.col("collection").alias("name"), "type").distinct().where("name <> 'src12'")
    return library.filed(rows, known).groupBy("collection", "type").agg(F.count("*").alias("n"))


def archive_and_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: documents archived, memberships taken away, and what is left of both."""
    docs, members = tables.library(spark, sf_dir), tables.memberships(spark, sf_dir)
    lives = library.archived(docs, docs.where("doc_id % 10 = 0")).groupBy(F.coalesce("lifecycle", F.lit("none")).alias("name")).agg(F.count("*").alias("n"))
    left = library.removed(members, members.where("doc_id % 2 = 0 AND type = 'project'")).groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n"))
    return lives.unionByName(left)


def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks after some documents were imported anew."""
    old = tables.chunks(spark, sf_dir).select("doc_id", "chunk_id", "token_count")
    new = old.where("doc_id % 4 = 1 AND chunk_id % 2 = 0").withColumn("token_count", F.lit(1).cast("long"))
    return library.replaced(old, new, ["doc_id"])


def recovered_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports that were cut short, by state."""
    states = F.array(*map(F.lit, ("queued", "indexed", "embedding", "failed")))
    docs = tables.library(spark, sf_dir).withColumn("status", F.element_at(states, (F.col("doc_id") % 4 + 1).cast("int")))
    return library.recovered(docs, F.lit(800)).groupBy("status").agg(F.count("*").alias("n"))


def evicted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries that a cache keeps."""
    return library.kept_newest(table(spark, sf_dir, "events").select("event_id", "ts"), 700, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id")


def corpus_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign of change for two tables."""
    one = library.signature(table(spark, sf_dir, "events"), "event_id").withColumn("name", F.lit("events"))
    return one.unionByName(library.signature(table(spark, sf_dir, "documents"), "doc_id").withColumn("name", F.lit("documents")))


def messages_with_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their skill and whether they have a table."""
    rows = tables.messages(spark, sf_dir).withColumn("skill_id", F.when(F.col("role") == "assistant", F.col("seq") % 3))
    known = spark.createDataFrame([(0, "Bank"), (1, "Invoice")], "skill_id int, title string")
    has = tables.messages(spark, sf_dir).where("seq % 4 = 1").select("conv_id", "seq")
    return conversation.with_skills(rows, known, has).select("conv_id", "seq", "skill_title", "has_table")


def undone_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages left and taken when each conversation's last answer is undone."""
    rows = tables.messages(spark, sf_dir)
    left, _, taken = conversation.undone(rows, rows.where("seq % 2 = 1").select("conv_id", "seq"))
    return left.select("conv_id", "seq", F.lit("left").alias("part")).unionByName(taken.select("conv_id", "seq", F.lit("taken").alias("part")))


def compaction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with checkpoints."""
    rows = tables.messages(spark, sf_dir)
    due = conversation.needs_compaction(rows, 600, keep=2, least=2)
    made = conversation.compacted(rows, due, due.select("conv_id", F.lit("so far").alias("summary")))
    return made.where("kind = 'compaction'").select("conv_id", "seq", "role", "text", "covers_through")


def stored_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """citations read from JSON, some of it broken."""
    json = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('[{"label":"S1","sourceTitle":"a","pageNumber":'), F.col("turn"), F.lit('},{"label":"S2","sourceTitle":"b"}]'))).when(F.col("turn") % 3 == 1, '[{"label":').otherwise("null")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", conversation.citations(json).alias("c")).select("conv_id", "turn", F.array_join("c.label", ",").alias("labels"), F.get("c", F.lit(0))["pageNumber"].cast("long").alias("page"))


QUERIES = {
    f.__name__: f
    for f in (
        source_snapshots, freshness_status, evidence_packs, review_gate, pack_counts, review_items, review_append, source_context, image_sessions, statement_purge, model_benchmarks, model_recommend, extraction_listing, listing_texts, collection_list, extraction_coverage, extraction_built_in, listing_refs, leaf_provenance, coverage_modes, missing_page_gaps, extraction_resume, compare_plans, translation_plan, skill_routes,
        group_by_budget, summary_plan, budget_arithmetic, changes_to_budget, shortened_texts, marked_snippets, question_routes, skill_suggestions, citation_markers, qa_scores, qa_aggregate, conversation_scopes, filtered_documents, documents_by_ids, ordered_collections, category_seeding, filed_imports, archive_and_remove,
        replaced_chunks, recovered_imports, evicted_cache, corpus_signature, messages_with_skills, undone_answers, compaction_rows, stored_citations,
    )
}

_CITED = """cited AS (SELECT conv_id AS review_id, turn AS ordinal, CASE WHEN turn % 5 = 4 THEN 'src' || (turn + 1) ELSE 'S' || (turn % 3) END AS k, CASE WHEN turn % 2 = 0 THEN conv_id * 3 + turn END AS doc_id, 'Report ' || (conv_id + turn * 40) AS title FROM conversations),
  docs AS (SELECT doc_id, 'Report ' || CASE WHEN doc_id < 120 THEN doc_id ELSE doc_id % 120 + 100 END AS title, sha256(text) AS sha256 FROM documents WHERE doc_id % 11 <> 0),
  only_ AS (SELECT title, min(doc_id) AS doc_id, min(sha256) AS sha256 FROM docs GROUP BY title HAVING count(*) = 1),
  snapshots AS (SELECT review_id, ordinal, k || CASE WHEN row_number() OVER (PARTITION BY review_id, k ORDER BY ordinal) > 1 THEN '.' || (ordinal + 1) ELSE '' END AS key, CASE WHEN c.doc_id IS NOT NULL OR o.doc_id IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS identity,
    coalesce(c.doc_id, o.doc_id) AS doc_id, coalesce(d.title, c.title) AS title, CASE WHEN c.doc_id IS NOT NULL THEN d.sha256 ELSE o.sha256 END AS sha256, CASE WHEN c.doc_id IS NOT NULL THEN CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'available' END WHEN o.doc_id IS NOT NULL THEN 'available' END AS availability
    FROM cited c LEFT JOIN docs d ON d.doc_id = c.doc_id LEFT JOIN only_ o ON o.title = c.title)"""
_STATES = """states AS (SELECT s.review_id, s.doc_id, CASE WHEN s.doc_id IS NULL OR s.sha256 IS NULL THEN 'unverifiable' WHEN n.doc_id IS NULL THEN 'missing' WHEN n.sha256 <> s.sha256 THEN 'changed' ELSE 'current' END AS state FROM snapshots s LEFT JOIN now_ n ON n.doc_id = s.doc_id)"""
_ITEMS = """items AS (SELECT conv_id AS review_id, conv_id * 100 + turn AS item_id, turn AS ordinal, CASE WHEN turn % 3 = 2 THEN 'source' ELSE 'block' END AS kind, CASE turn % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' END AS block_kind,
  ['supported', 'not_reviewed', 'follow_up', 'partly_supported', 'not_applicable', 'not_supported'][length(text) % 6 + 1] AS decision FROM conversations)"""
_RECORDS = r"""records AS (SELECT conv_id AS doc_id, conv_id * 100 + turn AS chunk_id, unnest(regexp_extract_all(text, '[A-Za-z]{4}')) AS value FROM conversations)"""
_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))".format
_ANSWERS = f"""answers AS (SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'de' ELSE 'en' END AS lang, {_NORMAL("CASE WHEN turn % 4 = 3 THEN 'The report does not mention it.' WHEN turn % 7 = 5 THEN 'Es gibt keine Angaben.' ELSE text END")} AS a,
    trim(array_to_string(string_split({_NORMAL('text')}, ' ')[3:5], ' ')) AS g, turn % 5 = 4 AS unanswerable, turn % 2 = 1 OR turn % 3 = 0 AS cites FROM conversations),
  counted AS (SELECT *, CASE WHEN a = '' THEN 0 ELSE len(string_split(a, ' ')) END AS na, CASE WHEN g = '' THEN 0 ELSE len(string_split(g, ' ')) END AS ng,
    CAST(coalesce(list_sum(list_transform(list_distinct(string_split(g, ' ')), lambda w: least(len(list_filter(string_split(a, ' '), lambda x: x = w)), len(list_filter(string_split(g, ' '), lambda x: x = w))))), 0) AS BIGINT) AS both_ FROM answers),
  scores AS (SELECT id, lang, unanswerable, CAST(NOT unanswerable AND g <> '' AND contains(' ' || a || ' ', ' ' || g || ' ') AS INTEGER) AS em, round(CASE WHEN unanswerable OR na = 0 OR ng = 0 THEN 0.0 ELSE 2.0 * both_ / (na + ng) END, 6)::DOUBLE AS f1, a IN ('the report does not mention it', 'es gibt keine angaben') AS abstained, NOT unanswerable AND cites AS citation_correct FROM counted)"""
_Q = "q AS (SELECT c_custkey, c_custkey % 15 AS k FROM customer)"

_ALL_WORDS = [("document-redaction", t, vocabulary.match_of(t)) for t in vocabulary.REDACTION["both"]] + [("document-edit", t, vocabulary.match_of(t)) for use in ("both", "route") for t in vocabulary.EDIT[use]] + list(_WORDS)
_TOKENS = r"CAST(list_sum(list_transform(regexp_extract_all(text, '[^ \t\n\r\f\v]+'), lambda w: CASE WHEN length(w) <= 16 THEN 1 ELSE CAST(ceil(length(w) / 4) AS BIGINT) END)) AS BIGINT)"

ORACLE_SQL = {
    "source_snapshots": f"WITH {_CITED} SELECT * FROM snapshots",
    "evidence_packs": f"""WITH {_CITED}, {_ITEMS}, now_ AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE sha256 END AS sha256 FROM docs WHERE doc_id % 7 <> 0),
      st AS (SELECT s.*, CASE WHEN s.doc_id IS NULL OR s.sha256 IS NULL THEN 'unverifiable' WHEN n.doc_id IS NULL THEN 'missing' WHEN n.sha256 <> s.sha256 THEN 'changed' ELSE 'current' END AS state, row_number() OVER (PARTITION BY review_id ORDER BY ordinal) AS idx FROM snapshots s LEFT JOIN now_ n ON n.doc_id = s.doc_id),
      ln AS (SELECT s.review_id, s.ordinal - 1 AS item, CASE WHEN s.ordinal <> 5 THEN s.idx END AS idx, ['supports', 'qualifies', 'contradicts', 'context', NULL][s.ordinal % 5 + 1] AS relation FROM st s WHERE s.ordinal > 0),
      it AS (SELECT i.review_id, i.ordinal, i.decision, i.block_kind, coalesce(concat_ws('/', l.idx, l.relation), '') AS link FROM items i LEFT JOIN ln l ON l.review_id = i.review_id AND l.item = i.ordinal),
      a AS (SELECT review_id, count(*) FILTER (decision = 'not_reviewed') AS hidden, count(*) FILTER (decision = 'follow_up') AS follow_ups, concat_ws(',', {", ".join(f"count(*) FILTER (decision = '{d}')" for d in evidence.DECISIONS)}) AS counts,
        coalesce(string_agg(concat_ws(':', ordinal, decision, CASE WHEN block_kind = 'heading' THEN 'true' ELSE 'false' END, CASE WHEN ordinal = 1 THEN 'look' END, link), '|' ORDER BY ordinal) FILTER (decision <> 'not_reviewed'), '') AS items FROM it GROUP BY review_id),
      b AS (SELECT review_id, string_agg(concat_ws(':', idx, key, identity, state, CASE WHEN ordinal % 2 = 0 THEN '<s> & ' || key END, CASE WHEN ordinal > 0 AND ordinal <> 5 AND ordinal % 5 < 4 THEN ['supports', 'qualifies', 'contradicts', 'context'][ordinal % 5 + 1] ELSE '' END), '|' ORDER BY idx) AS sources,
        count(*) FILTER (identity = 'unresolved') AS unresolved, count(*) FILTER (availability = 'missing') AS missing, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'missing' AND availability IS DISTINCT FROM 'missing') AS lost FROM st GROUP BY review_id)
      SELECT review_id, CASE WHEN review_id % 3 <> 0 THEN 'Why?' END AS question, hidden, follow_ups, counts, items, sources, unresolved, missing, changed, lost, changed > 0 AS outdated, review_id % 4 = 0 AS answer_changed, CASE WHEN changed > 0 AND review_id % 2 = 0 THEN '2024-05-01' END AS acknowledged_at FROM a JOIN b USING (review_id)""",
    "freshness_status": f"""WITH {_CITED}, now_ AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE sha256 END AS sha256 FROM docs WHERE doc_id % 7 <> 0), {_STATES}
      SELECT review_id, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'unverifiable') AS unverifiable, coalesce(string_agg(concat_ws(':', CAST(doc_id AS VARCHAR), state), ';' ORDER BY concat_ws(':', CAST(doc_id AS VARCHAR), state)) FILTER (state <> 'current'), '') AS fingerprint, count(*) FILTER (state = 'changed') > 0 AS outdated FROM states GROUP BY review_id""",
    "review_gate": f"WITH {_ITEMS}, b AS (SELECT *, CASE WHEN kind = 'block' AND block_kind = 'heading' THEN 'not_applicable' ELSE decision END AS d, kind = 'block' AND coalesce(block_kind, '') <> 'heading' AS needed FROM items) SELECT review_id, count(*) FILTER (needed) AS required, count(*) FILTER (needed AND d <> 'not_reviewed') AS decided, count(*) FILTER (needed) = count(*) FILTER (needed AND d <> 'not_reviewed') AS eligible FROM b GROUP BY review_id",
    "pack_counts": f"""WITH {_CITED}, {_ITEMS}, now_ AS (SELECT * FROM docs WHERE doc_id % 7 <> 0), {_STATES}, i AS (SELECT review_id, {', '.join(f"count(*) FILTER (decision = '{k}') AS {k}" for k in ('supported', 'partly_supported', 'not_supported', 'follow_up', 'not_applicable', 'not_reviewed'))} FROM items GROUP BY review_id),
      s AS (SELECT review_id, {', '.join(f"count(*) FILTER (state = '{k}') AS {k}" for k in ('current', 'changed', 'missing', 'unverifiable'))} FROM states GROUP BY review_id) SELECT i.*, s.* EXCLUDE (review_id) FROM i JOIN s USING (review_id)""",
    "review_items": f"WITH {_ITEMS} SELECT item_id, review_id + 1000 AS conv_id, CASE WHEN ordinal % 2 <> 0 THEN '' WHEN ordinal % 5 = 2 THEN 'S2' WHEN ordinal % 5 < 2 THEN 'S' || (ordinal % 5) || ',S2' ELSE 'S2,S' || (ordinal % 5) END AS keys FROM items WHERE review_id % 4 <> 0",
    "review_append": f"WITH {_ITEMS}, n AS (SELECT review_id, item_id, row_number() OVER (PARTITION BY review_id ORDER BY item_id) AS r FROM items WHERE ordinal >= 3 AND decision <> 'supported') SELECT review_id, item_id, CAST(ordinal AS BIGINT) AS ordinal FROM items WHERE ordinal < 3 UNION ALL SELECT review_id, item_id, (SELECT max(ordinal) FROM items i WHERE i.review_id = n.review_id AND ordinal < 3) + r FROM n",
    "source_context": """WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER w, '') AS b, coalesce(lead(text) OVER w, '') AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      s AS (SELECT conv_id, substr(text, 5, 20) AS snippet FROM conversations WHERE turn = 2 AND substr(text, 5, 20) <> ''),
      h AS (SELECT s.conv_id AS cite_id, min(turn) AS chunk_index, arg_min(struct_pack(text, b, f), turn) AS x, any_value(snippet) AS snippet FROM c JOIN s USING (conv_id) WHERE contains(text, snippet) GROUP BY 1)
      SELECT cite_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(right(concat_ws(chr(10), nullif(x.b, ''), substr(x.text, 1, instr(x.text, snippet) - 1)), 60) || '|' || left(concat_ws(chr(10), substr(x.text, instr(x.text, snippet) + length(snippet)), nullif(x.f, '')), 60)) AS around_md5 FROM h""",
    "image_sessions": "SELECT conv_id AS session_id, count(*) FILTER (role = 'user') AS turns, arg_min(left(text, 30), turn) FILTER (role = 'user') AS first_question FROM conversations GROUP BY conv_id",
    "statement_purge": "SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))",
    "model_benchmarks": "SELECT s_suppkey AS model_id, s_acctbal AS speed, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS quality FROM supplier",
    "model_recommend": """WITH m AS (SELECT p_partkey AS model_id, p_size * 2 AS ram_gb, p_size AS min_ram_gb, p_partkey % 4 AS rank, p_retailprice + p_partkey / 1e6 AS size_gb FROM part), r AS (SELECT unnest([0.5, 1.5, 8.0, 64.0])::DOUBLE AS ram),
      a AS (SELECT ram, model_id, row_number() OVER (PARTITION BY ram ORDER BY rank > 0 DESC, ram_gb DESC, rank DESC, size_gb DESC) AS n FROM r JOIN m ON ram_gb <= ram), b AS (SELECT ram, model_id, row_number() OVER (PARTITION BY ram ORDER BY rank > 0 DESC, min_ram_gb, rank DESC, size_gb) AS n FROM r JOIN m ON min_ram_gb <= ram)
      SELECT ram, coalesce(a.model_id, b.model_id) AS model_id FROM (SELECT * FROM a WHERE n = 1) a FULL JOIN (SELECT * FROM b WHERE n = 1) b USING (ram)""",
    "extraction_listing": f"WITH {_RECORDS} SELECT lower(value) AS key, min(value) AS value, count(*) AS occurrences, count(DISTINCT chunk_id) AS chunks FROM records GROUP BY lower(value)",
    "listing_texts": rf"""WITH v AS (SELECT conv_id AS doc_id, turn, unnest(regexp_extract_all(replace(' ' || lower(text) || ' ', ' ', '  '), ' (th|on|an|in|re) ', 1)) AS value FROM conversations WHERE conv_id % 5 <> 4),
      m AS (SELECT conv_id AS doc_id, count(*) AS total, count(*) FILTER (turn < 3 OR conv_id % 3 > 0) AS scanned, count(*) FILTER ((turn < 3 OR conv_id % 3 > 0) AND conv_id % 5 = 4 AND turn > 0) AS unread FROM conversations GROUP BY conv_id),
      p AS (SELECT DISTINCT doc_id, value, v.turn, CASE v.turn % 3 WHEN 0 THEN 'p. ' || (v.turn + 1) WHEN 1 THEN role ELSE 'section ' || (v.turn + 1) END AS label FROM v JOIN conversations c ON c.conv_id = v.doc_id AND c.turn = v.turn),
      l AS (SELECT doc_id, value, label, min(turn) AS turn FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, value ORDER BY turn) AS n FROM l),
      r AS (SELECT doc_id, value, string_agg(label, ', ' ORDER BY n) FILTER (n <= 4) AS labels, least(count(*), 4) AS shown FROM k GROUP BY ALL),
      i AS (SELECT doc_id, value, count(*) AS n, count(DISTINCT turn) AS places FROM v GROUP BY ALL),
      t AS (SELECT doc_id, count(*) AS kinds, string_agg('- ' || value || ' (×' || n || ') (' || labels || CASE WHEN places > shown THEN '…' ELSE '' END || ')', chr(10) ORDER BY n DESC, value) AS lines FROM i JOIN r USING (doc_id, value) GROUP BY doc_id),
      u AS (SELECT *, CASE WHEN unread > 0 THEN ' (' || unread || ' could not be read)' ELSE '' END AS suffix FROM m LEFT JOIN t USING (doc_id))
      SELECT doc_id, CASE WHEN lines IS NULL THEN 'No amounts found across ' || scanned || ' sections scanned' || suffix || '.' || CASE WHEN unread > 0 AND unread * 2 >= scanned THEN chr(10) || chr(10) || '{analysis.UNREAD_HINT} {analysis.UNREAD_AMOUNTS}' ELSE '' END
        ELSE '{analysis.SUMS_HINT} {analysis.SUMS_AMOUNTS}' || chr(10) || chr(10) || 'Found ' || kinds || ' amounts across ' || CASE WHEN doc_id % 2 = 0 AND scanned >= total THEN 'the whole document — ' ELSE '' END || scanned || ' sections scanned' || suffix || ':' || chr(10) || chr(10) || lines || chr(10) || chr(10) || '{analysis.CAVEAT}' END AS answer FROM u""",
    "collection_list": f"""WITH {MEMBERSHIPS}, {LIBRARY}, c AS (SELECT DISTINCT collection AS name, type FROM memberships), n AS (SELECT collection AS name, count(DISTINCT doc_id) AS documents FROM memberships JOIN library USING (doc_id) WHERE lifecycle IS DISTINCT FROM 'archived' GROUP BY collection)
      SELECT CASE WHEN name = 'de' AND type <> 'builtin' THEN 'Deutsche Texte' ELSE name END AS name, type, coalesce(documents, 0) AS documents FROM c LEFT JOIN n USING (name)""",
    "extraction_coverage": "SELECT conv_id AS doc_id, count(*) AS total, count(*) FILTER (turn % 4 <> 3) AS scanned, count(*) FILTER (turn % 4 = 2) AS unparsed, count(*) FILTER (turn % 4 <> 3) >= count(*) AS whole FROM conversations GROUP BY conv_id",
    "extraction_built_in": "SELECT record_type, value, count(*) AS n FROM (SELECT 'date' AS record_type, '2024-05-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS value FROM customer UNION ALL SELECT 'amount', c_custkey || ' EUR' FROM customer UNION ALL SELECT 'party', 'a' || c_custkey || '@b.org' FROM customer) GROUP BY ALL",
    "listing_refs": """WITH l AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'p. ' || (turn + 1) WHEN 1 THEN role ELSE '§ ' || (turn + 1) END AS label FROM conversations),
      d AS (SELECT conv_id, label, min(turn) AS place FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS n FROM d)
      SELECT conv_id AS key, '(' || string_agg(label, ', ' ORDER BY place) FILTER (n <= 4) || CASE WHEN (SELECT count(*) FROM conversations c WHERE c.conv_id = r.conv_id) > count(*) FILTER (n <= 4) THEN '…' ELSE '' END || ')' AS refs FROM r GROUP BY conv_id""",
    "leaf_provenance": "SELECT conv_id AS doc_id, conv_id * 10000 + turn AS leaf_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations",
    "coverage_modes": """WITH d AS (SELECT doc_id, ['ready', 'building', 'stale', 'failed', 'pending'][doc_id % 5 + 1] AS st, CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS truncated, n_chars % 50 AS leaves, n_chars % 50 + 3 AS chunks FROM documents),
      m AS (SELECT *, st = 'ready' AND NOT coalesce(truncated, false) AS ready, truncated IS NULL AND st IN ('building', 'pending', 'stale') AS partial FROM d)
      SELECT doc_id, CASE WHEN ready OR partial THEN 'tree' ELSE 'capped' END AS mode, CASE WHEN ready OR partial THEN leaves ELSE chunks END AS covered, chunks AS total, CASE WHEN ready THEN false WHEN partial THEN true ELSE coalesce(truncated, false) END AS truncated FROM m""",
    "missing_page_gaps": "WITH p AS (SELECT DISTINCT conv_id AS doc_id, turn + 1 AS page FROM conversations WHERE turn % 3 = 1), e AS (SELECT * FROM p UNION SELECT doc_id, 0 FROM p UNION SELECT doc_id, 13 FROM p), g AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY page) AS before FROM e) SELECT doc_id, CAST(before + 1 AS BIGINT) AS first, CAST(page - 1 AS BIGINT) AS last FROM g WHERE page - before > 1",
    "skill_routes": rf"""WITH q AS (SELECT conv_id * 1000 + turn AS question_id, lower(text || CASE turn WHEN 1 THEN ' Ersetze, please: RENAME it' WHEN 2 THEN ' schwärzend irreplaceable Anonymisierung' WHEN 3 THEN ' sensitive data' ELSE '' END) AS text FROM conversations),
      v AS (SELECT DISTINCT skill_id, lower(term) AS term, match FROM (VALUES {", ".join(f"('{s}', '{t}', '{m}')" for s, t, m in _ALL_WORDS)}) x(skill_id, term, match))
      SELECT question_id, skill_id, string_agg(DISTINCT term, '|' ORDER BY term) AS terms FROM q JOIN v ON CASE WHEN match = 'word' THEN regexp_matches(text, '(^|[^\p{{L}}\p{{N}}])' || term || '([^\p{{L}}\p{{N}}]|$)') ELSE contains(text, term) END GROUP BY ALL""",
    "compare_plans": rf"""WITH RECURSIVE c AS (SELECT conv_id, {_TOKENS} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE {_TOKENS} > 0),
      g AS (SELECT conv_id, n, cost, cost AS total, 0 AS w FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.n, c.cost, CASE WHEN g.total + c.cost > 475 THEN c.cost ELSE g.total + c.cost END, CASE WHEN g.total + c.cost > 475 THEN g.w + 1 ELSE g.w END FROM g JOIN c ON c.conv_id = g.conv_id AND c.n = g.n + 1),
      w AS (SELECT conv_id, w, sum(cost) AS tokens, count(*) AS turns FROM g GROUP BY ALL), p AS (SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id)
      SELECT conv_id AS pair_id, least(any_value(n), 12) AS windows, any_value(n) > 12 AS truncated, CAST(greatest(128, least(512, 1236 // least(any_value(n), 12))) AS BIGINT) AS answer_tokens, CAST(475 AS BIGINT) AS pair_words, least(any_value(n), 12) + 2 AS steps,
        CAST(sum(tokens) AS BIGINT) AS tokens, CAST(max(tokens) AS BIGINT) AS longest, CAST(sum(turns) AS BIGINT) AS turns FROM w JOIN p USING (conv_id) WHERE w < 12 GROUP BY conv_id""",
    "translation_plan": rf"""WITH RECURSIVE s AS (SELECT conv_id, turn, text, {_TOKENS} AS cost, (turn + 1) // 3 AS run FROM conversations WHERE turn % 3 <> 1),
      c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS n FROM s WHERE cost > 0),
      g AS (SELECT conv_id, run, turn, text, n, cost AS total, 0 AS w FROM c WHERE n = 1 UNION ALL SELECT c.conv_id, c.run, c.turn, c.text, c.n, CASE WHEN g.total + c.cost > 720 THEN c.cost ELSE g.total + c.cost END, CASE WHEN g.total + c.cost > 720 THEN g.w + 1 ELSE g.w END FROM g JOIN c ON c.conv_id = g.conv_id AND c.run = g.run AND c.n = g.n + 1),
      l AS (SELECT conv_id, max(turn) + 1 AS last FROM s GROUP BY conv_id),
      b AS (SELECT conv_id, run, 0 AS gap, w, 'window' AS kind, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, CAST(NULL AS BIGINT) AS first, CAST(NULL AS BIGINT) AS last FROM g GROUP BY ALL
        UNION ALL SELECT conv_id, k, 1, 0, 'gap', NULL, 3 * k + 2, 3 * k + 2 FROM l, (SELECT unnest(range(0, 4)) AS k) WHERE 3 * k + 2 < last
        UNION ALL SELECT conv_id, 99, 1, 0, 'gap', NULL, last + 1, 10 FROM l WHERE last < 10)
      SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY run, gap, w) - 1 AS block, kind, text_md5, first, last FROM b""",
    "extraction_resume": r"""WITH t AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn < 2 THEN left(text, 6) ELSE text END AS text FROM conversations), k AS (SELECT * FROM t WHERE regexp_matches(text, '\S')),
      r AS (SELECT doc_id, '__scan__' AS record_type, 'ok' AS normalized FROM k UNION ALL SELECT doc_id, 'amount', CAST(length(text) AS VARCHAR) FROM k WHERE length(text) % 5 <> 0)
      SELECT doc_id, record_type, normalized, count(*) AS n, count(*) AS chunks FROM r GROUP BY ALL""",
    "group_by_budget": """WITH RECURSIVE t AS (SELECT conv_id AS doc_id, turn AS ordinal, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
      g AS (SELECT doc_id, ordinal, r, cost AS total, 1 AS n, 0 AS "group" FROM t WHERE r = 1 UNION ALL
        SELECT t.doc_id, t.ordinal, t.r, CASE WHEN g.n >= 2 AND g.total + t.cost > 400 THEN t.cost ELSE g.total + t.cost END, CASE WHEN g.n >= 2 AND g.total + t.cost > 400 THEN 1 ELSE g.n + 1 END, g."group" + CASE WHEN g.n >= 2 AND g.total + t.cost > 400 THEN 1 ELSE 0 END FROM g JOIN t ON t.doc_id = g.doc_id AND t.r = g.r + 1)
      SELECT doc_id, ordinal, CAST("group" AS INTEGER) AS "group" FROM g""",
    "summary_plan": """WITH RECURSIVE p AS (SELECT doc_id, least(length(unnest(string_split(text, '.'))), 200) AS cost, generate_subscripts(string_split(text, '.'), 1) AS o FROM documents), t AS (SELECT doc_id, cost, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM p WHERE cost > 0),
      g AS (SELECT doc_id, r, cost AS total, 0 AS w FROM t WHERE r = 1 UNION ALL SELECT t.doc_id, t.r, CASE WHEN g.total + t.cost > 200 THEN t.cost ELSE g.total + t.cost END, g.w + CASE WHEN g.total + t.cost > 200 THEN 1 ELSE 0 END FROM g JOIN t ON t.doc_id = g.doc_id AND t.r = g.r + 1),
      n AS (SELECT doc_id, max(w) + 1 AS n FROM g GROUP BY doc_id)
      SELECT doc_id, CAST(least(n, 12) AS INTEGER) AS windows, n > 12 AS truncated, CAST(CASE WHEN n <= 1 THEN 512 ELSE greatest(128, least(512, floor(212 / least(n, 12)))) END AS BIGINT) AS answer_tokens, CAST(CASE WHEN n <= 1 THEN 1 ELSE least(n, 12) + 1 END AS INTEGER) AS steps FROM n""",
    "budget_arithmetic": """WITH o AS (SELECT o_orderkey, o_orderkey % 9000 AS c, o_custkey AS a, o_orderkey % 700 AS b, CAST(floor((o_orderkey % 9000) / 7) AS BIGINT) AS t FROM orders), h AS (SELECT *, least(a, t // 2) AS fa, least(b, t // 2) AS fb FROM o), m AS (SELECT *, least(a - fa, t - fa - fb) AS ma FROM h)
      SELECT o_orderkey, CAST(greatest(200, floor((greatest(1024, c) - 812) / 1.3::DOUBLE)) AS BIGINT) AS summary, CAST(greatest(1, least(greatest(120, least(floor((c - 300) / 5.5::DOUBLE), 720)), floor((c - 300) / 5.5::DOUBLE))) AS BIGINT) AS translation, CAST(greatest(1, fa + ma) AS BIGINT) AS first, CAST(greatest(1, fb + least(b - fb, t - fa - fb - ma)) AS BIGINT) AS second FROM m""",
    "changes_to_budget": """WITH c AS (SELECT conv_id AS pair_id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
      s AS (SELECT pair_id, total, unnest(list_transform(range(32), lambda k: greatest(1, CAST(floor(total / pow(2, k)) AS BIGINT)))) AS size FROM (SELECT DISTINCT pair_id, total FROM c)),
      f AS (SELECT s.pair_id, any_value(s.total) AS total, max(size) FILTER (upto <= 300) AS kept FROM s JOIN c ON c.pair_id = s.pair_id AND c.n = s.size GROUP BY s.pair_id) SELECT pair_id, CAST(coalesce(kept, 1) AS INTEGER) AS kept, coalesce(kept, 1) < total AS cut FROM f""",
    "shortened_texts": r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\S+')) AS w, generate_subscripts(regexp_extract_all(text, '\S+'), 1) AS i FROM conversations), s AS (SELECT *, sum(CASE WHEN length(w) <= 16 THEN 1 ELSE CAST(ceil(length(w) / 4) AS BIGINT) END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS cost FROM w)
      SELECT c.conv_id, c.turn, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (i = 1 OR cost <= 8), '') AS head FROM conversations c LEFT JOIN s USING (conv_id, turn) GROUP BY ALL""",
    "marked_snippets": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS w FROM conversations), h AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g') IN ('the', 'und')) AS hit FROM t), f AS (SELECT *, greatest(0, coalesce(list_position(hit, true) - 1, 0) - 4) AS first FROM h)
      SELECT conv_id, turn, CASE WHEN first > 0 THEN '…' ELSE '' END || coalesce(array_to_string(list_transform(w[first + 1:first + 12], lambda x: CASE WHEN regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g') IN ('the', 'und') THEN '[' || x || ']' ELSE x END), ' '), '') || CASE WHEN first + 12 < len(w) THEN '…' ELSE '' END AS snippet FROM f""",
    "question_routes": f"""WITH {_Q} SELECT c_custkey, CASE WHEN k = 0 THEN CASE WHEN c_custkey % 3 >= 2 THEN 'compare' ELSE 'relevance/compare' END WHEN k IN (1, 2, 3, 13) THEN CASE WHEN c_custkey % 2 = 0 THEN 'coverage-extract' ELSE 'relevance/coverage' END WHEN k IN (4, 5) AND c_custkey % 4 = 0 THEN 'tree-summary' ELSE 'relevance' END AS route,
      CASE WHEN k IN (2, 6) THEN 'date' WHEN k IN (3, 13) THEN 'amount' WHEN k = 7 THEN 'party' ELSE 'generic' END AS record_type, k IN (3, 13) AS aggregation, k IN (8, 12) AS small_talk, k IN (1, 6, 11) AS looks_up FROM q""",
    "skill_suggestions": r"""WITH a AS (SELECT conv_id * 100 + turn AS question_id, turn % 3 AS k, regexp_replace(regexp_replace(text || CASE turn % 3 WHEN 0 THEN ' my bank statement' WHEN 1 THEN ' Invoice?' ELSE ' pre-statement all' END, '(?i)the', 'x', 'g'), '(?i)all([a-z])', 'x\1', 'g') AS q FROM conversations),
      s AS (SELECT question_id, 'app:bank' AS skill_id, CAST((k <> 1) AS INTEGER) AS hits, 2 AS score FROM a UNION ALL SELECT question_id, 'app:invoice', CAST((k = 1) AS INTEGER), 2 + 1 + 1 FROM a UNION ALL
        SELECT question_id, 'user:all', CAST(regexp_matches(lower(q), '(^|[^\p{L}\p{N}])all($|[^\p{L}\p{N}])') AS INTEGER), 3 FROM a)
      SELECT question_id, skill_id, hits, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, skill_id) AS n FROM s WHERE hits > 0 AND score >= 3) WHERE n = 1""",
    "citation_markers": "SELECT conv_id, turn, CASE turn WHEN 2 THEN 'S2,S10' WHEN 10 THEN 'S2,S10' ELSE 'S2,S' || turn || ',S10' END AS markers FROM conversations",
    "qa_scores": f"WITH {_ANSWERS} SELECT *, CASE WHEN unanswerable THEN abstained ELSE em = 1 AND citation_correct END AS correct FROM scores",
    "qa_aggregate": f"""WITH {_ANSWERS}, r AS (SELECT lang, count(*) AS n, avg(em) FILTER (NOT unanswerable) AS em_rate, avg(f1) FILTER (NOT unanswerable) AS mean_f1, avg(CAST(citation_correct AS DOUBLE)) FILTER (NOT unanswerable) AS citation_rate, avg(CAST(abstained AND em = 0 AS DOUBLE)) FILTER (NOT unanswerable) AS over_abstain_rate,
      avg(CAST(abstained AS DOUBLE)) FILTER (unanswerable) AS abstain_rate, avg(CAST(NOT abstained AS DOUBLE)) FILTER (unanswerable) AS hallucination_rate FROM scores GROUP BY lang) SELECT lang, n, {', '.join(f'coalesce(round({c}, 6), 0.0) AS {c}' for c in ('em_rate', 'mean_f1', 'citation_rate', 'over_abstain_rate', 'abstain_rate', 'hallucination_rate'))} FROM r""",
    "conversation_scopes": f"""WITH {MEMBERSHIPS}, c AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT conv_id, unnest(CASE conv_id % 5 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [3, 5, 6, 7] WHEN 2 THEN [3, 5, 6, 7] ELSE [3] END) AS doc_id FROM c
        UNION SELECT conv_id, doc_id FROM c JOIN memberships m ON m.collection = CASE conv_id % 5 WHEN 0 THEN 'src3' WHEN 3 THEN 'src4' WHEN 4 THEN 'src1' END) SELECT conv_id, count(*) AS documents, CAST(min(doc_id) AS BIGINT) AS first FROM s GROUP BY conv_id""",
    "filtered_documents": f"WITH {LIBRARY}, {MEMBERSHIPS} SELECT doc_id, 'needsReindex' AS view FROM library WHERE doc_id % 3 = 0 AND coalesce(lifecycle, 'permanent') = 'permanent' UNION ALL SELECT doc_id, 'unfiled' FROM library WHERE doc_id NOT IN (SELECT doc_id FROM memberships WHERE type = 'project') AND doc_id IN (SELECT doc_id FROM memberships WHERE collection = 'src1')",
    "documents_by_ids": f"""WITH {LIBRARY}, {MEMBERSHIPS}, {tables.CHUNKS} SELECT l.doc_id, title, coalesce((SELECT string_agg(DISTINCT collection, ',' ORDER BY collection) FROM memberships m WHERE m.doc_id = l.doc_id), '') AS collections, (SELECT count(*) FROM chunks c WHERE c.doc_id = l.doc_id) AS chunk_count, (SELECT count(DISTINCT vec_id) FROM embeddings e WHERE e.label = l.doc_id) AS embedded_count FROM library l WHERE l.doc_id IN (1, 3, 5, 8, 13)""",
    "ordered_collections": f"WITH {MEMBERSHIPS}, d AS (SELECT DISTINCT collection AS name, type FROM memberships) SELECT CAST(row_number() OVER (ORDER BY type <> 'builtin', name) - 1 AS INTEGER) AS place, name FROM d",
    "category_seeding": "SELECT n_name AS name, true AS builtin FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT unnest(['Fees', 'Income']), true",
    "filed_imports": f"""WITH {MEMBERSHIPS}, p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 2 AND source <> 'src12' AND source IN (SELECT collection FROM memberships WHERE type = 'project') THEN source ELSE 'Library' END AS collection FROM documents WHERE doc_id % 4 <> 1) SELECT collection, CASE WHEN collection = 'Library' THEN 'builtin' ELSE 'project' END AS type, count(*) AS n FROM p GROUP BY ALL""",
    "archive_and_remove": f"WITH {LIBRARY}, {MEMBERSHIPS} SELECT CASE WHEN doc_id % 10 = 0 THEN 'archived' ELSE coalesce(lifecycle, 'none') END AS name, count(*) AS n FROM library GROUP BY 1 UNION ALL SELECT collection, count(*) FROM memberships WHERE NOT (doc_id % 2 = 0 AND type = 'project') GROUP BY collection",
    "replaced_chunks": f"WITH {tables.CHUNKS}, n AS (SELECT doc_id, chunk_id FROM chunks WHERE doc_id % 4 = 1 AND chunk_id % 2 = 0) SELECT doc_id, chunk_id, token_count FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, chunk_id, 1 FROM n",
    "recovered_imports": f"WITH {LIBRARY}, s AS (SELECT ['queued', 'indexed', 'embedding', 'failed'][doc_id % 4 + 1] AS st, updated_at FROM library) SELECT CASE WHEN st IN ('queued', 'embedding') AND updated_at < 800 THEN 'failed' ELSE st END AS status, count(*) AS n FROM s GROUP BY 1",
    "evicted_cache": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 700",
    "corpus_signature": "SELECT count(*) AS n, max(event_id) AS last, 'events' AS name FROM events UNION ALL SELECT count(*), max(doc_id), 'documents' FROM documents",
    "messages_with_skills": "SELECT conv_id, turn AS seq, CASE WHEN role = 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'Bank' WHEN 1 THEN 'Invoice' END END AS skill_title, turn % 4 = 1 AS has_table FROM conversations",
    "undone_answers": "WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) SELECT c.conv_id, c.turn AS seq, CASE WHEN l.turn IS NOT NULL AND role = 'assistant' THEN 'taken' ELSE 'left' END AS part FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn",
    "compaction_rows": f"""WITH c AS (SELECT conv_id, turn, role, {COST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), d AS (SELECT conv_id, sum(cost) AS tokens, count(*) AS messages, max(turn) AS last, max(turn) FILTER (back > 2 AND role = 'assistant') AS covers_through FROM c GROUP BY conv_id)
      SELECT conv_id, CAST(last + 1 AS INTEGER) AS seq, 'system' AS role, 'so far' AS text, covers_through FROM d WHERE tokens > 510 AND messages >= 4 AND covers_through IS NOT NULL""",
    "stored_citations": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'S1,S2' END AS labels, CASE WHEN turn % 3 = 0 THEN turn END AS page FROM conversations",
}
