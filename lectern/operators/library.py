"""Documents, collections and scopes: which documents a question or a list covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T

LARGE = 10 * 1024 * 1024
#: File titles that name no particular document.
GENERIC_TITLES = ("document", "file", "report", "untitled", "scan", "page", "dokument", "datei", "seite")


def scope(documents: DataFrame, memberships: DataFrame, collections: list[str] = (), ids: list[int] = (), archived: bool = False) -> DataFrame:
    """Documents of any of the collections or ids; all if neither is given; archived ones only on request."""
    rows = documents
    if collections or ids:
        members = memberships.where(F.col("collection").isin(*collections)).select("doc_id").distinct().withColumn("_in", F.lit(True))
        rows = rows.join(members, "doc_id", "left")
        chosen = F.coalesce("_in", F.lit(False))
        rows = rows.where(chosen | F.col("doc_id").isin(*ids) if ids else chosen).drop("_in")
    return rows if archived else rows.where(F.coalesce("lifecycle", F.lit("permanent")) != "archived")


def searchable(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Indexed documents that have chunks, in the order of their creation."""
    return documents.where("status = 'indexed'").join(chunks.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("created_at", "doc_id")


def only_in(memberships: DataFrame, collection: str) -> DataFrame:
    """Documents of a collection that no other collection holds."""
    own = memberships.where(F.col("collection") == collection).select("doc_id").distinct()
    return own.join(memberships.where(F.col("collection") != collection).select("doc_id"), "doc_id", "left_anti")


def unfiled(documents: DataFrame, memberships: DataFrame) -> DataFrame:
    """Documents in no project."""
    return documents.join(memberships.where("type = 'project'").select("doc_id"), "doc_id", "left_anti")


def listing(documents: DataFrame, memberships: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents, the newest first, with their collections and numbers of chunks and vectors."""
    held = memberships.groupBy("doc_id").agg(F.array_sort(F.collect_set("collection")).alias("collections"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    embedded = vectors.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("embedded_count"))
    rows = documents.join(held, "doc_id", "left").join(counts, "doc_id", "left").join(embedded, "doc_id", "left")
    rows = rows.withColumn("collections", F.array_join(F.coalesce("collections", F.array().cast("array<string>")), ","))
    return rows.fillna(0, ["chunk_count", "embedded_count"]).orderBy(F.col("created_at").desc(), F.col("doc_id").desc())


def needs_reindex(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: whether there are indexed documents with chunks, but none with a vector."""
    indexed = documents.where("status = 'indexed'").join(chunks.select("doc_id").distinct(), "doc_id", "left_semi")
    found = indexed.join(vectors.select("doc_id").distinct().withColumn("_v", F.lit(1)), "doc_id", "left")
    return found.agg(F.count("*").alias("indexed"), F.count("_v").alias("embedded")).withColumn("needs_reindex", (F.col("indexed") > 0) & (F.col("embedded") == 0))


def smart_views(documents: DataFrame, memberships: DataFrame) -> DataFrame:
    """A row (view, documents) for each smart view."""
    rows, views = _views(documents, memberships)
    counted = rows.select(*[F.sum(c.cast("long")).alias(v) for v, c in views.items()])
    return counted.unpivot([], list(views), "view", "documents").withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))


def _views(documents: DataFrame, memberships: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The documents with what the views look at, and the views."""
    filed = memberships.where("type = 'project'").select("doc_id").distinct().withColumn("_p", F.lit(True))
    rows = documents.join(filed, "doc_id", "left")
    views = {
        "archived": F.coalesce("lifecycle", F.lit("permanent")) == "archived", "unfiled": F.col("_p").isNull(), "large": F.coalesce(F.col("size_bytes") >= LARGE, F.lit(False)),
        "failed": F.col("status") == "failed", "audio": F.coalesce(F.col("mime_type").startswith("audio/"), F.lit(False)),
    }
    for name, column in (("generated", "origin"), ("needsReindex", "stale_embeddings"), ("ocr", "ocr")):
        if column in documents.columns:
            views[name] = F.coalesce(F.col(column), F.lit(False)) if documents.schema[column].dataType.typeName() == "boolean" else F.col(column).isNotNull()
    return rows, views


def filtered(documents: DataFrame, memberships: DataFrame, view: str | None = None, lifecycle: str | None = None, collection: str | None = None) -> DataFrame:
    """The documents of a view, a lifecycle (none given counts as permanent) and a collection, the last changed first."""
    names, rows = documents.columns, documents
    if view:
        rows, views = _views(documents, memberships)
        rows = rows.where(views[view])
    if lifecycle:
        rows = rows.where(F.coalesce("lifecycle", F.lit("permanent")) == lifecycle)
    if collection:
        rows = rows.join(memberships.where(F.col("collection") == collection).select("doc_id"), "doc_id", "left_semi")
    return rows.select(*names).orderBy(F.col("updated_at").desc(), F.col("doc_id").desc())


def named_documents(documents: DataFrame, question: str) -> DataFrame:
    """Documents whose title the question names; none if it names all of several."""
    asked = F.lit(question)
    title = T.normalised(F.col("title"))
    stem = T.normalised(F.regexp_replace("title", r"\.[A-Za-z0-9]+$", ""))
    fits = lambda form: (F.length(form) >= 3) & ~form.isin(*GENERIC_TITLES) & T.contains_words(T.normalised(asked), form)
    marked = documents.withColumn("_hit", fits(title) | fits(stem))
    totals = marked.agg(F.count("*").alias("_n"), F.sum(F.col("_hit").cast("long")).alias("_h"))
    return marked.where("_hit").crossJoin(F.broadcast(totals)).where((F.col("_h") < F.col("_n")) | (F.col("_n") == 1)).drop("_hit", "_n", "_h")  # one row


def staleness(generated: DataFrame, documents: DataFrame) -> DataFrame:
    """Why a generated document (doc_id, made_at, sources) is out of date; null if it isn't.

    A source that is gone or archived outweighs one that was updated since.
    """
    source = documents.select(F.col("doc_id").alias("source_id"), "updated_at", F.coalesce("lifecycle", F.lit("permanent")).alias("_life"))
    rows = generated.select("doc_id", "made_at", F.explode_outer("sources").alias("source_id")).join(source, "source_id", "left")
    removed = F.col("source_id").isNotNull() & (F.col("_life").isNull() | (F.col("_life") == "archived"))
    changed = F.coalesce(F.col("updated_at") > F.col("made_at"), F.lit(False))
    found = rows.groupBy("doc_id").agg(F.max(removed.cast("int")).alias("r"), F.max(changed.cast("int")).alias("c"))
    return found.select("doc_id", F.when(F.col("r") == 1, "source-removed").when(F.col("c") == 1, "source-changed").alias("reason"))


def recovered(documents: DataFrame, cutoff: Column) -> DataFrame:
    """Documents whose import was cut short before the cutoff become failed."""
    stuck = F.col("status").isin("queued", "extracting", "chunking", "embedding") & (F.col("updated_at") < cutoff)
    return documents.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def added(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the rows whose keys it doesn't have yet; of rows that share a key the least by their other columns."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*([c for c in rows.columns if c not in keys] or keys)))
    fresh = rows.withColumn("_n", rank).where("_n = 1").drop("_n").join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh)


def replaced(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with its rows of the given keys replaced."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def latest(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; of equally new ones the greatest by its other columns."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc(), *(F.col(c).desc() for c in table.columns if c not in (*keys, order))))
    return table.withColumn("_n", rank).where("_n = 1").drop("_n")


def without(tables: dict[str, DataFrame], ids: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """All tables without the rows of the deleted documents."""
    return {name: t.join(ids.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def kept_newest(table: DataFrame, cap: int, order: list[Column]) -> DataFrame:
    """The first ``cap`` rows of an order."""
    return table.orderBy(*order).limit(cap)


def _scopes(conversations: DataFrame) -> DataFrame:
    """Each conversation's collections ``c`` and own documents ``d``."""
    new = F.from_json("scope_json", "collectionIds array<string>, documentIds array<long>")
    old = F.from_json("ids_json", "array<long>")
    usable = F.coalesce(F.size(new["collectionIds"]) > 0, F.lit(False)) | F.coalesce(F.size(new["documentIds"]) > 0, F.lit(False))
    legacy = F.coalesce(F.size(old) > 0, F.lit(False))
    return conversations.select("conv_id", F.when(usable, new["collectionIds"]).when(legacy, F.array().cast("array<string>")).otherwise(F.array(F.coalesce("project", F.lit("Library")))).alias("c"), F.when(usable, new["documentIds"]).when(legacy, old).alias("d"))


def resolved_scope(conversations: DataFrame, memberships: DataFrame, attachments: DataFrame) -> DataFrame:
    """Documents (conv_id, doc_id) in each conversation's scope.

    The scope is that of ``scope_json`` (collectionIds, documentIds); else the ids of the older
    ``ids_json``; else the conversation's project; else the collection Library. Attached documents
    always belong to it. Text that is no JSON counts as none.
    """
    rows = _scopes(conversations)
    by_collection = rows.select("conv_id", F.explode("c").alias("collection")).join(memberships, "collection").select("conv_id", "doc_id")
    return by_collection.union(rows.select("conv_id", F.explode("d").alias("doc_id"))).union(attachments.select("conv_id", "doc_id")).distinct()


def scope_sizes(conversations: DataFrame, memberships: DataFrame, attachments: DataFrame) -> DataFrame:
    """How many documents each scope of ``resolved_scope`` has, and the first (conv_id, documents, first); none for an empty one.

    Conversations with the same collections share their documents, so these are counted once for each
    distinct set of collections; only the documents that conversations name themselves are looked up in them.
    """
    rows = _scopes(conversations).select("conv_id", F.array_sort(F.array_distinct(F.coalesce("c", F.array().cast("array<string>")))).alias("c"), "d")
    held = rows.select("c").distinct().select("c", F.explode("c").alias("collection")).join(memberships, "collection").select("c", "doc_id").distinct()
    shared = held.groupBy("c").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
    # a conversation may stand in several rows: its scope is that of all of them
    sets = rows.groupBy("conv_id").agg(F.collect_set("c").alias("sets"))
    one, many = sets.where(F.size("sets") == 1).select("conv_id", F.col("sets")[0].alias("c")), sets.where(F.size("sets") > 1)
    own = rows.select("conv_id", F.explode("d").alias("doc_id")).union(attachments.select("conv_id", "doc_id"))
    wide = many.select("conv_id", F.explode("sets").alias("c")).join(held, "c").select("conv_id", "doc_id")
    own = own.union(wide).distinct().join(one, "conv_id", "left")
    same = F.expr("own.c <=> held.c AND own.doc_id <=> held.doc_id")
    more = own.alias("own").join(held.alias("held"), same, "left_anti").groupBy("conv_id").agg(F.count("*").alias("more"), F.min("doc_id").alias("own_low"))
    both = one.join(shared, "c").select("conv_id", "n", "low").join(more, "conv_id", "full")
    return both.select("conv_id", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("documents"), F.least("low", "own_low").alias("first"))


def ordered_collections(collections: DataFrame) -> DataFrame:
    """Collections, built-in ones first, then by name."""
    return collections.orderBy((F.col("type") != "builtin").cast("int"), "name")


def seeded(categories: DataFrame, names: list[str]) -> DataFrame:
    """The categories (name, builtin) with those of the names that are missing, as built-in ones."""
    fresh = categories.sparkSession.createDataFrame([(n, True) for n in dict.fromkeys(names)], "name string, builtin boolean")
    return categories.unionByName(fresh.join(categories.where("builtin").select("name"), "name", "left_anti").select(*categories.columns))


def filed(imports: DataFrame, collections: DataFrame) -> DataFrame:
    """Where imported documents (doc_id, destination, target) belong: the project if there is one of that name, else the Library; temporary ones nowhere."""
    known = collections.where("type = 'project'").select(F.col("name").alias("target"), F.lit(True).alias("_there"))
    rows = imports.join(known, "target", "left")
    place = F.when((F.col("destination") == "project") & F.col("_there"), F.col("target")).otherwise("Library")
    return rows.where("destination <> 'temporary'").select("doc_id", place.alias("collection"), F.when(place == "Library", "builtin").otherwise("project").alias("type"))


def archived(documents: DataFrame, ids: DataFrame, on: bool = True) -> DataFrame:
    """The documents with the lifecycle of some set to archived or back to permanent."""
    rows = documents.join(ids.select("doc_id").distinct().withColumn("_on", F.lit(True)), "doc_id", "left")
    return rows.withColumn("lifecycle", F.when(F.col("_on"), "archived" if on else "permanent").otherwise(F.col("lifecycle"))).drop("_on").select(*documents.columns)


def removed(memberships: DataFrame, gone: DataFrame) -> DataFrame:
    """The memberships without those (doc_id, collection) that are taken away."""
    return memberships.join(gone.select("doc_id", "collection").distinct(), ["doc_id", "collection"], "left_anti")


def renamed(collections: DataFrame, memberships: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Collections and memberships with a project's name changed; a built-in collection keeps its name, and one that is there already is an error."""
    there = collections.where(F.col("name") == new).limit(1).count()
    if there and old != new:
        raise ValueError(f"there is a collection {new} already")
    own = (F.col("name") == old) & (F.col("type") != "builtin")
    changed = collections.where(own).select("name").distinct().withColumn("_new", F.lit(new)).withColumnRenamed("name", "collection")
    moved = memberships.join(changed, "collection", "left").withColumn("collection", F.coalesce("_new", "collection")).select(*memberships.columns)
    return collections.withColumn("name", F.when(own, new).otherwise(F.col("name"))), moved


def with_counts(collections: DataFrame, memberships: DataFrame, documents: DataFrame) -> DataFrame:
    """Collections in their order (name, type, documents): how many documents, archived ones apart, each has."""
    live = documents.where(F.coalesce(F.col("lifecycle") != "archived", F.lit(True))).select("doc_id")
    n = memberships.join(live, "doc_id").groupBy(F.col("collection").alias("name")).agg(F.count_distinct("doc_id").alias("documents"))
    return ordered_collections(collections.join(n, "name", "left").fillna(0, ["documents"]).select(*collections.columns, "documents"))


def listed_by_ids(documents: DataFrame, memberships: DataFrame, chunks: DataFrame, vectors: DataFrame, ids: list[int]) -> DataFrame:
    """The document list for some ids; only their rows are counted."""
    own = F.col("doc_id").isin(*ids)
    return listing(*(t.where(own) for t in (documents, memberships, chunks, vectors)))


def signature(table: DataFrame, seq: str) -> DataFrame:
    """One row that changes with the table: how many rows it has and the last number."""
    return table.agg(F.count("*").alias("n"), F.max(seq).alias("last"))
