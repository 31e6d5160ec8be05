"""Who may see what: scopes, narrowing filters, expiry, and caches with a time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States in which a document can be searched; bounds of a look-back in hours.
SEARCHABLE = ("ready",)
LEAST_HOURS, MOST_HOURS = 1, 168


def visible(owner: Column, visibility: Column, me: str) -> Column:
    return (owner == me) | (visibility == "shared")


def resolved_scope(collections: DataFrame, chat: int, extras: list[int]) -> DataFrame:
    """(id, ord) of the collections of a chat: its own container and all shared ones, then ``extras`` not yet among them.

    ``collections``: (id, kind, chat_id, visibility). The first place of an id counts.
    """
    spark = collections.sparkSession
    own = collections.where(((F.col("kind") == "chat") & (F.col("chat_id") == chat)) | (F.col("visibility") == "shared"))
    first = own.select("id", F.lit(-1).alias("ord"))
    more = spark.createDataFrame([(int(x), i) for i, x in enumerate(extras)], "id long, ord int")  # as long as the request
    return first.unionByName(more).groupBy("id").agg(F.min("ord").alias("ord"))


def searchable(documents: DataFrame, scope: DataFrame, collection: str, status: str = "status", ready: tuple[str, ...] = SEARCHABLE) -> DataFrame:
    """Documents of a scope (id) in a state that can be searched; an empty scope has none."""
    return documents.where(F.col(status).isin(*ready)).join(scope.select(F.col("id").alias(collection)), collection, "left_semi")


def narrowed(rows: DataFrame, ids: list | None = None, tags: list[str] | None = None, since=None, until=None, mime: str | None = None, source_type: str | None = None, page: int | None = None) -> DataFrame:
    """Rows (id, tags, created_at, mime, source_type, page) that pass every given filter; filters only ever narrow."""
    out = rows
    if ids:
        out = out.where(F.col("id").isin(ids))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("created_at") <= F.lit(until))
    for name, value in (("mime", mime), ("source_type", source_type), ("page", page)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def summary_scope(summaries: DataFrame, source_type: str | None = None, page: int | None = None) -> DataFrame:
    """Summaries belong to whole documents: asking for web sources or for a page leaves none."""
    return summaries.where(F.lit(source_type != "web" and page is None))


def web_branch(chunks: DataFrame, documents: DataFrame, chat: int | None) -> DataFrame:
    """Chunks (source_type, document_id, chat_id) of scoped documents (document_id), and the web chunks of the chat."""
    own = chunks.where("source_type = 'document'").join(documents.select("document_id"), "document_id", "left_semi")
    if chat is None:
        return own
    return own.unionByName(chunks.where((F.col("source_type") == "web") & (F.col("chat_id") == chat)).select(own.columns))


def clamped_hours(hours: Column) -> Column:
    return F.greatest(F.lit(LEAST_HOURS), F.least(F.lit(MOST_HOURS), hours))


def invite_status(revoked: Column, used: Column, expires: Column, now: Column) -> Column:
    """The first that holds of: revoked, used, expired; else live."""
    return F.when(revoked, "revoked").when(used, "used").when(expires <= now, "expired").otherwise("live")


def fresh(created: Column, now: Column, ttl: str) -> Column:
    """Whether an entry of a cache is younger than its time to live."""
    return created > now - F.expr(f"INTERVAL {ttl}")


def cached(queries: DataFrame, cache: DataFrame, now: Column, ttl: str) -> DataFrame:
    """``queries`` (hash, ...) with ``value`` of the newest fresh entry of ``cache`` (hash, value, created_at), else null."""
    live = cache.where(fresh(F.col("created_at"), now, ttl)).groupBy("hash").agg(F.max_by("value", "created_at").alias("value"))
    return queries.join(live, "hash", "left")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """``cache`` with ``entries`` (unique by hash) in place of what their hashes held."""
    return cache.join(entries.select("hash"), "hash", "left_anti").unionByName(entries.select(cache.columns))


def expired(rows: DataFrame, now: Column, at: str = "expires_at") -> DataFrame:
    """Rows that a sweep takes away; rows without an end stay."""
    return rows.where(F.col(at) <= now)


def free_model(name: Column) -> Column:
    """Model ids that end in ``:free`` or whose last part of the path is ``free``."""
    return name.endswith(":free") | (F.element_at(F.split(name, "/"), -1) == "free")


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and the rows of ``wanted`` whose keys it lacks."""
    return existing.unionByName(wanted.dropDuplicates(keys).join(existing.select(keys), keys, "left_anti").select(existing.columns))
