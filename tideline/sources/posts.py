"""Posts from archives, provider exports, feeds and status dumps, as one canonical table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import IMAGE_SUFFIXES, VIDEO_SUFFIXES, clean_text, has_suffix, html_to_text, urls
from ..functions.time import iso, utc_day
from ..operators.quality import any_timestamp, keep_latest, post_type, rss_timestamp
from .json_arrays import as_lines, is_array

# Names under which providers give the same field, in the order they are tried.
WRAPPERS = ["data", "items", "results", "posts", "response"]
ALIASES = {
    "post_id": ["post_id", "id", "postId", "post_id_str"],
    "created": ["created_at_utc", "createdAtUtc", "created_at", "createdAt", "created", "published_at", "publishedAt", "timestamp"],
    "received": ["received_at", "received_at_utc", "receivedAtUtc", "receivedAt", "fetched_at", "fetchedAt", "scraped_at", "scrapedAt", "collected_at"],
    "ingested": ["ingested_at", "ingested_at_utc", "ingestedAt", "ingestedAtUtc"],
    "author": ["author_id", "authorId", "account_id", "accountId", "account.id"],
    "text": ["text", "text_raw", "content", "body", "status", "full_text", "description"],
    "media": ["media", "media_urls", "mediaUrls", "media_attachments", "mediaAttachments"],
    "type": ["post_type", "type", "kind"],
    "url": ["url", "permalink", "uri", "post_url", "postUrl"],
    "language": ["language", "lang"],
    "parent": ["parent_post_id", "in_reply_to_id"],
    "quoted": ["quoted_post_id", "quote_id"],
    "replies": ["replies_count", "reply_count", "replies", "replyCount"],
    "reblogs": ["reblogs_count", "repost_count", "reblogs", "retweet_count"],
    "likes": ["favourites_count", "favourite_count", "likes_count", "likes"],
}


def read_rows(spark: SparkSession, path: str, *, limit: int | None = None) -> DataFrame:
    """JSON (array, lines, or wrapped under known names, nested too), CSV or Parquet by suffix; `limit` rows before anything else.

    Arrays, lines and Parquet are read by as many tasks as they have splits; a wrapped payload and CSV with line breaks in it by one for each file.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        rows = spark.read.parquet(path)
    elif name.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif name.endswith((".jsonl", ".ndjson")):
        rows = unwrap(spark.read.json(path))
    elif is_array(spark, path):
        rows = unwrap(spark.read.json(as_lines(spark, path, limit=limit)))
    else:
        rows = unwrap(spark.read.option("multiLine", True).json(path))
    return rows if limit is None else rows.limit(limit)


def unwrap(df: DataFrame, *, inner: bool = False) -> DataFrame:
    """The records below known wrapper names: arrays are tried before objects, at every level. A payload without any is an error."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = [w for w in WRAPPERS if w in kinds]
    if not found:
        if inner or not kinds or set(kinds) == {"_corrupt_record"}:
            raise ValueError("the payload holds no records")
        return df
    for w in found:
        if isinstance(kinds[w], T.ArrayType) and isinstance(kinds[w].elementType, T.StructType):
            return df.select(F.explode(w).alias("_row")).select("_row.*")
    for w in found:
        if isinstance(kinds[w], T.StructType):
            return unwrap(df.select(f"{w}.*"), inner=True)
    raise ValueError("the payload holds no records")


def has_field(schema: T.StructType, path: str) -> bool:
    head, _, rest = path.partition(".")
    for f in schema.fields:
        if f.name == head:
            return not rest or (isinstance(f.dataType, T.StructType) and has_field(f.dataType, rest))
    return False


def first_of(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first non-null of the fields that df has, as text."""
    present = [F.col(n).cast("string") for n in names if has_field(df.schema, n)]
    present = [F.nullif(c, F.lit("NaN")) for c in present]  # floats that aren't numbers are this text too
    return F.coalesce(*present, *([default] if default is not None else [])) if present or default is not None else F.lit(None).cast("string")


def collected_urls(df: DataFrame, names: list[str]) -> Column:
    """Addresses in the first non-null field: text, arrays, arrays of objects with url, src or href, objects of these."""

    def of(c: Column, kind: T.DataType) -> Column:
        none = F.array().cast("array<string>")
        if isinstance(kind, T.StringType):
            return F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(none)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            keys = [k for k in ("url", "src", "href") if k in kind.elementType.names]
            return F.coalesce(F.array_compact(F.transform(c, lambda x: F.coalesce(*(F.nullif(x[k].cast("string"), F.lit("")) for k in keys)))), none) if keys else none
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.filter(c.cast("array<string>"), lambda x: x.isNotNull() & (x != "")), none)
        if isinstance(kind, T.StructType):
            return F.concat(none, *(of(c[f.name], f.dataType) for f in kind.fields))
        return F.when(c.isNotNull(), F.array(c.cast("string"))).otherwise(none)

    out = F.array().cast("array<string>")
    for n in reversed([n for n in names if n in df.columns]):
        out = F.when(F.col(n).isNotNull(), of(F.col(n), df.schema[n].dataType)).otherwise(out)
    return out


def metric(df: DataFrame, names: list[str]) -> Column:
    return F.coalesce(first_of(df, names).try_cast("double").cast("long"), F.lit(0))


def sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def _canonical(df: DataFrame, source_name: str, source_provider: str, fields: dict[str, Column], hash_urls: bool) -> DataFrame:
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    out = df.select(F.lit(source_name).alias("source_name"), F.lit(source_provider).alias("source_provider"), *(c.alias(k) for k, c in fields.items()), raw.alias("raw_json"))
    out = out.withColumns({"text_clean": clean_text(F.col("text_raw")), "urls": sorted_set(F.concat("_own_urls", urls(F.col("text_raw"))))})
    parts = F.concat(F.array("post_id", "text_clean"), F.col("media_urls"), F.col("urls") if hash_urls else F.array().cast("array<string>"))
    return out.withColumns(
        {"has_image": has_suffix(F.col("media_urls"), IMAGE_SUFFIXES), "has_video": has_suffix(F.col("media_urls"), VIDEO_SUFFIXES), "content_hash": F.sha2(F.array_join(parts, "|"), 256)}
    ).drop("_own_urls")


def normalise_archive(df: DataFrame, *, source_name: str = "archive", source_provider: str = "archive", author_id: str = "author") -> DataFrame:
    """Archive rows (id, created_at, content, url, media, counts) as posts; receipt defaults to creation."""
    created = any_timestamp(first_of(df, ["created_at"]))
    count = lambda c: F.coalesce(first_of(df, [c]).try_cast("double").cast("long"), F.lit(0))
    return _canonical(
        df, source_name, source_provider,
        {
            "post_id": first_of(df, ["id"]), "author_id": F.lit(author_id), "created_at_utc": created, "received_at_utc": F.coalesce(any_timestamp(first_of(df, ["received_at"])), created), "ingested_at_utc": F.current_timestamp(),
            "text_raw": first_of(df, ["content"], F.lit("")), "language": F.lit("en"), "post_type": first_of(df, ["post_type"], F.lit("original")), "parent_post_id": first_of(df, ["parent_post_id"]), "quoted_post_id": first_of(df, ["quoted_post_id"]),
            "_own_urls": collected_urls(df, ["url"]), "media_urls": collected_urls(df, ["media"]), "engagement": F.struct(count("replies_count").alias("replies_count"), count("reblogs_count").alias("reblogs_count"), count("favourites_count").alias("favourites_count")),
        },
        hash_urls=False,
    )


def load_archive(spark: SparkSession, path: str, *, limit: int | None = None, dedupe: bool = False, **names) -> DataFrame:
    """An archive as posts ordered by creation and id; with dedupe, the newest ingest per (post_id, content_hash)."""
    out = normalise_archive(read_rows(spark, path, limit=limit), **names)
    if dedupe:
        out = keep_latest(out, ["post_id", "content_hash"], [F.col("ingested_at_utc"), F.col("received_at_utc"), F.col("raw_json")])
    return out.orderBy("created_at_utc", "post_id")


def normalise_provider(df: DataFrame, *, source_name: str = "provider", source_provider: str = "external") -> DataFrame:
    """Provider rows as posts by the first alias that has a value. A row without id or creation time has nulls there: see post_problems()."""
    a = ALIASES
    created = any_timestamp(first_of(df, a["created"]))
    media = sorted_set(collected_urls(df, a["media"]))
    return _canonical(
        df, source_name, source_provider,
        {
            "post_id": first_of(df, a["post_id"]), "author_id": first_of(df, a["author"], F.lit("unknown_author")), "created_at_utc": created, "received_at_utc": F.coalesce(any_timestamp(first_of(df, a["received"])), created),
            "ingested_at_utc": F.coalesce(any_timestamp(first_of(df, a["ingested"])), F.current_timestamp()), "text_raw": first_of(df, a["text"], F.lit("")), "language": first_of(df, a["language"], F.lit("en")),
            "post_type": post_type(first_of(df, a["type"], F.lit("original"))), "parent_post_id": first_of(df, a["parent"]), "quoted_post_id": first_of(df, a["quoted"]), "_own_urls": collected_urls(df, a["url"]), "media_urls": media,
            "engagement": F.struct(metric(df, a["replies"]).alias("replies_count"), metric(df, a["reblogs"]).alias("reblogs_count"), metric(df, a["likes"]).alias("favourites_count")),
        },
        hash_urls=True,
    )


def newest(posts: DataFrame) -> DataFrame:
    """The newest receipt per (post_id, content_hash)."""
    return keep_latest(posts, ["post_id", "content_hash"], [F.col("received_at_utc"), F.col("ingested_at_utc"), F.col("raw_json")])


def load_provider(spark: SparkSession, path: str, *, limit: int | None = None, **names) -> DataFrame:
    return newest(normalise_provider(read_rows(spark, path, limit=limit), **names)).orderBy("created_at_utc", "post_id")


def normalise_statuses(df: DataFrame, *, received_at: str | None = None, **names) -> DataFrame:
    """Status-API rows: receipt stamped where absent, type from reblog, quote and reply fields, then as provider rows."""
    present = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    kind = F.when(present("reblog"), "retruth").when(present("quote_id") | present("quote"), "quote").when(present("in_reply_to_id"), "reply").otherwise("original")
    stamp = F.lit(received_at) if received_at else iso(F.current_timestamp())
    df = df.withColumns({"received_at": first_of(df, ["received_at"], stamp), "post_type": kind})
    return normalise_provider(df, **names)


def load_feed(spark: SparkSession, path: str, *, source_name: str = "feed", source_provider: str = "feed", start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """RSS items as posts: id from guid, else the link's tail, else a hash; text from the description, else the title. start and end are days (UTC), both included."""
    rows = spark.read.format("xml").option("rowTag", "item").option("inferSchema", False).load(path)
    rows = rows if limit is None else rows.limit(limit)
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(first_of(rows, [n])), F.lit("")) for n in names if has_field(rows.schema, n)] or [F.lit(None).cast("string")])
    guid = text("guid._VALUE") if has_field(rows.schema, "guid._VALUE") else text("guid")
    link, title, raw = text("link"), text("title"), text("description")
    tail = F.nullif(F.regexp_extract(link, r"/([^/?#]+)$", 1), F.lit(""))
    published = text("pubDate", "dc:date")
    shown = html_to_text(raw)
    low, category = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(shown)), F.lower(F.coalesce(text("category"), F.lit("")))
    kind = F.when(category.contains("retruth") | category.contains("re-truth"), "retruth").when(category.isin("reply", "re", "retweet"), "reply").when(category.isin("quote", "quoted"), "quote")
    kind = kind.when(low.startswith("rt "), "reply").when(low.contains("retruth"), "retruth").when(low.contains("quote:"), "quote").otherwise("original")
    media = F.array().cast("array<string>")
    flat = rows.select(
        F.coalesce(guid, tail, F.sha2(F.concat_ws("|", published, title, raw), 256)).alias("post_id"), iso(rss_timestamp(published)).alias("created_at"), F.coalesce(F.nullif(shown, F.lit("")), title, F.lit("")).alias("text"),
        kind.alias("post_type"), link.alias("url"), F.regexp_replace(F.coalesce(text("author", "dc:creator"), F.lit("unknown_author")), "^@", "").alias("author_id"), F.array_distinct(F.concat(media, *_feed_media(rows))).alias("media"),
    )
    posts = keep_latest(normalise_provider(flat, source_name=source_name, source_provider=source_provider), ["post_id", "content_hash"], [F.col("ingested_at_utc"), F.col("raw_json")])
    if start:
        posts = posts.where(utc_day(F.col("created_at_utc")) >= F.lit(start).cast("date"))
    if end:
        posts = posts.where(utc_day(F.col("created_at_utc")) <= F.lit(end).cast("date"))
    return posts.orderBy("created_at_utc", "post_id")


def _feed_media(rows: DataFrame) -> list[Column]:
    """Addresses in the attributes of enclosures and media elements, one or several."""
    out = []
    for name in ("enclosure", "media:content", "image"):
        if name in rows.columns:
            kind, c = rows.schema[name].dataType, F.col(f"`{name}`")
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and "_url" in kind.elementType.names:
                out.append(F.coalesce(F.array_compact(F.transform(c, lambda x: x["_url"])), F.array().cast("array<string>")))
            elif isinstance(kind, T.StructType) and "_url" in kind.names:
                out.append(F.when(c["_url"].isNotNull(), F.array(c["_url"])).otherwise(F.array().cast("array<string>")))
    return out


def first_source(spark: SparkSession, loaders: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame | None, DataFrame]:
    """Posts of the first source that yields rows, and a status row for each that was tried."""
    log, found = [], None
    for name, load in loaders:
        try:
            df = load()
            empty = df.isEmpty()
            log.append((name, "empty" if empty else "used", None))
        except (AnalysisException, ValueError, OSError) as e:  # missing or unreadable input; other errors are faults of a loader
            empty = True
            log.append((name, "failed", str(e)[:200]))
        if not empty:
            found = df
            break
    return found, spark.createDataFrame(log, "source string, status string, error string")
