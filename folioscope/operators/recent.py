"""Operation log, recency buckets and the recent-activity graph.

Every function takes the report date; none reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import links as L
from folioscope.functions import text as T

#: Bucket width in days, number of buckets, days that are still shown.
DAYS, BUCKETS = 3, 7
BUCKETED = DAYS * BUCKETS
SHOWN = BUCKETED + DAYS
#: Operations that a commit subject may name before its colon.
OPS = ("ingest", "query", "lint", "audit", "evolve", "migrate", "checkpoint", "restore", "undo", "compile", "refactor")


def age_days(day: Column, anchor: Column) -> Column:
    return F.datediff(anchor, day)


def bucket_of(age: Column) -> Column:
    """r0..r6 for three days each, then floating; null for later and future days."""
    return F.when((age >= 0) & (age < BUCKETED), F.concat(F.lit("r"), F.floor(age / DAYS).cast("string"))).when((age >= BUCKETED) & (age < SHOWN), "floating")


def bucket_rank(bucket: Column) -> Column:
    return F.when(bucket.startswith("r"), F.substring(bucket, 2, 1).cast("int")).otherwise(BUCKETS + 1)


def depth_of(age: Column) -> Column:
    """From 1.0 today down to 0.1."""
    return F.when(age < 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.round(1 - age * 0.92 / SHOWN, 2)))


def recency_score(updated: Column, now: Column) -> Column:
    """1 / (1 + days / 30), days not below zero; 0 where nothing is known."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(updated)) / 86_400e6)
    return F.when(updated.isNotNull(), 1 / (1 + days / 30)).otherwise(0.0)


def log_entries(logs: DataFrame) -> DataFrame:
    """(entry_id, log_path, date, time, op, title, body, touched) of log files (path, body), one row an entry."""
    rows = logs.select(F.col("path").alias("log_path"), F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("pos", "text"))
    head = r"\A## \[(\d{2}:\d{2})\]\s+([a-zA-Z0-9_-]+)\s+\|\s+(.+?)\s*\z"
    rows = rows.withColumn("is_head", F.col("text").rlike(head))
    run = Window.partitionBy("log_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("entry", F.sum(F.col("is_head").cast("int")).over(run)).where("entry > 0")
    part = lambda n: F.regexp_extract("text", head, n)
    grouped = rows.groupBy("log_path", "entry").agg(
        F.max(F.when(F.col("is_head"), F.struct(part(1).alias("time"), part(2).alias("op"), part(3).alias("title")))).alias("h"),
        F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("pos", "text")))).alias("l"),
    )
    day = F.regexp_extract("log_path", r"(\d{8})\.md\z", 1)
    body = T.strip(F.array_join("l.text", "\n"))
    anchor = T.slug(F.concat_ws("-", "h.time", "h.op", "h.title"))
    linked = F.transform(L.hrefs(body), lambda h: L.target_of(h, lenient=True))
    touched = F.array_sort(F.array_compact(F.array_union(linked, F.transform(L.log_literals(body), L.normal_path))))
    return grouped.select(
        F.concat(F.lit("log-entry:"), day, F.lit("-"), anchor).alias("entry_id"),
        "log_path",
        F.to_date(day, "yyyyMMdd").alias("date"),
        "h.time",
        "h.op",
        "h.title",
        body.alias("body"),
        touched.alias("touched"),
    )


def infer_op(subject: Column, files: Column) -> Column:
    prefix = F.when(subject.contains(":"), F.lower(T.strip(F.substring_index(subject, ":", 1))))
    return F.when(prefix.isin(*OPS), prefix).when(F.exists(files, lambda f: f.startswith("raw/")), "ingest").otherwise("checkpoint")


def op_title(subject: Column) -> Column:
    prefix = F.when(subject.contains(":"), F.lower(T.strip(F.substring_index(subject, ":", 1))))
    rest = T.strip(F.substring(subject, F.length(F.substring_index(subject, ":", 1)) + 2, F.length(subject)))
    return F.when(prefix.isin(*OPS) & (rest != ""), rest).otherwise(subject)


def git_fallback(commits: DataFrame) -> DataFrame:
    """Entries of commits (hash, committed_at, subject, files) that changed pages and no log file."""
    touched = F.array_sort(F.filter("files", lambda f: f.startswith("wiki/") & f.endswith(".md")))
    unlogged = commits.where(~F.exists("files", lambda f: f.rlike(r"\Alog/\d{8}\.md\z"))).withColumn("touched", touched).where(F.size("touched") > 0)
    return unlogged.select(
        F.concat(F.lit("git-commit:"), "hash").alias("entry_id"),
        F.lit("").alias("log_path"),
        F.to_date("committed_at").alias("date"),
        F.date_format("committed_at", "HH:mm").alias("time"),
        infer_op(F.col("subject"), F.col("files")).alias("op"),
        op_title(F.col("subject")).alias("title"),
        F.lit("").alias("body"),
        "touched",
    )


def recent_entries(entries: DataFrame, anchor: Column) -> DataFrame:
    """Entries inside the window with age, bucket and depth."""
    age = age_days(F.col("date"), anchor)
    return entries.withColumn("age_days", age).withColumn("bucket", bucket_of(age)).where("bucket is not null").withColumn("depth", depth_of(age))


def recent_edges(recent: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(bucket, page_id, w, d): entries that touched a page, by bucket; the index page only in the first one."""
    rows = recent.where("bucket != 'floating'").select("bucket", "depth", F.explode("touched").alias("page_id"))
    if catalog is not None:
        rows = rows.join(catalog.select("page_id").distinct(), "page_id", "left_semi")
    rows = rows.where("bucket = 'r0' or page_id != 'wiki/index.md'")
    return rows.groupBy("bucket", "page_id").agg(F.count("*").alias("w"), F.max("depth").alias("d"))


def recent_pages(recent: DataFrame) -> DataFrame:
    """(page_id, primary_bucket, buckets, d) of every touched page."""
    rows = recent.select("bucket", "depth", bucket_rank(F.col("bucket")).alias("n"), F.explode("touched").alias("page_id"))
    agg = rows.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("n", "bucket"))).alias("b"), F.max("depth").alias("d"))
    return agg.select("page_id", F.get("b.bucket", 0).alias("primary_bucket"), F.col("b.bucket").alias("buckets"), "d")


def bucket_nodes(spark) -> DataFrame:
    """The control node of each bucket: index, age range, depth of its middle."""
    rows = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket_index"))
    start = F.col("bucket_index") * DAYS
    return rows.select(F.concat(F.lit("r"), F.col("bucket_index").cast("string")).alias("id"), "bucket_index", start.alias("from_days"), (start + DAYS).alias("to_days"), depth_of(start + DAYS / 2).alias("d"))


def dates_by_bucket(recent: DataFrame) -> DataFrame:
    return recent.groupBy("bucket").agg(F.sort_array(F.collect_set("date"), False).alias("dates"))


def latest_batch(entries: DataFrame, op: str = "ingest") -> DataFrame:
    """(page_id) touched by the newest entries of an operation; entries of the same minute count together."""
    rows = entries.where(F.col("op") == op)
    top = rows.orderBy(F.desc("date"), F.desc("time")).limit(1).select("date", "time")
    return rows.join(F.broadcast(top), ["date", "time"], "left_semi").select(F.explode("touched").alias("page_id")).distinct()


def touched_heads(commits: DataFrame) -> DataFrame:
    """(head, n): changed paths by their first folder."""
    return commits.select(F.explode("files").alias("path")).groupBy(F.substring_index("path", "/", 1).alias("head")).agg(F.count("*").alias("n"))


def ordered_entries(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries newest first: by date, time and id."""
    out = entries.orderBy(F.desc("date"), F.desc("time"), F.desc("entry_id"))
    return out if limit is None else out.limit(limit)


def touched_nodes(recent: DataFrame, nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_id, title, kind) of the pages that entries touched; what a page's own node says wins over the catalogue."""
    ids = recent.select(F.explode("touched").alias("page_id")).distinct()
    own = nodes.select("page_id", F.col("title").alias("_t"), F.col("kind").alias("_k"))
    out = ids.join(own, "page_id", "left").join(catalog.select("page_id", "title", "kind"), "page_id", "left")
    return out.select("page_id", F.coalesce("_t", "title", "page_id").alias("title"), F.coalesce("_k", "kind", F.lit("page")).alias("kind"))
