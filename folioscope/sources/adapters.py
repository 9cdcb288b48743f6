"""Corpora made from relational tables.

``STAR`` is one SQL text that Spark and other engines read alike. It writes a
Markdown page for each region, nation, supplier and customer, and an index; links
follow the foreign keys, some are dead, old or malformed by ``key % n``. Beside each
body stand the values that parsing it must give back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "chr(10)"
TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "pages", "conversations", "embeddings")
RAW_FILES = ("raw/nations.md", "raw/suppliers.md", "raw/unused.md")


def _when(condition: str, *parts: str) -> str:
    return f"CASE WHEN {condition} THEN concat({', '.join(parts)}, {NL}) ELSE '' END"


def _line(*parts: str) -> str:
    return f"{', '.join(parts)}, {NL}" if parts else NL


def _text(s: str) -> str:
    return "'" + s + "'"


def _day(month: int, key: str) -> str:
    return f"concat('2024-{month:02d}-', lpad(CAST(1 + {key} % 28 AS STRING), 2, '0'))"


_NATION = "concat('/entities/nation-', {n}, '.md')"
_S, _C = _NATION.format(n="s_nationkey"), _NATION.format(n="c_nationkey")

_REGION_BODY = f"""concat('---', {NL}, 'title: ', r_name, {NL}, 'type: summary', {NL}, 'tags: [geo, region]', {NL},
 'created: 2023-01-01', {NL}, '---', {NL}, '# ', r_name, {NL}, {NL}, 'Region ', r_name, ' is described here.', {NL}, {NL},
 '- [First](/entities/nation-', r_regionkey, '.md)', {NL})"""
_NATION_BODY = f"""concat('---', {NL}, 'title: "', n_name, '"', {NL}, 'tags:', {NL}, '  - geo', {NL}, '  - ', lower(n_name), {NL}, 'created: 20230105', {NL},
 'sources:', {NL}, '  - raw/nations.md', {NL}, 'source_url: https://example.org/nation/', n_nationkey, {NL}, '---', {NL},
 '# ', n_name, {NL}, {NL}, 'Part of [its region](/regions/region-', n_regionkey, '.md).', {NL})"""
_SUPPLIER_BODY = f"""concat('---', {NL}, 'title: ', s_name, {NL}, {_when("s_suppkey % 3 <> 0", "'type: supplier'")}, 'tags: [supply, tier', s_suppkey % 3, ']', {NL},
 'created: ', {_day(1, "s_suppkey")}, {NL}, 'updated: ', {_day(2, "s_suppkey")}, {NL},
 'sources: [raw/suppliers.md, wiki/entities/nation-', s_nationkey, '.md, https://example.org/s]', {NL}, '---', {NL},
 '# ', s_name, {NL}, {NL},
 s_name, ' has ', s_suppkey % 5 + 1, ' gb of stock in [home](', {_S}, ').', {NL},
 'Shared Model has ', s_suppkey % 3 + 1, 'k tokens.', {NL}, {NL},
 '## Related pages', {NL}, {NL},
 '- [Nation](', {_S}, ')', {NL},
 {_when("s_suppkey % 4 = 0", "'- [Nation again](<'", _S, "'#top>)'")},
 {_when("s_suppkey % 7 = 0", "'- [Gone](/missing/m'", "s_suppkey % 3", "'.md)'")},
 {_when("s_suppkey % 5 = 0", "'- [Old](wiki'", _S, "')'")},
 {_when("s_suppkey % 10 = 3", "'- [No root](entities/nation-'", "s_nationkey", "'.md)'")},
 {_when("s_suppkey % 11 = 1", "'- [Up](..'", _S, "')'")},
 {_when("s_suppkey % 13 = 2", "'- [Spaced](/entities/nation '", "s_nationkey", "'.md)'")},
 {_when("s_suppkey % 6 = 0", "'- [Site](https://example.org/a.md)'")},
 {_when("s_suppkey % 9 = 0", "'- plain words only'")},
 {NL}, '## Notes', {NL}, {NL}, '```', {NL}, '# not a heading', {NL}, '- fenced bullet', {NL}, '```', {NL},
 {_when("s_suppkey % 8 = 0", "'See [[nation-'", "s_nationkey", "']] too.'")},
 {_when("s_suppkey % 12 = 0", "'This page is outdated and needs verification.'")},
 '### Detail', {NL}, {NL}, 'More about ', s_name, '.', {NL})"""
_CUSTOMER_BODY = f"""concat('---', {NL}, 'title: ', c_name, {NL}, {_when("c_custkey % 6 <> 0", "'type: customer'")}, 'tags: [', lower(c_mktsegment), ', customer]', {NL},
 'created: ', {_day(1, "c_custkey")}, {NL}, 'updated: ', {_day(2, "c_custkey")}, {NL}, {_when("c_custkey % 3 = 0", "'sources: [raw/customers.md]'")}, '---', {NL},
 '# ', c_name, {NL}, {NL}, 'Customer ', c_name, ' lives in [nation](', {_C}, ').', {NL}, {NL},
 '## Related pages', {NL}, {NL}, '- [Nation](', {_C}, ')', {NL}, '- [Supplier](/concepts/supplier-', c_custkey % 40, '.md)', {NL})"""

_SUPPLIER_SUMMARY = f"concat(s_name, ' has ', s_suppkey % 5 + 1, ' gb of stock in [home](', {_S}, '). Shared Model has ', s_suppkey % 3 + 1, 'k tokens.')"

#: The index page's summary: its first lines, joined, as far as a summary goes. Only what pages are compared with needs it.
_INDEX_SUMMARY = {
    "spark": "'- plain entry'",
    "duckdb": """(SELECT rtrim(substr(string_agg(l, ' ' ORDER BY k), 1, 260)) FROM (SELECT k, l, coalesce(sum(length(l) + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM (
 SELECT -1 AS k, '- plain entry' AS l UNION ALL SELECT n_nationkey, concat('- [', n_name, '](/entities/nation-', n_nationkey, '.md)') FROM nation WHERE n_nationkey % 5 <> 4) i) j WHERE taken - 1 <= 220)""",
}
_INDEX = {
    "spark": "array_join(transform(array_sort(collect_list(struct(k, l))), x -> x.l), '')",
    "duckdb": "string_agg(l, '' ORDER BY k)",
}


def star_sql(engine: str) -> str:
    """page_id, title, kind, tags, created, updated, summary, body; only the two joins of index lines differ by engine."""
    agg = _INDEX[engine]
    return f"""
SELECT concat('wiki/regions/region-', r_regionkey, '.md') AS page_id, r_name AS title, 'summary' AS kind, 'geo,region' AS tags, '2023-01-01' AS created,
 '2023-01-01' AS updated, concat('Region ', r_name, ' is described here.') AS summary, {_REGION_BODY} AS body FROM region
UNION ALL
SELECT concat('wiki/entities/nation-', n_nationkey, '.md'), n_name, 'entity', concat('geo,', lower(n_name)), '2023-01-05', '2023-01-05',
 concat('Part of [its region](/regions/region-', n_regionkey, '.md).'), {_NATION_BODY} FROM nation
UNION ALL
SELECT concat('wiki/concepts/supplier-', s_suppkey, '.md'), s_name, CASE WHEN s_suppkey % 3 <> 0 THEN 'supplier' ELSE 'concept' END, concat('supply,tier', s_suppkey % 3),
 {_day(1, "s_suppkey")}, {_day(2, "s_suppkey")}, {_SUPPLIER_SUMMARY}, {_SUPPLIER_BODY} FROM supplier
UNION ALL
SELECT concat('wiki/customers/customer-', c_custkey, '.md'), c_name, CASE WHEN c_custkey % 6 <> 0 THEN 'customer' ELSE 'page' END, concat(lower(c_mktsegment), ',customer'),
 {_day(1, "c_custkey")}, {_day(2, "c_custkey")}, concat('Customer ', c_name, ' lives in [nation](', {_C}, ').'), {_CUSTOMER_BODY} FROM customer
UNION ALL
SELECT 'wiki/index.md', 'Index', 'index', '', NULL, NULL, {_INDEX_SUMMARY[engine]}, concat('---', {NL}, 'title: Index', {NL}, '---', {NL}, '# Index', {NL}, {NL}, '## Entities', {NL}, {NL},
 '- plain entry', {NL}, (SELECT {agg} FROM (SELECT n_nationkey AS k, concat('- [', n_name, '](/entities/nation-', n_nationkey, '.md)', {NL}) AS l FROM nation WHERE n_nationkey % 5 <> 4) a),
 {NL}, '## Concepts', {NL}, {NL}, (SELECT {agg} FROM (SELECT s_suppkey AS k, concat('- [', s_name, '](/concepts/supplier-', s_suppkey, '.md)', {NL}) AS l FROM supplier WHERE s_suppkey % 3 <> 0) b))
"""


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def star_wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, body) of the pages, and nothing else: all the rest is to be parsed."""
    sql = star_sql("spark")
    for name, df in load(spark, sf_dir, "region", "nation", "supplier", "customer").items():
        view = f"folioscope_{name}"
        df.createOrReplaceTempView(view)
        sql = sql.replace(f"FROM {name}", f"FROM {view}")
    return spark.sql(sql).select("page_id", "body")


def catalog_files(pages: DataFrame) -> DataFrame:
    """(path) of all files that links may mean: pages and raw files."""
    raw = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, RAW_FILES))).alias("path"))
    return pages.select(F.col("page_id").alias("path")).unionByName(raw)


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, without frontmatter: page_id, title, kind, tags, summary, updated, body."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(
        F.concat(F.lit("wiki/documents/"), "doc_id", F.lit(".md")).alias("page_id"),
        F.concat(F.lit("Document "), "doc_id").alias("title"),
        F.col("source").alias("kind"),
        F.array("lang").alias("tags"),
        F.lit("").alias("summary"),
        F.lit("2024-01-01").cast("timestamp").alias("updated"),
        F.col("text").alias("body"),
    )


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, href) of the web pages' links."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries, one for each event: the event's type as operation, the user's page as what it touched."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select(
        F.concat(F.lit("event:"), "event_id").alias("entry_id"),
        "event_id",
        F.to_date("ts").alias("date"),
        F.date_format("ts", "HH:mm").alias("time"),
        F.col("event_type").alias("op"),
        F.concat(F.lit("event "), "event_id").alias("title"),
        F.array(F.concat(F.lit("wiki/users/u"), F.col("user_id") % 50, F.lit(".md"))).alias("touched"),
    )


def event_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback records made of events: type, target, state and place follow from the event's number and user."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("error", "warn", "suggest", "info"))), (i % 4 + 1).cast("int"))
    open_ = i % 3 != 0
    place = lambda n: F.when(i % 2 == 0, F.array((F.col("user_id") % 3 + n).cast("int"), F.lit(1)))
    return ev.select(
        F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("-"), F.lpad(F.lower(F.hex(i % 65536)), 4, "0")).alias("id"),
        F.concat(F.lit("wiki/users/u"), F.col("user_id") % 50, F.lit(".md")).alias("target"),
        kind.alias("type"),
        place(1).alias("start"),
        place(2).alias("end"),
        F.lit("reader").alias("author"),
        F.when(i % 10 == 9, "email").otherwise("cli").alias("source"),
        F.col("ts").cast("timestamp").alias("created"),
        F.when(open_, "open").otherwise("resolved").alias("status"),
        F.when(open_, "open").otherwise("resolved").alias("mode"),
        F.when(i % 5 == 0, "This seems wrong.").otherwise("Fine.").alias("comment"),
        F.lit("").alias("resolution"),
        F.when(i % 6 == 0, "deferred").when(i % 6 == 3, "accepted").alias("decision"),
        F.concat(F.lit("audit/"), i, F.lit(".md")).alias("path"),
        "event_id",
    )
