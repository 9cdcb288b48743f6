"""Migrations of older pages: link anchors, missing types, double-bracket links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import links as L
from folioscope.functions import text as T

WIKILINK = r"!?\[\[([^\]|#\n]*)(?:#([^\]|\n]*))?(?:\|([^\]\n]*))?\]\]"


def rewrite_links(pages: DataFrame) -> DataFrame:
    """(page_id, body, n): links to ``wiki/x.md`` anchored at the root, and how many changed."""
    n = F.regexp_count("body", F.lit(r"\]\(<?wiki/[^)\n]*?\.md"))
    return pages.select("page_id", L.rewrite_anchored(F.col("body")).alias("body"), n.cast("long").alias("n"))


def backfill_type(pages: DataFrame) -> DataFrame:
    """Pages with a type in their frontmatter: that of their folder where there was none."""
    kind = T.page_kind(F.lit(None).cast("string"), F.col("page_id"))
    block = T.front_block(F.col("body"))
    has_front = F.col("body").startswith("---\n") & (T.front_lines(F.col("body")) > 0)
    typed = F.coalesce(F.nullif(T.strip(T.front_value(T.front_map(block), "type")), F.lit("")), F.lit("")) != ""
    added = F.concat(F.lit("---\ntype: "), kind, F.lit("\n"), F.substring(F.col("body"), F.lit(5), F.length("body")))
    fresh = F.concat(F.lit("---\ntype: "), kind, F.lit("\n---\n"), "body")
    body = F.when(typed, F.col("body")).when(has_front, added).otherwise(fresh)
    return pages.select("page_id", body.alias("body"), (~typed).alias("added"))


def suffix_catalog(catalog: DataFrame) -> DataFrame:
    """(suffix, page_id, n) of every path suffix without ``.md``; n pages have it. Turns a suffix match into an equi-join."""
    parts = F.split(T.without_md(F.col("page_id")), "/")
    rows = catalog.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/"))).alias("suffix"))
    rows = rows.withColumn("suffix", F.lower("suffix"))
    return rows.groupBy("suffix").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def wikilink_targets(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_id, name, target, state) of the double-bracket links of pages: ok, ambiguous or missing."""
    found = F.transform(F.regexp_extract_all("body", F.lit(f"({WIKILINK})"), 1), lambda m: T.strip(F.regexp_extract(m, WIKILINK, 1)))
    rows = pages.select("page_id", F.explode(F.array_distinct(F.filter(found, lambda n: n != ""))).alias("name"))
    rows = rows.withColumn("suffix", F.lower(T.without_md(F.regexp_replace("name", r"\A/", ""))))
    ids = suffix_catalog(catalog).withColumnRenamed("page_id", "target")
    exact = catalog.select(F.col("page_id").alias("exact"), F.lower(T.without_md(F.col("page_id"))).alias("suffix"))
    under = catalog.select(F.col("page_id").alias("under"), F.regexp_replace(F.lower(T.without_md(F.col("page_id"))), r"\Awiki/", "").alias("suffix"))
    index = catalog.where(F.col("page_id").endswith("/index.md")).select(F.col("page_id").alias("folder"), F.regexp_replace(F.lower(F.regexp_replace("page_id", r"/index\.md\z", "")), r"\Awiki/", "").alias("suffix"))
    for other in (exact, under, index, ids):
        rows = rows.join(other.dropDuplicates(["suffix"]), "suffix", "left")
    target = F.coalesce("exact", "under", "folder", F.when(F.col("n") == 1, F.col("target")))
    return rows.select("page_id", "name", target.alias("target"), F.when(target.isNotNull(), "ok").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("state"))


def migrate_wikilinks(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_id, body, n): links whose target is clear become Markdown links; the others stay.

    Targets are joined first, as one map for each page; only the substitution itself,
    which no built-in function expresses, runs over Arrow batches.
    """
    import re

    found = wikilink_targets(pages, catalog).where("state = 'ok'").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "target"))).alias("to"))
    rows = pages.select("page_id", "body").join(found, "page_id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            bodies, counts = [], []
            for body, to in zip(part["body"], part["to"], strict=True):
                to, n = dict(to or {}), 0

                def link(m, to=to):
                    nonlocal n
                    target = to.get(m[1].strip())
                    if target is None:
                        return m[0]
                    n += 1
                    label = (m[3] or m[1]).strip()
                    href = "/" + target.removeprefix("wiki/") + (f"#{re.sub(r'[^a-z0-9]+', '-', m[2].lower()).strip('-')}" if m[2] else "")
                    return f"[{label}](<{href}>)" if re.search(r"\s", href) else f"[{label}]({href})"

                bodies.append(re.sub(WIKILINK, link, body))
                counts.append(n)
            yield pd.DataFrame({"page_id": part["page_id"], "body": bodies, "n": counts})

    return rows.mapInPandas(run, "page_id string, body string, n long")


def page_lookup(pages: DataFrame, path: str) -> DataFrame:
    """The page that a request path means: a folder is its index, ``.md`` may be left out; outside paths mean none."""
    clean = path.strip("/")
    if path.startswith("//") or ".." in path.split("/"):
        return pages.limit(0)
    wanted = [clean, f"{clean}.md", f"{clean}/index.md", f"wiki/{clean}", f"wiki/{clean}.md", f"wiki/{clean}/index.md"]
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col("page_id"))
    return pages.where(F.col("page_id").isin(*wanted)).orderBy(rank).limit(1)


def unique_names(rows: DataFrame, base: str, by: list[str], order: str) -> DataFrame:
    """Adds ``name``: the base, with a number behind it from the second row of the same group on."""
    n = F.row_number().over(Window.partitionBy(*by, base).orderBy(order))
    return rows.withColumn("name", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n.cast("string"))))
