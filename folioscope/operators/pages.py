"""The line model, parsed pages and chunks.

``lines`` is the one place where page text is exploded. Every sequential reading of
a page (fence, section, heading path) is a running window over (page, line), so all
of them share a single exchange by page id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

FENCE = "```"
HEADING = r"\A(#{1,6})\s+(.+?)\s*\z"
MAX_TOKENS = 3000


def parse_pages(pages: DataFrame) -> DataFrame:
    """Pages with what their frontmatter and first lines say: one narrow projection.

    Takes page_id and body, and ``mtime`` if there is one: it stands in where no date is given.
    """
    fm, body = F.col("fm"), F.col("body")
    mtime = F.col("mtime").cast("timestamp") if "mtime" in pages.columns else F.lit(None).cast("timestamp")
    out = pages.withColumn("fm", T.front_map(T.front_block(body))).withColumn("plain", T.strip_front(body))
    title = T.page_title(T.front_value(fm, "title"), F.col("plain"), F.col("page_id"))
    created = T.dateish(T.front_value(fm, "created"))
    updated = F.coalesce(T.dateish(T.front_value(fm, "updated")), created, mtime)
    return out.select(
        "page_id",
        title.alias("title"),
        T.page_kind(T.front_value(fm, "type"), F.col("page_id")).alias("kind"),
        T.front_values(fm, "tags").alias("tags"),
        T.front_values(fm, "sources").alias("sources"),
        T.source_urls(fm).alias("source_urls"),
        created.alias("created"),
        updated.alias("updated"),
        fm.alias("frontmatter"),
        F.sha2(body, 256).alias("sha256"),
        F.octet_length(body).cast("long").alias("size_bytes"),
        T.token_estimate(F.col("plain")).alias("token_count"),
        "plain",
        "body",
    )


def lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, text, stripped, in_front, is_fence, in_fence, level, heading, section_id, section)."""
    front = T.front_lines(F.col("body"))
    rows = pages.select("page_id", front.alias("front"), F.posexplode(F.split("body", r"\r\n|\n|\r")).alias("pos", "text"))
    rows = rows.select("page_id", (F.col("pos") + 1).alias("line_no"), "text", T.strip(F.col("text")).alias("stripped"), (F.col("pos") < F.col("front")).alias("in_front"))
    run = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("is_fence", ~F.col("in_front") & F.col("stripped").startswith(FENCE))
    rows = rows.withColumn("in_fence", (F.sum(F.col("is_fence").cast("int")).over(run) % 2 == 1) | F.col("is_fence"))
    marks = F.when(~F.col("in_fence") & ~F.col("in_front"), F.regexp_extract("stripped", HEADING, 1)).otherwise("")
    rows = rows.withColumn("level", F.length(marks))
    rows = rows.withColumn("heading", F.when(F.col("level") > 0, F.regexp_extract("stripped", HEADING, 2)))
    return rows.withColumn("section_id", F.sum((F.col("level") > 0).cast("int")).over(run)).withColumn("section", F.last("heading", True).over(run))


def heading_paths(rows: DataFrame) -> DataFrame:
    """Adds heading_path: the headings above each line, of strictly growing level, joined by `` / ``.

    A level is on the path if its last heading came after the last one of every
    higher level; so no stack is kept, only the last place of each level.
    """
    run = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == n, F.struct("line_no", "heading")), True).over(run) for n in range(1, 7)]
    rows = rows.withColumns({f"_h{n}": c for n, c in enumerate(last, start=1)})
    parts, above = [], F.lit(0)
    for n in range(1, 7):
        place = F.coalesce(F.col(f"_h{n}.line_no"), F.lit(0))
        parts.append(F.when(place > above, F.col(f"_h{n}.heading")))
        above = F.greatest(above, place)
    path = F.array_join(F.array_compact(F.array(*parts)), " / ")
    return rows.withColumn("heading_path", path).drop(*[f"_h{n}" for n in range(1, 7)])


def sections(pages: DataFrame) -> DataFrame:
    """Non-blank sections with their text: page_id, section_id, heading, heading_path, body, start_line."""
    rows = heading_paths(lines(pages)).where("not in_front")
    grouped = rows.groupBy("page_id", "section_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"),
        F.max("section").alias("heading"),
        F.max_by("heading_path", "line_no").alias("heading_path"),
        F.min("line_no").alias("start_line"),
    )
    body = T.strip(F.array_join("l.text", "\n"))
    return grouped.select("page_id", "section_id", F.coalesce("heading", F.lit("")).alias("heading"), "heading_path", body.alias("body"), "start_line").where("body != ''")


def _split(max_tokens: int):
    """Packs paragraphs greedily; one that is too long by itself stays whole. Only long sections come here."""
    import re

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                pieces, held = [], ""
                for p in re.split(r"(\n\s*\n)", r.body):
                    if held.strip() and len(held) + len(p) > max_tokens * 4:
                        pieces.append(held.strip())
                        held = p
                    else:
                        held += p
                if held.strip():
                    pieces.append(held.strip())
                line = r.start_line
                for k, piece in enumerate(pieces):
                    rows.append((r.page_id, r.section_id, k, r.heading, r.heading_path, piece, line))
                    line += piece.count("\n") + 1
            yield pd.DataFrame(rows, columns=["page_id", "section_id", "piece", "heading", "heading_path", "body", "start_line"])

    return run


def chunks(pages: DataFrame, max_tokens: int = MAX_TOKENS, allow_split: bool = True) -> DataFrame:
    """Retrieval chunks: chunk_id, page_id, ordinal, heading, heading_path, body, token_count, content_sha256, start_line, end_line.

    Sections over ``max_tokens`` are split at blank lines, or stay whole without
    ``allow_split``. A page without text has one empty chunk.
    """
    found = sections(pages)
    pieces = found.withColumn("piece", F.lit(0))
    if allow_split:
        small = pieces.where(T.token_estimate(F.col("body")) <= max_tokens)
        cols = ["page_id", "section_id", "piece", "heading", "heading_path", "body", "start_line"]
        long = found.where(T.token_estimate(F.col("body")) > max_tokens)
        split = long.mapInPandas(_split(max_tokens), "page_id string, section_id long, piece int, heading string, heading_path string, body string, start_line int")
        pieces = small.select(*cols).unionByName(split.select(*cols))
    order = Window.partitionBy("page_id").orderBy("section_id", "piece")
    pieces = pieces.withColumn("ordinal", F.row_number().over(order) - 1)
    breaks = F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit("")))
    key = F.concat_ws("\0", "page_id", "heading_path", F.col("ordinal").cast("string"), "body")
    full = pieces.select(
        F.concat(F.lit("chunk:"), F.substring(F.sha2(key, 256), 1, 32)).alias("chunk_id"),
        "page_id",
        "ordinal",
        "heading",
        "heading_path",
        "body",
        T.token_estimate(F.col("body")).alias("token_count"),
        F.sha2("body", 256).alias("content_sha256"),
        F.col("start_line").cast("int").alias("start_line"),
        (F.col("start_line") + breaks).cast("int").alias("end_line"),
    )
    blank = pages.where(T.strip(T.strip_front(F.col("body"))) == "").select(
        F.concat(F.lit("chunk:"), F.substring(F.sha2(F.concat_ws("\0", "page_id", F.lit("empty")), 256), 1, 32)).alias("chunk_id"),
        "page_id",
        F.lit(0).alias("ordinal"),
        F.lit("").alias("heading"),
        F.lit("").alias("heading_path"),
        F.lit("").alias("body"),
        F.lit(0).cast("long").alias("token_count"),
        F.sha2(F.lit(""), 256).alias("content_sha256"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
    )
    return full.unionByName(blank)


def summaries(pages: DataFrame, limit: int = 260, enough: int = 220) -> DataFrame:
    """(page_id, summary): the first prose paragraph, white space collapsed, at most ``limit`` characters."""
    rows = lines(pages).where("not in_front")
    prose = ~F.col("in_fence") & (F.col("stripped") != "") & ~F.col("stripped").startswith("#") & ~F.col("stripped").startswith("![")
    order = Window.partitionBy("page_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prose", prose).withColumn("seen", F.coalesce(F.sum(F.col("prose").cast("int")).over(before), F.lit(0)))
    stop = (F.col("stripped") == "") & (F.col("seen") > 0)
    rows = rows.withColumn("stopped", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0)))
    rows = rows.where("prose and stopped = 0")
    length = F.sum(F.length("stripped") + 1).over(before)
    rows = rows.withColumn("taken", F.coalesce(length, F.lit(0))).where(F.col("taken") - 1 <= enough)
    joined = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "stripped"))).alias("l"))
    joined = joined.select("page_id", F.rtrim(F.substring(T.collapse(F.array_join("l.stripped", " ")), 1, limit)).alias("summary"))
    return pages.select("page_id").join(joined, "page_id", "left").select("page_id", F.coalesce("summary", F.lit("")).alias("summary"))


def token_counts(pages: DataFrame, column: str = "body") -> DataFrame:
    """(page_id, token, tf)."""
    return pages.select("page_id", F.explode(T.tokens(F.col(column))).alias("token")).groupBy("page_id", "token").agg(F.count("*").alias("tf"))


def postings(chunked: DataFrame, meta: DataFrame) -> DataFrame:
    """Inverted index (token, page_id, chunk_id, field, tf): heading and body by chunk, title and tags by page."""
    fields = [chunked.select("page_id", "chunk_id", F.lit(f).alias("field"), F.explode(T.tokens(F.col(f))).alias("token")) for f in ("heading", "body")]
    none = F.lit(None).cast("string").alias("chunk_id")
    fields.append(meta.select("page_id", none, F.lit("title").alias("field"), F.explode(T.tokens(F.col("title"))).alias("token")))
    fields.append(meta.select("page_id", none, F.lit("tags").alias("field"), F.explode(T.tokens(F.array_join("tags", " "))).alias("token")))
    out = fields[0]
    for f in fields[1:]:
        out = out.unionByName(f)
    return out.groupBy("token", "page_id", "chunk_id", "field").agg(F.count("*").alias("tf"))


def snippets(pages: DataFrame, query_tokens: list[str], limit: int = 260) -> DataFrame:
    """(page_id, snippet): the first line with a token of the query, else the first line of text."""
    text = T.collapse(F.col("text"))
    rows = lines(pages).where("not in_front").withColumn("line", text).where((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("is_fence"))
    wanted = F.array(*map(F.lit, query_tokens)) if query_tokens else F.array().cast("array<string>")
    hit = F.arrays_overlap(T.tokens(F.col("line")), wanted)
    best = rows.groupBy("page_id").agg(F.min_by("line", F.struct(~hit, "line_no")).alias("snippet"))
    return best.select("page_id", F.rtrim(F.substring("snippet", 1, limit)).alias("snippet"))


def ordered_text(chunked: DataFrame) -> DataFrame:
    """(page_id, text): the chunks of each page in order, a blank line between them."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "body")))["body"]
    return chunked.groupBy("page_id").agg(F.array_join(parts, "\n\n").alias("text"))
