"""Quality rules: each takes DataFrames and returns issues, so that any set of them can be unioned.

issues: rule, severity, counted, page_id, line_no, subject, detail, suggestion
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import links as L
from folioscope.functions import text as T
from folioscope.operators import graph as G
from folioscope.operators.pages import lines

INDEX = "wiki/index.md"
#: Headings whose bullets are to be links, on pages and on the index.
PAGE_SECTIONS = ("used in", "related pages", "related concepts", "links into the wiki", "sub-pages", "concepts introduced / referenced")
INDEX_SECTIONS = ("concepts", "entities", "summaries", "summaries (chronological)")
#: Words that mark doubtful text.
MARKERS = (
    r"(?i)\b(?:contradict(?:ion|s|ory)?|inconsistent|stale|outdated|needs\s+verification|needs\s+source|todo:?\s*verify|verify\s+later|fact[-\s]?check)\b"
    r"|矛盾|不一致|过时|陈旧|待核实|需验证|需要验证|事实错误|口径不一致"
)
#: Verbs of claims and the form that stands for each.
PREDICATES = {
    "supports": ("support", "supports", "支持"),
    "uses": ("use", "uses", "使用", "采用"),
    "has": ("has", "拥有"),
    "requires": ("require", "requires", "需要", "要求"),
    "is": ("is", "are", "was", "were", "是", "为"),
    "equals": ("equal", "equals", "等于"),
    "reaches": ("reach", "reaches", "achieve", "achieves", "达到"),
}
#: Units that make a number a claim, and the kinds of claim by what their text holds, the first that fits.
UNITS = ("k", "m", "b", "kb", "mb", "gb", "tb", "tokens?", r"context\s+window", "参数", "上下文", "窗口", "%", "％")
KINDS = (
    ("context_window", r"context\s+window|上下文|窗口"),
    ("parameters", r"parameters?|params?|参数"),
    ("tokens", r"tokens?"),
    ("storage", r"\b(?:kb|mb|gb|tb)\b"),
    ("percent", r"%|％"),
)
#: The forms of a verb in text, and the characters of names and of what stands around a number.
_VERBS = "supports?|uses?|has|requires?|is|are|was|were|equals?|reaches?|achieves?|支持|使用|采用|需要|要求|是|为|等于|达到|拥有"
_NAME, _ANY_NAME, _AROUND = "[A-Za-z0-9_.+-]", "[㐀-鿿A-Za-z0-9_.+-]{2,40}", r"[^.\n;。；]{0,40}"
_NUMBER = r"\d+(?:\.\d+)?\s*"
#: Subject (up to nine words), verb and a value with a unit; letters of either case.
CLAIM = rf"(?i)([A-Z]{_NAME}*(?:\s+[A-Z]{_NAME}*){{0,8}}|{_ANY_NAME})\s+({_VERBS})\s+({_AROUND}?{_NUMBER}(?:{'|'.join(UNITS)}){_AROUND})"
VALUE = rf"(?i)({_NUMBER}(?:kb|mb|gb|tb|k|m|b|tokens?|参数|上下文|窗口|%)?)"
#: Guard limits in bytes and pages (warn, stop).
GUARDS = {"corpus_bytes": (50 << 20, 1 << 30), "page_bytes": (512 << 10, 16 << 20), "pages": (25_000, 80_000)}


def _issues(rows: DataFrame, rule: str, severity: str, counted: bool, subject: Column, page: str = "page_id", line: Column | None = None, detail: Column | None = None, suggestion: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    return rows.select(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        F.lit(counted).alias("counted"),
        F.col(page).alias("page_id"),
        (F.lit(None) if line is None else line).cast("int").alias("line_no"),
        subject.alias("subject"),
        (text if detail is None else detail).alias("detail"),
        (text if suggestion is None else suggestion).alias("suggestion"),
    )


def _by_line(pages: DataFrame, found) -> DataFrame:
    """(page_id, line_no, item) of an array expression over each line; narrow."""
    rows = pages.select("page_id", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    return rows.select("page_id", (F.col("pos") + 1).alias("line_no"), F.explode(found(F.col("text"))).alias("item"))


def scale_guard(stats: DataFrame) -> DataFrame:
    """One row per guard: (guard, value, verdict) from files (path, size_bytes)."""
    one = stats.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("corpus_bytes"), F.coalesce(F.max("size_bytes"), F.lit(0)).alias("page_bytes"), F.count("*").alias("pages"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("guard"), F.col(k).cast("long").alias("value"), F.lit(w).cast("long").alias("warn_at"), F.lit(h).cast("long").alias("stop_at")) for k, (w, h) in GUARDS.items()])).alias("g")).select("g.*")
    return rows.select("guard", "value", F.when(F.col("value") >= F.col("stop_at"), "stop").when(F.col("value") >= F.col("warn_at"), "warn").otherwise("ok").alias("verdict"))


def parent_paths(pages: DataFrame) -> DataFrame:
    return _issues(_by_line(pages, L.parent_paths), "parent_path", "hard", True, F.col("item"), line=F.col("line_no"))


def bare_links(pages: DataFrame) -> DataFrame:
    rows = G.links_with_lines(pages).where(L.link_class(F.col("href")) == "bare")
    return _issues(rows, "missing_root", "hard", True, F.col("href"), line=F.col("line_no"), suggestion=L.suggestion(F.col("href")))


def absolute_paths(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Absolute paths that no file answers; those inside links are left to the dead-link rule."""
    bare = F.regexp_replace("body", L.LINK, "")
    rows = _by_line(pages.withColumn("body", bare), L.absolute_paths).withColumn("t", L.normal_path(F.concat(F.lit("wiki"), F.substring_index("item", "#", 1))))
    dead = rows.join(files.select(F.col("path").alias("t")), "t", "left_anti")
    return _issues(dead, "absolute_path", "hard", True, F.col("item"), line=F.col("line_no"))


def dead_links(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Links in a valid form whose file is missing. Distinct targets meet the catalogue, not occurrences."""
    rows = G.links_with_lines(pages).withColumn("t", L.target_of(F.col("href"))).where("t is not null")
    dead = rows.join(files.select(F.col("path").alias("t")).distinct(), "t", "left_anti")
    return _issues(dead, "dead_link", "hard", True, F.col("href"), line=F.col("line_no"), detail=F.col("t"))


def malformed_links(pages: DataFrame) -> DataFrame:
    rows = _by_line(pages, L.malformed)
    return _issues(rows, "malformed_link", "soft", True, F.col("item"), line=F.col("line_no"), suggestion=F.concat(F.lit("<"), "item", F.lit(">")))


def plain_bullets(pages: DataFrame) -> DataFrame:
    """Bullets without a link under headings whose bullets are to be links; open and done tasks are not meant."""
    item = T.strip(F.regexp_extract("text", r"\A\s*[-*]\s+(.*)\z", 1))
    section = F.lower("section")
    wanted = F.when(F.col("page_id") == INDEX, section.isin(*INDEX_SECTIONS)).otherwise(section.isin(*PAGE_SECTIONS))
    rows = lines(pages).where("not in_fence and level = 0").withColumn("item", item).where((F.col("item") != "") & wanted)
    rows = rows.where(~F.col("item").rlike(r"\A\[[ xX]\]") & ~F.col("item").rlike(r"!?\[[^\]\n]+\]\("))
    return _issues(rows, "plain_bullet", "soft", True, F.col("item"), line=F.col("line_no"), detail=section)


def orphans(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    rows = catalog.where(F.col("page_id") != INDEX).join(edges.select(F.col("t").alias("page_id")).distinct(), "page_id", "left_anti")
    return _issues(rows, "orphan", "soft", True, F.col("page_id"))


def missing_index(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    listed = edges.where(F.col("s") == INDEX).select(F.col("t").alias("page_id")).distinct()
    return _issues(catalog.where(F.col("page_id") != INDEX).join(listed, "page_id", "left_anti"), "missing_index", "soft", True, F.col("page_id"))


def frequent_missing(resolved: DataFrame, least: int = 3) -> DataFrame:
    """(target, n): addresses without a page that are used often."""
    rows = resolved.where("target is null").withColumn("t", L.target_of(F.col("href"))).where("t is not null")
    return rows.groupBy(F.col("t").alias("target")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def frequently_missing(pages: DataFrame, catalog: DataFrame, least: int = 3) -> DataFrame:
    rows = frequent_missing(G.resolve_links(G.extract_links(pages), catalog), least).withColumn("page_id", F.lit(None).cast("string"))
    return _issues(rows, "frequent_missing", "soft", True, F.col("target"), detail=F.col("n").cast("string"))


def over_limits(stats: DataFrame) -> DataFrame:
    """Guards that are over a limit: a warning does not count, a stop does."""
    rows = scale_guard(stats).where("verdict != 'ok'").withColumn("page_id", F.lit(None).cast("string"))
    return _issues(rows, "scale", "gate", True, F.col("guard"), detail=F.concat_ws(" ", "verdict", "value")).withColumn("counted", F.col("detail").startswith("stop"))


def feedback_issues(audits: DataFrame, files: DataFrame) -> DataFrame:
    """Feedback records that break a rule of shape or whose target is missing."""
    from folioscope.operators.audits import problems

    return _issues(problems(audits, files), "audit_shape", "soft", True, F.col("problem"), page="id")


def residual_wikilinks(pages: DataFrame) -> DataFrame:
    return _issues(_by_line(pages, L.wikilinks), "wikilink", "soft", True, F.col("item"), line=F.col("line_no"))


def dead_sources(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Sources that name no file; an address under no known root names none."""
    rows = parsed.select("page_id", F.explode("sources").alias("item")).where(~F.col("item").rlike(L.EXTERNAL)).withColumn("t", L.target_of(F.col("item")))
    dead = rows.join(files.select(F.col("path").alias("t")).distinct(), "t", "left_anti")
    return _issues(dead, "dead_source", "hard", True, F.col("item"))


def prose_lines(pages: DataFrame) -> DataFrame:
    return lines(pages).where("not in_front and not in_fence and stripped != ''").where(~F.col("stripped").startswith("#"))


def markers(pages: DataFrame) -> DataFrame:
    rows = prose_lines(pages).withColumn("item", F.regexp_extract("text", f"({MARKERS})", 1)).where("item != ''")
    return _issues(rows, "marker", "info", False, F.col("item"), line=F.col("line_no"), detail=F.substring(T.collapse(F.col("text")), 1, 180))


def numeric_claims(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, subject, predicate, kind, value, excerpt)."""
    found = F.regexp_extract_all("stripped", F.lit(f"({CLAIM})"), 1)
    rows = prose_lines(pages).select("page_id", "line_no", "stripped", F.explode(found).alias("c"))
    rows = rows.select("page_id", "line_no", "stripped", *[F.regexp_extract("c", CLAIM, n).alias(c) for n, c in ((1, "who"), (2, "verb"), (3, "what"))])
    verb = F.lower("verb")
    predicate = verb
    for form, words in PREDICATES.items():
        predicate = F.when(verb.isin(*words), form).otherwise(predicate)
    kind = F.lit("numeric")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.col("what").rlike(f"(?i){pattern}"), name).otherwise(kind)
    number = F.regexp_replace(F.lower(F.regexp_extract("what", VALUE, 1)), r"\s+", "")
    return rows.select("page_id", "line_no", T.collapse(F.lower("who")).alias("subject"), predicate.alias("predicate"), kind.alias("kind"), number.alias("value"), F.substring(T.collapse(F.col("stripped")), 1, 180).alias("excerpt"))


SALT = 64


def claim_conflicts(claims: DataFrame, evidence: int = 3) -> DataFrame:
    """(subject, predicate, kind, n_values, values, evidence): claims that give two values or more; the first places of each value.

    Places are ranked in ``SALT`` parts of a value first, so that a claim of half the
    corpus is no single task, and only the first few of each part meet.
    """
    key = ["subject", "predicate", "kind", "value"]
    place = ["page_id", "line_no", "excerpt"]
    part = F.pmod(F.xxhash64(*place), F.lit(SALT))
    by_part, by_value = Window.partitionBy(*key, "part").orderBy(*place), Window.partitionBy(*key).orderBy(*place)
    first = claims.withColumn("part", part).withColumn("n", F.row_number().over(by_part)).where(F.col("n") <= evidence)
    first = first.withColumn("n", F.row_number().over(by_value)).where(F.col("n") <= evidence)
    places = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*place))).alias("places"))
    out = places.groupBy(*key[:3]).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(F.struct("value", "places"))).alias("evidence"))
    return out.where("n_values >= 2").withColumn("values", F.col("evidence.value"))


def log_shape(logs: DataFrame) -> DataFrame:
    """Log files (path, body) whose name, first line or frontmatter is not as it should be."""
    name = T.file_name(F.col("path"))
    day = F.regexp_extract(name, r"\A(\d{4})(\d{2})(\d{2})\.md\z", 0)
    stamp = F.try_to_timestamp(F.substring(day, 1, 8), F.lit("yyyyMMdd"))
    title = F.concat(F.lit("# "), F.date_format(stamp, "yyyy-MM-dd"))
    first = F.rtrim(F.substring_index("body", "\n", 1))
    bad_name = F.when((day == "") | stamp.isNull(), "file name is not YYYYMMDD.md")
    bad_head = F.when(bad_name.isNull() & (F.coalesce(title, F.lit("")) != first), "first line is not the date")
    front = F.when(F.col("body").startswith("---\n"), "has frontmatter")
    rows = logs.select("path", F.explode(F.array_compact(F.array(bad_name, bad_head, front))).alias("item"))
    return _issues(rows, "log_shape", "soft", True, F.col("item"), page="path")


def deleted_pages(changes: DataFrame) -> DataFrame:
    return _issues(changes.where("change = 'delete'"), "deleted_page", "soft", True, F.col("page_id"))


def open_audits(audits: DataFrame) -> DataFrame:
    return _issues(audits.where("mode = 'open'"), "open_audit", "gate", True, F.col("id"), page="target")


def all_rules(pages: DataFrame, parsed: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Every rule on page text and links, as one union."""
    claims = claim_conflicts(numeric_claims(pages)).withColumn("page_id", F.lit(None).cast("string"))
    found = [
        parent_paths(pages),
        bare_links(pages),
        absolute_paths(pages, files),
        dead_links(pages, files),
        malformed_links(pages),
        plain_bullets(pages),
        orphans(parsed, edges),
        missing_index(parsed, edges),
        frequently_missing(pages, parsed),
        residual_wikilinks(pages),
        dead_sources(parsed, files),
        markers(pages),
        _issues(claims, "claim_conflict", "info", False, F.col("subject"), detail=F.array_join("values", ", ")),
    ]
    return reduce(DataFrame.unionByName, found)


def verdict(issues: DataFrame) -> DataFrame:
    """(counted, clean): the number of issues that count, and whether there is none."""
    return issues.agg(F.count(F.when(F.col("counted"), 1)).alias("counted")).withColumn("clean", F.col("counted") == 0)


def graph_stats(parsed: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pages, edges, isolated pages, mean degree, size."""
    deg = G.degrees(edges, parsed).agg(F.sum((F.col("degree") == 0).cast("long")).alias("isolated"), F.max("degree").alias("max_degree"))
    size = parsed.agg(F.count("*").alias("pages"), F.sum("size_bytes").alias("bytes"), F.countDistinct("kind").alias("kinds"))
    links = edges.agg(F.count("*").alias("edges"), F.sum("w").alias("links"))
    one = F.lit(1).alias("_")
    return size.select("*", one).join(links.select("*", one), "_").join(deg.select("*", one), "_").drop("_")
