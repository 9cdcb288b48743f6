"""Reports: frames of lines (pos, line), made by expressions, so that a report is as large as what it lists and is written in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import format_link

FORMS = ("text", "json", "paths")


def query_report(ranked: DataFrame, form: str = "text") -> DataFrame:
    """A ranked result (with reasons and its order in ``rank``) as text, JSON or paths only."""
    if form not in FORMS:
        raise ValueError(f"no such form: {form}")
    number = lambda c: F.format_string("%.3f", F.col(c))
    if form == "paths":
        return ranked.select(F.col("rank").cast("long").alias("pos"), F.col("page_id").alias("line"))
    if form == "json":
        return ranked.select(F.col("rank").cast("long").alias("pos"), F.to_json(F.struct(*[c for c in ranked.columns if c != "rank"])).alias("line"))
    rows = F.array(
        F.concat(F.col("rank"), F.lit(". "), format_link(F.col("title"), F.col("page_id"))),
        F.concat(F.lit("   kind: "), "kind", F.lit(" | score: "), number("score"), F.lit(" | degree: "), F.col("degree").cast("string")),
        F.when(F.size("reasons") > 0, F.concat(F.lit("   why: "), F.array_join("reasons", "; "))),
    )
    return _numbered(ranked.select(F.col("rank").alias("at"), F.array_compact(rows).alias("lines")), ["at"])


def _numbered(groups: DataFrame, order: list) -> DataFrame:
    """Lines of groups (lines ARRAY) in the order of the groups."""
    steps = groups.withColumn("n", F.size("lines"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("_b", before).select("_b", F.posexplode("lines").alias("k", "line")).select((F.col("_b") + F.col("k")).cast("long").alias("pos"), "line")


def _titled(spark: SparkSession, lines: list[Column]) -> DataFrame:
    return spark.range(1).select(F.array(*lines).alias("lines"))


def register_report(clusters: DataFrame, priced: DataFrame, mode: str, stamp: str, stale_days: int) -> DataFrame:
    """The register of feedback in Markdown: counts, a queue of places by priority, and open records that are stale."""
    spark = clusters.sparkSession
    total = priced.agg(F.struct(F.count("*").alias("n"), F.count(F.when(F.col("mode") == "open", 1)).alias("o"), F.count(F.when(F.col("mode") == "resolved", 1)).alias("r")).alias("c")).scalar()
    places = clusters.agg(F.count("*")).scalar()
    text = lambda c: c.cast("string")
    head = _titled(
        spark,
        [
            F.lit("# Feedback register"), F.lit(""), F.lit(f"Generated: {stamp}"), F.lit(f"Mode: `{mode}`"), F.concat(F.lit("Records: "), text(total["n"])),
            F.concat(F.lit("Open: "), text(total["o"]), F.lit(" · Resolved: "), text(total["r"]), F.lit(" · Places: "), text(places)),
            F.lit(""), F.lit("## Queue"), F.when(places == 0, F.lit("No places with signals or open records.")).otherwise(F.lit("")),
        ],
    )
    order = [F.desc("priority"), F.desc("open_n"), F.desc("n"), F.col("key")]
    queue = clusters.select(
        F.row_number().over(Window.orderBy(*order)).cast("long").alias("at"),
        F.array(
            F.concat(F.lit("### "), format_link(F.col("target"), F.col("target"))),
            F.concat(F.lit("- Priority: `"), text(F.col("priority")), F.lit("` · records: `"), text(F.col("n")), F.lit("` · open: `"), text(F.col("open_n")), F.lit("` · stale: `"), text(F.col("stale_n")), F.lit("`")),
            F.concat(F.lit("- Severities: `"), "severities", F.lit("`")),
            F.concat(F.lit("- Decisions: `"), "decisions", F.lit("`")),
            F.lit(""),
        ).alias("lines"),
    )
    stale = priced.where("mode = 'open' and stale")
    older = stale.select(F.row_number().over(Window.orderBy("target", "created", "id")).cast("long").alias("at"), F.array(F.concat(F.lit("- `"), "id", F.lit("` "), format_link(F.col("target"), F.col("target")), F.lit(" ("), text(F.col("age_days")), F.lit(" days)"))).alias("lines"))
    none = F.when(stale.agg(F.count("*")).scalar() == 0, F.lit(f"No open records older than {stale_days} days."))
    middle = _titled(spark, [F.lit("## Stale open records")]).withColumn("lines", F.array_compact(F.concat("lines", F.array(none))))
    zero = F.lit(0).cast("long").alias("at")
    parts = [head.select(zero, "lines"), queue, middle.select(zero, "lines"), older]
    out = None
    for k, part in enumerate(parts):
        one = part.select(F.lit(k).alias("part"), "at", "lines")
        out = one if out is None else out.unionByName(one)
    return _numbered(out, ["part", "at"])


def scan_report(pages: DataFrame, edges: DataFrame, round_number: int, max_rounds: int) -> DataFrame:
    """What a scanning round asks for in Markdown: pages and pairs to read, or that it has ended."""
    spark = pages.sparkSession
    n, m = pages.agg(F.count("*")).scalar(), edges.agg(F.count("*")).scalar()
    text = lambda c: c.cast("string")
    state = F.when((n == 0) & (m == 0), F.lit("Converged: nothing new.")).otherwise(F.lit("Last round." if round_number >= max_rounds else "Read these, then scan again."))
    head = _titled(spark, [F.lit(f"# Scan, round {round_number} of {max_rounds}"), F.concat(F.lit("Pages: "), text(n), F.lit(" · pairs: "), text(m)), state])
    rows = head.select(F.lit(0).alias("part"), F.lit("").alias("at"), "lines")
    rows = rows.unionByName(pages.select(F.lit(1).alias("part"), F.col("page_id").alias("at"), F.array(F.concat(F.lit("- "), "page_id")).alias("lines")))
    pair = F.concat_ws(" — ", "a", "b")
    rows = rows.unionByName(edges.select(F.lit(2).alias("part"), pair.alias("at"), F.array(F.concat(F.lit("- "), pair)).alias("lines")))
    return _numbered(rows, ["part", "at"])


def write_report(report: DataFrame, path: str) -> None:
    """The lines in order, as text files whose names sort as they are to be read."""
    report.orderBy("pos").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def report_text(report: DataFrame) -> str:
    """A report as one text, for what is shown to a person: a ranked result within its limit, a register page."""
    return "\n".join(r["line"] for r in report.orderBy("pos").toLocalIterator()) + "\n"
