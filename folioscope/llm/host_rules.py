"""Host-level quality rules (native).

Every document is measured by built-in functions; failures are aggregated by
host, the hosts' failure rates are shrunk towards an empirical beta prior
(moments matched over all hosts), and the verdict on a host is joined back to
its documents.

A document that fails a base rule is rejected. A host whose shrunk failure rate
is over ``host_limit`` is distrusted: its documents must also pass the strict
limits, so that a clean document is kept wherever it comes from.

Defined results: a null text has no words and fails; a null host is a host of
its own; repeated rows are measured each; an empty table gives an empty result;
extra columns are only carried when asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import OTHER_SPACE, materialise, quoted, text_of, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Strict limits, for documents of distrusted hosts.
STRICT_REPEAT_PERCENT = 20
STRICT_SYMBOL_PERCENT = 10
STRICT_DUP_LINE_PERCENT = 30
HOST_LIMIT = 0.5

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(ordered: Column) -> Column:
    """Words inside 3-word windows whose hash occurs again; ``ordered`` is sorted by (hash, position)."""
    last = F.size(ordered) - 1
    again = F.filter(
        ordered,
        lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(ordered, k + 1)["h"] == x["h"])),
    )
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda a, i: F.struct((a["n"] + (i + 3 - F.greatest(i, a["end"])).cast("long")).alias("n"), (i + 3).alias("end")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns in one struct (so their names never clash), the host and the measures of each row, in one narrow pass."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + OTHER_SPACE, "")) > 0)
    out = docs.select(
        F.struct(*[F.col(quoted(c)) for c in carry]).alias("_carried"),
        F.col("source").cast("string").alias("_host"),
        words_of(text).alias("_words"),
        lines.alias("_lines"),
        F.length(F.translate(text, " " + OTHER_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    windows = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = out.select(
        "_carried",
        "_host",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("_n_lines"),
        windows.alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_ordered", ordered)
    return out.withColumn("n_repeat_words", F.when(F.col("_ordered").isNull(), F.lit(0).cast("long")).otherwise(_repeat_words(F.col("_ordered")))).drop("_windows", "_ordered")


def host_rules(docs: DataFrame, carry: list[str], host_limit: float = HOST_LIMIT) -> DataFrame:
    """``carry`` and the measures, ``base_failed``, ``host_rate`` (shrunk), ``host_trusted`` and ``kept``."""
    out = _judged(docs, carry, host_limit)
    return out.select("_carried.*", *[c for c in out.columns if c != "_carried"])


def _judged(docs: DataFrame, carry: list[str], host_limit: float = HOST_LIMIT) -> DataFrame:
    """The same with the carried columns in the struct ``_carried``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = materialise(measure(docs, carry).withColumn("base_failed", failed), "host-rules")

    hosts = rows.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("f"))
    hosts = hosts.withColumn("rate", F.col("f") / F.col("n"))
    # Moments over hosts, each weighted by its documents: one row, read by a scalar subquery.
    mean = F.sum("f") / F.sum("n")
    spread = F.sum(F.col("n") * F.col("rate") * F.col("rate")) / F.sum("n") - mean * mean
    strength = F.greatest(F.lit(2.0), F.least(F.lit(1e6), mean * (1 - mean) / F.greatest(spread, F.lit(1e-9)) - 1))
    prior = hosts.agg(F.struct((mean * strength).alias("a"), strength.alias("ab")).alias("p"))
    hosts = hosts.withColumn("_prior", prior.scalar())
    hosts = hosts.select(
        F.col("_host").alias("_h"),
        ((F.col("f") + F.col("_prior.a")) / (F.col("n") + F.col("_prior.ab"))).alias("host_rate"),
    )
    out = rows.join(hosts, rows["_host"].eqNullSafe(hosts["_h"]), "left").drop("_h", "_host")
    strict = (
        (100 * F.col("n_repeat_words") > STRICT_REPEAT_PERCENT * F.col("n_words"))
        | (100 * F.col("n_symbols") > STRICT_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > STRICT_DUP_LINE_PERCENT * F.col("_n_lines"))
    )
    out = out.withColumn("host_trusted", F.coalesce(F.col("host_rate") <= host_limit, F.lit(True)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_trusted") | ~strict)).drop("_n_lines")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    return _judged(docs, docs.columns).where("kept").select("_carried.*")
