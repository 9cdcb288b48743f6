"""Chat formatting into budgeted windows (native).

Prefix sums of turn tokens choose turn-aligned spans: with a stride S of half the
room for new turns, a span holds the turns that begin inside one stride, so it has
at most 2 S tokens; a turn of more than S tokens is a span of its own. Every window
repeats the system turn, then as many whole turns before the span as fit in
``history`` tokens, then the span. The loss mask covers the assistant texts of the
span only: repeated ones are masked out, so each is learned once.

The prefix sums are taken in two levels (blocks of ``BLOCK`` turn numbers, then the
blocks' totals), and history is joined by (conversation, token bucket), so one very
long conversation is spread over tasks.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. A backslash inside a text becomes
two, ``<|`` becomes ``<\\|`` and a line feed in a role becomes ``\\n``; so no text
can forge a mark and ``unescape`` restores it exactly.

Defined results: a null role or text is empty; a null turn comes first; equal turn
numbers are ordered by role and text; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives an empty result; other columns are
ignored. A window exceeds the budget only if one turn or the system turn does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY, BLOCK = 1024, 256, 256
MARK_TOKENS = 4
KEY = ["_c", "_null"]


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    plain = F.transform(
        F.split(text, r"\\\\"),  # at every doubled backslash
        lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")),
    )
    return F.array_join(plain, "\\")


def turn_tokens(role: Column, text: Column) -> Column:
    """Token estimate of a turn: a quarter of its UTF-8 bytes, rounded up, and its marks."""
    return F.ceil((F.octet_length(role) + F.octet_length(text)) / 4) + MARK_TOKENS


def _placed(rows: DataFrame) -> DataFrame:
    """Adds pos and start: turns and tokens before each turn of its conversation, the system turn's tokens left out."""
    block = [*KEY, "_block"]
    inside = Window.partitionBy(*block).orderBy("turn", "role", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    rows = rows.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_first", F.first(F.struct("role", "text", "tokens")).over(inside))
    rows = rows.withColumn("_before", F.coalesce(F.sum("tokens").over(before), none))
    blocks = rows.groupBy(*block).agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"), F.max(F.when(F.col("_i") == 0, F.struct("role", "text", "tokens"))).alias("_head"))
    along = Window.partitionBy(*KEY).orderBy("_block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    head = F.first("_head").over(along)
    blocks = blocks.select(
        *block,
        F.coalesce(F.sum("_n").over(earlier), none).alias("_n0"),
        F.coalesce(F.sum("_t").over(earlier), none).alias("_t0"),
        F.when(head["role"] == "system", head).alias("system"),
    )
    rows = rows.join(blocks, block).withColumn("pos", F.col("_i") + F.col("_n0"))
    system_tokens = F.coalesce(F.col("system.tokens"), none)
    start = F.when(F.col("pos") == 0, none).otherwise(F.col("_before") + F.col("_t0") - system_tokens)
    return rows.select(*KEY, "role", "text", "tokens", "system", "pos", start.alias("start"), system_tokens.alias("system_tokens"))


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """One row per window: conv_id, window (its order), n_context, text, loss (array of start and length, code points), tokens."""
    turn = F.col("turn").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_c"),
        F.col("conv_id").isNull().alias("_null"),
        turn.alias("turn"),
        role.alias("role"),
        text.alias("text"),
        turn_tokens(role, text).alias("tokens"),
        F.coalesce(F.floor(turn / block), F.lit(-(1 << 62))).alias("_block"),
    )
    rows = _placed(rows)
    stride = F.greatest(F.lit(64), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2))
    is_system = (F.col("pos") == 0) & F.col("system").isNotNull()
    span = 2 * F.floor(F.col("start") / stride) + F.when(F.col("tokens") > stride, 1).otherwise(0)
    rows = rows.withColumn("is_system", is_system).withColumn("span", F.when(is_system, F.lit(-1).cast("long")).otherwise(span))

    # A first span: that of the first turn after the system turn, which takes the system turn as new.
    spans = rows.groupBy(*KEY, "span").agg(F.min("start").alias("s0"), F.min("pos").alias("p0"), F.max("system").alias("system"))
    order = Window.partitionBy(*KEY).orderBy("span")
    spans = spans.withColumn("after", F.lead("span").over(order)).withColumn("nth", F.row_number().over(order))
    first = spans.where(F.col("span") == -1).select(*KEY, F.coalesce("after", F.lit(0).cast("long")).alias("_to"))
    repeated = spans.where((F.col("span") >= 0) & (F.col("nth") > F.when(F.col("system").isNull(), 1).otherwise(2)))

    cols = [*KEY, "span", "kind", "pos", "role", "text", "tokens"]
    new = rows.where(~F.col("is_system")).withColumn("kind", F.lit(2)).select(*cols)
    opening = rows.where(F.col("is_system")).drop("span").join(first, KEY).withColumn("kind", F.lit(2)).withColumnRenamed("_to", "span").select(*cols)
    system = repeated.where(F.col("system").isNotNull()).select(*KEY, "span", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), "system.role", "system.text", "system.tokens")
    bucket = F.floor(F.col("s0") / history)
    wanted = repeated.select(*KEY, "span", "s0", "p0", F.explode(F.array(bucket, bucket - 1)).alias("_b"))
    told = rows.where(~F.col("is_system")).withColumn("_b", F.floor(F.col("start") / history)).drop("span", "system")
    past = told.join(wanted, [*KEY, "_b"]).where((F.col("pos") < F.col("p0")) & (F.col("start") >= F.col("s0") - history))
    past = past.withColumn("kind", F.lit(1)).select(*cols)

    turns = new.unionByName(opening).unionByName(system).unionByName(past)
    windows = turns.groupBy(*KEY, "span").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", "role", "text"))).alias("turns"),
        F.sum("tokens").alias("tokens"),
    )
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            ((t["kind"] == 2) & (t["role"] == "assistant")).alias("learned"),
        ),
    )
    windows = windows.withColumn("pieces", pieces)
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)
    loss = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + size(p)).alias("at"),
            F.when(
                p["learned"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return windows.select(
        F.when(~F.col("_null"), F.col("_c")).alias("conv_id"),
        F.col("span").alias("window"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_context"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        loss.alias("loss"),
        "tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns (role and text, unescaped) that are new in each window, and the text under its mask, parsed from its text."""
    parts = F.slice(F.split("text", r"<\|im_start\|>"), F.col("n_context") + 2, 1 << 30)
    bodies = F.transform(parts, lambda p: F.substring(p, F.lit(1), F.length(p) - len(CLOSE)))
    turns = F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.substring_index(b, "\n", 1)).alias("role"),
            unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("text"),
        ),
    )
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", "tokens", F.length("text").cast("long").alias("chars"), turns.alias("turns"), F.array_join(learned, "").alias("learned"))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation: what reading all its windows back gives."""
    told = read_back(windows)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    told = told.select("conv_id", "window", "chars", F.size("turns").cast("long").alias("n"), said.alias("said"), "learned")
    grouped = told.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_windows"),
        F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("w"),
    )
    learned = F.array_join("w.learned", "")
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(F.encode(F.array_join("w.said", ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(F.encode(learned, "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
