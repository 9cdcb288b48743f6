"""Candidate search and ranking.

Weights are added as integers (hundredths) and divided once, so that sums do not
depend on their order.
"""

from __future__ import annotations

from collections import Counter
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import graph as G
from folioscope.operators.recent import recency_score

#: Fixed values, in hundredths: title, tags, summary, each occurrence and its cap.
LEXICAL = (300, 220, 150, 25, 250)
INTEREST = (240, 200, 120, 18, 180)
DOWNRANK = 140
SORTS = {"relevance": ["score", "degree", "updated"], "updated": ["updated", "score"], "degree": ["degree", "score"], "title": []}


#: Words in the headings of a profile under which likes and dislikes are listed.
LIKED = ("current focus", "当前关注", "recurring interests", "长期兴趣", "positive signals", "正向信号", "source preferences", "来源偏好", "exploration queue", "探索队列", "discussion signals", "讨论信号")
DISLIKED = ("downrank", "less relevant", "not interested", "暂不关注", "降权", "低优先级", "排除")


def query_tokens(spark: SparkSession, text: str) -> list[tuple[str, int]]:
    """Tokens of a question with their counts, by the same expression that pages are tokenised with."""
    row = spark.range(1).select(T.tokens(F.lit(text)).alias("t")).first()
    return sorted(Counter(row["t"]).items())


def _weights(spark: SparkSession, tokens: list[tuple[str, float]]) -> DataFrame:
    """The question's own words: bounded by its length, so always small enough to broadcast."""
    rows = ", ".join(f"('{t.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', {float(w)}D)" for t, w in tokens)
    if not rows:
        return spark.sql("SELECT '' AS token, 0D AS q WHERE false")
    return spark.sql(f"SELECT token, q FROM VALUES {rows} AS v(token, q)")


def page_text() -> Column:
    """What a page is searched by: title, tags, summary and text."""
    return F.concat_ws("\n", "title", F.array_join("tags", " "), "summary", "body")


def _points(weights: tuple[int, ...], title: Column, tags: Column, summary: Column, tf: Column) -> Column:
    """Hundredths that one word gives: where it stands, and how often, up to a cap."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return flag(title, weights[0]) + flag(tags, weights[1]) + flag(summary, weights[2]) + F.least(F.lit(weights[4]), tf * weights[3])


def lexical(pages: DataFrame, tokens: list[tuple[str, int]], carry: list[str] | None = None) -> DataFrame:
    """(page_id, lexical, matched) of the pages with a word of the question; all pages and the carried columns if any are named.

    One narrow pass: the question's words are a literal, a page's words are filtered to
    them before anything is counted, and the norm is the number of words. Nothing is
    exploded or shuffled.
    """
    words = F.array(*[F.lit(t) for t, _ in tokens])
    asked = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(int(q)).cast("long").alias("q")) for t, q in tokens])
    every = T.tokens(page_text())
    fields = [T.tokens(c) for c in (F.col("title"), F.array_join("tags", " "), F.col("summary"))]
    rows = pages.select("page_id", *(carry or []), every.alias("_all"), *[f.alias(n) for f, n in zip(fields, ("_title", "_tags", "_summary"), strict=True)])
    rows = rows.withColumn("_hit", F.filter("_all", lambda x: F.array_contains(words, x)))
    has = lambda c, t: F.array_contains(c, t)
    tf = lambda t: F.size(F.filter("_hit", lambda x: x == t)).cast("long")
    each = lambda s: F.when(has("_hit", s["t"]), s["q"] * _points(LEXICAL, has("_title", s["t"]), has("_tags", s["t"]), has("_summary", s["t"]), tf(s["t"]))).otherwise(F.lit(0).cast("long"))
    points = F.aggregate(asked, F.lit(0).cast("long"), lambda total, s: total + each(s))
    norm = F.sqrt(F.greatest(F.size("_all"), F.lit(1)))
    out = rows.select("page_id", *(carry or []), (8 * (points / 100) / norm).alias("lexical"), F.array_sort(F.array_distinct("_hit")).alias("matched"))
    return out if carry is not None else out.where("size(matched) > 0")


def interest(pages: DataFrame, terms: DataFrame) -> DataFrame:
    """(page_id, interest) from terms (sign, token, weight): likes add as in the text score, dislikes take off a fixed amount.

    Words meet the terms before they are grouped, so only words of interest travel.
    """
    own = terms.groupBy("token").agg(F.sum(F.when(F.col("sign") > 0, F.col("weight")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("sign") < 0, F.col("weight")).otherwise(0.0)).alias("minus"))
    words = pages.select("page_id", F.explode(T.tokens(page_text())).alias("token"))
    hits = words.join(own, "token").groupBy("page_id", "token", "plus", "minus").agg(F.count("*").alias("tf"))
    fields = pages.select("page_id", F.size(T.tokens(page_text())).alias("n"), *[T.tokens(c).alias(n) for c, n in ((F.col("title"), "a"), (F.array_join("tags", " "), "b"), (F.col("summary"), "c"))])
    has = lambda c: F.array_contains(c, F.col("token"))
    one = F.round(F.col("plus") * 100).cast("long") * _points(INTEREST, has("a"), has("b"), has("c"), F.col("tf")) - F.round(F.col("minus") * 100).cast("long") * DOWNRANK
    points = hits.join(fields, "page_id").groupBy("page_id", "n").agg(F.sum(one).alias("p"))
    return points.select("page_id", (4 * (F.col("p") / 10_000) / F.sqrt(F.greatest("n", F.lit(1)))).alias("interest"))


def interest_terms(profile: DataFrame) -> DataFrame:
    """(sign, token, weight) from profile pages (page_id, body): bullets under liked and disliked headings."""
    from folioscope.operators.pages import lines

    section = F.lower(F.coalesce("section", F.lit("")))
    any_of = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: section.contains(n))
    rows = lines(profile).where("not in_fence and level = 0").where(F.col("stripped").rlike(r"\A[-*]"))
    item = T.strip(T.strip_links(F.regexp_replace("stripped", r"\A[-* ]+", "")))
    item = F.regexp_replace(item, r"\A\[[ xX]\]\s*", "")
    rows = rows.select(section.alias("section"), any_of(DISLIKED).alias("no"), any_of(LIKED).alias("yes"), item.alias("item")).where("(yes or no) and item != '' and instr(item, '<') = 0")
    hint = F.regexp_extract("item", r"(?i)\bweight\s*:\s*([0-9]+(?:\.[0-9]+)?)", 1)
    weight = F.when(hint == "", 1.0).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(5.0), hint.cast("double"))))
    signal = T.strip(F.substring_index("item", "|", 1))
    spoken = F.col("section").contains("discussion signals") | F.col("section").contains("讨论信号")
    signal = F.when(spoken & signal.contains("—"), F.substring_index(signal, "—", -1)).otherwise(signal)
    signal = F.regexp_replace(F.regexp_replace(signal, r"\b\d{4}-\d{2}-\d{2}\b", ""), r"(?i)\bweight\s*:\s*[0-9]+(?:\.[0-9]+)?", "")
    words = rows.select(F.when(F.col("no"), -1).otherwise(1).alias("sign"), weight.alias("weight"), F.explode(T.tokens(signal)).alias("token"))
    return words.groupBy("sign", "token").agg(F.sum("weight").alias("weight"))


def interest_query(terms: DataFrame, n: int = 12) -> DataFrame:
    return terms.where("sign > 0").groupBy("token").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "token").limit(n)


def fts_hits(postings: DataFrame, tokens: list[tuple[str, int]], limit: int | None = None) -> DataFrame:
    """(page_id, hits): distinct chunks with any of the first 24 tokens."""
    wanted = _weights(postings.sparkSession, tokens[:24])
    hits = postings.where("chunk_id is not null").join(F.broadcast(wanted), "token", "left_semi").groupBy("page_id").agg(F.countDistinct("chunk_id").alias("hits"))
    return hits if limit is None else hits.orderBy(F.desc("hits"), "page_id").limit(limit)


def like_hits(pages: DataFrame, chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(page_id, hits): rows of page and chunk that hold any of the first 16 terms, letters taken literally."""
    text = F.lower(F.concat_ws("\n", "title", "summary", F.array_join("tags", " "), "chunk_body"))
    rows = pages.select("page_id", "title", "summary", "tags").join(chunks.select("page_id", F.col("body").alias("chunk_body")), "page_id", "left")
    wanted = [F.contains(text, F.lit(t.lower())) for t in terms[:16]]
    hit = F.lit(False)
    for w in wanted:
        hit = hit | w
    return rows.where(hit).groupBy("page_id").agg(F.count("*").alias("hits"))


def resolve_seeds(pages: DataFrame, seeds: list[str]) -> DataFrame:
    """(seed, page_id): the exact id, else an exact title, id or stem, else one that holds the text; the shortest id wins.

    Seeds are a few texts of a request; pages meet them in one pass over a literal array.
    """
    rows = pages.select("page_id", "title", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    low = F.lower(F.trim("seed"))
    names = [F.lower("title"), F.lower("page_id"), F.lower(T.stem(F.col("page_id")))]
    from folioscope.functions.links import normal_path

    path = normal_path(F.trim("seed"))
    exact_id = (F.col("page_id") == path) | (F.col("page_id") == F.concat(F.lit("wiki/"), path))
    exact = (names[0] == low) | (names[1] == low) | (names[2] == low)
    part = F.contains(names[0], low) | F.contains(names[1], low) | F.contains(names[2], low)
    step = F.when(exact_id, 0).when(exact, 1).when(part, 2)
    found = rows.withColumn("step", step).where("step is not null")
    return found.groupBy("seed").agg(F.min_by("page_id", F.struct("step", F.length("page_id"), "page_id")).alias("page_id"))


def browse_pool(pages: DataFrame, limit: int) -> DataFrame:
    """What is ranked where nothing is asked: the newest pages, a bounded number."""
    return pages.orderBy(F.desc("updated"), "page_id").limit(max(50 * limit, 1000))


def candidates(postings: DataFrame, pages: DataFrame, chunks: DataFrame, text: str, limit: int, terms: DataFrame | None = None) -> DataFrame | None:
    """(page_id) that a question and the interests can be about; none if nothing is asked.

    Chunks with words of the question come first; only if fewer pages than the limit
    have any, those that hold its text literally are added. ``interest`` adds the pages
    of the liked words. Each list is bounded by the number of hits asked for.
    """
    spark, out = pages.sparkSession, None
    tokens = query_tokens(spark, text)
    if tokens:
        most = max(20 * limit, 100)
        out = fts_hits(postings, tokens, most).select("page_id")
        enough = out.agg(F.count("*")).scalar()
        plain = like_hits(pages, chunks, text.split()).orderBy(F.desc("hits"), "page_id").limit(most).select("page_id")
        out = out.unionByName(plain.where(enough < limit))
    if terms is not None:
        liked = interest_query(terms).select("token")  # a dozen words
        hits = postings.where("chunk_id is not null").join(F.broadcast(liked), "token", "left_semi").groupBy("page_id").agg(F.countDistinct("chunk_id").alias("hits"))
        hits = hits.orderBy(F.desc("hits"), "page_id").limit(max(10 * limit, 50)).select("page_id")
        out = hits if out is None else out.unionByName(hits)
    return None if out is None else out.distinct()


def rank(
    pages: DataFrame,
    edges: DataFrame,
    text: str = "",
    seeds: DataFrame | None = None,
    depth: int = 1,
    since: datetime | None = None,
    until: datetime | None = None,
    kinds: list[str] | None = None,
    tags: list[str] | None = None,
    terms: DataFrame | None = None,
    now: datetime | None = None,
    limit: int = 12,
    sort: str = "relevance",
    include_index: bool = False,
    among: DataFrame | None = None,
) -> DataFrame:
    """Ranked pages with all components. ``pages`` needs page_id, title, kind, tags, summary, body, updated.

    One lazy plan: filters run before anything is scored, the text score is a narrow
    pass, and the greatest degree is a one-row scalar subquery. ``among`` limits what is
    ranked to candidates and the neighbourhood of the seeds. ``now`` is the clock's time
    unless it is given.
    """
    spark = pages.sparkSession
    stamp = F.lit(now or datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
    tokens = query_tokens(spark, text)
    asked = bool(tokens) or seeds is not None
    near = G.proximity(G.khop(edges, seeds, depth, pages)) if seeds is not None else None
    kept = pages
    if among is not None:
        ids = among.select("page_id")
        kept = kept.join(ids if near is None else ids.unionByName(near.select("page_id")).distinct(), "page_id", "left_semi")
    if asked and not include_index:
        kept = kept.where("page_id != 'wiki/index.md'")
    if since is not None:
        kept = kept.where(F.col("updated") >= F.lit(since))
    if until is not None:
        kept = kept.where(F.col("updated") <= F.lit(until))
    if kinds:
        kept = kept.where(F.col("kind").isin(*kinds))
    if tags:
        kept = kept.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    carry = ["title", "kind", "updated"]
    if tokens:
        rows = lexical(kept, tokens, carry)
    else:
        rows = kept.select("page_id", *carry, F.lit(0.0).alias("lexical"), F.array().cast("array<string>").alias("matched"))
    rows = rows.join(G.degrees(edges, kept), "page_id")
    rows = rows.join(near, "page_id", "left") if near is not None else rows.withColumn("rel", F.lit(0.0))
    rows = rows.join(interest(kept, terms), "page_id", "left") if terms is not None else rows.withColumn("interest", F.lit(0.0))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lexical", "rel", "interest")})
    if asked:
        rows = rows.where("lexical > 0 or rel > 0 or interest > 0")
    top = rows.agg(F.max("degree").alias("m")).scalar()
    rows = rows.withColumn("centrality", F.coalesce(F.col("degree") / F.nullif(top, F.lit(0)), F.lit(0.0))).withColumn("recency", recency_score(F.col("updated"), stamp))
    lex, rel, cen, rec, liked = (F.col(c) for c in ("lexical", "rel", "centrality", "recency", "interest"))
    if asked:
        score = 2.0 * lex + 1.5 * rel + 0.4 * cen + 0.3 * rec + 0.7 * liked
    elif since is not None or until is not None:
        score = 1.2 * rec + 0.4 * cen + 0.7 * liked
    else:
        score = 0.8 * cen + 0.4 * rec + 0.9 * liked
    rows = rows.withColumn("score", score)
    order = [F.lower("title")] if sort == "title" else [F.desc(c) for c in SORTS[sort]]
    return rows.orderBy(*order, "page_id").limit(limit)


def with_reasons(ranked: DataFrame) -> DataFrame:
    """Adds the reasons of each hit: matched words, closeness, degree, interest, date."""
    words = F.when(F.size(F.coalesce("matched", F.array().cast("array<string>"))) > 0, F.concat(F.lit("matched: "), F.array_join(F.slice("matched", 1, 6), ", ")))
    near = F.when(F.col("rel") >= 1.25, "seed page").when(F.col("rel") > 0, F.concat(F.lit("graph distance "), F.round(1 / F.col("rel") - 0.35).cast("int").cast("string")))
    degree = F.when(F.col("degree") > 0, F.concat(F.lit("degree "), F.col("degree").cast("string")))
    liked = F.when(F.col("interest") > 0, "matches interests").when(F.col("interest") < 0, "downranked")
    when = F.concat(F.lit("updated "), F.date_format("updated", "yyyy-MM-dd"))
    return ranked.withColumn("reasons", F.array_compact(F.array(words, near, degree, liked, when)))
