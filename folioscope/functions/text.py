"""Text functions of pages: frontmatter, titles, tokens, slugs, dates, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries and pages do not count.
STOPWORDS = (
    "a an and are as at be by can does for from how i in is it of on or say should "
    "the to vs what when where which who why wiki with"
).split()

FRONT = r"(?s)\A---\n(.*?)\n---\n"
SPACE = " \t\r\n\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


# --- frontmatter -------------------------------------------------------------


def front_block(body: Column) -> Column:
    """Lines between the opening and closing marks; empty if there are none."""
    return F.regexp_extract(body, FRONT, 1)


def front_lines(body: Column) -> Column:
    """How many lines the frontmatter takes, its marks included."""
    whole = F.regexp_extract(body, FRONT, 0)
    return F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))


def strip_front(body: Column) -> Column:
    return F.regexp_replace(body, FRONT, "")


def unquote(v: Column) -> Column:
    v = strip(v)
    double = v.rlike(r'(?s)\A".*"\z') & (F.length(v) > 1)
    single = v.rlike(r"(?s)\A'.*'\z") & (F.length(v) > 1)
    inner = F.substring(v, F.lit(2), F.length(v) - 2)
    plain = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.when(double, plain).when(single, inner).otherwise(v)


def _line_values(value: Column) -> Column:
    """Values that stand behind a key: of an inline list, of a scalar, or none."""
    value = strip(value)
    inline = value.startswith("[") & value.endswith("]")
    items = F.split(F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0))), ",")
    listed = F.filter(F.transform(items, unquote), lambda x: x != "")
    return F.when(inline, listed).when(value == "", F.array().cast("array<string>")).otherwise(F.array(unquote(value)))


def front_map(block: Column) -> Column:
    """MAP of every key to its values: scalars, inline lists and indented ``- item`` lists alike.

    One fold over the block's lines carries the key that an item belongs to; text is
    kept as it is, numbers included.
    """
    start = F.struct(F.lit("").alias("key"), F.array().cast("array<struct<k:string,v:array<string>>>").alias("out"))
    key = lambda x: F.regexp_extract(x, r"\A([A-Za-z_][A-Za-z0-9_-]*):(?:\s.*)?\z", 1)
    item = lambda x: F.regexp_extract(x, r"\A\s+-\s+(.*)\z", 1)

    def step(a, x):
        k = key(x)
        own = F.struct(k.alias("k"), _line_values(F.substring(x, F.length(k) + 2, F.length(x))).alias("v"))
        more = F.struct(a["key"].alias("k"), F.array(unquote(item(x))).alias("v"))
        return (
            F.when(k != "", F.struct(k.alias("key"), F.concat(a["out"], F.array(own)).alias("out")))
            .when((item(x) != "") & (a["key"] != ""), F.struct(a["key"].alias("key"), F.concat(a["out"], F.array(more)).alias("out")))
            .otherwise(a)
        )

    pairs = F.aggregate(F.split(block, r"\r?\n"), start, step, lambda a: a["out"])
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.flatten(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])).alias("value"))))


def front_values(fm: Column, key: str) -> Column:
    return F.coalesce(fm[key], F.array().cast("array<string>"))


def front_value(fm: Column, key: str) -> Column:
    """First value of a key, or null."""
    return F.get(front_values(fm, key), 0)


def source_urls(fm: Column) -> Column:
    """http(s) addresses of ``source_url`` and ``source_urls``, each once, in order."""
    found = F.concat(front_values(fm, "source_url"), front_values(fm, "source_urls"))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda u: F.lower(u).rlike(r"\Ahttps?://\S+\z")))


# --- names -------------------------------------------------------------------


def file_name(page_id: Column) -> Column:
    return F.substring_index(page_id, "/", -1)


def without_md(c: Column) -> Column:
    return F.when(c.endswith(".md"), F.substring(c, F.lit(1), F.length(c) - 3)).otherwise(c)


def stem(page_id: Column) -> Column:
    return without_md(file_name(page_id))


def page_title(fm_title: Column, plain: Column, page_id: Column) -> Column:
    """Frontmatter title, else the first ``# `` line, else the file's stem."""
    first = strip(F.regexp_extract(plain, r"(?m)^# +(.+?)\s*$", 1))
    return F.coalesce(F.nullif(strip(fm_title), F.lit("")), F.nullif(first, F.lit("")), stem(page_id))


def page_kind(fm_type: Column, page_id: Column) -> Column:
    """Frontmatter type, else by folder, else index or page."""
    folder = F.when(F.size(F.split(page_id, "/")) >= 3, F.get(F.split(page_id, "/"), 1))
    by_folder = F.when(folder == "concepts", "concept").when(folder == "entities", "entity").when(folder == "summaries", "summary")
    return F.coalesce(F.nullif(strip(fm_type), F.lit("")), by_folder, F.when(page_id == "wiki/index.md", "index").otherwise("page"))


def display_meta(page_id: Column, title: Column) -> Column:
    """STRUCT of display, short and qualified name, breadcrumb, file and parent name."""
    parts = F.split(page_id, "/")
    n = F.size(parts)
    name, parent = F.element_at(parts, -1), F.when(n >= 2, F.get(parts, n - 2)).otherwise("")
    is_index = name == "index.md"
    fallback = F.when(is_index, F.when((parent != "") & (parent != "wiki"), without_md(parent)).otherwise("Index")).otherwise(without_md(name))
    display = F.coalesce(F.nullif(strip(title), F.lit("")), fallback)
    inner = F.transform(F.filter(parts, lambda p: p != "index.md"), without_md)
    head = F.slice(inner, F.lit(1), F.size(inner) - 1)
    crumb = (
        F.when(~is_index, F.concat(head, F.array(display)))
        .when(F.size(inner) == 0, F.array(display))
        .when(F.element_at(inner, -1) == "wiki", F.concat(inner, F.array(display)))
        .otherwise(inner)
    )
    rest = F.when(F.get(crumb, 0) == "wiki", F.slice(crumb, 2, 1 << 20)).otherwise(crumb)
    qualified = F.when(F.size(rest) == 0, display).otherwise(F.array_join(rest, " / "))
    return F.struct(
        display.alias("display_name"),
        display.alias("short_name"),
        qualified.alias("qualified_name"),
        crumb.alias("breadcrumb"),
        name.alias("file_name"),
        without_md(parent).alias("parent_name"),
    )


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by dashes."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def audit_slug(c: Column, words: int = 5, chars: int = 30) -> Column:
    """Slug of the first words, cut to a number of characters."""
    return F.btrim(F.substring(slug(F.array_join(F.slice(F.split(collapse(c), " "), 1, words), " ")), 1, chars), F.lit("-"))


# --- measures ----------------------------------------------------------------


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up; nothing for blank text."""
    return F.when(strip(c) == "", 0).otherwise(F.ceil(F.length(c) / 4)).cast("long")


def human_bytes(n: Column) -> Column:
    """1536 -> 1.5 KB; whole bytes below a kilobyte."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.1f", F.bround(n / float(1024**power), 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def dateish(c: Column) -> Column:
    """Timestamp of ISO texts, dates with or without dashes, dates with a time; null for all else. Zone-less texts are UTC."""
    v = strip(c)
    iso = F.when(v.contains("T") | v.endswith("Z"), F.try_to_timestamp(v))
    day = F.when(v.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_timestamp(v, F.lit("yyyy-MM-dd")))
    tight = F.when(v.rlike(r"\A\d{8}\z"), F.try_to_timestamp(v, F.lit("yyyyMMdd")))
    timed = F.when(v.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}\z"), F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm")))
    return F.coalesce(iso, day, tight, timed)


# --- tokens ------------------------------------------------------------------


def ascii_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9][a-z0-9_.+-]*)"), 1)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))


def cjk_tokens(c: Column) -> Column:
    """A run of one character once; a longer run twice, and each pair of neighbours once."""
    runs = F.regexp_extract_all(c, F.lit("([\\u3400-\\u9fff]+)"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(F.array(r, r), pairs(r)))))


def tokens(c: Column) -> Column:
    """All tokens of a text with repetitions, as an array to explode and count."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(ascii_words(c), cjk_tokens(c))


def strip_links(c: Column) -> Column:
    """Images and links replaced by their labels."""
    images = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    return F.regexp_replace(images, r"\[([^\]]+)\]\((?:<[^>]+>|[^)]+)\)", "$1")


def format_link(label: Column, href: Column) -> Column:
    """Markdown link; an address with white space stands in angle brackets."""
    return F.concat(F.lit("["), label, F.lit("]("), F.when(href.rlike(r"\s"), F.concat(F.lit("<"), href, F.lit(">"))).otherwise(href), F.lit(")"))
