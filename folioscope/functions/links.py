"""Links in Markdown text: extraction, classes, resolution to page ids, rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import strip


def _address(char: str, least: str = "+") -> str:
    """Characters of one class up to ``.md``, then an anchor, if there is one, of the same class."""
    return rf"{char}{least}?\.md(?:#{char}*)?"


# What counts as a link to a Markdown file, as a path and as an external
# address decides which rows there are, so the classes of characters below must stay.
_LABEL = r"[^\]\n]*"
_IN_ANGLES, _BARE, _SPACED, _PATH = r"[^>\n]", r"[^()\s]", r"[^)<>\n]", r"[^<>\"'\n)]"
#: A link: label, then the address in angle brackets or bare.
LINK = rf"\[({_LABEL})\]\(\s*(?:<({_address(_IN_ANGLES)})>|({_address(_BARE)}))\s*\)"
#: An address with white space outside angle brackets, which readers of Markdown do not take for a link.
SPACED = rf"\[{_LABEL}\]\(\s*({_SPACED}*?\s{_address(_SPACED, '*')})\s*\)"
PARENT = rf"(\.\./{_address(_PATH, '*')})"
ABSOLUTE = rf"(?<![A-Za-z0-9._:/-])(/{_address(_PATH, '*')})"
EXTERNAL = r"(?i)\A[a-z][a-z0-9+.-]*:"
DOUBLE_BRACKETS = r"\[\[([^\]\n]+?)\]\]"
LOG_PATH, LOG_PATH_IN_TICKS = r"(wiki/[^\s`<>)]*?\.md)", r"`(wiki/[^`\n]+?\.md)`"
#: Folders that a root-relative address may begin with.
ROOTS = ("wiki/", "log/", "raw/", "audit/")


def _matched(text: Column) -> Column:
    """Whole matches, images marked by a leading exclamation mark."""
    return F.regexp_extract_all(text, F.lit("(!?" + LINK + ")"), 1)


def link_parts(text: Column) -> Column:
    """ARRAY of STRUCT(label, href, is_image) of links to Markdown files; anchors cut, external addresses left out."""
    raw = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, LINK, 2), F.lit("")), F.regexp_extract(m, LINK, 3))
    parts = F.transform(
        _matched(text),
        lambda m: F.struct(F.regexp_extract(m, LINK, 1).alias("label"), strip(F.substring_index(raw(m), "#", 1)).alias("href"), m.startswith("!").alias("is_image")),
    )
    return F.filter(parts, lambda p: (p["href"] != "") & ~p["href"].rlike(EXTERNAL))


def hrefs(text: Column) -> Column:
    return F.transform(link_parts(text), lambda p: p["href"])


def normal_path(path: Column) -> Column:
    """Path without empty, ``.`` and ``..`` segments; leading ``..`` stay, as nothing is above them."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = F.lit("..")
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda a, s: F.when((s == up) & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != up), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    return F.array_join(done, "/")


def _rooted(path: Column) -> Column:
    out = F.lit(False)
    for root in ROOTS:
        out = out | path.startswith(root)
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value written once: nested uses would copy its whole expression."""
    return F.get(F.transform(F.array(value), body), 0)


def target_of(href: Column, lenient: bool = False) -> Column:
    """The file an address means, whether or not it exists; null if it can mean none.

    A leading slash stands for ``wiki/``. Other addresses must begin with a known
    root, or with nothing at all in lenient use (search), where ``wiki/`` is meant.
    """
    full = F.when(href.startswith("/"), F.concat(F.lit("wiki"), href)).otherwise(href)

    def judged(p: Column) -> Column:
        outside = (p == "..") | p.startswith("../") | (p == "")
        if lenient:
            return F.when(outside, F.lit(None)).when(p.startswith("wiki/"), p).otherwise(F.concat(F.lit("wiki/"), p))
        return F.when(~outside & _rooted(p), p)

    # An anchored address that climbs out of ``wiki/`` means nothing, under either reading.
    climbs = href.startswith("/") & href.contains("..")
    return _let(normal_path(full), lambda p: F.when(~climbs | p.startswith("wiki/"), judged(p)))


def suggestion(href: Column) -> Column:
    """The address with ``wiki/`` before it, where only this is missing."""
    bad = lambda p: p.isin("", ".", "..") | p.startswith("../") | _rooted(p) | href.startswith("/")
    return _let(normal_path(href), lambda p: F.when(~bad(p), F.concat(F.lit("wiki/"), p)))


def link_class(href: Column) -> Column:
    def judged(p: Column) -> Column:
        return F.when(href.startswith("/"), "anchored").when((p == "..") | p.startswith("../"), "parent").when(_rooted(p), "rooted").otherwise("bare")

    return _let(normal_path(href), judged)


def malformed(text: Column) -> Column:
    """Addresses with white space that are not in angle brackets."""
    found = F.regexp_extract_all(text, F.lit(SPACED), 1)
    return F.filter(F.transform(found, strip), lambda u: ~u.rlike(EXTERNAL))


def parent_paths(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PARENT), 1), strip)


def absolute_paths(text: Column) -> Column:
    """Paths from the file system's root, wherever they stand; parts of an external address are none of them."""
    found = F.regexp_extract_all(text, F.lit(ABSOLUTE), 1)
    return F.filter(F.transform(found, strip), lambda p: ~p.startswith("//"))


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DOUBLE_BRACKETS), 1)


def log_literals(text: Column) -> Column:
    """Page paths written in log text, plain or between backticks."""
    plain = F.regexp_extract_all(text, F.lit(LOG_PATH), 1)
    ticked = F.regexp_extract_all(text, F.lit(LOG_PATH_IN_TICKS), 1)
    return F.array_union(plain, ticked)


def rewrite_anchored(text: Column) -> Column:
    """Links to ``wiki/x.md`` become ``/x.md``; a second run changes nothing."""
    return F.regexp_replace(text, r"\]\((<?)wiki/([^)\n]*?\.md)", "]($1/$2")
