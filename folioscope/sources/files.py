"""Markdown trees, logs, feedback files, JSON artifacts, version-control listings."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "page_id string, old_page_id string, change string"
COMMITS = "hash string, committed_at timestamp, subject string, files array<string>"
JSON_LIMIT = 64 << 20


def _relative(root: str) -> Column:
    """The path below the root: what follows the root's own path, decoded."""
    base = re.sub(r"^[a-z][a-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return F.substring(path, F.instr(path, base) + len(base), F.length(path))


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def stat_scan(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, size_bytes, mtime) without reading any content: the column is pruned from the scan."""
    rows = _files(spark, root, glob).select(_relative(root).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    return rows.where(~F.col("path").rlike(r"(\A|/)\."))


def scan_corpus(spark: SparkSession, root: str, folder: str = "wiki") -> DataFrame:
    """(page_id, body, size_bytes, mtime) of a tree's Markdown pages."""
    rows = _files(spark, root, "*.md").select(_relative(root).alias("page_id"), F.decode("content", "UTF-8").alias("body"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    return rows.where(F.col("page_id").startswith(f"{folder}/") & ~F.col("page_id").rlike(r"(\A|/)\."))


def raw_scan(spark: SparkSession, root: str) -> DataFrame:
    return stat_scan(spark, root, "*").where(F.col("path").startswith("raw/"))


def log_scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of daily logs; the reader orders them, a source does not sort."""
    rows = _files(spark, root, "*.md").select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("body"))
    return rows.where(F.col("path").rlike(r"\Alog/\d{8}\.md\z"))


def audit_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(path, body) of open and of resolved feedback files."""
    rows = _files(spark, root, "*.md").select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("body"))
    return rows.where(F.col("path").rlike(r"\Aaudit/[^/]+\.md\z")), rows.where(F.col("path").rlike(r"\Aaudit/resolved/[^/]+\.md\z"))


def sidecar_files(spark: SparkSession, root: str) -> DataFrame:
    return _files(spark, root, "*.md.audit").select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("body"))


def json_artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A JSON artifact by its plain name; larger ones than the limit and names with a path are refused."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name.startswith("."):
        raise ValueError(f"not an artifact name: {name}")
    size = _files(spark, root, name).agg(F.max("length")).first()[0] or 0
    if size > JSON_LIMIT:
        raise ValueError(f"{name} has {size} bytes; the limit is {JSON_LIMIT}")
    return spark.read.option("multiLine", True).json(f"{root}/{name}")


def parse_porcelain(text: bytes) -> list[tuple[str, str | None, str]]:
    """Changes of ``git status --porcelain=v1 -z``: a rename carries its old path in the next field."""
    fields, out = iter(text.decode("utf-8", "surrogateescape").split("\0")), []
    for field in fields:
        if len(field) < 4:
            continue
        state, path = field[:2], field[3:]
        if "R" in state or "C" in state:
            old = next(fields, None)
            out.append((path, old, "rename" if "R" in state else "insert"))
        elif "D" in state:
            out.append((path, None, "delete"))
        else:
            out.append((path, None, "insert" if state in ("??", "A ", "AM") else "update"))
    return out


def _git(root: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", root, "-c", "core.quotepath=false", *args], capture_output=True, check=True).stdout


def working_changes(spark: SparkSession, root: str) -> DataFrame:
    """Changes of the working tree. A listing of one repository, read where its folder is: on the driver."""
    return spark.createDataFrame(parse_porcelain(_git(root, "status", "--porcelain=v1", "-z", "--untracked-files=all")), CHANGES)


def range_changes(spark: SparkSession, root: str, old: str, new: str = "HEAD") -> DataFrame:
    """Changes between two commits."""
    fields = iter(_git(root, "diff", "--name-status", "-z", "-M", old, new).decode("utf-8", "surrogateescape").split("\0"))
    rows = []
    for state in fields:
        if not state:
            continue
        path = next(fields)
        if state[0] in "RC":
            rows.append((next(fields), path, "rename" if state[0] == "R" else "insert"))
        else:
            rows.append((path, None, {"A": "insert", "D": "delete"}.get(state[0], "update")))
    return spark.createDataFrame(rows, CHANGES)


def commit_log(spark: SparkSession, root: str, days: int, now) -> DataFrame:
    """(hash, committed_at, subject, files) of the commits of the last days before ``now``."""
    from datetime import UTC, datetime, timedelta

    since = (now - timedelta(days=days)).isoformat()
    text = _git(root, "log", f"--since={since}", "--name-only", "-z", "--format=%x01%H%x02%ct%x02%s").decode("utf-8", "surrogateescape")
    rows = []
    for part in text.split("\x01")[1:]:
        head, *files = [x.strip("\n") for x in part.split("\0")]
        sha, stamp, subject = head.split("\x02")
        rows.append((sha, datetime.fromtimestamp(int(stamp), UTC).replace(tzinfo=None), subject, [f for f in files if f]))
    return spark.createDataFrame(rows, COMMITS)


def union_changes(parts: Iterable[DataFrame]) -> DataFrame:
    """All sources of change as one, oldest source first, each page once with its newest change.

    So a page that was committed and then removed from the working tree is removed, and
    one that was removed and then written again is there.
    """
    out = None
    for n, p in enumerate(parts):
        one = p.select("page_id", "old_page_id", "change", F.lit(n).alias("n"))
        out = one if out is None else out.unionByName(one)
    newest = F.struct("n", "change")  # of equal age the order of the words decides, so that the answer is fixed
    old = F.max_by("old_page_id", F.when(F.col("old_page_id").isNotNull(), F.col("n")))
    return out.groupBy("page_id").agg(old.alias("old_page_id"), F.max_by("change", newest).alias("change"))


def scoped_stats(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of a stat scan (path, ...) for pages that were changed and still exist."""
    wanted = changes.where("change != 'delete'").select(F.col("page_id").alias("path")).distinct()
    return stats.join(wanted, "path", "left_semi")


def largest(stats: DataFrame, n: int = 20) -> DataFrame:
    return stats.orderBy(F.desc("size_bytes"), "path").limit(n)


def tag_scan(spark: SparkSession, root: str, prefix: str = "ckpt/") -> DataFrame:
    """(tag, hash, created_at) of a repository's checkpoint tags, newest first."""
    from datetime import UTC, datetime

    text = _git(root, "for-each-ref", f"refs/tags/{prefix.rstrip('/')}", "--format=%(refname:strip=2)%01%(objectname)%01%(*objectname)%01%(creatordate:unix)").decode("utf-8", "surrogateescape")
    rows = []
    for line in text.splitlines():
        tag, own, target, stamp = line.split("\x01")
        rows.append((tag, target or own, datetime.fromtimestamp(int(stamp), UTC).replace(tzinfo=None)))
    return spark.createDataFrame(rows, "tag string, hash string, created_at timestamp").orderBy(F.desc("created_at"), F.desc("tag"))


def head_of(root: str) -> str | None:
    """The commit that a clean working tree stands on; none if it is not clean or no repository of its own."""
    try:
        top = _git(root, "rev-parse", "--show-toplevel").decode().strip()
        if os.path.realpath(top) != os.path.realpath(root) or _git(root, "status", "--porcelain", "--", "wiki").strip():
            return None
        return _git(root, "rev-parse", "HEAD").decode().strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def scaffold(spark: SparkSession) -> dict[str, DataFrame]:
    """Empty tables of every kind, for a corpus that begins."""
    schemas = {
        "pages": "page_id string, body string",
        "edges": "s string, t string, k string, w long, d double",
        "chunks": "chunk_id string, page_id string, ordinal int, heading string, heading_path string, body string, token_count long, content_sha256 string, start_line int, end_line int",
        "log_entries": "entry_id string, log_path string, date date, time string, op string, title string, body string, touched array<string>",
        "interest": "sign int, token string, weight double",
        "changes": CHANGES,
        "commits": COMMITS,
    }
    return {k: spark.createDataFrame([], v) for k, v in schemas.items()}
