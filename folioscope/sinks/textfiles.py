"""Small text files on any Hadoop file system: replaced whole, so that a reader meets the old or the new text.

Every writer here works on one file that a person could have written (a log of a day, a
profile, a pointer); tables go through ``Store``.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Text files below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        if self._fs.getScheme() == "file":  # people edit these files, and checksums beside them would then be wrong
            self._fs = self._fs.getRawFileSystem()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self._conf).makeQualified(path)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        """The text of a file, or none."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> bool:
        """Puts a whole text in a file's place; one that is there already is left alone. Whether anything was written.

        The text is written beside and renamed over the old file in one step, so there is
        no moment without a file, and a writer that dies leaves the old one.
        """
        if self.read(name) == text:
            return False
        path, part = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.part")
        self._beside(part, text)
        self._replace(part, path)
        return True

    def _beside(self, part, text: str) -> None:
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _replace(self, part, path) -> None:
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf).rename(part, path, how)

    def remove(self, name: str, recursive: bool = False) -> bool:
        return self._fs.delete(self._path(name), recursive)


def entry_text(time: str, op: str, title: str, touched: list[str], details: list[str] = ()) -> str:
    """A log entry: its heading, details, and a link for each touched page."""
    lines = [f"## [{time}] {op} | {title}", ""]
    lines += [f"- {d}" for d in details]
    for page in touched:
        href = "/" + page.removeprefix("wiki/")
        lines.append(f"- touched [{page.rsplit('/', 1)[-1].removesuffix('.md')}]({f'<{href}>' if ' ' in href else href})")
    return "\n".join(lines)


def append_log(files: Files, now: datetime, op: str, title: str, touched: list[str], details: list[str] = ()) -> str:
    """Adds an entry to the log of its day, which is begun with its date; what was there stays as it was. The log's name."""
    name = f"log/{now:%Y%m%d}.md"
    before = files.read(name) or f"# {now:%Y-%m-%d}\n"
    files.write(name, before.rstrip() + "\n\n" + entry_text(f"{now:%H:%M}", op, title, touched, details) + "\n")
    return name


def log_checkpoint(files: Files, now: datetime, op: str, title: str, pages: list[str], begun: bool) -> bool:
    """Makes sure that a checkpoint's pages stand in the log of the day; whether the log was changed.

    ``begun``: the day's last entry belongs to this checkpoint already, and only pages
    that the log does not name are added to it. Else a new entry names them all.
    """
    name = f"log/{now:%Y%m%d}.md"
    before = files.read(name)
    if not begun or before is None:
        append_log(files, now, op, title, pages)
        return True
    missing = [p for p in pages if p not in before and "/" + p.removeprefix("wiki/") not in before]
    if not missing:
        return False
    more = entry_text("", "", "", missing).split("\n")[2:]
    return files.write(name, before.rstrip() + "\n" + "\n".join(more) + "\n")


def insert_bullets(text: str, section: str, bullets: list[str]) -> str:
    """A profile's text with bullets at the end of a section of the second level, which is added at the end if it is missing."""
    block = "\n".join(f"- {b.strip()}" for b in bullets if b.strip())
    if not block:
        return text
    rows = text.split("\n")
    heads = [k for k, row in enumerate(rows) if re.match(r"##\s", row)]
    at = next((k for k in heads if rows[k][2:].strip().lower() == section.lower()), None)
    if at is None:
        return text.rstrip("\n") + f"\n\n## {section}\n\n{block}\n"
    end = next((k for k in heads if k > at), len(rows))
    head, rest = "\n".join(rows[:end]).rstrip(), "\n".join(rows[end:])
    return f"{head}\n{block}\n" + (f"\n{rest}" if rest else "")


def insert_into_profile(files: Files, name: str, section: str, bullets: list[str]) -> bool:
    return files.write(name, insert_bullets(files.read(name) or "# Interests\n", section, bullets))


def free_name(files: Files, folder: str, stem: str) -> str:
    """The first name in a folder that no file has: the stem, then the stem with -2, -3 and so on."""
    n = 1
    while files.exists(name := f"{folder}/{stem}{'' if n == 1 else f'-{n}'}.md"):
        n += 1
    return name


def scaffold_files(files: Files, title: str, day: str, force: bool = False) -> list[str]:
    """The first files of a corpus. Refused where one of them is there already, unless forced."""
    first = {
        "wiki/index.md": f"---\ntitle: {title}\ntype: index\n---\n\n# {title}\n\n## Concepts\n\n## Entities\n\n## Summaries\n",
        "INTEREST.md": "# Interests\n\n## Current Focus\n\n## Downrank\n",
        f"log/{day.replace('-', '')}.md": f"# {day}\n",
    }
    there = [name for name in first if files.exists(name)]
    if there and not force:
        raise FileExistsError(f"the corpus has begun already: {', '.join(there)}")
    for name, text in first.items():
        files.write(name, text)
    return sorted(first)


def remove_legacy(files: Files, suffix: str = ".agraph") -> int:
    """Removes artifacts of an earlier format below ``graph`` and ``wiki``; how many there were."""
    removed = 0
    for folder in ("graph", "wiki"):
        if not files.exists(folder):
            continue
        found = files._fs.listFiles(files._path(folder), True)
        names = []
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(suffix):
                names.append(path)
        removed += sum(bool(files._fs.delete(path, False)) for path in names)
    return removed


def write_sidecars(spark: SparkSession, path: str, fresh: DataFrame, removed: DataFrame, shards: int = 64) -> int:
    """Rows by page in ``shards`` parts of a table; only the parts of fresh and removed pages are written again. How many.

    ``fresh`` has page_id and any columns; pages of ``removed`` (page_id) go. The new
    parts are complete before the old ones are replaced.
    """
    from folioscope.operators.graph import kept

    shard = F.pmod(F.xxhash64("page_id"), F.lit(shards)).cast("int")
    fresh = fresh.withColumn("shard", shard)
    gone = removed.select("page_id").unionByName(fresh.select("page_id")).distinct()
    touched = [r["shard"] for r in gone.select(shard.alias("shard")).distinct().collect()]  # at most ``shards`` numbers
    target = Files(spark, path)
    rows = fresh
    there = [k for k in touched if target.exists(f"shard={k}")]
    if there:
        old = spark.read.parquet(path).where(F.col("shard").isin(there))
        rows = old.join(gone, "page_id", "left_anti").select(fresh.columns).unionByName(fresh)
    rows = kept(rows)
    filled = {r["shard"] for r in rows.select("shard").distinct().collect()}
    rows.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for k in set(touched) - filled:
        target.remove(f"shard={k}", True)
    return len(touched)
