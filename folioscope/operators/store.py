"""Snapshots and incremental maintenance.

A snapshot is a set of Parquet folders under one version, published by renaming a small
pointer file over the old one when all of them are written; readers see a whole version
or the one before. Derived tables are maintained by recomputing the rows of changed pages
and keeping the others: old left-anti changed, union new.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import graph as G
from folioscope.sinks.textfiles import Files

VOLATILE = ("generated_at",)


def state_diff(old: DataFrame, new: DataFrame, key: str = "page_id", mark: str = "sha256") -> DataFrame:
    """(page_id, change): insert, update, delete or same, by content."""
    o, n = old.select(key, F.col(mark).alias("_o")), new.select(key, F.col(mark).alias("_n"))
    change = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_o") != F.col("_n"), "update").otherwise("same")
    return o.join(n, key, "full").select(key, change.alias("change"))


def upsert(table: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "page_id") -> DataFrame:
    """The table with the rows of changed keys replaced by the fresh ones."""
    return table.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)


def ego_delta(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after a change and the pages whose neighbourhood it touches: the changed ones, their old and new targets."""
    ids = changed.select(F.col("page_id").alias("s")).distinct()
    gone = edges.join(ids, "s", "left_semi")
    after = edges.join(ids, "s", "left_anti").unionByName(fresh.select(edges.columns))
    touched = changed.select("page_id").unionByName(gone.select(F.col("t").alias("page_id"))).unionByName(fresh.select(F.col("t").alias("page_id"))).distinct()
    return after, touched


def dirty_pages(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed and removed pages with their neighbours on both sides."""
    ids = changes.where("change != 'same'").select("page_id").distinct()
    steps = G.undirected(edges)
    near = steps.join(ids.withColumnRenamed("page_id", "a"), "a", "left_semi").select(F.col("b").alias("page_id"))
    return ids.unionByName(near).distinct()


def undo_diff(parent: DataFrame, target: DataFrame, head: DataFrame, key: str = "page_id", mark: str = "sha256") -> DataFrame:
    """(page_id, action) that undoes the step parent -> target on top of head.

    ``restore`` the parent's state, ``remove`` what the step added, ``keep`` what it
    did not touch, ``done`` what is undone already, ``conflict`` where head has moved on.
    """
    cols = {"_p": parent, "_t": target, "_h": head}
    out = None
    for name, df in cols.items():
        one = df.select(key, F.col(mark).alias(name))
        out = one if out is None else out.join(one, key, "full")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    action = F.when(same("_p", "_t"), "keep").when(same("_h", "_p"), "done").when(same("_h", "_t"), F.when(F.col("_p").isNull(), "remove").otherwise("restore")).otherwise("conflict")
    return out.select(key, action.alias("action"))


def stale_files(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state): files that an index (path, size_bytes, mtime) does not know as they are now: new, gone or changed. Empty if it is fresh."""
    old = indexed.select("path", F.struct("size_bytes", "mtime").alias("_o"))
    new = current.select("path", F.struct("size_bytes", "mtime").alias("_n"))
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "gone").when(F.col("_o") != F.col("_n"), "changed")
    return old.join(new, "path", "full").select("path", state.alias("state")).where("state is not null")


def index_totals(tables: dict[str, DataFrame], changes: DataFrame) -> DataFrame:
    """One row: pages, chunks and links of an index, and how many pages were changed or removed for it."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(tables["pages"], "docs")
    for table, name in (("chunks", "chunks"), ("edges", "links")):
        out = out.withColumn(name, tables[table].agg(F.count("*")).scalar())
    moved = changes.agg(F.struct(F.count(F.when(F.col("change").isin("insert", "update", "rename"), 1)).alias("changed"), F.count(F.when(F.col("change") == "delete", 1)).alias("removed")).alias("c")).scalar()
    return out.withColumn("_m", moved).select("docs", "chunks", "links", "_m.changed", "_m.removed")


def content_digest(df: DataFrame) -> str:
    """A digest of the rows in any order; columns that change with every run are left out."""
    cols = sorted(c for c in df.columns if c not in VOLATILE)
    row = df.select(F.xxhash64(*[F.to_json(F.struct(c)) for c in cols]).alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return "-".join(map(str, row))


class Store:
    """Versions of named tables under one folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def _read(self, name: str) -> dict | None:
        text = self.files.read(name)
        return None if text is None else json.loads(text)

    def _write(self, name: str, value: dict) -> None:
        self.files.write(name, json.dumps(value, sort_keys=True))

    def current(self) -> str | None:
        return (self._read("CURRENT.json") or {}).get("version")

    def manifest(self, version: str | None = None) -> dict:
        return self._read(f"{version or self.current()}/MANIFEST.json") or {}

    def publish(self, tables: dict[str, DataFrame], stamp: str, message: str = "", clean: bool = True, shard_rows: int = 0, ordered: bool = False) -> str:
        """Writes a version; tables that are equal to the current ones are referred to, not kept twice.

        A table is computed once: it is written, and what was written is digested. With
        ``ordered`` rows stand in their canonical order, in files of ``shard_rows`` rows.
        Without a clean verdict the version is kept, but the pointer does not move.
        """
        before, version, entry = self.current(), f"v{uuid.uuid4().hex[:12]}", {}
        known = self.manifest(before).get("tables", {}) if before else {}
        for name, df in tables.items():
            rows = G.canonical(df) if ordered else df
            writer = rows.write.option("maxRecordsPerFile", shard_rows) if shard_rows else rows.write
            path = f"{version}/{name}"
            writer.parquet(f"{self.root}/{path}")
            digest = content_digest(self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}"))
            if known.get(name, {}).get("digest") == digest:
                self.files.remove(path, True)
                entry[name] = known[name]
            else:
                entry[name] = {"digest": digest, "path": path}
        self._write(f"{version}/MANIFEST.json", {"version": version, "parent": before, "generated_at": stamp, "message": message, "tables": entry})
        if clean:
            self._write("CURRENT.json", {"version": version})
        return version

    def read(self, name: str, version: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """A table of a version; an unknown table, or one without an asked column, is refused."""
        tables = self.manifest(version).get("tables", {})
        if name not in tables:
            raise KeyError(f"no table {name} in version {version or self.current()}")
        table = self.spark.read.parquet(f"{self.root}/{tables[name]['path']}")
        missing = [c for c in columns if c not in table.columns]
        if missing:
            raise ValueError(f"{name} has no columns {', '.join(missing)}; build the index again")
        return table

    def lookup(self, ids: list[str] | DataFrame | None = None, newest: int | None = None) -> DataFrame:
        """Rows of the pages table: of given ids (a few literals, or a frame of page_id), or the newest ones."""
        rows = self.read("pages", columns=("page_id", "updated"))
        if isinstance(ids, DataFrame):
            rows = rows.join(ids.select("page_id").distinct(), "page_id", "left_semi")
        elif ids is not None:
            rows = rows.where(F.col("page_id").isin(*ids))
        return rows if newest is None else rows.orderBy(F.desc("updated"), "page_id").limit(newest)

    def undo(self, version: str | None = None, mark: str = "sha256") -> tuple[DataFrame, DataFrame]:
        """(pages after undoing the step that made a version, (page_id, action)); by default the last step.

        Pages that head has changed since are left as they are and reported as conflicts.
        """
        target = version or self.current()
        parent = self.manifest(target).get("parent")
        if parent is None:
            raise ValueError(f"{target} has no version before it")
        old, new, head = self.read("pages", parent), self.read("pages", target), self.read("pages")
        actions = undo_diff(old, new, head, mark=mark)
        todo = actions.where("action in ('restore', 'remove')").select("page_id")
        back = actions.where("action = 'restore'").select("page_id")
        kept = head.join(todo, "page_id", "left_anti")
        return kept.unionByName(old.join(back, "page_id", "left_semi").select(head.columns)), actions

    def history(self) -> list[dict]:
        """Manifests, newest first."""
        out, at = [], self.current()
        while at:
            m = self.manifest(at)
            out.append({k: m.get(k) for k in ("version", "parent", "generated_at", "message")})
            at = m.get("parent")
        return out

    def restore(self, version: str) -> None:
        if not self.manifest(version):
            raise KeyError(version)
        self._write("CURRENT.json", {"version": version})

    def prune(self, keep: int) -> list[str]:
        """Removes versions that are not among the newest and that no kept manifest refers to."""
        kept = [h["version"] for h in self.history()[:keep]]
        used = {t["path"].split("/")[0] for v in kept for t in self.manifest(v)["tables"].values()} | set(kept)
        gone = [h["version"] for h in self.history()[keep:] if h["version"] not in used]
        for v in gone:
            self.files.remove(v, True)
        return gone
