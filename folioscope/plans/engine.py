"""The engine: one object over a corpus, whose methods are lazy DataFrames.

``Engine.from_path`` reads a folder, ``Engine.from_frames`` takes frames; both give the
same operations. Parsed pages and edges are each defined once, so queries that need
both share their scans and exchanges.
"""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.text import format_link
from folioscope.operators import audits as U
from folioscope.operators import graph as G
from folioscope.operators import migrate as M
from folioscope.operators import pages as P
from folioscope.operators import rank as R
from folioscope.operators import recent as C
from folioscope.operators import reports as E
from folioscope.operators import rules as Q
from folioscope.operators import scan as S
from folioscope.operators.store import Store, index_totals, stale_files
from folioscope.sinks.textfiles import Files, append_log, free_name, insert_into_profile
from folioscope.sources import files as X

#: Days of a window's unit.
UNITS = {"d": 1, "w": 7, "m": 30, "y": 365}


def clock() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def window_start(text: str, now: datetime) -> datetime:
    """Start of a window such as 3w, or the day that the text names."""
    found = re.fullmatch(r"(\d+)([dwmy])", text.strip().lower())
    return now - timedelta(days=int(found[1]) * UNITS[found[2]]) if found else datetime.fromisoformat(text.strip())


def window_end(text: str) -> datetime:
    """A time, or the last moment of a day."""
    out = datetime.fromisoformat(text.strip())
    return out + timedelta(days=1) - timedelta(microseconds=1) if len(text.strip()) <= 10 else out


class Engine:
    def __init__(self, spark: SparkSession, pages: DataFrame, files: DataFrame | None = None, logs: DataFrame | None = None, audits: DataFrame | None = None, profile: DataFrame | None = None, root: str | None = None):
        self.spark, self.pages, self.root = spark, pages, root
        self.files = files if files is not None else pages.select(F.col("page_id").alias("path"))
        self.logs = logs if logs is not None else spark.createDataFrame([], "path string, body string")
        self.audits, self.profile, self.indexed = audits, profile, False

    @classmethod
    def from_path(cls, spark: SparkSession, root: str) -> Engine:
        opened, resolved = X.audit_files(spark, root)
        audits = U.from_files(U.scan(opened, resolved))
        profile = X._files(spark, root, "INTEREST.md").select(F.lit("INTEREST.md").alias("page_id"), F.decode("content", "UTF-8").alias("body"))
        return cls(spark, X.scan_corpus(spark, root), X.stat_scan(spark, root, "*"), X.log_scan(spark, root), audits, profile, root)

    @classmethod
    def from_frames(cls, spark: SparkSession, pages: DataFrame, **frames: DataFrame) -> Engine:
        return cls(spark, pages, **frames)

    # --- derived tables ---

    @cached_property
    def parsed(self) -> DataFrame:
        return P.parse_pages(self.pages)

    @cached_property
    def edges(self) -> DataFrame:
        return G.knowledge_graph(self.parsed)

    # What a ranked query reads several times is written once for an engine (or read from
    # its index), so that the plan of a query does not hold the parsing many times over.

    @cached_property
    def summarised(self) -> DataFrame:
        return G.kept(self.parsed.drop("frontmatter").join(P.summaries(self.pages), "page_id"))

    @cached_property
    def held_edges(self) -> DataFrame:
        return G.kept(self.edges)

    @cached_property
    def chunk_rows(self) -> DataFrame:
        return G.kept(self.chunks())

    @cached_property
    def postings(self) -> DataFrame:
        return G.kept(P.postings(self.chunk_rows, self.summarised))

    @classmethod
    def from_store(cls, spark: SparkSession, root: str, store: Store) -> Engine:
        """An engine that reads the tables of an index instead of parsing again, if the index is fresh; else one over the folder.

        Fresh: the index was made at the commit that a clean working tree stands on, or
        every file has the size and time that the index knows.
        """
        out = cls.from_path(spark, root)
        manifest = store.manifest() if store.current() else {}
        if not manifest or not {"pages", "chunks", "postings", "edges", "files"} <= set(manifest["tables"]):
            return out
        head = X.head_of(root)
        if not (head and head == manifest.get("message", "").partition("@")[2]):
            if not stale_files(store.read("files"), out.stats()).isEmpty():
                return out
        out.indexed = True
        out.parsed, out.edges = store.read("pages", columns=("page_id", "title", "kind", "tags", "updated", "summary", "body")), store.read("edges")
        out.summarised, out.held_edges, out.chunk_rows, out.postings = out.parsed, out.edges, store.read("chunks"), store.read("postings")
        return out

    def stats(self) -> DataFrame:
        """(path, size_bytes, mtime) of the pages' files, without their content."""
        return X.stat_scan(self.spark, self.root).where("path like 'wiki/%'")

    def index(self, store: Store, stamp: str) -> str:
        """Builds the index with what tells later whether it is fresh: the files' sizes and times, and the commit of a clean tree."""
        tables = self.tables() | {"pages": self.summarised, "files": self.stats()}
        return store.publish(tables, stamp, f"index@{X.head_of(self.root) or ''}")

    def chunks(self, max_tokens: int = P.MAX_TOKENS) -> DataFrame:
        return P.chunks(self.pages, max_tokens)

    def tables(self, max_tokens: int = P.MAX_TOKENS) -> dict[str, DataFrame]:
        """What an index holds: pages, chunks, postings and links."""
        chunks = self.chunks(max_tokens)
        return {"pages": self.parsed.drop("frontmatter"), "chunks": chunks, "postings": P.postings(chunks, self.parsed), "edges": self.edges}

    def views(self) -> None:
        """Registers the tables for SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)

    # --- verbs ---

    def build(self, store: Store, stamp: str, max_tokens: int = P.MAX_TOKENS, message: str = "index") -> str:
        return store.publish(self.tables(max_tokens), stamp, message)

    def query(self, text: str = "", related: list[str] | None = None, depth: int = 1, since: str | None = None, until: str | None = None, recent: str | None = None, kinds: list[str] | None = None, tags: list[str] | None = None, limit: int = 12, sort: str = "relevance", include_index: bool = False, interest: bool = True, now: datetime | None = None) -> DataFrame:
        """Ranked pages with reasons. What is ranked are candidates: hits of the words and the interests, the neighbourhood of the seeds, or the newest pages where nothing is asked."""
        now = now or clock()
        start = recent or since
        pages = self.summarised
        seeds = G.kept(R.resolve_seeds(pages, related).select("page_id")) if related else None
        terms = G.kept(R.interest_terms(self.profile)) if interest and self.profile is not None else None
        among = R.candidates(self.postings, pages, self.chunk_rows, text, limit, terms)
        if among is not None:
            among = G.kept(among)
        elif seeds is not None:
            among = seeds
        else:
            pages = pages.join(R.browse_pool(pages.select("page_id", "updated"), limit).select("page_id"), "page_id", "left_semi")
        out = R.rank(
            pages, self.held_edges, text, seeds, depth, window_start(start, now) if start else None, window_end(until) if until else None,
            kinds, tags, terms, now, limit, sort, include_index, among,
        )
        return R.with_reasons(out)

    def report(self, ranked: DataFrame, form: str = "text", sort: str = "relevance") -> DataFrame:
        """A query's result as numbered lines of text, JSON or paths."""
        order = [F.lower("title")] if sort == "title" else [F.desc(c) for c in R.SORTS[sort]]
        return E.query_report(ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order, "page_id"))), form)  # of a result that a limit has bounded

    def check(self, full: bool = True, changes: DataFrame | None = None) -> DataFrame:
        """Issues of the whole corpus, or of changed pages only; the scale guard and open feedback block both."""
        pages, parsed = self.pages, self.parsed
        sizes = pages.select(F.col("page_id").alias("path"), F.octet_length("body").alias("size_bytes"))
        if not full and changes is not None:
            changed = changes.where("change != 'delete'").select("page_id").distinct()
            pages = pages.join(changed, "page_id", "left_semi")
            parsed = P.parse_pages(pages)
            found = [f(pages) for f in (Q.parent_paths, Q.bare_links, Q.malformed_links, Q.plain_bullets, Q.residual_wikilinks, Q.markers)]
            out = Q.dead_links(pages, self.files).unionByName(Q.dead_sources(parsed, self.files)).unionByName(Q.absolute_paths(pages, self.files)).unionByName(Q.deleted_pages(changes))
            for f in [*found, Q.over_limits(X.scoped_stats(sizes, changes))]:
                out = out.unionByName(f)
        else:
            out = Q.all_rules(pages, parsed, self.edges, self.files).unionByName(Q.log_shape(self.logs)).unionByName(Q.over_limits(sizes))
            if self.audits is not None:
                out = out.unionByName(Q.feedback_issues(self.audits, self.files))
        return out if self.audits is None else out.unionByName(Q.open_audits(self.audits))

    # --- versions ---

    def snapshot(self, store: Store, stamp: str, message: str = "checkpoint") -> str:
        """A version of the index that becomes the current one only if no issue counts."""
        clean = self.check().where("counted").isEmpty()
        return store.publish(self.tables(), stamp, message, clean)

    def undo(self, store: Store, stamp: str, version: str | None = None) -> DataFrame:
        """Undoes a version's step on top of the current one and publishes the outcome; (page_id, action). With a conflict nothing is published."""
        pages, actions = store.undo(version)
        actions = G.kept(actions.where("action != 'keep'"))
        if actions.where("action = 'conflict'").isEmpty() and not actions.where("action in ('restore', 'remove')").isEmpty():
            after = Engine.from_frames(self.spark, G.kept(pages.select("page_id", "body")))
            store.publish(after.tables(), stamp, f"undo {version or store.current()}")
        return actions

    def restore(self, store: Store, version: str) -> DataFrame:
        """Makes a version the current one; its pages."""
        store.restore(version)
        return store.read("pages")

    def totals(self, changes: DataFrame) -> DataFrame:
        return index_totals(self.tables(), changes)

    def scan(self, seeds: DataFrame, depth: int = 1, enqueued: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        met = enqueued if enqueued is not None else self.pages.select("page_id").limit(0)
        return S.scan_round(self.edges, seeds, met, depth)

    def audit_register(self, now: datetime, mode: str = "all", stale_days: int = U.STALE_DAYS) -> DataFrame:
        rows = self.audits if mode == "all" else self.audits.where(F.col("mode") == mode)
        return U.clusters(U.scored(rows, F.lit(now), stale_days)).orderBy(F.desc("priority"), F.desc("open_n"), F.desc("n"), "key")

    def audit_review(self, mode: str = "open") -> DataFrame:
        """(target, place, id, type, created, comment): every target's records, gravest first."""
        rows = self.audits if mode == "all" else self.audits.where(F.col("mode") == mode)
        return U.by_target(rows).join(rows.select("id", "comment"), "id").orderBy("target", "place")

    def audit_list(self, mode: str = "open", target: str | None = None) -> DataFrame:
        return U.listed(self.audits, mode, target)

    def audit_report(self, now: datetime, mode: str = "all", stale_days: int = U.STALE_DAYS) -> DataFrame:
        rows = self.audits if mode == "all" else self.audits.where(F.col("mode") == mode)
        priced = U.scored(rows, F.lit(now), stale_days)
        return E.register_report(U.clusters(priced), priced, mode, f"{now:%Y-%m-%dT%H:%M:%S}", stale_days)

    def drain(self) -> DataFrame:
        """Moves the feedback of sidecars into files of its own; (path, id, kept, problem). A sidecar with a record that is not valid stays."""
        files = Files(self.spark, self.root)
        sidecars = X.sidecar_files(self.spark, self.root)
        known = self.audits if self.audits is not None else U.from_files(U.scan(*X.audit_files(self.spark, self.root)))
        fresh, fate = U.drained(sidecars, known, self.files)
        fate, written = G.kept(fate), G.kept(U.serialise(fresh))
        for row in written.toLocalIterator():
            files.write(row["path"], row["body"])
        done = fate.groupBy("path").agg(F.max("kept").alias("kept")).where("not kept")
        for row in done.toLocalIterator():
            files.remove(row["path"])
        return fate

    def recent(self, anchor: str, commits: DataFrame | None = None) -> DataFrame:
        """Entries of the log, and of commits that left none, inside the window."""
        rows = C.log_entries(self.logs)
        if commits is not None:
            rows = rows.unionByName(C.git_fallback(commits))
        return C.recent_entries(rows, F.lit(anchor).cast("date"))

    def view(self, name: str, path: str | None = None, anchor: str | None = None) -> DataFrame:
        """Edges of a graph view."""
        recent = None
        if name == "recent":
            recent = C.recent_edges(self.recent(anchor), self.pages).select(F.col("bucket").alias("s"), F.col("page_id").alias("t"), F.lit("touched").alias("k"), "w", "d")
        raw = self.files.where("path like 'raw/%'").select("path")
        return G.graph_view(name, self.parsed, raw, path, recent)

    def page(self, path: str) -> DataFrame:
        return M.page_lookup(self.pages, path)

    def tree(self) -> DataFrame:
        return G.path_tree(self.pages.select(F.col("page_id").alias("path")))

    def canonicalise_links(self) -> DataFrame:
        return M.rewrite_links(self.pages)

    def evolve(self, title: str, summary: str, pages: list[str], day: str, interests: list[tuple[int, str, float]] = ()) -> dict[str, DataFrame]:
        """Rows to append: a discussion that rests on existing pages, and interest terms. Pages that do not exist are refused. ``write_evolved`` writes them."""
        wanted = self.spark.createDataFrame([(p,) for p in pages], "page_id string")
        missing = [r["page_id"] for r in wanted.join(self.pages.select("page_id"), "page_id", "left_anti").collect()]
        if missing or any(not p.endswith(".md") for p in pages):
            raise ValueError(f"no such pages: {missing or pages}")
        links = self.spark.createDataFrame([(title, p) for p in pages], "label string, page string").select(format_link(F.col("page"), F.concat(F.lit("/"), F.regexp_replace("page", r"\Awiki/", ""))).alias("link"))
        slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")[:80]
        note = self.spark.createDataFrame([(day, slug, title, summary)], "day string, slug string, title string, summary string")
        terms = self.spark.createDataFrame(list(interests), "sign int, token string, weight double")
        return {"discussions": M.unique_names(note, "slug", ["day"], "title"), "links": links, "interest": terms}

    def write_evolved(self, title: str, summary: str, pages: list[str], now: datetime, interests: list[tuple[int, str, float]] = ()) -> str:
        """Writes what ``evolve`` checks: the discussion under a free name, its signals in the profile, and an entry in the log. The note's name."""
        rows = self.evolve(title, summary, pages, f"{now:%Y-%m-%d}", interests)
        files = Files(self.spark, self.root)
        slug = rows["discussions"].first()["slug"]
        links = [f"- {r['link']}" for r in rows["links"].collect()]  # the few pages that the caller named
        name = free_name(files, "discussions", f"{now:%Y-%m-%d}-{slug}")
        files.write(name, f"---\ntitle: {json.dumps(title, ensure_ascii=False)}\ntype: discussion\ncreated: {now:%Y-%m-%d}\n---\n\n# {title}\n\n{summary.strip()}\n\n## Related pages\n\n" + "\n".join(links) + "\n")
        bullets = [f"{now:%Y-%m-%d} — {token} weight: {weight:g}" for sign, token, weight in interests if sign > 0]
        insert_into_profile(files, "INTEREST.md", "Discussion signals", bullets)
        insert_into_profile(files, "INTEREST.md", "Downrank", [f"{token} weight: {weight:g}" for sign, token, weight in interests if sign < 0])
        append_log(files, now, "evolve", title, pages, [f"Signals: {len(interests)}", f"Discussion: [{name.rsplit('/', 1)[-1]}]({name})"])
        return name
