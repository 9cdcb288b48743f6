"""The reference behaviours on small corpora."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import links as L
from folioscope.functions import text as T
from folioscope.operators import audits as U
from folioscope.operators import graph as G
from folioscope.operators import migrate as M
from folioscope.operators import pages as P
from folioscope.operators import rank as R
from folioscope.operators import recent as C
from folioscope.operators import rules as Q
from folioscope.operators import scan as S
from folioscope.operators import store as D
from folioscope.plans.engine import Engine, window_end, window_start
from folioscope.sources import files as X


def page(title, *body, **fm):
    head = "".join(f"{k}: {v}\n" for k, v in {"title": title, **fm}.items())
    return f"---\n{head}---\n# {title}\n\n" + "\n".join(body) + "\n"


def frame(spark, pages):
    return spark.createDataFrame(list(pages.items()), "page_id string, body string")


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


LINKED = {
    "wiki/index.md": page("Index", "## Concepts", "- [A](/concepts/A.md)", "- [B](/concepts/B.md)", "- [C](/concepts/C.md)"),
    "wiki/concepts/A.md": page("A", "See [B](/concepts/B.md).", type="concept"),
    "wiki/concepts/B.md": page("B", "nothing"),
    "wiki/concepts/C.md": page("C", "nothing"),
}


def edges_of(spark, pages):
    return G.knowledge_graph(P.parse_pages(frame(spark, pages)))


def test_moved_link_updates_both_sides_only(spark):
    before = edges_of(spark, LINKED)
    moved = LINKED | {"wiki/concepts/A.md": page("A", "See [C](/concepts/C.md).", type="concept")}
    full = {(r.s, r.t) for r in edges_of(spark, moved).collect()}
    changed = spark.createDataFrame([("wiki/concepts/A.md",)], "page_id string")
    fresh = edges_of(spark, moved).where("s = 'wiki/concepts/A.md'")
    after, touched = D.ego_delta(before, changed, fresh)
    assert {(r.s, r.t) for r in after.collect()} == full
    assert {r.page_id for r in touched.collect()} == {f"wiki/concepts/{x}.md" for x in "ABC"}
    ego = {r.page_id: r.ego for r in G.ego_rows(after).collect()}
    assert [x["from"] for x in ego["wiki/concepts/C.md"]["in"]] == ["wiki/concepts/A.md", "wiki/index.md"]
    assert [x["from"] for x in ego["wiki/concepts/B.md"]["in"]] == ["wiki/index.md"]


def test_block_lists_and_lineage(spark):
    body = "---\ntitle: S\ntype: summary\nsources:\n  - raw/a.md\nsource_urls:\n  - https://e.org/x\n  - ftp://no\ntags:\n  - one\n  - two\n---\n# S\n"
    p = P.parse_pages(frame(spark, {"wiki/summaries/s.md": body}))
    row = p.first()
    assert (row.tags, row.source_urls, row.kind) == (["one", "two"], ["https://e.org/x"], "summary")
    raw = spark.createDataFrame([("raw/a.md",)], "path string")
    got = [(r.s, r.t, r.k, r.w, r.d) for r in G.lineage(p, raw).collect()]
    assert got == [("raw/a.md", "wiki/summaries/s.md", "ingested_as", 1, 1.0)]


def test_unlogged_commit_is_recovered(spark):
    commits = spark.createDataFrame(
        [("a" * 40, datetime(2024, 1, 30, 9, 5), "notes", ["raw/x.md", "wiki/summaries/日本.md"]), ("b" * 40, datetime(2024, 1, 30), "logged", ["wiki/a.md", "log/20240130.md"])],
        X.COMMITS,
    )
    got = C.recent_entries(C.git_fallback(commits), F.lit("2024-01-31").cast("date")).collect()
    assert [(r.op, r.touched, r.bucket, r.time) for r in got] == [("ingest", ["wiki/summaries/日本.md"], "r0", "09:05")]


def test_log_entries(spark):
    text = "# 2024-01-30\n\n## [10:05] ingest | First: thing\n- [A](/concepts/A.md) and `wiki/b c.md`\n\nnot ## [x]\n## [11:00] lint | Second\n"
    got = C.log_entries(spark.createDataFrame([("log/20240130.md", text)], "path string, body string")).orderBy("time").collect()
    assert [(r.entry_id, r.op, r.title, r.touched) for r in got] == [
        ("log-entry:20240130-10-05-ingest-first-thing", "ingest", "First: thing", ["wiki/b c.md", "wiki/concepts/A.md"]),
        ("log-entry:20240130-11-00-lint-second", "lint", "Second", []),
    ]
    assert got[0].date == date(2024, 1, 30)
    bad = spark.createDataFrame([("log/2024.md", "x"), ("log/20240101.md", "# 2024-01-02\n"), ("log/20240102.md", "# 2024-01-02\n")], "path string, body string")
    assert {r.page_id for r in Q.log_shape(bad).collect()} == {"log/2024.md", "log/20240101.md"}


def test_normalised_graph_hides_and_clamps(spark):
    nodes = spark.createDataFrame([("a", "page"), ("b", "page"), ("h", "hidden"), (None, "page")], "id string, kind string")
    edges = spark.createDataFrame([("a", "b", "k", 2, 0.8), ("a", "h", "k", 1, 1.0), ("a", "a", "k", 1, 1.0), ("b", "a", "k", 0, 7.0)], "s string, t string, k string, w long, d double")
    got = {(r.s, r.t): (r.w, r.d) for r in G.normalise_edges(nodes, edges, ("hidden",)).collect()}
    assert got == {("a", "b"): (2, 0.8), ("b", "a"): (1, 1.0)}


def test_resolution_of_links(spark):
    assert one(spark, "/a/../b c.md", L.target_of) == "wiki/b c.md"
    assert one(spark, "/../../x.md", L.target_of) is None
    assert one(spark, "../x.md", L.target_of) is None
    assert one(spark, "raw/x.md", L.target_of) == "raw/x.md"
    assert one(spark, "x.md", L.target_of) is None
    assert one(spark, "x.md", lambda c: L.target_of(c, True)) == "wiki/x.md"
    assert one(spark, "x.md", L.suggestion) == "wiki/x.md"
    text = "[a](/b.md) ![i](/i.md) [c](<d e.md#f>) [x](https://e.org/z.md) [y](no.txt) [s](t u.md) `/etc/x.md` https://e.org/w.md"
    assert one(spark, text, L.hrefs) == ["/b.md", "/i.md", "d e.md"]
    assert one(spark, text, L.malformed) == ["t u.md"]
    assert "/etc/x.md" in one(spark, text, L.absolute_paths)
    assert one(spark, "[a](wiki/x.md) [b](</y.md>)", L.rewrite_anchored) == "[a](/x.md) [b](</y.md>)"


def test_text_functions(spark):
    assert one(spark, "The C++ and a.b of Foo-bar x", T.tokens) == ["c++", "a.b", "foo-bar"]
    assert sorted(one(spark, "数据库 字", T.tokens)) == sorted(["数据库", "数据库", "数据", "据库", "字"])
    assert one(spark, "Hello, World!", T.slug) == "hello-world"
    assert one(spark, "One two three four five six", T.audit_slug) == "one-two-three-four-five"
    assert one(spark, "abcde", T.token_estimate) == 2 and one(spark, " \n", T.token_estimate) == 0
    assert one(spark, "2024-02-30", T.dateish) is None
    assert one(spark, "20240229", T.dateish) == datetime(2024, 2, 29)
    assert one(spark, "2024-01-02T03:04:05+02:00", T.dateish) == datetime(2024, 1, 2, 1, 4, 5)
    assert one(spark, "![i](x) [l](<y z>) t", T.strip_links) == "i l t"
    fm = one(spark, "---\na: \"x\\\"y\"\nb: [1, 'two', ]\nc:\n  - p\n  - q\nd: 7\n---\n", lambda c: T.front_map(T.front_block(c)))
    assert fm == {"a": ['x"y'], "b": ["1", "two"], "c": ["p", "q"], "d": ["7"]}


def chunked(spark, body, **kw):
    return P.chunks(frame(spark, {"wiki/p.md": body}), **kw).orderBy("ordinal").collect()


def test_chunks(spark):
    got = chunked(spark, "---\ntitle: t\n---\nintro\n# A\ntext\n```\n# no\n```\n## B\n\n### C\nc\n# D\n")
    assert [(r.heading_path, r.start_line, r.end_line) for r in got] == [("", 4, 4), ("A", 5, 9), ("A / B", 10, 10), ("A / B / C", 12, 13), ("D", 14, 14)]
    assert [r.token_count for r in chunked(spark, "")] == [0] and chunked(spark, "")[0].end_line == 1
    unclosed = chunked(spark, "# A\n```\n# no\n## no\n")
    assert len(unclosed) == 1
    parts = chunked(spark, "# A\n\n" + "\n\n".join("w" * 50 for _ in range(5)), max_tokens=30)
    assert len(parts) == 3 and all(len(r.body) <= 120 for r in parts) and [r.ordinal for r in parts] == [0, 1, 2]


def test_khop_proximity_and_rounds(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "e"), ("x", "y")]
    edges = spark.createDataFrame([(s, t, "k", 1, 1.0) for s, t in pairs], "s string, t string, k string, w long, d double")
    seeds = spark.createDataFrame([("a",)], "page_id string")
    near = {r.page_id: r.dist for r in G.khop(edges, seeds, 2).collect()}
    assert near == {"a": 0, "b": 1, "d": 1, "c": 2}
    rel = {r.page_id: r.rel for r in G.proximity(G.khop(edges, seeds, 2)).collect()}
    assert rel["a"] == 1.25 and rel["c"] == pytest.approx(1 / 2.35)
    none = seeds.limit(0)
    pages, new = S.scan_round(edges, seeds, none)
    assert {r.page_id for r in pages.collect()} == {"a", "b", "d"} and {(r.a, r.b) for r in new.collect()} == {("a", "b"), ("a", "d")}
    met = spark.createDataFrame([("a",), ("b",)], "page_id string")
    pages, new = S.scan_round(edges, seeds, met)
    assert {(r.a, r.b) for r in new.collect()} == {("a", "d")}
    found = {r.page_id: r["round"] for r in S.fixpoint(edges, seeds).collect()}
    assert found.keys() == {"a", "b", "c", "d", "e"} and found["a"] == 0


def test_claims_markers_and_conflicts(spark):
    body = page("P", "Model X supports 8k tokens.", "```", "Model X supports 9k tokens.", "```", "Model X support 16k tokens", "This is outdated.")
    p = frame(spark, {"wiki/p.md": body})
    got = [(r.subject, r.predicate, r.kind, r.value) for r in Q.numeric_claims(p).collect()]
    assert got == [("model x", "supports", "tokens", "8k"), ("model x", "supports", "tokens", "16k")]
    assert Q.claim_conflicts(Q.numeric_claims(p)).first()["values"] == ["16k", "8k"]
    assert [r.subject for r in Q.markers(p).collect()] == ["outdated"]


def test_audits(spark):
    text = "---\nid: 20240101-101010-ab12\ntarget: wiki/a.md\ntype: warn\nstart: [1, 2]\nend: [3, 4]\nauthor: x\nsource: cli\ncreated: 2024-01-01T10:10:10Z\nstatus: open\n---\n# Comment\n\nlooks wrong\n\n# Resolution\n\nDeferred for now\n"
    old = "---\nid: 20240102-101010-ab13\ntarget: wiki/b.md\nseverity: info\ntarget_lines: [2, 3]\nauthor: x\nsource: web-viewer\ncreated: 2024-01-30\nstatus: open\n---\n# Comment\nfine\n"
    files = spark.createDataFrame([("audit/a.md", text, "open"), ("audit/b.md", old, "open")], "path string, body string, mode string")
    rows = U.from_files(files)
    got = {r.id: r for r in U.scored(rows, F.lit("2024-01-31")).collect()}
    first, second = got["20240101-101010-ab12"], got["20240102-101010-ab13"]
    assert (first.decision, first.priority, first.anchor_key) == ("deferred", 35 + 25 + 20 + 15 + 15, "wiki/a.md#L1C2-L3C4")
    assert (second.type, list(second.start), second.priority) == ("info", [2, 1], 5 + 15)
    assert U.problems(rows).collect() == []
    side = spark.createDataFrame([("wiki/a.md.audit", '[{"id": "x", "target": "wiki/a.md"}]'), ("wiki/b.md.audit", '{"id": "y", "start": [0, 1]}')], "path string, body string")
    bad = {(r.id, r.problem) for r in U.problems(U.from_sidecars(side)).collect()}
    assert ("x", "missing author") in bad and ("y", "invalid start") in bad and ("x", "invalid id") in bad
    assert U.resolve(rows, first.id, "done").where("mode = 'resolved'").first().decision == "accepted"
    again = U.from_files(U.serialise(rows).withColumn("mode", F.lit("open")))
    assert {(r.id, r.target, r.comment) for r in again.collect()} == {(r.id, r.target, r.comment) for r in rows.collect()}
    with pytest.raises(ValueError):
        U.create("a", "cli", "../x.md", "warn", (1, 1), (1, 2), "", datetime(2024, 1, 1), "ab12")


def test_anchors_move_with_their_text(spark):
    text = "one\ntwo words\nthree\ntwo words\n"
    df = spark.createDataFrame([(text,)], "t string").withColumn("a", U.compute_anchor(F.col("t"), F.lit(4), F.lit(13)))
    places = lambda new: df.select(U.resolve_anchor(F.lit(new), F.col("a")).alias("r")).first()["r"]
    assert tuple(places(text)) == (4, "lines")
    assert tuple(places("zero\nmore\n\n" + text.replace("three\ntwo words\n", ""))) == (15, "text")
    assert tuple(places("zero\n\n\n\n" + text)) == (12, "context")
    assert places("gone") is None


def test_seed_ladder(spark):
    p = P.parse_pages(frame(spark, LINKED))
    got = {r.seed: r.page_id for r in R.resolve_seeds(p, ["concepts/B.md", "a", "conc", "zz"]).collect()}
    assert got == {"concepts/B.md": "wiki/concepts/B.md", "a": "wiki/concepts/A.md", "conc": "wiki/concepts/A.md"}


def test_migrations(spark):
    p = frame(spark, LINKED | {"wiki/x/A.md": "# no type\n[[concepts/B|bee]] [[A]] [[C#Some Part]]\n"})
    got = {r.page_id: r.body for r in M.migrate_wikilinks(p, p).collect()}
    assert got["wiki/x/A.md"] == "# no type\n[bee](/concepts/B.md) [[A]] [C](/concepts/C.md#some-part)\n"
    typed = {r.page_id: r for r in M.backfill_type(p).collect()}
    assert typed["wiki/concepts/B.md"].body.startswith("---\ntype: concept\ntitle: B\n") and not typed["wiki/concepts/A.md"].added
    assert typed["wiki/x/A.md"].body.startswith("---\ntype: page\n---\n# no type")
    assert M.page_lookup(p, "/concepts/A").first().page_id == "wiki/concepts/A.md"
    assert M.page_lookup(p, "../etc/passwd").collect() == []


def test_store_versions(spark, tmp_path):
    store = D.Store(spark, str(tmp_path / "s"))
    p1, p2 = frame(spark, LINKED), frame(spark, LINKED | {"wiki/n.md": "x"})
    one_ = store.publish({"pages": p1}, "t1")
    assert store.publish({"pages": p1}, "t2") != one_ and store.manifest()["tables"]["pages"]["path"].startswith(one_)
    two = store.publish({"pages": p2}, "t3")
    store.publish({"pages": p1.limit(0)}, "t4", clean=False)
    assert store.current() == two and store.read("pages").count() == 5
    store.restore(one_)
    assert store.read("pages").count() == 4
    merged = D.upsert(p1, frame(spark, {"wiki/concepts/A.md": ""}), frame(spark, {"wiki/concepts/A.md": "new"}))
    assert {r.page_id: r.body for r in merged.collect()}["wiki/concepts/A.md"] == "new"


def test_engine_on_a_folder(spark, tmp_path):
    for k, v in (LINKED | {"log/20240130.md": "# 2024-01-30\n\n## [10:00] ingest | x\n[A](/concepts/A.md)\n", "raw/r.md": "r", "wiki/with space.md": "s", "INTEREST.md": "## Downrank\n- nothing\n"}).items():
        f = tmp_path / k
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(v)
    e = Engine.from_path(spark, str(tmp_path))
    assert {r.page_id for r in e.pages.collect()} == {*LINKED, "wiki/with space.md"}
    hits = e.query("nothing", now=datetime(2024, 2, 1)).collect()
    assert {r.page_id for r in hits} >= {"wiki/concepts/B.md", "wiki/concepts/C.md"} and hits[0].reasons
    assert e.query(related=["A"], depth=1).first().page_id == "wiki/concepts/A.md"
    assert {r.rule for r in e.check().collect()} >= {"orphan", "missing_index"}
    assert e.view("recent", anchor="2024-01-31").count() == 1 and e.view("navigation").count() == 4
    assert X.stat_scan(spark, str(tmp_path)).count() == 8 and X.raw_scan(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        e.evolve("t", "s", ["wiki/none.md"], "2024-01-01")
    assert e.evolve("T", "s", ["wiki/with space.md"], "2024-01-01")["links"].first()["link"].endswith("(</with space.md>)")
    with pytest.raises(ValueError):
        X.json_artifact(spark, str(tmp_path), "../x")


def test_changes_and_windows(spark):
    text = b"R  new.md\0old.md\0 M wiki/a.md\0?? wiki/n.md\0 D wiki/d.md\0"
    assert X.parse_porcelain(text) == [("new.md", "old.md", "rename"), ("wiki/a.md", None, "update"), ("wiki/n.md", None, "insert"), ("wiki/d.md", None, "delete")]
    assert window_start("2w", datetime(2024, 1, 31)) == datetime(2024, 1, 17)
    assert window_end("2024-01-31").hour == 23 and window_end("2024-01-31T10:00").hour == 10


def test_streams(spark, tmp_path):
    from folioscope.streaming import ingest as I

    rows = [(datetime(2024, 1, 30, 10), "p", "ingest"), (datetime(2024, 1, 30, 11), "p", "ingest"), (datetime(2024, 1, 20), "q", "lint")]
    spark.createDataFrame(rows, "ts timestamp_ntz, page_id string, op string").write.parquet(f"{tmp_path}/ev")
    events = spark.readStream.schema("ts timestamp_ntz, page_id string, op string").parquet(f"{tmp_path}/ev")
    q = I.daily_counts(events).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.bucket, r.page_id): r.w for r in I.bucketed(spark.table("daily"), date(2024, 1, 31)).collect()}
    assert got == {("r0", "p"): 2, ("r3", "q"): 1}
    spark.createDataFrame([("a", "1", datetime(2024, 1, 1)), ("a", "2", datetime(2024, 1, 2))], "page_id string, body string, mtime timestamp").write.parquet(f"{tmp_path}/pg")
    seen = []
    pages = spark.readStream.schema("page_id string, body string, mtime timestamp").parquet(f"{tmp_path}/pg")
    I.index_stream(pages, lambda b, n: seen.extend(b.collect()), f"{tmp_path}/ck").start().awaitTermination()
    assert [(r.page_id, r.body) for r in seen] == [("a", "2")]
