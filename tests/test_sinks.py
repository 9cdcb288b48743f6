"""What is written: files, logs, profiles, sidecars, versions, reports; and what reads it again."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.operators import audits as U
from folioscope.operators import pages as P
from folioscope.operators import rank as R
from folioscope.operators import reports as E
from folioscope.operators import rules as Q
from folioscope.operators import store as D
from folioscope.plans.engine import Engine
from folioscope.sinks import textfiles as W
from folioscope.sources import files as X
from tests.test_engine import LINKED, frame

NOW = datetime(2024, 2, 1, 9, 30)


@pytest.fixture
def files(spark, tmp_path):
    return W.Files(spark, str(tmp_path))


def test_a_writer_that_dies_leaves_the_old_file(files, tmp_path, monkeypatch):
    assert files.write("a/x.json", "one") and not files.write("a/x.json", "one")
    with monkeypatch.context() as m:
        m.setattr(W.Files, "_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("dies before the rename")))
        with pytest.raises(RuntimeError):
            files.write("a/x.json", "two")
    assert files.read("a/x.json") == "one" and files.write("a/x.json", "two") and files.read("a/x.json") == "two"
    assert files.read("none") is None


def test_log_and_profile(files):
    name = W.append_log(files, NOW, "ingest", "first", ["wiki/a b.md"], ["Signals: 2"])
    W.append_log(files, NOW, "evolve", "second", [])
    text = files.read(name)
    assert name == "log/20240201.md" and text.startswith("# 2024-02-01\n\n## [09:30] ingest | first") and "(</a b.md>)" in text and text.count("# 2024-02-01\n") == 1
    assert W.log_checkpoint(files, NOW, "checkpoint", "t", ["wiki/a b.md", "wiki/c.md"], begun=True)
    assert not W.log_checkpoint(files, NOW, "checkpoint", "t", ["wiki/c.md"], begun=True)
    assert files.read(name).startswith(text.rstrip()) and files.read(name).count("/c.md") == 1 and files.read(name).count("## [") == 2
    assert W.log_checkpoint(files, NOW, "checkpoint", "t", ["wiki/c.md"], begun=False) and files.read(name).count("## [") == 3
    assert W.insert_bullets("# I\n\n## A\n- x\n\n## B\n- y\n", "a", ["new ", ""]) == "# I\n\n## A\n- x\n- new\n\n## B\n- y\n"
    assert W.insert_bullets("# I\n## B\n- y", "A", ["n"]) == "# I\n## B\n- y\n\n## A\n\n- n\n" and W.insert_bullets("t", "A", [" "]) == "t"


def test_scaffold_names_and_legacy(files):
    made = W.scaffold_files(files, "T", "2024-02-01")
    assert made == ["INTEREST.md", "log/20240201.md", "wiki/index.md"]
    with pytest.raises(FileExistsError):
        W.scaffold_files(files, "T", "2024-02-01")
    W.scaffold_files(files, "T", "2024-02-01", force=True)
    assert W.free_name(files, "wiki", "index") == "wiki/index-2.md"
    files.write("graph/x/a.agraph", "x"), files.write("wiki/b.agraph", "x"), files.write("raw/c.agraph", "x")
    assert W.remove_legacy(files) == 2 and W.remove_legacy(files) == 0 and files.exists("raw/c.agraph") and files.exists("wiki/index.md")


def test_sidecars_write_touched_parts_only(spark, tmp_path):
    rows = lambda ids, v: spark.createDataFrame([(f"p{k}", v) for k in ids], "page_id string, v string")
    none = spark.createDataFrame([], "page_id string")
    path = str(tmp_path / "side")
    W.write_sidecars(spark, path, rows(range(50), "a"), none, shards=16)
    mtime = {f: f.stat().st_mtime_ns for f in (tmp_path / "side").rglob("*.parquet")}
    n = W.write_sidecars(spark, path, rows([3, 99], "b"), rows([7], "")[["page_id"]], shards=16)
    got = {r.page_id: r.v for r in spark.read.parquet(path).collect()}
    assert got == {f"p{k}": "b" if k in (3, 99) else "a" for k in [*range(50), 99] if k != 7}
    assert n <= 3 and sum(f.exists() for f in mtime) > 5
    W.write_sidecars(spark, path, rows([], ""), rows(range(100), "")[["page_id"]], shards=16)
    assert not list((tmp_path / "side").glob("shard=*"))


def test_versions_are_undone_page_by_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Engine, "tables", lambda self, max_tokens=0: {"pages": self.parsed.drop("frontmatter")})
    store = D.Store(spark, str(tmp_path / "s"))
    e = lambda pages: Engine.from_frames(spark, frame(spark, pages))
    v = [e(p).build(store, f"t{k}") for k, p in enumerate([LINKED, LINKED | {"wiki/n.md": "# N\nnew"}, LINKED | {"wiki/n.md": "# N\nnew", "wiki/concepts/B.md": "# B\nedited"}])]
    assert {r.page_id: r.action for r in e(LINKED).undo(store, "t4", v[1]).collect()} == {"wiki/n.md": "remove"}
    now = {r.page_id: r.body for r in store.read("pages").collect()}
    assert "wiki/n.md" not in now and now["wiki/concepts/B.md"] == "# B\nedited"  # the later step stands
    head = store.current()
    e(LINKED | {"wiki/concepts/B.md": "# B\nedited again"}).build(store, "t5")
    assert {r.action for r in e(LINKED).undo(store, "t6", v[2]).collect()} == {"conflict"}
    assert {r.page_id: r.body for r in store.read("pages").collect()}["wiki/concepts/B.md"] == "# B\nedited again"
    assert e(LINKED).restore(store, head).count() == len(LINKED) and store.history()[0]["version"] == head
    with pytest.raises(ValueError):
        store.undo(v[0])
    with pytest.raises(KeyError):
        store.read("nothing")
    with pytest.raises(ValueError):
        store.read("pages", columns=("no_such",))
    assert [r.page_id for r in store.lookup(["wiki/concepts/A.md"]).collect()] == ["wiki/concepts/A.md"] and store.lookup(newest=2).count() == 2


def test_canonical_shards(spark, tmp_path):
    store = D.Store(spark, str(tmp_path / "s"))
    edges = spark.createDataFrame([(f"s{k:03}", "t", "k") for k in range(60)], "s string, t string, k string").repartition(5)
    store.publish({"edges": edges}, "t", shard_rows=10, ordered=True)
    parts = sorted((tmp_path / "s").glob("*/edges/*.parquet"))
    rows = [[r.s for r in spark.read.parquet(str(p)).collect()] for p in parts]
    assert all(len(r) <= 10 and r == sorted(r) for r in rows) and [x for r in rows for x in r] == [f"s{k:03}" for k in range(60)]


def test_an_engine_reads_a_fresh_index_only(spark, tmp_path):
    for k, v in LINKED.items():
        f = tmp_path / "c" / k
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(v)
    root, store = str(tmp_path / "c"), D.Store(spark, str(tmp_path / "s"))
    assert not Engine.from_store(spark, root, store).indexed
    e = Engine.from_path(spark, root)
    e.index(store, "t")
    again = Engine.from_store(spark, root, store)
    assert again.indexed
    ask = lambda x: [(r.page_id, round(r.score, 9)) for r in x.query("nothing", now=NOW).collect()]
    assert ask(again) == ask(e) and ask(e)
    (tmp_path / "c/wiki/concepts/new.md").write_text("# New\n")
    assert not Engine.from_store(spark, root, store).indexed


def test_candidates_fall_back_to_literal_text(spark):
    pages = frame(spark, {f"wiki/p{k}.md": f"# P{k}\n{'needle ' if k < 3 else ''}word 5%% off" for k in range(30)})
    parsed = P.parse_pages(pages).join(P.summaries(pages), "page_id")
    chunks = P.chunks(pages)
    postings = P.postings(chunks, parsed)
    found = lambda text, n: {r.page_id for r in R.candidates(postings, parsed, chunks, text, n).collect()}
    assert found("needle", 3) == {f"wiki/p{k}.md" for k in range(3)}
    assert found("needle 5%%", 4) == {f"wiki/p{k}.md" for k in range(30)}
    assert R.candidates(postings, parsed, chunks, "", 3) is None
    e = Engine.from_frames(spark, pages)
    assert [r.page_id for r in e.query("needle", now=NOW).collect()] == [f"wiki/p{k}.md" for k in range(3)] and e.query(limit=5).count() == 5


def test_check_counts_guards_frequent_and_feedback(spark, monkeypatch):
    monkeypatch.setitem(Q.GUARDS, "pages", (2, 3))
    pages = frame(spark, {f"wiki/p{k}.md": f"# P{k}\n[x](/gone.md)\n" for k in range(4)})
    record = U.create("a", "cli", "wiki/none.md", "warn", (1, 1), (1, 2), "hm", NOW, "ab12")
    audits = spark.createDataFrame([record], "id string, target string, type string, start array<int>, end array<int>, author string, source string, created timestamp, status string, mode string, comment string, resolution string, decision string, path string")
    issues = Engine.from_frames(spark, pages, audits=audits).check().collect()
    rules = {(r.rule, r.subject): r.counted for r in issues}
    assert rules["scale", "pages"] and rules["frequent_missing", "wiki/gone.md"] and rules["audit_shape", "target does not exist"] and rules["open_audit", record["id"]]


def test_sidecar_feedback_is_drained(spark, tmp_path):
    good = '{"id": "20240101-101010-ab1%d", "target": "wiki/a.md", "type": "warn", "start": [1, 2], "end": [1, 5], "author": "x", "source": "cli", "created": "2024-01-01T10:10:10Z", "status": "open", "comment": "c"}'
    for name, text in {"wiki/a.md": "# A\n", "wiki/a.md.audit": f"[{good % 1}, {good % 1}, {good % 2}]", "wiki/b.md.audit": f'[{good % 3}, {{"id": "bad"}}]'}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    e = Engine.from_path(spark, str(tmp_path))
    fate = e.drain().collect()
    assert sorted((r.id, r.problem) for r in fate if r.problem == "duplicate") == [("20240101-101010-ab11", "duplicate")]
    assert {p.name for p in (tmp_path / "audit").glob("*.md")} == {f"20240101-101010-ab1{k}.md" for k in (1, 2, 3)}
    assert not (tmp_path / "wiki/a.md.audit").exists() and (tmp_path / "wiki/b.md.audit").exists()
    again = Engine.from_path(spark, str(tmp_path))
    assert {r.id for r in again.audit_list().collect()} == {f"20240101-101010-ab1{k}" for k in (1, 2, 3)}
    assert {r.problem for r in again.drain().collect() if not r.kept} == {"duplicate"}
    review = again.audit_review().collect()
    assert [r.place for r in review] == [1, 2, 3] and review[0].comment == "c"


def test_reports(spark, tmp_path):
    e = Engine.from_frames(spark, frame(spark, LINKED))
    hits = e.query("nothing", now=NOW)
    paths = [r.line for r in e.report(hits, "paths").orderBy("pos").collect()]
    assert paths == [r.page_id for r in hits.collect()]
    text = E.report_text(e.report(hits))
    assert text.startswith("1. [") and f"({paths[0]})" in text and "why: " in text
    assert e.report(hits, "json").first().line.startswith("{")
    with pytest.raises(ValueError):
        e.report(hits, "xml")
    rows = [U.create("a", "cli", f"wiki/{k % 2}.md", "warn", (1, 1), (1, 2), "wrong", datetime(2024, 1, 1 + k), f"ab1{k}") for k in range(3)]
    audits = spark.createDataFrame(rows, "id string, target string, type string, start array<int>, end array<int>, author string, source string, created timestamp, status string, mode string, comment string, resolution string, decision string, path string")
    lines = E.report_text(Engine.from_frames(spark, frame(spark, LINKED), audits=audits).audit_report(NOW)).split("\n")
    assert lines[0] == "# Feedback register"
    assert lines.index("### [wiki/0.md](wiki/0.md)") < lines.index("### [wiki/1.md](wiki/1.md)") < lines.index("## Stale open records")
    assert sum(line.startswith("- `2024") for line in lines) == 3
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    report = E.scan_report(frame(spark, LINKED).select("page_id"), pairs, 1, 8)
    E.write_report(report, str(tmp_path / "r"))
    assert "- a — b" in E.report_text(report) and spark.read.text(str(tmp_path / "r")).count() == report.count()


def test_evolve_writes_note_profile_and_log(spark, tmp_path):
    for k, v in (LINKED | {"INTEREST.md": "# I\n\n## Downrank\n"}).items():
        f = tmp_path / k
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(v)
    e = Engine.from_path(spark, str(tmp_path))
    names = [e.write_evolved("A talk", "said", ["wiki/concepts/A.md"], NOW, [(1, "graphs", 2.0), (-1, "noise", 1.0)]) for _ in range(2)]
    assert names == ["discussions/2024-02-01-a-talk.md", "discussions/2024-02-01-a-talk-2.md"]
    terms = {(r.sign, r.token): r.weight for r in R.interest_terms(Engine.from_path(spark, str(tmp_path)).profile).collect()}
    assert terms[1, "graphs"] == 4.0 and terms[-1, "noise"] == 2.0
    assert (tmp_path / "log/20240201.md").read_text().count("evolve | A talk") == 2


def test_changes_of_three_sources(spark):
    rows = lambda *r: spark.createDataFrame(list(r), X.CHANGES)
    got = {r.page_id: (r.change, r.old_page_id) for r in X.union_changes([rows(("a", None, "insert"), ("b", "z", "rename"), ("c", None, "delete")), rows(("a", None, "delete"), ("b", None, "update")), rows(("c", None, "insert"))]).collect()}
    assert got == {"a": ("delete", None), "b": ("update", "z"), "c": ("insert", None)}


def test_tags_and_fresh_heads(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    assert X.head_of(str(tmp_path)) is None
    for k in range(3):
        (tmp_path / "wiki").mkdir(exist_ok=True)
        (tmp_path / f"wiki/{k}.md").write_text("x")
        run("add", "."), run("commit", "-qm", f"c{k}"), run("tag", f"ckpt/ingest/2024-01-0{k + 1}")
    run("tag", "other")
    assert [r.tag for r in X.tag_scan(spark, str(tmp_path)).collect()] == [f"ckpt/ingest/2024-01-0{k}" for k in (3, 2, 1)]
    head = X.head_of(str(tmp_path))
    assert head == X.tag_scan(spark, str(tmp_path)).first().hash
    (tmp_path / "wiki/0.md").write_text("y")
    assert X.head_of(str(tmp_path)) is None


def test_claims_in_any_case(spark):
    p = frame(spark, {"wiki/p.md": "the shared model has 8k tokens\nMODEL Supports 9 K tokens\n模型 支持 8k 上下文\nit reach 5k tokens"})
    got = [(r.subject, r.predicate, r.kind, r.value) for r in Q.numeric_claims(p).orderBy("line_no").collect()]
    assert got == [("the shared model", "has", "tokens", "8k"), ("model", "supports", "tokens", "9k"), ("模型", "supports", "context_window", "8k")]
    many = spark.range(5000).select(F.lit("s").alias("subject"), F.lit("has").alias("predicate"), F.lit("k").alias("kind"), (F.col("id") % 2).cast("string").alias("value"), F.format_string("p%04d", "id").alias("page_id"), F.lit(1).alias("line_no"), F.lit("x").alias("excerpt"))
    row = Q.claim_conflicts(many).first()
    assert row["values"] == ["0", "1"] and [[q.page_id for q in v.places] for v in row.evidence] == [["p0000", "p0002", "p0004"], ["p0001", "p0003", "p0005"]]


def test_command_line(spark, tmp_path):
    import io

    from folioscope.__main__ import main

    def run(*argv):
        out = io.StringIO()
        return main(list(argv), spark, out, NOW), out.getvalue().splitlines()

    root = str(tmp_path / "c")
    assert run("scaffold", root, "T")[0] == 0 and run("scaffold", root, "T")[0] == 2
    for k, v in LINKED.items():
        f = tmp_path / "c" / k
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(v)
    assert run("query", root, "nothing", "--format", "paths", "--rebuild-index", "--limit", "2") == (0, ["wiki/concepts/B.md", "wiki/concepts/C.md"])
    assert run("check", root, "--full")[0] == 0
    (tmp_path / "c/wiki/concepts/D.md").write_text("# D\n[x](/gone.md)\n")
    code, lines = run("check", root, "--full")
    assert code == 1 and "hard dead_link wiki/concepts/D.md:2 /gone.md" in lines and "soft orphan wiki/concepts/D.md: wiki/concepts/D.md" in lines
    assert run("history", root)[1][0].split()[1] == "2024-02-01T09:30:00"
    assert "- wiki/concepts/A.md" in run("scan", root, "--seed", "wiki/concepts/A.md")[1]
    assert run("undo", root)[0] == 2 and run("audit", root)[1][0] == "# Feedback register"
