"""The engine's verbs on a command line: ``python -m folioscope VERB ROOT ...``.

Exit codes: 0 done; 1 a check found issues that count; 2 a wrong request; 3 an undo met conflicts.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import reports as E
from folioscope.operators import scan as S
from folioscope.operators.graph import kept, sweep
from folioscope.operators.rank import SORTS
from folioscope.operators.store import Store
from folioscope.plans.engine import Engine, clock
from folioscope.sinks.textfiles import Files, remove_legacy, scaffold_files
from folioscope.sources import files as X

INDEX = ".index"  # below the root, unless another place is named


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("folioscope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = out.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str) -> argparse.ArgumentParser:
        one = verbs.add_parser(name, help=text)
        one.add_argument("root")
        one.add_argument("--index", help="folder of the index; by default below the root")
        return one

    q = verb("query", "pages ranked for a question")
    q.add_argument("text", nargs="?", default="")
    q.add_argument("--related", action="append")
    q.add_argument("--depth", type=int, default=1)
    for name in ("since", "until", "recent"):
        q.add_argument(f"--{name}")
    q.add_argument("--kind", action="append", dest="kinds")
    q.add_argument("--tag", action="append", dest="tags")
    q.add_argument("--limit", type=int, default=12)
    q.add_argument("--sort", choices=sorted(SORTS), default="relevance")
    q.add_argument("--format", choices=E.FORMS, default="text")
    for name in ("include-index", "rebuild-index", "no-index", "no-interest"):
        q.add_argument(f"--{name}", action="store_true")
    c = verb("check", "issues; of changed pages only unless --full")
    c.add_argument("--full", action="store_true")
    i = verb("index", "build the index")
    i.add_argument("--max-tokens", type=int, default=3000)
    s = verb("scan", "what a round asks for around changed pages")
    s.add_argument("--seed", action="append")
    s.add_argument("--depth", type=int, default=1)
    a = verb("audit", "the register of feedback, or with --review the records of each target")
    a.add_argument("--mode", choices=("open", "resolved", "all"), default="all")
    a.add_argument("--stale-days", type=int, default=14)
    a.add_argument("--review", action="store_true")
    verb("drain", "file the feedback of sidecars")
    verb("history", "versions of the index, newest first")
    u = verb("undo", "undo a version's step")
    u.add_argument("version", nargs="?")
    r = verb("restore", "make a version the current one")
    r.add_argument("version")
    p = verb("prune", "remove old versions")
    p.add_argument("keep", type=int)
    n = verb("scaffold", "the first files of a corpus")
    n.add_argument("title")
    n.add_argument("--force", action="store_true")
    verb("clean", "remove artifacts of an earlier format")
    return out


def _printed(report: DataFrame, out) -> None:
    for row in report.orderBy("pos").toLocalIterator():
        print(row["line"], file=out)


def main(argv: list[str], spark: SparkSession | None = None, out=None, now: datetime | None = None) -> int:
    args = parser().parse_args(argv)
    out, now = out or sys.stdout, now or clock()
    spark = spark or SparkSession.builder.appName("folioscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.index or f"{args.root.rstrip('/')}/{INDEX}")
    stamp = f"{now:%Y-%m-%dT%H:%M:%S}"
    try:
        return _run(args, spark, store, stamp, now, out)
    except (ValueError, KeyError, FileExistsError) as error:
        print(f"refused: {error}", file=sys.stderr)
        return 2
    finally:
        sweep(spark)


def _run(args: argparse.Namespace, spark: SparkSession, store: Store, stamp: str, now: datetime, out) -> int:
    if args.verb == "scaffold":
        print("\n".join(scaffold_files(Files(spark, args.root), args.title, f"{now:%Y-%m-%d}", args.force)), file=out)
        return 0
    if args.verb == "clean":
        print(remove_legacy(Files(spark, args.root)), file=out)
        return 0
    if args.verb == "history":
        for m in store.history():
            print(m["version"], m["generated_at"], m["message"], file=out)
        return 0
    if args.verb == "prune":
        print("\n".join(store.prune(args.keep)), file=out)
        return 0
    engine = Engine.from_path(spark, args.root)
    if args.verb == "query":
        if args.rebuild_index:
            engine.index(store, stamp)
        if not args.no_index:
            engine = Engine.from_store(spark, args.root, store)
        hits = engine.query(args.text, args.related, args.depth, args.since, args.until, args.recent, args.kinds, args.tags, args.limit, args.sort, args.include_index, not args.no_interest, now)
        _printed(engine.report(hits, args.format, args.sort), out)
    elif args.verb == "check":
        changes = None if args.full or X.head_of(args.root) else _changes(spark, args.root)
        issues = kept(engine.check(args.full or changes is None, changes))
        for row in issues.orderBy(F.desc("counted"), "rule", "page_id", "line_no", "subject").toLocalIterator():
            print(row["severity"], row["rule"], f"{row['page_id'] or '-'}:{row['line_no'] or ''}", row["subject"], *[f"(try {row['suggestion']})"] * bool(row["suggestion"]), file=out)
        return int(not issues.where("counted").isEmpty())
    elif args.verb == "index":
        print(engine.index(store, stamp), file=out)
    elif args.verb == "scan":
        changes = spark.createDataFrame([(p, None, "update") for p in args.seed], X.CHANGES) if args.seed else _changes(spark, args.root)
        seeds = kept(S.change_seeds(changes))
        pages, edges = engine.scan(seeds, args.depth)
        _printed(E.scan_report(kept(pages), kept(edges), 1, S.MAX_ROUNDS), out)
    elif args.verb == "audit" and args.review:
        for row in engine.audit_review(args.mode).toLocalIterator():
            print(row["target"], row["place"], row["type"], row["id"], row["comment"].replace("\n", " "), file=out)
    elif args.verb == "audit":
        _printed(engine.audit_report(now, args.mode, args.stale_days), out)
    elif args.verb == "drain":
        for row in engine.drain().toLocalIterator():
            print(row["path"], row["id"], row["problem"] or "filed", file=out)
    elif args.verb == "undo":
        actions = engine.undo(store, stamp, args.version)
        for row in actions.orderBy("page_id").toLocalIterator():
            print(row["action"], row["page_id"], file=out)
        return 0 if actions.where("action = 'conflict'").isEmpty() else 3
    elif args.verb == "restore":
        engine.restore(store, args.version)
        print(args.version, file=out)
    return 0


def _changes(spark: SparkSession, root: str) -> DataFrame:
    """What the working tree has changed; of a folder that is no repository, everything."""
    try:
        return X.working_changes(spark, root)
    except (OSError, X.subprocess.CalledProcessError):
        return X.scan_corpus(spark, root).select("page_id", F.lit(None).cast("string").alias("old_page_id"), F.lit("update").alias("change"))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
