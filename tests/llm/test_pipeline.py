import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from folioscope.llm import queries as q
from tests.llm.fixtures import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark, tmp_path):
    base = [t for t in prose(61, 60, 200, 3000) if len(t.split()) > 70]
    item = " ".join(base[0].split()[:40]) + " benchmark only words in here"
    passage = " ".join(prose(62, 3, 200, 3000)[0].split()[:60] + [f"p{k}" for k in range(60)][:60])
    docs = {k: t for k, t in enumerate(base[:20])}
    docs[100] = docs[3]  # copy
    docs[101] = docs[4].replace(" ", "  ", 3)  # equal words
    docs[102] = " ".join(docs[5].split()[:-1])  # near copy
    docs[103] = "too short"
    docs[104] = "spam spam " * 60
    docs[105] = base[21] + " " + passage
    docs[106] = base[22] + " " + passage + " tail"
    docs[107] = base[23] + " " + " ".join(item.split()[20:]) + " and " + " ".join(item.split()[:20])
    docs[108] = None
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in docs.items()] + [(None, base[24], None, None, None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), docs, base


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for name, f in cp.STAGES:
        docs = f(spark, docs, path)
        rows = docs.collect()
        out.append((name, docs.columns, {r.doc_id: r for r in rows}))
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_every_stage_decides(spark, corpus):
    path, docs, base = corpus
    (_, c1, r1), (_, c2, r2), (_, c3, r3), (_, c4, r4), (_, c5, r5) = stages(spark, path)
    assert c1 == c2 == c3 == c4 == [x.split()[0] for x in COLUMNS.split(", ")]
    assert r1.keys() == docs.keys() - {103, 104, 108} | {None}
    assert r2.keys() == r1.keys() - {100, 101, 102}
    assert r3.keys() == r2.keys()
    assert r3[105].text == docs[105] and r3[106].text == base[22] + " tail" and r3[106].n_chars == len(r3[106].text)
    assert all(r3[k].text == docs[k] for k in r3 if k not in (None, 106)) and r3[None].text == base[24]
    assert r4.keys() == r3.keys() - {107, 0} or r4.keys() == r3.keys() - {107}
    assert r5.keys() == r4.keys() and all(len(r.ids) == r.n_tokens for r in r5.values())


def test_run_and_registration(spark, corpus):
    import __spark_entry__ as entry

    path, _, _ = corpus
    assert entry.queries()["pipeline"](spark, path).count() > 10
    assert {n.split("_")[0] for n in q.queries()} == {f"op{k}" for k in range(1, 11)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


CLASHING = ("n_words", "host_rate", "_words", "_host", "_carried", "_spans", "spans", "whole", "at", "uid", "pack", "kept", "component_id")


def test_extra_columns_with_inner_names_and_repeated_rows(spark, corpus, tmp_path):
    """Each stage but the last returns its columns whatever they are called; repeated rows are found by content."""
    path, docs, base = corpus
    rows = spark.read.parquet(f"{path}/documents.parquet")
    rows = rows.unionByName(rows.where("doc_id < 5")).select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHING)])
    names = rows.columns
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, path)
        assert out.columns == names, name
        held = out.collect()
        assert held and all(tuple(r[c] for c in CLASHING) == tuple(range(len(CLASHING))) for r in held), name
        rows = spark.createDataFrame(held, out.schema)
    kept = [r.doc_id for r in held]
    assert len(kept) == len(set(kept)) and {1, 2, 105, 106, None} <= set(kept)
    assert cp.STAGES[-1][1](spark, rows, path).count() == len(kept)
