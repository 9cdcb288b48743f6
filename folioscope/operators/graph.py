"""Typed link graphs: build, degrees, neighbourhoods, navigation, lineage, normalisation."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import links as L
from folioscope.functions import text as T
from folioscope.operators.pages import lines

EDGE = ["s", "t", "k"]


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, label, href, is_image), a row for each occurrence."""
    return pages.select("page_id", F.explode(L.link_parts(F.col("body"))).alias("l")).select("page_id", "l.*")


def links_with_lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, label, href): links never span lines, so each line is read alone, without a window."""
    rows = pages.select("page_id", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    return rows.select("page_id", (F.col("pos") + 1).alias("line_no"), F.explode(L.link_parts(F.col("text"))).alias("l")).select("page_id", "line_no", "l.label", "l.href")


def resolve_links(links: DataFrame, catalog: DataFrame, lenient: bool = False) -> DataFrame:
    """Adds ``target``: the page that an address means, null if there is none. An equi-join with the catalogue."""
    wanted = links.withColumn("_t", L.target_of(F.col("href"), lenient))
    ids = catalog.select(F.col("page_id").alias("target")).distinct()
    return wanted.join(ids, wanted["_t"] == ids["target"], "left").drop("_t")


def edges_of(resolved: DataFrame, kind: str = "links_to") -> DataFrame:
    """(s, t, k, w, d): occurrences as weight; no self loops."""
    rows = resolved.where(F.col("target").isNotNull() & (F.col("target") != F.col("page_id")))
    return rows.groupBy(F.col("page_id").alias("s"), F.col("target").alias("t")).agg(F.count("*").alias("w")).select("s", "t", F.lit(kind).alias("k"), "w", F.lit(1.0).alias("d"))


def merge_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*EDGE).agg(F.sum("w").alias("w"), F.max("d").alias("d"))


def knowledge_graph(parsed: DataFrame) -> DataFrame:
    """Edges ``links_to`` of body links and ``derived_from`` of sources, between pages."""
    body = edges_of(resolve_links(extract_links(parsed), parsed, lenient=True))
    sources = parsed.select("page_id", F.explode("sources").alias("href")).where(~F.col("href").rlike(L.EXTERNAL))
    derived = edges_of(resolve_links(sources, parsed, lenient=True), "derived_from")
    return body.unionByName(derived)


def degrees(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(page_id, inbound, outbound, degree) over distinct (neighbour, kind)."""
    once = edges.select(*EDGE).distinct()
    both = once.select(F.col("t").alias("page_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(once.select(F.col("s").alias("page_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = both.groupBy("page_id").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    out = catalog.select("page_id").join(counts, "page_id", "left").select("page_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("inbound", "outbound")])
    return out.withColumn("degree", F.col("inbound") + F.col("outbound"))


def reverse_links(edges: DataFrame) -> DataFrame:
    """(t, s): the sources of every page, a row each, so a hub of the corpus is no single row."""
    return edges.select("t", "s").distinct()


def ego(edges: DataFrame, center: str) -> DataFrame:
    """Edges of one page, each direction kept, once."""
    rows = edges.where((F.col("s") == center) | (F.col("t") == center)).select(*EDGE).distinct()
    return rows.withColumn("direction", F.when(F.col("s") == center, "out").otherwise("in"))


def ego_edges(edges: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(page_id, direction, other, kind, title, other_kind): the neighbours of every page, a row each.

    Names of the other end come from the catalogue (page_id, title, kind); one that is
    not there stands for itself: its id is its title and its kind is ``page``.
    """
    once = edges.select(*EDGE).distinct()
    rows = once.select(F.col("s").alias("page_id"), F.lit("out").alias("direction"), F.col("t").alias("other"), F.col("k").alias("kind"))
    rows = rows.unionByName(once.select(F.col("t").alias("page_id"), F.lit("in").alias("direction"), F.col("s").alias("other"), F.col("k").alias("kind")))
    if catalog is None:
        return rows
    names = catalog.select(F.col("page_id").alias("other"), F.col("title"), F.col("kind").alias("other_kind"))
    return rows.join(names, "other", "left").select("page_id", "direction", "other", "kind", F.coalesce("title", "other").alias("title"), F.coalesce("other_kind", F.lit("page")).alias("other_kind"))


def ego_rows(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(page_id, ego): the nested in and out lists of the asked pages, or of every page."""
    once = edges.select(*EDGE).distinct()
    if asked is not None:
        ids = asked.select("page_id").distinct()
        mine = lambda c: once.join(ids.withColumnRenamed("page_id", c), c, "left_semi")
        once = mine("s").unionByName(mine("t")).distinct()
    i = once.groupBy(F.col("t").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("from"), F.col("k").alias("kind")))).alias("in"))
    o = once.groupBy(F.col("s").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("to"), F.col("k").alias("kind")))).alias("out"))
    empty_i, empty_o = (F.array().cast(f"array<struct<{c}:string,kind:string>>") for c in ("from", "to"))
    out = i.join(o, "page_id", "full").select("page_id", F.struct(F.coalesce("in", empty_i).alias("in"), F.coalesce("out", empty_o).alias("out")).alias("ego"))
    return out if asked is None else out.join(ids, "page_id", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("s").alias("a"), F.col("t").alias("b")).unionByName(edges.select(F.col("t").alias("a"), F.col("s").alias("b"))).where("a != b").distinct()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where a session names none, a temporary one of this process, which only a local session can use."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_folioscope_graph", None)
        if not folder:
            warnings.warn("spark.checkpoint.dir is not set; a temporary local folder is used", stacklevel=2)
            folder = spark._folioscope_graph = tempfile.mkdtemp(prefix="folioscope-graph-")
    return folder.rstrip("/")


_written: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back; ``sweep`` removes it.

    A loop's plan then does not hold its input many times over, and a lost executor
    costs a reread.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/folioscope-graph/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Remove what ``kept`` has written in this process; call it when no result that rests on it is still to be read."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def khop(edges: DataFrame, seeds: DataFrame, depth: int, through: DataFrame | None = None) -> DataFrame:
    """(page_id, dist) within ``depth`` steps of the seeds, either way, each page once.

    A step joins the frontier with the edges and drops what was met before, so no page
    is expanded twice; frontiers after the first are written, so the plan stays a chain.
    ``through`` limits the pages that are expanded further.
    """
    steps = kept(undirected(edges)) if depth > 1 else undirected(edges)
    found = frontier = seeds.select("page_id", F.lit(0).alias("dist")).distinct()
    for n in range(depth):
        at = frontier if through is None else frontier.join(through.select("page_id"), "page_id", "left_semi")
        near = steps.join(at.select(F.col("page_id").alias("a")), "a", "left_semi").select(F.col("b").alias("page_id")).distinct()
        frontier = near.join(found.select("page_id"), "page_id", "left_anti").withColumn("dist", F.lit(n + 1))
        if n + 1 < depth:
            frontier = kept(frontier)
        found = found.unionByName(frontier)
    return found


def proximity(near: DataFrame) -> DataFrame:
    """(page_id, rel): 1.25 for seeds, else 1 / (distance + 0.35)."""
    return near.select("page_id", F.when(F.col("dist") == 0, 1.25).otherwise(1 / (F.col("dist") + 0.35)).alias("rel"))


def induced(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Undirected edges (a, b), a before b, with both ends in the scope."""
    pairs = undirected(edges).where("a < b")
    ids = scope.select("page_id")
    return pairs.join(ids.withColumnRenamed("page_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("page_id", "b"), "b", "left_semi").select("a", "b")


def navigation(pages: DataFrame, catalog: DataFrame, index_id: str = "wiki/index.md") -> DataFrame:
    """Edges ``contains`` from the index to its sections and ``listed_in`` from sections to the pages of their bullets."""
    index = pages.where(F.col("page_id") == index_id)
    root = f"nav:{index_id}"
    run = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("stripped", r"\A#{2,6}\s+(.+?)\s*\z", 1)
    rows = lines(index).withColumn("name", F.nullif(name, F.lit(""))).withColumn("under", F.last("name", True).over(run))
    node = F.when(F.col("under").isNull(), root).otherwise(F.concat(F.lit(f"{root}#"), T.slug(F.col("under"))))
    contains = rows.where("name is not null").select(F.lit(root).alias("s"), node.alias("t"), F.lit("contains").alias("k"))
    bullets = rows.where(F.col("text").rlike(r"\A\s*[-*]\s+")).select(node.alias("s"), F.explode(L.link_parts(F.col("text"))).alias("l")).where("not l.is_image").select("s", "l.href")
    listed = resolve_links(bullets, catalog, lenient=True).where("target is not null").select("s", F.col("target").alias("t"), F.lit("listed_in").alias("k"))
    return contains.unionByName(listed).distinct().select(*EDGE, F.lit(1).cast("long").alias("w"), F.lit(1.0).alias("d"))


def lineage(parsed: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Edges raw file ``ingested_as`` page, page ``derived_from`` page, summary page ``mentions`` page.

    A source that names a raw file is that; otherwise it may name a page.
    """
    refs = parsed.select("page_id", F.explode("sources").alias("href")).where(~F.col("href").rlike(L.EXTERNAL))
    refs = refs.withColumn("_raw", L.normal_path(F.col("href")))
    raw = raw_files.select(F.col("path").alias("raw")).distinct()
    refs = refs.join(raw, refs["_raw"] == raw["raw"], "left")
    pages = resolve_links(refs, parsed, lenient=True)
    ingested = pages.where("raw is not null").select(F.col("raw").alias("s"), F.col("page_id").alias("t"), F.lit("ingested_as").alias("k"))
    derived = pages.where("raw is null and target is not null").select(F.col("target").alias("s"), F.col("page_id").alias("t"), F.lit("derived_from").alias("k"))
    told = resolve_links(extract_links(parsed.where("kind = 'summary'")), parsed, lenient=True)
    mentions = told.where("target is not null and target != page_id").select(F.col("page_id").alias("s"), F.col("target").alias("t"), F.lit("mentions").alias("k"))
    return ingested.unionByName(derived).unionByName(mentions).distinct().select(*EDGE, F.lit(1).cast("long").alias("w"), F.lit(1.0).alias("d"))


def normalise_edges(nodes: DataFrame, edges: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Edges between shown nodes: no self loops, weight from 1, depth in [0, 1], the heaviest of equal edges."""
    shown = nodes.where(F.col("id").isNotNull() & (F.col("id") != "") & ~F.coalesce(F.col("kind"), F.lit("")).isin(*hidden, "\0")).select("id").distinct()
    good = edges.where("s is not null and t is not null and k is not null and s != t")
    good = good.join(shown.withColumnRenamed("id", "s"), "s", "left_semi").join(shown.withColumnRenamed("id", "t"), "t", "left_semi")
    good = good.select(*EDGE, F.greatest(F.coalesce("w", F.lit(1)), F.lit(1)).cast("long").alias("w"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("d", F.lit(1.0)))).alias("d"))
    return good.groupBy(*EDGE).agg(F.max("w").alias("w"), F.max("d").alias("d"))


def node_rows(parsed: DataFrame, edges: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Nodes with display names, breadcrumb and degrees."""
    meta = T.display_meta(F.col("page_id"), F.col("title"))
    rows = parsed.select("page_id", "title", "kind", "tags", "source_urls", meta.alias("m")).select("page_id", "title", "kind", "tags", "source_urls", "m.*")
    rows = rows.join(degrees(edges, parsed), "page_id")
    return rows if summaries is None else rows.join(summaries, "page_id", "left")


def search_nodes(nodes: DataFrame, needle: str, limit: int = 8) -> DataFrame:
    """Nodes whose names, id or tags hold the text, by degree."""
    text = F.lower(F.concat_ws("\n", "title", "qualified_name", "page_id", F.array_join("tags", "\n")))
    return nodes.where(text.contains(needle.lower())).orderBy(F.desc("degree"), "page_id").limit(limit)


def path_tree(paths: DataFrame) -> DataFrame:
    """(path, parent, name, depth, is_dir) of Markdown files and the folders above them; hidden parts left out."""
    ok = paths.where(F.col("path").endswith(".md") & ~F.col("path").rlike(r"(\A|/)\."))
    parts = F.split("path", "/")
    rows = ok.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("depth"), (n < F.size(parts)).alias("is_dir")))).alias("p")).select("p.*").distinct()
    name = F.substring_index("path", "/", -1)
    parent = F.when(F.col("depth") > 1, F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(name) - 1)).otherwise("")
    return rows.select("path", parent.alias("parent"), name.alias("name"), "depth", "is_dir")


def graph_view(view: str, parsed: DataFrame, raw_files: DataFrame | None = None, path: str | None = None, recent: DataFrame | None = None) -> DataFrame:
    """Edges of a named view: knowledge, navigation, lineage, local (of ``path``) or recent."""
    if view == "knowledge":
        return knowledge_graph(parsed)
    if view == "navigation":
        return navigation(parsed, parsed)
    if view == "lineage":
        return lineage(parsed, raw_files)
    if view == "local":
        return ego(knowledge_graph(parsed), path).drop("direction").withColumns({"w": F.lit(1).cast("long"), "d": F.lit(1.0)})
    if view == "recent":
        return recent
    raise ValueError(f"no such view: {view}")


#: What viewers of the graph are told: hidden kinds, views and their layout engines.
SETTINGS = {
    "hidden_kinds": ("query",),
    "default_view": "knowledge",
    "views": ("knowledge", "recent", "navigation", "lineage"),
    "engines": {"knowledge": "forceatlas2", "recent": "bipartite", "navigation": "tree", "lineage": "dag"},
}
#: Pull between a page's kind and those of its neighbours, in the order of the first row.
AFFINITY = (
    ("kind", "entity", "concept", "summary", "synthesis", "query", "index"),
    ("entity", 0.8, 1.2, 1.0, 1.0, 0.8, 0.8),
    ("concept", 1.2, 0.8, 1.0, 1.2, 1.0, 0.8),
    ("summary", 1.0, 1.0, 0.5, 1.0, 0.8, 0.6),
    ("synthesis", 1.0, 1.2, 1.0, 0.8, 1.0, 0.8),
    ("query", 0.8, 1.0, 0.8, 1.0, 0.5, 0.5),
    ("index", 0.8, 0.8, 0.6, 0.8, 0.5, 0.5),
)


def affinities(spark: SparkSession) -> DataFrame:
    """(kind, other, pull) of the settings."""
    rows = [(row[0], other, pull) for row in AFFINITY[1:] for other, pull in zip(AFFINITY[0][1:], row[1:], strict=True)]
    return spark.createDataFrame(rows, "kind string, other string, pull double")


def priority_labels(nodes: DataFrame) -> DataFrame:
    """(page_id) of the nodes whose label is always shown: the 14 % of most neighbours, 8 at least and 18 at most."""
    wanted = nodes.agg(F.greatest(F.lit(8), F.least(F.lit(18), F.ceil(F.count("*") * F.lit(14) / 100))).alias("n")).scalar()
    top = nodes.select("page_id", "degree").orderBy(F.desc("degree"), "page_id").limit(18)
    ranked = top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("degree"), "page_id")))  # of 18 rows
    return ranked.where(F.col("n") <= wanted).select("page_id")


def canonical(table: DataFrame) -> DataFrame:
    """Rows in the order in which artifacts are written: edges by their ends and kind, all else by the first column."""
    return table.orderBy(*(EDGE if set(EDGE) <= set(table.columns) else table.columns[:1]))
