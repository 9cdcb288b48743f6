"""Scanning rounds after a change: what is new around changed pages, until nothing is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import graph as G

MAX_ROUNDS = 8


def scan_scope(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    return G.khop(edges, seeds, depth)


def scan_round(edges: DataFrame, seeds: DataFrame, enqueued: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """New pages and new edges of a round.

    An edge is new if it touches a seed, unless its other end is no seed and was met
    in an earlier round. A page is new if it is a seed never met, or an end of a new
    edge. Both are empty exactly when the scan has converged.
    """
    scope = scan_scope(edges, seeds, depth)
    pairs = G.induced(edges, scope)
    seed = seeds.select("page_id").distinct()
    met = enqueued.select("page_id").distinct()
    flag = lambda df, c, name: df.select(F.col("page_id").alias(c), F.lit(True).alias(name))
    for c in ("a", "b"):
        pairs = pairs.join(flag(seed, c, f"{c}_seed"), c, "left").join(flag(met, c, f"{c}_met"), c, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    shielded = (~yes("a_seed") & yes("a_met")) | (~yes("b_seed") & yes("b_met"))
    new_edges = pairs.where((yes("a_seed") | yes("b_seed")) & ~shielded).select("a", "b")
    ends = new_edges.select(F.explode(F.array("a", "b")).alias("page_id"))
    new_pages = seed.join(met, "page_id", "left_anti").unionByName(ends).distinct()
    return new_pages, new_edges


def fixpoint(edges: DataFrame, seeds: DataFrame, depth: int = 1, max_rounds: int = MAX_ROUNDS, checkpoint=G.kept) -> DataFrame:
    """(page_id, round): each page with the round that first reads it.

    Every round's new pages are the next round's seeds. Each round is written and
    reread, so plans do not grow with the rounds.
    """
    edges = checkpoint(edges)
    met = edges.select(F.col("s").alias("page_id")).limit(0)
    found = None
    frontier = seeds.select("page_id").distinct()
    for n in range(max_rounds):
        pages, _ = scan_round(edges, frontier, met, depth)
        met_now = met.unionByName(frontier).distinct()
        fresh = pages if found is None else pages.join(found.select("page_id"), "page_id", "left_anti")
        fresh = checkpoint(fresh.withColumn("round", F.lit(n)))
        found = fresh if found is None else found.unionByName(fresh)
        met = checkpoint(met_now)
        frontier = checkpoint(fresh.select("page_id").join(met, "page_id", "left_anti"))
        if frontier.isEmpty():
            break
    return found


def change_seeds(changes: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """Changed pages that still exist; without any, those of the latest batch."""
    seeds = changes.where("change != 'delete' and page_id like 'wiki/%.md'").select("page_id").distinct()
    return batch.select("page_id") if batch is not None and seeds.isEmpty() else seeds
