"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stored


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long), the component being its smallest node.

    Alternates large-star and small-star steps, each of which moves every edge towards the
    smallest node around; the rounds grow with the logarithm of the graph, and each round's
    edges are written to the shared folder. Minima are taken per task before the shuffle, and
    the joins with them have one row per node on one side, so adaptive execution can split a
    hub's partition. Loops, repeated edges and edges with a null end are dropped.
    """
    edges = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = _fingerprint(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        nearest = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(nearest, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(least, "b")
        edges = stored(
            linked.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct())
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    star = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return star.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def forest(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> set[tuple[int, int]]:
    """Edges (smaller, larger id) that connect what a matrix of links between two lists of ids connects.

    At most one edge per row and column: each to the smallest id of its component. An id may
    stand in both lists, or several times in one.
    """
    top = np.iinfo(np.int64).max
    names, inverse = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    row, column = inverse[:len(rows)], inverse[len(rows):]
    label = names.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, row, np.where(links, label[column][None, :], top).min(1, initial=top))
        np.minimum.at(new, column, np.where(links, new[row][:, None], top).min(0, initial=top))
        if (new == label).all():
            return {(int(a), int(b)) for a, b in zip(label, names) if a != b}
        label = new
