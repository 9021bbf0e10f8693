"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, learned independently on the two halves of a bounded sample of unit vectors, form
a grid of cells; every vector lives in the cell of its nearest codewords. A vector visits the
cells of the grid in order of a lower bound on the distance to anything in them, merging the two
halves' sorted lists (multi-sequence traversal), until the bound passes a radius. The radius is
the one that reached the target recall for a sample of vectors compared with all others, every
vector with links counting alike and no cell of the grid supplying most of the sample; and at least
the one that reaches it where the differences of linked vectors point in random directions, so
that it does not rest on a few links. Whatever shares a visited cell is verified by its cosine.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.sizing import small_side
from .common import bounded_sample, broadcast_object, map_rows, record_batch, schema_of, ship, slices, stored
from .components import components, forest

COSINE = 0.93
TARGET_RECALL = 0.9999
# Vectors that train the codebooks (at least, and for each codeword), and vectors compared with all others for the radius.
TRAINING_VECTORS, TRAINING_PER_CODEWORD, CALIBRATION_VECTORS = 4096, 16, 1024
# Codewords of a half grow with the root of the number of vectors; the most are enough for 16 billion.
CODEWORDS_LEAST, CODEWORDS_MOST, VECTORS_PER_CELL = 8, 4096, 1000
# Sample vectors with links below which the radius misses none.
LINKED_LEAST = 16
TRAINING_ROUNDS = 8
# Vectors on either side of one comparison.
BLOCK = 2048
# Steps of the radius.
RADII = 100


@dataclass
class MultiIndex:
    """Codebooks of the halves; ``dimension`` is that of whole vectors."""

    dimension: int
    books: tuple[np.ndarray, np.ndarray]
    radius: float = 1.0

    def halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.dimension // 2
        return units[:, :cut], units[:, cut:]

    def bounds(self, units: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Per half the squared lower bounds to every codeword's region, and the home cells."""
        found, home = [], []
        for half, book in zip(self.halves(units), self.books):
            squares = (book * book).sum(1)
            d = np.maximum((half * half).sum(1)[:, None] - 2 * half @ book.T + squares[None, :], 0)
            near = d.argmin(1)
            own = book[near]
            gaps = np.sqrt(np.maximum(squares[near][:, None] - 2 * own @ book.T + squares[None, :], 1e-30))
            # A point nearer to codeword i lies beyond the plane halfway between i and the nearest one.
            low = (d - d[np.arange(len(d)), near][:, None]) / (2 * gaps)
            found.append(np.where(np.arange(len(book))[None, :] == near[:, None], 0, np.maximum(low, 0)) ** 2)
            home.append(near)
        return found, home[0] * len(self.books[1]) + home[1]


def visits(first: np.ndarray, second: np.ndarray, radius: float) -> list[int]:
    """Cells in order of the sum of two halves' bounds, up to ``radius``: a multi-sequence traversal."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap, out, n = [(x[0] + y[0], 0, 0)], [], len(b)
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > radius:
            break
        out.append(a[i] * n + b[j])
        if j + 1 < n:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return out


def unit(vector: list[float | None] | None) -> np.ndarray | None:
    """The vector at length 1, or None if it is null, empty, zero or holds null or non-finite numbers."""
    if not vector or None in vector:
        return None
    x = np.asarray(vector, dtype=np.float64)
    most = np.abs(x).max()
    if not np.isfinite(x).all() or most == 0:
        return None
    x = x / most
    return x / np.sqrt(x @ x)


def _units(vectors: DataFrame) -> DataFrame:
    def start():
        def row(vec_id, label, vector):
            u = unit(vector) if label is not None and vec_id is not None else None
            if u is None:
                return vec_id, label, None, None, None, None
            raw = np.asarray(vector, dtype=np.float64).tobytes()
            hi, lo = struct.unpack("<qq", hashlib.blake2b(raw, digest_size=16).digest())
            return vec_id, label, len(u), hi, lo, u.tobytes()

        return row

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return map_rows(rows, start, "vec_id long, label string, dimension int, hi long, lo long, unit binary")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)


def codebook(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """k-means on a bounded sample; fewer codewords if there are fewer points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    book = points[rng.choice(len(points), size=min(size, len(points)), replace=False)]
    for _ in range(TRAINING_ROUNDS):
        squares = (book * book).sum(1)[None, :]
        near = np.concatenate([(squares - 2 * points[at:at + 1024] @ book.T).argmin(1) for at in range(0, len(points), 1024)])
        book = np.stack([points[near == i].mean(0) if (near == i).any() else book[i] for i in range(len(book))])
    return np.unique(book, axis=0)


def build(classes: DataFrame, dimension: int, count: int) -> MultiIndex:
    """Codebooks from a sample of ``classes`` (vec_id, label, unit), whose size follows that of the codebooks."""
    size = int(np.clip((count / VECTORS_PER_CELL) ** 0.5, CODEWORDS_LEAST, CODEWORDS_MOST))
    most = max(TRAINING_VECTORS, TRAINING_PER_CODEWORD * size)
    sample = bounded_sample(classes.withColumn("all", F.lit(1)), "all", most, key=("vec_id", "label"))
    got = _matrix([bytes(r["unit"]) for r in sorted(sample.select("_pick", "unit").collect())])
    cut = dimension // 2
    return MultiIndex(dimension, (codebook(got[:, :cut], size, 1), codebook(got[:, cut:], size, 2)))


def _probes(index: MultiIndex, classes: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, ids, units) of at most CALIBRATION_VECTORS vectors, no more than two of one label's cell while others are left."""
    sample = bounded_sample(classes.withColumn("all", F.lit(1)), "all", 4 * CALIBRATION_VECTORS, key=("label", "vec_id"))
    got = sorted(sample.select("_pick", "label", "vec_id", "unit").collect())
    labels, ids, units = np.array([r["label"] for r in got]), np.array([r["vec_id"] for r in got]), _matrix([bytes(r["unit"]) for r in got])
    _, home = index.bounds(units)
    turn, seen = [], {}
    for place in zip(labels.tolist(), home.tolist()):
        seen[place] = seen.get(place, 0) + 1
        turn.append(seen[place])
    first = np.argsort(np.maximum(turn, 2), kind="stable")[:CALIBRATION_VECTORS]
    return labels[first], ids[first], units[first]


def calibrate(index: MultiIndex, classes: DataFrame, cosine: float, recall: float) -> MultiIndex:
    """Sets the radius at which sample vectors meet ``recall`` of their links among all vectors, on average over those with links.

    The sample has at most CALIBRATION_VECTORS vectors and is sent to every task, which answers
    with counts per vector and step of the radius. If the differences of linked vectors point
    anywhere, the squared part of one that crosses a cell's two planes is that of two out of
    ``dimension`` normal components; a radius for these is the least taken. With fewer than
    LINKED_LEAST linked vectors in the sample the radius is the one that misses none.
    """
    spark = classes.sparkSession
    # Unit vectors of that cosine are no farther apart than this, squared.
    most = 2 - 2 * cosine
    probes = _probes(index, classes)
    shared = broadcast_object(spark, (index, probes))
    schema = schema_of("probe int, step int, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (labels, ids, units) = pickle.loads(shared.value)
        (first, second), _ = own.bounds(units)
        counts = np.zeros((len(ids), RADII + 1), dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                rows = part.to_pydict()
                others = _matrix(rows["unit"])
                p, q = np.nonzero(units @ others.T >= cosine)
                same = (labels[p] == np.array(rows["label"])[q]) & (ids[p] != np.array(rows["vec_id"])[q])
                p, q = p[same], q[same]
                if not len(p):
                    continue
                _, home = own.bounds(others)
                need = first[p, home[q] // len(own.books[1])] + second[p, home[q] % len(own.books[1])]
                np.add.at(counts, (p, np.minimum(np.ceil(need / most * RADII), RADII).astype(int)), 1)
        yield record_batch([(int(p), int(i), int(counts[p, i])) for p, i in zip(*np.nonzero(counts))], arrow)

    counts = np.zeros((len(probes[1]), RADII + 1))
    found = classes.select("label", "vec_id", "unit").mapInArrow(run, schema)
    for r in found.groupBy("probe", "step").agg(F.sum("n").alias("n")).collect():
        counts[r["probe"], r["step"]] = r["n"]
    linked = counts[counts.sum(axis=1) > 0]
    share = 1.0
    if len(linked) >= LINKED_LEAST and recall < 1:
        met = (np.cumsum(linked, axis=1) / linked.sum(axis=1)[:, None]).mean(axis=0)
        # One step more than the sample needed.
        sampled = (int(np.argmax(met >= recall)) + 1) / RADII
        share = min(1.0, max(sampled, -2 * np.log(1 - recall) / index.dimension))
    index.radius = most * share * (1 + 1e-9)
    return index


def _placed(index: MultiIndex, classes: DataFrame) -> DataFrame:
    """Every vector with its home cell and the cells it visits."""
    shared = broadcast_object(classes.sparkSession, index)

    def start():
        own: MultiIndex = pickle.loads(shared.value)

        def row(vec_id, label, size, data):
            (first, second), home = own.bounds(np.frombuffer(data, dtype=np.float64)[None, :])
            return vec_id, label, size, data, int(home[0]), visits(first[0], second[0], own.radius)

        return row

    return map_rows(classes.select("vec_id", "label", "size", "unit"), start,
                    "vec_id long, label string, size long, unit binary, home int, cells array<int>")


def _compared(placed: DataFrame, cosine: float) -> DataFrame:
    """Per block of visitors and residents: (vec_id, links, edge): partial link counts, and a forest of the links."""
    residents = placed.select("label", F.col("home").alias("cell"), F.lit(True).alias("resident"), "vec_id", "size", "unit")
    visitors = placed.select("label", F.explode("cells").alias("cell"), F.lit(False).alias("resident"), "vec_id", "size", "unit")
    counts = placed.groupBy("label", F.col("home").alias("cell")).agg(F.count("*").alias("n_residents")).join(
        visitors.groupBy("label", "cell").agg(F.count("*").alias("n_visitors")), ["label", "cell"])
    # At most a row per label and cell; written, so that a hot cell's side of a shuffled join can be split.
    both = residents.unionAll(visitors).join(small_side(stored(counts)), ["label", "cell"])
    own_blocks = F.ceil(F.when(F.col("resident"), F.col("n_residents")).otherwise(F.col("n_visitors")) / BLOCK)
    other_blocks = F.ceil(F.when(F.col("resident"), F.col("n_visitors")).otherwise(F.col("n_residents")) / BLOCK)
    blocks = both.withColumn("own", F.pmod(F.xxhash64("vec_id"), own_blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), other_blocks - 1)))
    blocks = blocks.select(
        "label", "cell", F.when(F.col("resident"), F.col("own")).otherwise(F.col("other")).alias("resident_block"),
        F.when(F.col("resident"), F.col("other")).otherwise(F.col("own")).alias("visitor_block"), "resident", "vec_id", "size", "unit")
    result = schema_of("vec_id long, links long, edge long")
    arrow = to_arrow_schema(result)

    def run(table: pa.Table) -> pa.Table:
        resident = np.array(table.column("resident").to_pylist())
        ids, sizes = table.column("vec_id").to_numpy(), table.column("size").to_numpy()
        units = _matrix(table.column("unit").to_pylist())
        rows, columns = np.flatnonzero(~resident), np.flatnonzero(resident)
        if not len(rows) or not len(columns):
            return pa.Table.from_batches([], schema=arrow)
        links = (units[rows] @ units[columns].T >= cosine) & (ids[rows][:, None] != ids[columns][None, :])
        n = links @ sizes[columns]
        out = [(int(ids[r]), int(k), None) for r, k in zip(rows, n) if k]
        out += [(b, 0, a) for a, b in sorted(forest(links, ids[rows], ids[columns]))] if out else []
        return pa.Table.from_batches([record_batch(out, arrow)])

    return blocks.groupBy("label", "cell", "resident_block", "visitor_block").applyInArrow(run, result)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = TARGET_RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Vectors of equal label (of any type that has a text form) are linked from ``cosine`` on. n_links counts the other vectors linked
    directly; component_id is the smallest vec_id that links reach. A row without vec_id or label,
    or whose vector is null, empty, zero or holds null or non-finite numbers, is linked with
    nothing (0 links, its own component); vectors of different lengths are not linked. Equal
    vectors are one class: they count each other, and are compared once. Rows of the same
    vec_id, label and vector count as several vectors. Other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = stored(_units(vectors))
    key = ["label", "hi", "lo"]
    classes = stored(rows.where("unit IS NOT NULL").groupBy(*key, "dimension").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("size"), F.first("unit").alias("unit")))
    compared = None
    for r in sorted(classes.groupBy("dimension").count().collect()):
        own = classes.where(F.col("dimension") == r["dimension"])
        index = calibrate(build(own, r["dimension"], r["count"]), own, cosine, recall)
        part = _compared(stored(_placed(index, own)), cosine)
        compared = part if compared is None else compared.unionAll(part)
    if compared is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    compared = stored(compared)
    links = compared.where("links > 0").groupBy("vec_id").agg(F.sum("links").alias("links"))
    found = components(compared.where("edge IS NOT NULL").select(F.col("edge").alias("a"), F.col("vec_id").alias("b")))
    named = (
        classes.select(*key, "vec_id", "size").join(links, "vec_id", "left")
        .join(found, F.col("vec_id") == F.col("node"), "left")
        .select(*key, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
                F.coalesce("component", "vec_id").alias("component"))
    )
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", *key).join(named, key, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
