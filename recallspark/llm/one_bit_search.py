"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is coded against the centroid of its cell: the residual, turned by a random rotation,
keeps one bit per dimension, its length, and the inner product between the turned unit residual
and its code. For a query, the packed bits (counted against four bit planes of the turned query)
estimate every inner product, and the correction scalars bound the error of the estimate. A block
of codes is searched so: estimates for all; the true products of the best estimates give a
threshold; every vector whose upper bound reaches it is multiplied with the query in double
precision. What the blocks find is merged by score.

Cells are centroids of k-means on a bounded sample; every vector is indexed. Queries visit the
cells in the order of what they promise, as many as it takes to find ``RECALL`` of the neighbours
of ``PROBES`` sample queries, measured against all vectors. Up to ``FEW_CELLS`` cells all are visited.
A cell is searched in blocks of ``BLOCK`` codes by shares of ``SHARE`` queries, so a hot cell is
many tasks. Equal vectors are one entry with their smallest ids, as many as a result could show.

Edge cases. Vectors that are null, empty, zero or hold null or non-finite components, and rows
without vec_id, take no part. Vectors meet only vectors of as many components. Repeated rows (same
id, same vector) are one row; one id on different vectors is several rows, each a query of its own
and a neighbour of the other. Ties go to the smaller vec_id. Fewer candidates than asked for: all
of them. Other columns are ignored. Without rows the result is empty.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sizing import small_side
from .common import broadcast_object, bounded_sample, ship, stored

NEIGHBOURS = 20
# Codes searched together, and queries that search them in one task; and bytes of the vectors of either.
BLOCK = 16_384
SHARE = 8_192
SIDE_BYTES = 16 << 20
# Cells: one for so many vectors; as many as so many at most, learned from so many vectors of each.
CELL = 16_384
CELLS_MOST = 16_384
FIT_PER_CELL = 16
FIT_LEAST = 4_096
FEW_CELLS = 4
# Queries that tell how many cells to visit, and the share of neighbours they must find.
PROBES = 256
RECALL = 0.995
# Standard deviations of the estimate's error that the bounds allow.
DEVIATIONS = 3.0
# Bit planes of a query, and estimates that set the threshold.
PLANES = 4
FIRST = 64
SEED = 2024


@dataclass
class Space:
    """Cells of the vectors of one dimension: numbers from ``base`` on."""

    base: int
    centroids: np.ndarray
    spread: np.ndarray

    def __post_init__(self):
        d = self.centroids.shape[1]
        rng = np.random.default_rng(SEED)
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.half = (self.centroids ** 2).sum(axis=1) / 2

    def nearest(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(len(v), dtype=np.int64)
        for at in range(0, len(v), 1024):
            out[at:at + 1024] = np.argmax(v[at:at + 1024] @ self.centroids.T - self.half, axis=1)
        return out

    def promise(self, q: np.ndarray) -> np.ndarray:
        """Per query and cell, what its better vectors may reach: the centroid's product and two deviations of a residual's."""
        reach = 2 / np.sqrt(q.shape[1]) * np.linalg.norm(q, axis=1)[:, None] * self.spread
        return q @ self.centroids.T + reach


def encode(residuals: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits (rows of 64-bit words), lengths, and products of unit residual and code."""
    d = residuals.shape[1]
    length = np.linalg.norm(residuals, axis=1)
    turned = residuals @ rotation
    overlap = np.abs(turned).sum(axis=1) / np.sqrt(d) / np.where(length > 0, length, 1)
    return pack(turned > 0), length, np.where(length > 0, overlap, 1.0)


def pack(bits: np.ndarray) -> np.ndarray:
    n, d = bits.shape
    padded = np.zeros((n, -(-d // 64) * 64), dtype=bool)
    padded[:, :d] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Block:
    """Codes of one cell, and their vectors for verification."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, overlap: np.ndarray, space: Space, cell: int):
        self.vectors, self.words, self.length = vectors, np.ascontiguousarray(codes.T), length
        self.d, self.space, self.centre = vectors.shape[1], space, space.centroids[cell]
        self.ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        self.scale = length / (overlap * np.sqrt(self.d))
        self.slack = length * np.sqrt(np.maximum(1 - overlap ** 2, 0) / max(self.d - 1, 1)) / overlap
        self.norms = np.linalg.norm(vectors, axis=1)
        # What does not depend on the query's own residual.
        self.inner = vectors @ self.centre

    def estimates(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products, and how far they may be off.

        <q, x> = <q - c, x - c> + <q, c> + <c, x> - <c, c>; only the first term is estimated.
        """
        rest = query - self.centre
        turned = rest @ self.space.rotation
        low, high = turned.min(), turned.max()
        step = (high - low) / ((1 << PLANES) - 1) or 1.0
        levels = np.rint((turned - low) / step).astype(np.int64)
        seen = np.zeros(len(self.length), dtype=np.int64)
        for plane in range(PLANES):
            for word, bits in zip(self.words, pack(((levels >> plane) & 1).astype(bool)[None, :])[0]):
                seen += np.bitwise_count(word & bits).astype(np.int64) << plane
        # Sum over all dimensions of sign times level, from the counts at set bits.
        signed = 2 * (seen * step + self.ones * low) - (levels.sum() * step + self.d * low)
        rounding = np.linalg.norm(turned - (levels * step + low))
        fixed = query @ self.centre - self.centre @ self.centre
        error = DEVIATIONS * (np.linalg.norm(rest) * self.slack + rounding * self.scale)
        return signed * self.scale + fixed + self.inner, error

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of vectors among which are the ``k`` best, equal ones included."""
        n = len(self.length)
        chosen = np.arange(n)
        near = 1e-9 * np.linalg.norm(query) * self.norms.max(initial=0)
        if n > k:
            estimate, error = self.estimates(query)
            first = np.argpartition(-estimate, min(max(FIRST, k), n) - 1)[:max(FIRST, k)]
            threshold = np.partition(self.vectors[first] @ query, -k)[-k]
            chosen = np.flatnonzero(estimate + error >= threshold - near)
            product = self.vectors[chosen] @ query
            if len(chosen) > k:
                chosen = chosen[product >= np.partition(product, -k)[-k] - near]
        return chosen, exact(self.vectors[chosen], query)


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components."""
    total = np.zeros(len(vectors))
    for column, x in zip(vectors.T, query):
        total = total + column * x
    return total


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, k1, k2) of the rows that take part; the two hashes name a vector."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & nonzero)
    # Both zeros are one number.
    v = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).select(
        "*", F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"))


def _entries(rows: DataFrame, ids: int) -> DataFrame:
    """(k1, k2, v, ids) of every distinct vector, with its smallest ids; each task sends no more of them."""
    smallest = Window.partitionBy("k1", "k2").orderBy("vec_id")
    held = rows.withColumn("_rank", F.dense_rank().over(smallest)).where(F.col("_rank") <= ids)
    return held.groupBy("k1", "k2").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids"))


def fit(entries: DataFrame, n: int) -> dict[int, Space]:
    """Cells per dimension, from a sample of at most ``FIT_PER_CELL`` vectors for each of the cells."""
    cells = max(1, min(CELLS_MOST, -(-n // CELL)))
    sized = entries.select("k1", "k2", "v", F.size("v").alias("d"))
    counts = {r["d"]: r["count"] for r in sized.groupBy("d").count().collect()}
    sample = bounded_sample(sized, "d", max(FIT_LEAST, cells * FIT_PER_CELL), key=("k1", "k2"))
    found: dict[int, list] = {}
    for r in sample.select("d", "v").collect():
        found.setdefault(r["d"], []).append(r["v"])
    spaces, base = {}, 0
    for d, rows in sorted(found.items()):
        v = np.array(rows)
        centres = _means(v, max(1, min(len(v), CELLS_MOST, -(-counts[d] // CELL))))
        space = Space(base, centres, np.zeros(len(centres)))
        at = space.nearest(v)
        far = np.linalg.norm(v - centres[at], axis=1) ** 2
        space.spread = np.sqrt(np.bincount(at, weights=far, minlength=len(centres)) / np.maximum(np.bincount(at, minlength=len(centres)), 1))
        spaces[d], base = space, base + len(centres)
    return spaces


def _means(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    order = np.lexsort(v.T[::-1])
    centres = v[order[np.linspace(0, len(v) - 1, k).astype(int)]].copy()
    for _ in range(rounds if k > 1 else 1):
        at = Space(0, centres, np.zeros(k)).nearest(v) if k > 1 else np.zeros(len(v), dtype=np.int64)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, v)
        n = np.bincount(at, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _vectors(column: pa.Array) -> np.ndarray:
    """List column of equal sizes as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def _by_size(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, places, matrix) of the rows of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        places = np.flatnonzero(sizes == d)
        yield int(d), places, _vectors(column.take(pa.array(places)))


def index(entries: DataFrame, spaces) -> DataFrame:
    """(k1, k2, ids, v, cell, code, length, overlap) of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(spaces.value)
        for batch in batches:
            for d, places, v in _by_size(batch.column("v")):
                space = known[d]
                cell = space.nearest(v)
                code, length, overlap = encode(v - space.centroids[cell], space.rotation)
                part = batch.take(pa.array(places))
                codes = pa.array([row.tobytes() for row in code], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("k1", "k2", "ids", "v")), pa.array(cell + space.base), codes, pa.array(length), pa.array(overlap)],
                    names=["k1", "k2", "ids", "v", "cell", "code", "length", "overlap"])

    return entries.select("k1", "k2", "ids", "v").mapInArrow(
        run, "k1 long, k2 long, ids array<long>, v array<double>, cell long, code binary, length double, overlap double")


def visits(queries: DataFrame, spaces, most: dict[int, int]) -> DataFrame:
    """(k1, k2, v, cell) for every cell that a query visits: the most promising ones of its dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(spaces.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for d, places, v in _by_size(batch.column("v")):
                    space = known[d]
                    m = min(most[d], len(space.centroids))
                    order = np.argpartition(-space.promise(v), m - 1, axis=1)[:, :m] if m < len(space.centroids) else np.tile(np.arange(m), (len(v), 1))
                    part = batch.take(pa.array(np.repeat(places, m)))
                    yield part.append_column("cell", pa.array(order.ravel() + space.base))

    return queries.select("k1", "k2", "v").mapInArrow(run, "k1 long, k2 long, v array<double>, cell long")


def calibrate(queries: DataFrame, indexed: DataFrame, spaces: dict[int, Space], shared, k: int, recall: float = RECALL) -> dict[int, int]:
    """Cells to visit per dimension, so that sample queries find ``recall`` of their neighbours on average.

    ``PROBES`` queries of each dimension are multiplied with all vectors; a task sends the best of
    each, so the work grows with the vectors and the answers do not.
    """
    most = {d: len(s.centroids) for d, s in spaces.items()}
    wide = [d for d, n in most.items() if n > FEW_CELLS]
    if not wide:
        return most
    sized = queries.select("k1", "k2", "v", F.size("v").alias("d")).where(F.col("d").isin(wide))
    probes: dict[int, np.ndarray] = {}
    for r in bounded_sample(sized, "d", PROBES, key=("k1", "k2")).orderBy("d", "k1", "k2").select("d", "v").collect():
        probes.setdefault(r["d"], []).append(r["v"])
    probes = {d: np.array(v) for d, v in probes.items()}
    sent = broadcast_object(indexed.sparkSession, probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = pickle.loads(sent.value), {}
        for batch in batches:
            for d, places, v in _by_size(batch.column("v")):
                if d not in asked:
                    continue
                cells = batch.column("cell").to_numpy()[places]
                score = asked[d] @ v.T
                for i, row in enumerate(score):
                    old_score, old_cell = held.get((d, i), (np.zeros(0), np.zeros(0, dtype=np.int64)))
                    s, c = np.concatenate([old_score, row]), np.concatenate([old_cell, cells])
                    best = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                    held[d, i] = s[best], c[best]
        for (d, i), (s, c) in held.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * len(s), "probe": [i] * len(s), "score": s, "cell": c})

    best = Window.partitionBy("d", "probe").orderBy(F.desc("score"), "cell")
    truth = indexed.select("v", "cell").mapInArrow(run, "d long, probe long, score double, cell long").withColumn(
        "_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    found: dict[int, list[int]] = {}
    for r in truth.select("d", "probe", "cell").collect():
        space, query = spaces[r["d"]], probes[r["d"]][r["probe"]]
        promise = space.promise(query[None, :])[0]
        found.setdefault(r["d"], []).append(int((promise > promise[r["cell"] - space.base]).sum()) + 1)
    for d, ranks in found.items():
        ranks = np.sort(ranks)
        most[d] = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))])
    return most


def search(embeddings: DataFrame, queries: Column, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows of each row that ``queries`` holds for."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(embeddings)
    entries = stored(_entries(rows, k + 1))
    wanted = stored(rows.where(queries).select("vec_id", "k1", "k2").distinct())
    spaces = fit(entries, entries.count())
    shared = broadcast_object(spark, spaces)
    indexed = stored(index(entries, shared))
    asking = stored(indexed.join(small_side(wanted.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi"))
    visiting = stored(visits(asking, shared, calibrate(asking, indexed, spaces, shared, k + 1, recall)))
    # Blocks of a cell and shares of its visitors, from two small tables of counts.
    vector_bytes = F.sum(F.size("v").cast("long") * 8)
    sizes = stored(indexed.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / BLOCK, vector_bytes / SIDE_BYTES)).alias("blocks")).join(
        visiting.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / SHARE, vector_bytes / SIDE_BYTES)).alias("shares")), "cell"))
    sizes = small_side(sizes)
    spread = F.pmod(F.xxhash64("k2", "k1"), F.col("blocks"))
    holders = indexed.join(sizes, "cell").select(
        "cell", spread.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
        "k1", "k2", "v", "ids", "code", "length", "overlap")
    share = F.pmod(F.xxhash64("k2", "k1"), F.col("shares"))
    seekers = visiting.join(sizes, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), share.alias("share"), "k1", "k2", "v",
        F.lit(None).cast("array<long>"), F.lit(None).cast("binary"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    found = holders.unionAll(seekers).groupBy("cell", "block", "share").applyInArrow(
        _searcher(shared, k + 1), "q1 long, q2 long, own boolean, vec_id long, score double")
    best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", "own")
    # One more than asked for: a query's own row is among them.
    lists = found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k + 1).groupBy("q1", "q2").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "own", "vec_id", "score"))).alias("near"))
    lists = stored(lists)
    others = F.slice(F.filter("near", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id")))), 1, k)
    return (
        wanted.select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
        .join(small_side(lists, basis=lists.select("q1", F.explode("near.score").alias("score"))), ["q1", "q2"])
        .select("query_id", F.posexplode(others).alias("_pos", "x"))
        .select("query_id", (F.col("_pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )


def _searcher(shared, k: int):
    def run(table: pa.Table) -> pa.Table:
        spaces = pickle.loads(shared.value)
        holds = table.column("ids").is_valid()
        base, asking = table.filter(holds).combine_chunks(), table.filter(pa.compute.invert(holds)).combine_chunks()
        out: list[tuple] = []
        if base.num_rows and asking.num_rows:
            v = _vectors(base.column("v").combine_chunks())
            space = spaces[v.shape[1]]
            code = np.frombuffer(b"".join(base.column("code").to_pylist()), dtype=np.uint64).reshape(len(v), -1)
            block = Block(v, code, base.column("length").to_numpy(), base.column("overlap").to_numpy(), space, base.column("cell")[0].as_py() - space.base)
            names = np.stack([base.column("k1").to_numpy(), base.column("k2").to_numpy()], axis=1)
            ids = base.column("ids").combine_chunks()
            borders, values = ids.offsets.to_numpy(), ids.values.to_numpy()
            q = _vectors(asking.column("v").combine_chunks())
            for q1, q2, query in zip(asking.column("k1").to_pylist(), asking.column("k2").to_pylist(), q):
                places, scores = block.best(query, k)
                own = (names[places, 0] == q1) & (names[places, 1] == q2)
                near = [(-s, int(i), bool(o)) for p, s, o in zip(places, scores, own) for i in values[borders[p]:borders[p + 1]]]
                near.sort()
                out += [(q1, q2, o, i, -s) for s, i, o in near[:k]]
        columns = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["q1", "q2", "own", "vec_id", "score"])

    return run
