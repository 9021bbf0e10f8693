"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch has one number per coordinate. In round i every shingle is thrown into a random
coordinate with a random value above all values of earlier rounds, and each coordinate keeps
its smallest; the last rounds throw every shingle into one fixed coordinate each, so every
coordinate fills. Two sketches agree in a coordinate with the sets' Jaccard similarity, and the
share of agreeing coordinates is as concentrated as with independent hash functions, at a cost
of about the set's size instead of size times coordinates.

Sketches are cut into bands. Documents that share a band are compared with the band's most
connected document (its leader), by their full sets. Whoever is not linked to the leader is
compared, again by full sets, with everyone of the leader's group that the triangle inequality
of the Jaccard distance does not rule out. No pairs of already connected documents are made.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.sizing import small_side
from .common import map_rows, record_batch, schema_of, ship, slices, stored, texts
from .components import components, forest
from .words import SPACED, hashed_words, mix, windows

SHINGLE_WORDS = 5
PERCENT = 80
# 30 bands of 5 coordinates: a pair of similarity 0.8 shares no band with probability 7 in a million.
BANDS, BAND_ROWS = 30, 5
# Documents a task of the last comparison holds: rows to settle, and columns to compare them with; and their shingles.
ROW_BLOCK, COLUMN_BLOCK = 512, 4096
ROW_SHINGLES, COLUMN_SHINGLES = 1 << 20, 1 << 22
VOCABULARY_BLOCK = 2048


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of ``size`` consecutive words, A-Z lower-cased; with fewer words, the whole sequence."""
    h = hashed_words(text, SPACED)[0]
    if 0 < len(h) < size:
        return windows(h, len(h)) ^ np.uint64(len(h))
    return np.unique(windows(h, size))


def sketch(items: np.ndarray, coordinates: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.full(coordinates, np.iinfo(np.uint64).max, dtype=np.uint64)
    t, begin = coordinates, 0
    step = max(1, 2 * t // len(items))
    while begin < t and out.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(begin, min(begin + step, t), dtype=np.uint64)
        v = mix(items[None, :] ^ mix(rounds + np.uint64(1))[:, None])
        place = (v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)
        value = (v & np.uint64(0xFFFFFFFF)) | (rounds << np.uint64(32))[:, None]
        np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        begin += step
    for i in np.flatnonzero(out == np.iinfo(np.uint64).max):
        v = mix(items ^ mix(np.array([t + i + 1], dtype=np.uint64)))
        out[i] = (np.uint64(t + i) << np.uint64(32)) | (v.min() & np.uint64(0xFFFFFFFF))
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def set_name(items: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of shingles."""
    return struct.unpack("<qq", hashlib.blake2b(items.tobytes(), digest_size=16).digest())


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    def start():
        def row(doc_id, text):
            items = shingles(text, size)
            if not len(items):
                return doc_id, 0, None, None, None
            return doc_id, len(items), *set_name(items), band_keys(sketch(items, BANDS * BAND_ROWS)).tolist()

        return row

    return map_rows(texts(docs), start, "doc_id long, n_shingles long, hi long, lo long, bands array<long>")


def _full(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(node, text): a text of every needed set (doc_id, hi, lo, node), found by an id that has it."""
    def start():
        def row(doc_id, text):
            items = shingles(text, size)
            return doc_id, text, *(set_name(items) if len(items) else (None, None))

        return row

    held = texts(docs).join(small_side(needed.select("doc_id").distinct()), "doc_id", "left_semi")
    named = map_rows(held, start, "doc_id long, text binary, hi long, lo long")
    return named.join(small_side(needed), ["doc_id", "hi", "lo"]).select("node", "text").dropDuplicates(["node"])


def _led_pairs(rows: DataFrame) -> DataFrame:
    """(leader, member): sets that share a band with a better connected one."""
    bands = rows.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(bands.join(shared, "band"))
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = (
        met.join(degree, "node").groupBy("band")
        .agg(F.max(F.struct("degree", (-F.col("node")).alias("id"))).alias("best"))
        .select("band", (-F.col("best.id")).alias("leader"))
    )
    return (
        met.join(leaders, "band").where("node != leader")
        .select("leader", F.col("node").alias("member")).distinct()
    )


def _verified(pairs: DataFrame, full: DataFrame, size: int) -> DataFrame:
    """The pairs with the sizes of their full sets' intersection and union."""
    side = full.select(F.col("node").alias("member"), F.col("text").alias("member_text"))
    lead = full.select(F.col("node").alias("leader"), F.col("text").alias("leader_text"))

    def start():
        last: tuple = (None, None)

        def row(leader, member, member_text, leader_text):
            nonlocal last
            if last[0] != leader:
                last = (leader, shingles(leader_text, size))
            mine = shingles(member_text, size)
            both = len(np.intersect1d(last[1], mine, assume_unique=True))
            return leader, member, both, len(mine) + len(last[1]) - both

        return row

    joined = pairs.join(side, "member").join(lead, "leader").select("leader", "member", "member_text", "leader_text")
    return map_rows(joined, start, "leader long, member long, inter long, total long")


def _blocks(pairs: DataFrame) -> DataFrame:
    """What is left to compare: (leader, ring, row block, column block) with one row per document in it.

    A member's ring is its distance from the leader in steps of 1 - PERCENT/100, rounded up,
    from 0. Documents whose rings are not the same or neighbours are too far apart to be linked. Ring 0 is
    linked to the leader already, so only members of outer rings are rows to settle.
    """
    step = 100 - PERCENT
    ring = F.expr(f"int(greatest(((total - inter) * 100 + total * {step} - 1) div (total * {step}) - 1, 0))")
    # A member has at most as many shingles as the union with its leader.
    placed = pairs.select("leader", "member", ring.alias("ring"), F.col("total").alias("weight"))
    rows = placed.where("ring > 0").select("leader", "member", F.col("ring").alias("task"), F.lit(True).alias("is_row"), "ring", "weight")
    columns = rows.withColumn("is_row", F.lit(False))
    inner = placed.select("leader", "member", (F.col("ring") + 1).alias("task"), F.lit(False).alias("is_row"), "ring", "weight")
    everyone = rows.unionAll(columns).unionAll(inner)
    counts = everyone.groupBy("leader", "task").agg(
        F.sum(F.col("is_row").cast("long")).alias("n_rows"),
        F.sum((~F.col("is_row")).cast("long")).alias("n_columns"),
        F.sum(F.when(F.col("is_row"), F.col("weight"))).alias("row_weight"),
        F.sum(F.when(~F.col("is_row"), F.col("weight"))).alias("column_weight")).where("n_rows > 0 AND n_columns > 1")
    # Written, so that the join is between two shuffles of which adaptive execution can split a hot leader's, or a broadcast.
    in_blocks = everyone.join(small_side(stored(counts)), ["leader", "task"])
    row_blocks = F.greatest(F.ceil(F.col("n_rows") / ROW_BLOCK), F.ceil(F.col("row_weight") / ROW_SHINGLES)).cast("int")
    column_blocks = F.greatest(F.ceil(F.col("n_columns") / COLUMN_BLOCK), F.ceil(F.col("column_weight") / COLUMN_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("member"), F.when(F.col("is_row"), row_blocks).otherwise(column_blocks)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("is_row"), column_blocks).otherwise(row_blocks) - 1))
    return in_blocks.withColumn("own", own).withColumn("other", others).select(
        "leader", "task", F.when(F.col("is_row"), F.col("own")).otherwise(F.col("other")).alias("row_block"),
        F.when(F.col("is_row"), F.col("other")).otherwise(F.col("own")).alias("column_block"),
        "member", "is_row", "ring")


def linked(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``rows`` and ``columns`` are similar enough, as a matrix."""
    everything = np.concatenate(rows + columns)
    values, counts = np.unique(everything, return_counts=True)
    values = values[counts > 1]
    inter = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for at in range(0, len(values), VOCABULARY_BLOCK):
        part = values[at:at + VOCABULARY_BLOCK]
        inter += _dense(rows, part) @ _dense(columns, part).T
    sizes = np.array([len(r) for r in rows])[:, None] + np.array([len(c) for c in columns])[None, :]
    return (inter * 100 >= (sizes - inter) * PERCENT)


def _dense(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(part)), dtype=np.float32)
    for i, items in enumerate(sets):
        a, b = np.searchsorted(items, part[0]), np.searchsorted(items, part[-1], side="right")
        found = items[a:b]
        at = np.searchsorted(part, found)
        out[i, at[part[at] == found]] = 1
    return out


def _block_edges(blocks: DataFrame, full: DataFrame, size: int) -> DataFrame:
    """(a, b): a forest of the links within each block."""
    schema = schema_of("a long, b long")
    arrow = to_arrow_schema(schema)
    with_text = blocks.join(full.select(F.col("node").alias("member"), "text"), "member")

    def run(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        leader = table.column("leader")[0].as_py()
        for batch in table.select(["member", "is_row", "ring", "text"]).to_batches():
            for part in slices(batch):
                for member, is_row, ring, text in zip(*(c.to_pylist() for c in part.columns)):
                    sides[0 if is_row else 1].append((member, ring, shingles(text, size)))
        rows, columns = sides
        if not rows or not columns:
            return pa.Table.from_batches([], schema=arrow)
        links = linked([r[2] for r in rows], [c[2] for c in columns])
        # Ring 0 is one component already: the leader stands for it.
        targets = [leader if ring == 0 else member for member, ring, _ in columns]
        edges = forest(links, np.array([r[0] for r in rows]), np.array(targets))
        return pa.Table.from_batches([record_batch(sorted(edges), arrow)])

    return with_text.groupBy("leader", "task", "row_block", "column_block").applyInArrow(run, schema)


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * intersection >= PERCENT * union of their sets of ``size``-word
    shingles; a component is what links reach, named by its smallest doc_id, which is kept. A
    text with fewer words is one shingle; one without words, or null, is linked with nothing.
    Repeated rows give repeated results; rows that share a doc_id are one document to be reached,
    whatever their texts (a row without words stays alone); a null doc_id takes part in no link of its own and keeps its set's
    component, or none. Columns other than these two are not read.
    """
    ship(docs.sparkSession)
    rows = stored(_sketches(docs, size))
    held = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one node; the numbers are fixed when they are written.
    nodes = stored(held.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
                   .withColumn("node", F.monotonically_increasing_id()))
    sets = nodes.drop("bands")
    pairs = stored(_led_pairs(nodes))
    needed = pairs.select(F.explode(F.array("leader", "member")).alias("node")).distinct()
    full = stored(_full(docs, stored(sets.join(small_side(stored(needed)), "node")), size))
    checked = stored(_verified(pairs, full, size))
    links = checked.where(F.col("inter") * 100 >= F.col("total") * PERCENT).select(
        F.col("leader").alias("a"), F.col("member").alias("b"))
    found = components(links.unionAll(_block_edges(_blocks(checked), full, size)).unionAll(_shared_ids(held, sets)))
    members = sets.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    # A component is named by its smallest id; only those of several sets need looking at.
    joined = stored(members.where("component IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("least")))
    named = members.join(small_side(joined), "part", "left").select("hi", "lo", F.coalesce("least", "doc_id").alias("named"))
    component = F.coalesce("named", "doc_id")
    return rows.join(named, ["hi", "lo"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def _shared_ids(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): edges between the sets of ids that stand on several."""
    several = stored(held.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("hi", "lo")])
                     .where("min_hi <> max_hi OR min_lo <> max_lo").select("doc_id"))
    texts_of = held.join(small_side(several), "doc_id", "left_semi").select("doc_id", "hi", "lo").distinct()
    of_id = stored(texts_of.join(sets.select("hi", "lo", "node"), ["hi", "lo"]).select("doc_id", "node"))
    first = of_id.groupBy("doc_id").agg(F.min("node").alias("a"))
    return of_id.join(first, "doc_id").select("a", F.col("node").alias("b"))
