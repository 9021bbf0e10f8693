"""Words of scripts that set no spaces between them, found without a dictionary.

Inside a word the next character is easy to guess, at its end it is not. For every character
n-gram of the collection the entropies of what stands to its right and left are worked out; how
much they rise over those of the n-gram without its last (first) character, less the mean for its
length, tells how well its ends separate. The best path through a piece of text is the cut into
n-grams that adds up to most, each weighed by its length. Counting is two aggregations over the
collection; a path is worked out per piece, in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settled
from .sizing import small_side

# Scripts written without spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
# Characters of the longest word, and of the longest piece that is cut as one.
WORD_MOST = 4
PIECE = 200
DIGITS = 9


def parts(points: DataFrame) -> DataFrame:
    """(doc_id, pos, part, unspaced, text): statements with such scripts, in runs of them and of everything else.

    Long runs are cut into pieces of ``PIECE`` characters. ``part`` ascends within a statement.
    """
    several = points.where(F.col("point").rlike(UNSPACED)).select(
        "doc_id", "pos", F.expr(rf"posexplode(regexp_extract_all(point, r'{UNSPACED}{{1,{PIECE}}}|[^{UNSPACED[1:]}+', 0))").alias("part", "text"))
    return several.select("doc_id", "pos", "part", F.col("text").rlike(UNSPACED).alias("unspaced"), "text")


def _grams(text: Column) -> Column:
    """All n-grams of a piece with the characters beside them, '' at the piece's ends."""
    size = F.char_length(text)
    return F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(WORD_MOST), size - i + 1)), lambda n: F.struct(
            (i + n - 1).alias("end"), n.alias("n"), F.substring(text, i, n).alias("gram"),
            F.when(i > 1, F.substring(text, i - 1, F.lit(1))).otherwise("").alias("left"),
            F.substring(text, i + n, F.lit(1)).alias("right")))))


def _entropy(grams: DataFrame, side: str) -> DataFrame:
    """(gram, n, entropy) of the characters on one side; every end of a piece is a character of its own."""
    counted = grams.groupBy("gram", "n", side).agg(F.count("*").alias("c"))
    known = F.when(F.col(side) != "", F.col("c") * F.log("c")).otherwise(0.0)
    return counted.groupBy("gram", "n").agg((F.log(F.sum("c")) - F.sum(known) / F.sum("c")).alias(f"h_{side}"))


def gram_scores(pieces: DataFrame) -> DataFrame:
    """(gram, score) of every n-gram of up to ``WORD_MOST`` characters of ``pieces`` (text); written."""
    grams = pieces.select(F.explode(_grams(F.col("text"))).alias("g")).select("g.gram", "g.n", "g.left", "g.right")
    both = settled(_entropy(grams, "left").join(_entropy(grams, "right"), ["gram", "n"]))
    shorter = both.where(F.col("n") < WORD_MOST)
    begins = shorter.select(F.col("gram").alias("begin"), F.col("h_right").alias("begin_h"))
    ends = shorter.select(F.col("gram").alias("finish"), F.col("h_left").alias("finish_h"))
    inner = both.withColumn("begin", F.expr("substring(gram, 1, n - 1)")).withColumn("finish", F.expr("substring(gram, 2)"))
    risen = inner.join(begins, "begin", "left").join(ends, "finish", "left").select(
        "gram", "n", (F.col("h_right") - F.coalesce("begin_h", F.lit(0.0)) + F.col("h_left") - F.coalesce("finish_h", F.lit(0.0))).alias("rise"))
    usual = risen.groupBy("n").agg(F.avg("rise").alias("usual"))
    # Sums of the same numbers in another order may differ in the last digits.
    return settled(risen.join(F.broadcast(usual), "n").select("gram", F.round((F.col("rise") - F.col("usual")) * F.col("n"), DIGITS).alias("score")))


def _path(size: Column, scored: Column) -> Column:
    """Lengths of the words on the best path through a piece, from (end, n, score) of all its n-grams in order.

    ``best`` holds the best total up to each place, ``last`` the word that ends there; of
    equal totals the longer word is taken.
    """
    at = F.col
    first = F.struct(F.array(F.lit(0.0)).alias("best"), F.expr("cast(array() as array<int>)").alias("last"))

    def reach(state, j):
        # Up to the longest word every place has one n-gram more than the one before.
        before = F.when(j <= WORD_MOST, (j * (j - 1) / 2).cast("int")).otherwise(
            F.lit(WORD_MOST * (WORD_MOST + 1) // 2) + (j - WORD_MOST - 1) * WORD_MOST)
        options = F.transform(F.slice(scored, before + 1, F.least(j, F.lit(WORD_MOST))), lambda e: F.struct(
            (F.element_at(state["best"], j - e["n"] + 1) + e["score"]).alias("total"), e["n"].alias("n")))
        top = F.array_max(options)
        return F.struct(F.array_append(state["best"], top["total"]).alias("best"), F.array_append(state["last"], top["n"]).alias("last"))

    found = F.aggregate(F.sequence(F.lit(1), size), first, reach)["last"]
    start = F.struct(size.alias("at"), F.expr("cast(array() as array<int>)").alias("words"))

    def back(state, _):
        n = F.element_at(at("_last"), state["at"])
        return F.when(state["at"] > 0, F.struct((state["at"] - n).alias("at"), F.concat(F.array(n), state["words"]).alias("words"))).otherwise(state)

    return found, F.aggregate(F.sequence(F.lit(1), size), start, back)["words"]


def segments(several: DataFrame) -> DataFrame:
    """(doc_id, pos, part, words) of the unspaced parts of ``parts``; their words joined are the part."""
    runs = several.where("unspaced").select("doc_id", "pos", "part", "text")
    scores = gram_scores(runs)
    grams = runs.select("doc_id", "pos", "part", F.explode(_grams(F.col("text"))).alias("g")).select(
        "doc_id", "pos", "part", "g.end", "g.n", "g.gram")
    scored = grams.join(small_side(scores), "gram").groupBy("doc_id", "pos", "part").agg(
        F.array_sort(F.collect_list(F.struct("end", "n", "score"))).alias("scored"))
    size = F.char_length("text")
    last, words = _path(size, F.col("scored"))
    ends = F.transform("_lengths", lambda n, i: F.struct(
        F.aggregate(F.slice("_lengths", F.lit(1), i), F.lit(0), lambda a, b: a + b).alias("before"), n.alias("n")))
    cut = runs.join(scored, ["doc_id", "pos", "part"]).withColumn("_last", last).withColumn("_lengths", words)
    return cut.select("doc_id", "pos", "part", F.transform(ends, lambda w: F.substring(F.col("text"), w["before"] + 1, w["n"])).alias("words"))
