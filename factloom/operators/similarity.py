"""Similarity join of two tables of names: character trigrams and shared name tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import gazetteer
from factloom.session import BROADCAST_BYTES, materialised

GRAM_WEIGHT, TOKEN_WEIGHT, TOKENS_FOR_ALL = 0.7, 0.3, 3.0  # weights of the score (fixed values)
EPSILON = 1e-9
NAME_BYTES = 2_048  # what a name takes with its grams, about
GRAM_BYTES = 128


def _grams(names: DataFrame, name: str) -> DataFrame:
    """Each different name with its grams; the name is its own id."""
    different = names.where(F.col(name).isNotNull()).select(F.col(name).alias("id")).distinct()
    return different.select("id", F.col("id").alias("name"), text.trigrams("id").alias("grams"))


def _side(rows: DataFrame, count: int, row_bytes: int = NAME_BYTES) -> DataFrame:
    """A side of a join, broadcast only by its counted rows: files of names that share grams are far smaller than the names in memory."""
    return F.broadcast(rows) if count * row_bytes <= BROADCAST_BYTES else rows.hint("merge")


def _needed(size: Column, least: float) -> Column:
    """How many grams a name of ``size`` grams has to share with any name of at least that Jaccard similarity."""
    return F.greatest(F.lit(1), F.ceil(size * least - EPSILON).cast("int"))


def _prefixes(sides: dict[str, DataFrame], least: float) -> dict[str, DataFrame]:
    """(id, n, gram) of each side: the rarest grams of each name, so many that two similar names share one of them.

    The order of grams is by how many names of both sides have them, so frequent grams come up only where names need them.
    """
    long = {side: rows.select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram")) for side, rows in sides.items()}
    frequency = long["left"].select("gram").unionByName(long["right"].select("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    frequency = materialised(frequency, "gram-counts")
    grams = _side(frequency, frequency.count(), GRAM_BYTES)
    out = {}
    for side, rows in long.items():
        ranked = rows.join(grams, "gram").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("g"))
        short = F.slice("g", F.lit(1), F.col("n") - _needed(F.col("n"), least) + 1)
        out[side] = ranked.select("id", "n", F.explode(F.transform(short, lambda x: x["gram"])).alias("gram"))
    return out


def similar_names(left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str, right_name: str, at_least: float = 0.0) -> DataFrame:
    """``(left_id, right_id, jaccard, hits, similarity)`` of all pairs that share a trigram or a token and reach ``at_least``.

    Similarity = Jaccard of the distinct trigrams of the cleaned names x 0.7 + min(1, tokens of the right name that the left one
    contains / 3) x 0.3. Ids are unique on each side and of two different column names; null names pair with none.

    Candidates come two ways, both exact. Pairs without a token need a Jaccard similarity of ``at_least`` / 0.7 by
    themselves: they share a gram of both prefixes (rarest grams first), and their sizes differ by no more than that
    factor. Pairs with a token are found by one search for all tokens in the left names. Only candidates meet their grams.
    With ``at_least`` = 0 every shared gram makes a pair, so the result itself is that large. Equal names are compared once; their
    ids are joined to the pairs of names that are found.
    """
    sides = {"left": materialised(_grams(left, left_name), "left-names"), "right": materialised(_grams(right, right_name), "right-names")}
    n_left, n_right = sides["left"].count(), sides["right"].count()
    alone = min(1.0, at_least / GRAM_WEIGHT)
    by_gram = None
    if at_least <= GRAM_WEIGHT:
        prefix = _prefixes(sides, alone)
        a = prefix["left"].select(F.col("id").alias("l"), F.col("n").alias("ln"), "gram")
        b = prefix["right"].select(F.col("id").alias("r"), F.col("n").alias("rn"), "gram")
        fits = (F.col("ln") >= F.col("rn") * alone - EPSILON) & (F.col("rn") >= F.col("ln") * alone - EPSILON)
        by_gram = a.join(_side(b, n_right), "gram").where(fits).select("l", "r")

    tokens = sides["right"].select(F.col("id").alias("r"), F.explode(F.array_distinct(text.name_tokens("name"))).alias("name"))
    vocabulary = tokens.select("name").distinct().withColumn("ord", F.lit(0).cast("long"))
    lowered = sides["left"].select(F.col("id").alias("l"), F.lower("name").alias("_low"))
    by_token = gazetteer.mentioned(lowered, "l", "_low", vocabulary).join(_side(tokens, n_right), "name").select("l", "r")

    pairs = (by_token if by_gram is None else by_gram.unionByName(by_token)).distinct()
    a = sides["left"].select(F.col("id").alias("l"), F.col("name").alias("_ln"), F.col("grams").alias("_lg"))
    b = sides["right"].select(F.col("id").alias("r"), F.col("name").alias("_rn"), F.col("grams").alias("_rg"))
    met = pairs.join(_side(a, n_left), "l").join(_side(b, n_right), "r").withColumn("_i", F.size(F.array_intersect("_lg", "_rg")))
    jaccard = F.col("_i") / F.greatest(F.lit(1), F.size("_lg") + F.size("_rg") - F.col("_i"))
    low = F.lower("_ln")
    hits = F.size(F.filter(text.name_tokens("_rn"), lambda w: F.contains(low, w)))
    similarity = F.col("jaccard") * GRAM_WEIGHT + F.least(F.lit(1.0), F.col("hits") / TOKENS_FOR_ALL) * TOKEN_WEIGHT
    scored = met.select(F.col("l").alias("_l"), F.col("r").alias("_r"), jaccard.alias("jaccard"), hits.alias("hits")).withColumn("similarity", similarity)
    found = materialised(scored.where(F.col("similarity") >= at_least - EPSILON), "name-pairs")
    of_left = left.select(left_id, F.col(left_name).alias("_l"))
    of_right = right.select(right_id, F.col(right_name).alias("_r"))
    named = of_left.join(_side(found, found.count()), "_l")
    return named.join(_side(of_right, of_right.count()), "_r").select(left_id, right_id, "jaccard", "hits", "similarity")
