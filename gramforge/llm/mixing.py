"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent is bisected so that the
weights' entropy meets a target, and then towards 1 until no source is repeated more often than allowed. The weights are
realised within a budget of tokens: a source's documents fall into blocks by hash; whole passes take every block, and the
last, partial pass takes blocks in the order of a permutation until the source's budget is used up, the last block's
documents by a second, finer permutation. Only sums by source and by block are gathered, and they stay in tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramforge.llm.common import written

#: Blocks of a source, and parts of a block; the budget is met to one part of one block.
BLOCK_BITS = 8
LEVELS = 6  # bisection steps in one pass over the sums
STEPS = 48


@dataclass(frozen=True)
class Target:
    entropy: float = 0.95  # of the weights, as a share of the logarithm of the number of sources; None: exponent 1
    max_repeats: float = 4.0  # passes over a source at most, unless the budget itself asks for more of every source
    budget: float = 1.0  # tokens to draw, in multiples of the tokens there are
    top: float = 1.0  # largest exponent: 1 keeps the shares of sources that already meet the target, more sharpens them
    seed: str = "mix"


def n_tokens(text: Column) -> Column:
    """Words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))  # null is a source of its own


def _moments(sums: DataFrame, exponents: list[float], total: float) -> list[tuple[float, float]]:
    """Entropy and largest weight-to-share ratio for each exponent: one aggregation over the sums by source."""
    share = F.col("tokens") / F.lit(float(total))
    aggs = []
    for i, a in enumerate(exponents):
        w = F.pow(share, F.lit(a))
        aggs += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(share) * a).alias(f"l{i}"), F.max(w / share).alias(f"r{i}")]
    row = sums.filter("tokens > 0").agg(*aggs).first()
    return [(math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"]) for i in range(len(exponents))]


def _bisect(ok, low: float, high: float) -> float:
    """The end of [low, high] where `ok` (over lists of exponents; true at `low`, false from some point on) still holds."""
    for _ in range(STEPS // LEVELS):
        n = 1 << LEVELS
        inner = [low + (high - low) * i / n for i in range(1, n)]
        good = ok(inner)
        k = next((i for i, g in enumerate(good) if not g), len(inner))
        low, high = (inner[k - 1] if k else low), (inner[k] if k < len(inner) else high)
    return low


def exponent(sums: DataFrame, target: Target) -> float:
    """Weights are flatter and entropy higher for smaller exponents; sources with few tokens are then repeated."""
    head = sums.filter("tokens > 0").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not head.n or head.n == 1:
        return 1.0
    wanted = target.entropy * math.log(head.n)
    meets = lambda xs: [h >= wanted for h, _ in _moments(sums, xs, head.t)]
    at = target.top if meets([target.top])[0] else _bisect(meets, 0.0, target.top)
    allowed = max(target.max_repeats, target.budget)
    repeats = lambda xs: [r * target.budget <= allowed * (1 + 1e-12) for _, r in _moments(sums, xs, head.t)]
    return at if repeats([at])[0] else _bisect(lambda xs: repeats([1 + (at - 1) * x for x in xs]), 0.0, 1.0) * (at - 1) + 1


def plan(tokens: DataFrame, target: Target) -> DataFrame:
    """By source: _s, tokens, weight, wanted (tokens to draw), passes (whole ones) and the cut of the partial pass: its
    blocks before cut_block, and of that block the parts before cut_part. `tokens`: _s, _block, _part, tokens."""
    blocks = tokens.groupBy("_s", "_block").agg(F.sum("tokens").alias("tokens"))
    sums = written(blocks.groupBy("_s").agg(F.sum("tokens").alias("tokens")), "mix-sums")
    a = exponent(sums, target)
    every = sums.filter("tokens > 0").agg(F.sum("tokens").alias("t")).first().t or 0
    z = (sums.filter("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(float(every or 1)), F.lit(a)))).first()[0]) or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(every or 1)), F.lit(a)) / F.lit(z)).otherwise(0.0)
    sums = sums.withColumn("weight", weight).withColumn("wanted", F.floor(F.col("weight") * F.lit(target.budget * every)).cast("long"))
    sums = sums.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens") + 1e-9)).otherwise(1).cast("long"))
    sums = sums.withColumn("_rest", F.greatest(F.col("wanted") - F.col("passes") * F.col("tokens"), F.lit(0)))

    def cut(parts: DataFrame, key: str, rest: str) -> DataFrame:
        """The first key whose parts, added up, pass the rest, and what is left for it."""
        order = Window.partitionBy("_s").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)  # 2 ** BLOCK_BITS rows at most
        run = parts.withColumn("_before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
        over = run.filter((F.col("_before") + F.col("tokens") > F.col(rest)) & (F.col(rest) >= F.col("_before")))
        return over.groupBy("_s").agg(F.min(F.struct(key, (F.col(rest) - F.col("_before")).alias("_left"))).alias("_m")).select("_s", F.col(f"_m.{key}").alias(key), F.col("_m._left").alias("_left"))

    first = cut(blocks.join(sums.select("_s", "_rest"), "_s"), "_block", "_rest")
    fine = tokens.join(first, ["_s", "_block"]).groupBy("_s", "_part", "_left").agg(F.sum("tokens").alias("tokens"))
    second = cut(fine.withColumnRenamed("_left", "_fine"), "_part", "_fine")
    both = first.select("_s", F.col("_block").alias("cut_block")).join(second.select("_s", F.col("_part").alias("cut_part")), "_s", "left")
    return written(sums.join(both, "_s", "left").select("_s", "tokens", "weight", "wanted", "passes", F.coalesce("cut_block", F.lit(0)).alias("cut_block"), F.coalesce("cut_part", F.lit(0)).alias("cut_part")), "mix-plan")


def _place(key: str, seed: str) -> list[Column]:
    """The permuted block of a document, and its part within the block, from a hash of its id under the seed."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    n = BLOCK_BITS // 4
    return [F.conv(F.substring(h, 1, n), 16, 10).cast("int").alias("_block"), F.conv(F.substring(h, 1 + n, n), 16, 10).cast("int").alias("_part")]


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: `row`, a struct of its columns, n_tokens, weight of the source, block, and copies: how
    often the mixture takes the document, 0 included. A null source is a source of its own; null ids fall into one part of
    a block; documents without words cost nothing and are taken as often as whole passes go, and in the partial pass with
    their part."""
    own = docs.select(F.struct(*docs.columns).alias("row"), n_tokens(F.col(text_col)).alias("n_tokens"), _key(source_col).alias("_s"), *_place(id_col, target.seed))
    sums = written(own.groupBy("_s", "_block", "_part").agg(F.sum("n_tokens").alias("tokens")), "mix-parts")
    extra = (F.col("_block") < F.col("cut_block")) | ((F.col("_block") == F.col("cut_block")) & (F.col("_part") < F.col("cut_part")))
    chosen = own.join(plan(sums, target), "_s")
    return chosen.select("row", "n_tokens", "weight", F.col("_block").alias("block"), (F.col("passes") + extra.cast("long")).alias("copies"))


def drawn(docs: DataFrame, target: Target = Target(), **columns: str) -> DataFrame:
    """The mixture itself: the rows of docs, each as often as it is taken."""
    return mix(docs, target, **columns).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
