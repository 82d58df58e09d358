"""Mixing sources to target weights by temperature."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilerain.llm.common import stored, text_of

#: Steps into which one look at the sources cuts the interval that still holds the exponent; looks taken.
STEPS, LOOKS = 32, 7
#: Bits of the permutation key, and bits that one level of blocks opens.
KEY_BITS, LEVEL_BITS = 40, 10


def word_count(text: str = "text") -> Column:
    """Words between ASCII white space, nulls as none."""
    return F.size(F.regexp_extract_all(text_of(text), F.lit(r"[^\x20\x09-\x0D]+"), 0)).cast("long")


def _curve(totals: DataFrame, everything: int, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy (nats) of the weights, and passes over the least source for one over the largest, per exponent."""
    share = F.log(F.col("tokens") / F.lit(float(everything)))
    grid = totals.where("tokens > 0").select(share.alias("ln"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
    rows = grid.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("ln"))).alias("z"),
                                 F.sum(F.exp(F.col("a") * F.col("ln")) * F.col("ln")).alias("m"),
                                 F.min("ln").alias("low"), F.max("ln").alias("high")).collect()
    return {r["a"]: (math.log(r["z"]) - r["a"] * r["m"] / r["z"], math.exp((1 - r["a"]) * (r["high"] - r["low"]))) for r in rows}


def exponent(totals: DataFrame, entropy: float | None = None, passes: float | None = None) -> float:
    """The exponent between 0 and 1 for the shares of totals(source, tokens).

    The weights of sources are their token shares to this power: 1 leaves them, 0 makes them equal. It is the largest
    exponent whose weights reach `entropy` (a share of the logarithm of the number of sources), but never so small that
    the least source is passed over more than `passes` times for one pass over the largest. Entropy and passes fall as
    the exponent grows, so the interval is cut again and again; each look at the sources is one aggregation.
    """
    whole = totals.where("tokens > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).first()
    n, everything = whole["n"], whole["tokens"]
    if n < 2:
        return 1.0

    def curve_at(exponents: list[float]) -> dict[float, tuple[float, float]]:
        return _curve(totals, everything, exponents)

    def largest(ok) -> float:
        low, high = 0.0, 1.0  # ok holds at low, not at high
        if ok(*curve_at([1.0])[1.0]):
            return 1.0
        for _ in range(LOOKS):
            grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
            curve = curve_at(grid)
            below = max((i for i in range(STEPS) if ok(*curve[grid[i]])), default=0)
            low, high = grid[below], grid[below + 1]
        return low

    reached = 1.0 if entropy is None else largest(lambda h, _: h >= entropy * math.log(n) - 1e-12)
    if passes is None:
        return reached

    # the smallest exponent that keeps to the limit is where "over the limit" ends
    over = 0.0
    if curve_at([0.0])[0.0][1] > passes:
        over = largest(lambda _, p: p > passes)
    return max(reached if entropy is not None else 0.0, over)


def _key(doc_id: Column, seed: int) -> Column:
    """Forty bits that order the documents of a source; its leading bits are the block."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 10), 16, 10).cast("long")


def copies(docs: DataFrame, tokens: Column | None = None, doc_id: str = "doc_id", source: str = "source", entropy: float | None = 0.999,
           passes: float | None = 4.0, budget: float | None = None, seed: int = 11) -> DataFrame:
    """doc_id, source, n_tokens, weight, copies per row of `docs`: how often the mix takes it.

    Weights are temperature-mixed token shares (see `exponent`). A source gets its weight's share of `budget` tokens; by
    default the budget is the least with which the source passed over least is passed over once, so nothing is left out.
    The whole passes of a source take every document; the last, partial one takes documents in the order of a seeded
    block permutation until its tokens are used up. That order is cut without sorting a source: the 1,024 blocks of a
    source are summed, the one in which the budget ends is opened into 1,024 smaller ones, and so on to single documents,
    so a source with a third of all rows needs no large group.

    Null texts have no tokens. A null source is a source of its own. Rows of a source that repeat an id (null included)
    are taken together. Documents without tokens are free: the partial pass takes those before its end. An empty table
    gives no rows. A source without any token has weight 0 and each of its rows is taken once.
    """
    count = word_count() if tokens is None else tokens.cast("long")
    rows = stored(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
                              F.coalesce(count, F.lit(0).cast("long")).alias("n_tokens"),
                              _key(F.col(f"`{doc_id}`").cast("long"), seed).alias("key")))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    rows = rows.withColumn("name", name)
    totals = stored(rows.groupBy("name").agg(F.sum("n_tokens").alias("tokens")))
    power = exponent(totals, entropy, passes)
    whole = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(power))).alias("z"),
                                           F.max(F.pow(F.col("tokens").cast("double"), F.lit(1 - power))).alias("most")).first()
    z = whole["z"] or 1.0
    size = budget if budget is not None else (whole["most"] or 0.0) * z
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power)) / z).otherwise(0.0)
    quota = totals.select("name", "tokens", weight.alias("weight")).withColumn("quota", F.col("weight") * size)
    # a quota within a millionth of whole passes is whole passes
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + 1e-6)).otherwise(1)
    quota = quota.withColumn("whole", full.cast("long")).withColumn(
        "rest", F.greatest(F.lit(0).cast("long"), F.floor(F.col("quota") - F.col("whole") * F.col("tokens") + 1e-3).cast("long")))
    quota = stored(quota)

    # levels of blocks: `head` is the block of the level before in which the rest ends
    open_at = quota.where("tokens > 0 AND rest > 0").select("name", F.lit(0).cast("long").alias("head"), "rest")
    sums = rows.groupBy("name", "key").agg(F.sum("n_tokens").alias("n"))
    for level in range(KEY_BITS // LEVEL_BITS):
        shift = KEY_BITS - LEVEL_BITS * (level + 1)
        block = F.shiftright("key", shift)
        blocks = sums.groupBy("name", F.shiftright("key", shift + LEVEL_BITS).alias("head"), block.alias("block")).agg(F.sum("n").alias("n"))
        blocks = blocks.join(open_at, ["name", "head"])
        order = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
        blocks = blocks.withColumn("until", F.sum("n").over(order)).where("until > rest")
        first = blocks.groupBy("name").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("until") + F.col("n")).alias("rest")), "block").alias("x"))
        open_at = stored(first.select("name", F.col("x.block").alias("head"), F.col("x.rest").alias("rest")))
    ends = quota.join(open_at.select("name", F.col("head").alias("end")), "name", "left")
    more = F.when(F.col("rest") > 0, (F.col("key") < F.coalesce("end", F.lit(1 << KEY_BITS))).cast("long")).otherwise(0)
    return rows.join(ends.select("name", "weight", "whole", "rest", "end"), "name").select(
        "doc_id", "source", "n_tokens", "weight", (F.col("whole") + more).alias("copies"), "key")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of `docs`, all columns, each as often as `copies` says."""
    taken = copies(docs, doc_id=doc_id, source=source, **options)
    taken = taken.groupBy(F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source")).agg(F.max("copies").alias("__mix_copies"))
    here = docs[f"`{doc_id}`"].cast("long").eqNullSafe(F.col("__mix_id")) & docs[f"`{source}`"].cast("string").eqNullSafe(F.col("__mix_source"))
    joined = docs.join(taken.where("__mix_copies > 0"), here)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies"))).alias("__mix_pass")).drop("__mix_pass")
