"""Mixing sources to target weights by a temperature, realised as budgeted block permutations.

Source shares are raised to an exponent in [0, 1] and normalised. The exponent is bisected until the mix meets a target: no
source repeated more often than max_repeats, or a given entropy of the weights. A source's budget is then spent in passes
over the source: whole passes, and for the rest the head of a permutation of its blocks. Blocks are hash classes of a
source's documents, as many as its size asks for, so no source, however large, is ordered as one group; the running sum over its
blocks goes by ranges of their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_dir, small_side, stored

#: Exponents that one pass over the sources tries, and passes: 8 bits of the exponent each.
TRIED, PASSES = 256, 7
#: Ranges of 2**52 in the order of blocks, which are numbers below 2**60.
RANGE_BITS = 52


def drawn_key(*parts: Column | int) -> Column:
    """A number below 2**60 drawn from the parts: the same in any run, and in SQL."""
    texts = [F.coalesce((F.lit(x) if isinstance(x, int) else x).cast("string"), F.lit("~")) for x in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def token_mass(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, copies, n_tokens) by distinct row; n_tokens: the words of its text, one at least, so that empty texts have a place too."""
    words = F.greatest(F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(1)).cast("long")
    at = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), text_key(docs["text"]).alias("h"), words.alias("n_tokens"))
    return at.groupBy("doc_id", "source", "h").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("n_tokens"))


def exponent(sources: DataFrame, budget: float, max_repeats: float | None, entropy: float | None) -> float:
    """Bisect the exponent over (source, tokens), TRIED parts at a time; as many rows of sums reach the driver.

    With max_repeats the flattest mix within the limit, with entropy the mix of that entropy (nats). A target that no exponent
    from 0 to 1 meets raises ValueError.
    """
    most = sources.agg(F.max("tokens")).first()[0]
    if most is None:
        return 1.0
    sizes = sources.groupBy("tokens").agg(F.count("*").alias("c")).select("c", F.ln(F.col("tokens") / most).alias("l"))

    def too_flat(tried: list[float]) -> list[bool]:
        at = sizes.select("c", "l", F.explode(F.array(*map(F.lit, tried))).alias("a"))
        power = F.exp(F.col("a") * F.col("l"))
        sums = at.groupBy("a").agg(F.sum(F.col("c") * power).alias("z"), F.sum(F.col("c") * F.col("l") * power).alias("zl"), F.max(F.exp((F.col("a") - 1) * F.col("l"))).alias("r"))
        if entropy is None:
            bad = F.col("r") / F.col("z") * (budget / most) > max_repeats * (1 + 1e-12)
        else:  # entropy falls as the exponent grows
            bad = F.ln("z") - F.col("a") * F.col("zl") / F.col("z") > entropy
        found = {r["a"]: r["bad"] for r in sums.select("a", bad.alias("bad")).collect()}
        return [found[a] for a in tried]

    flattest, own = too_flat([0.0, 1.0])
    if own:
        raise ValueError(f"no mix meets the target: the sources' own shares {'repeat more often' if entropy is None else 'have a higher entropy'}")
    if not flattest:
        if entropy is None:
            return 0.0
        if entropy > math.log(sources.count()) + 1e-9:
            raise ValueError("no mix meets the target: equal shares have a lower entropy")
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = sorted({low + (high - low) * k / TRIED for k in range(1, TRIED)})
        flat = sum(too_flat(tried))  # the first ones
        low, high = (tried[flat - 1] if flat else low), (tried[flat] if flat < len(tried) else high)
    return high


def source_weights(mass: DataFrame, budget: float | None = None, max_repeats: float | None = 2.0, entropy: float | None = None) -> DataFrame:
    """(source, tokens, weight, target, passes, rest) of each source; budget: tokens to draw, by default as many as there are."""
    sources = mass.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    spent = budget or (sources.agg(F.sum("tokens")).first()[0] or 0)
    a = exponent(sources, float(spent), max_repeats, entropy)
    total = sources.agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a)))).first()[0] or 1.0
    out = sources.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(total))
    out = out.withColumn("target", F.floor(F.col("weight") * F.lit(float(spent)) + 1e-6))
    return out.withColumns({"passes": F.floor(F.col("target") / F.col("tokens")), "rest": F.expr("target % tokens")})


def blocks_before(blocks: DataFrame, path: str) -> DataFrame:
    """(of, b, earlier): the tokens of a source's blocks that come earlier in its order; first over ranges of the order, then within each."""
    blocks = stored(blocks.withColumn("range", F.shiftright("block_order", RANGE_BITS)), f"{path}/blocks")
    running = lambda *by: Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("source", "range").agg(F.sum("block_tokens").alias("n"))
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(running("source", ["range"])), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("block_tokens").over(running("source", "range", ["block_order", "block"])), F.lit(0))
    at = blocks.withColumn("within", within).join(ranges, blocks["source"].eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    return stored(at.select(F.col("source").alias("of"), F.col("block").alias("b"), (F.col("base") + F.col("within")).alias("earlier")), f"{path}/earlier")


def mixed_sources(docs: DataFrame, budget: float | None = None, max_repeats: float | None = 2.0, entropy: float | None = None, block_tokens: int = 1 << 18, seed: int = 0, path: str | None = None) -> DataFrame:
    """A row for each time that a document (doc_id, text, source) is drawn.

    Columns: doc_id, source, h (md5 of the text, null as empty), n_tokens, weight of the source, epoch (from 0), block, block_order
    and doc_order: sort keys of the permutation in that epoch. A last, partial epoch takes documents in this order while their
    tokens fit the source's target, so a source never exceeds it. Null sources are a source of their own; repeated rows are
    drawn together, as one document of their joint length. A target that can't be met raises ValueError.
    """
    path = path or new_dir(docs.sparkSession, "mixing")
    mass = stored(token_mass(docs), f"{path}/mass")
    weights = small_side(stored(source_weights(mass, budget, max_repeats, entropy), f"{path}/weights").withColumnRenamed("source", "of"))
    at = mass.join(weights, mass["source"].eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod(drawn_key(seed, F.col("doc_id"), F.col("h")), F.ceil(F.col("tokens") / block_tokens)))
    block_order = lambda epoch: drawn_key(seed, epoch, F.col("source"), F.col("block"))
    doc_order = lambda epoch: drawn_key(seed, epoch, F.col("doc_id"), F.col("h"))
    at = stored(at.withColumns({"block_order": block_order(F.col("passes")), "doc_order": doc_order(F.col("passes"))}), f"{path}/dealt")
    earlier = blocks_before(at.groupBy("source", "block", "block_order").agg(F.sum("n_tokens").alias("block_tokens")), path)
    within = Window.partitionBy("source", "block").orderBy("doc_order", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("upto", F.sum("n_tokens").over(within))
    at = at.join(earlier, at["source"].eqNullSafe(F.col("of")) & (at["block"] == F.col("b")))
    times = F.col("passes") + F.when(F.col("earlier") + F.col("upto") <= F.col("rest"), 1).otherwise(0)
    at = at.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1)).otherwise(F.array().cast("array<bigint>"))))
    last = F.col("epoch") == F.col("passes")
    return at.select(
        "doc_id", "source", "h", "n_tokens", "weight", "epoch", "block",
        F.when(last, F.col("block_order")).otherwise(block_order(F.col("epoch"))).alias("block_order"),
        F.when(last, F.col("doc_order")).otherwise(doc_order(F.col("epoch"))).alias("doc_order"),
    )
