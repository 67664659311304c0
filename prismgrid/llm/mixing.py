"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Blocks of tokens go to the source with the highest quotient weight / (2 * seats + 1),
until no block is left; a source whose documents are used up at the most repeats allowed
takes no further block. A source's blocks are whole passes over all its documents plus a
rest, which is apportioned the same way to hashed shards of the source. Each shard takes
documents in seeded order as long as its quota holds them whole, then the one document of
the others that comes nearest to what is left. No task orders more than one shard.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismgrid.llm.bpe import count_tokens
from prismgrid.session import checkpoint

#: Tokens of one block, the unit of apportionment.
BLOCK = 32
#: Tokens of a shard and the most shards of a source, whichever gives fewer shards.
SHARD_TOKENS, MOST_SHARDS = 1_000_000, 4096


def apportion(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Sainte-Laguë seats under caps: highest quotients first, ties to the earlier entry.

    All quotients above a divisor are taken at once, found by bisection; the few left go
    one by one. Seats that no entry may take stay free.
    """
    if not weights or seats <= 0:
        return [0] * len(weights)

    def taken(scale: float) -> list[int]:
        return [min(c, math.floor(w * scale + 0.5)) if w > 0 else 0 for w, c in zip(weights, caps, strict=True)]

    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    low, high = 0.0, 1.0
    while sum(taken(high)) < seats:
        low, high = high, high * 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(taken(middle)) <= seats else (low, middle)
    given = taken(low * (1 - 1e-9))  # quotients equal to the divisor are left to the queue
    while sum(given) > seats:  # ties at the divisor of the first step
        k = max((i for i in range(len(given)) if given[i]), key=lambda i: ((2 * given[i] - 1) / weights[i], i))
        given[k] -= 1
    queue = [(-w / (2 * g + 1), i) for i, (w, g, c) in enumerate(zip(weights, given, caps, strict=True)) if w > 0 and g < c]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def mix_sources(
    documents: DataFrame,
    mix_targets: DataFrame,
    seed: int = 0,
    total_tokens: int | None = None,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Chosen documents and actual shares of every mix.

    The choice is (mix_id, doc_id, source, repeats, n_tokens), one row per chosen
    document; the shares are (mix_id, source, target_share, reachable_share,
    actual_share, tokens, documents, most_repeats, max_repeats), one row per target.

    Without ``total_tokens`` a mix has the largest size at which each source that has
    tokens holds its share; with it, sources that cannot hold their share are used up
    and the others fill their own shares only. Weights are relative to their mix; null,
    negative and zero weights and null repeats give nothing; several targets of one
    source in a mix are added up, with the least of their repeats. Documents without
    tokens are never chosen. Sources without documents get share 0, the others'
    ``reachable_share`` is relative to what is left. Empty tables give no choice.
    """
    spark = documents.sparkSession
    mixes = (
        mix_targets.where("target_share > 0 and max_repeats > 0 and mix_id is not null and source is not null")
        .groupBy("mix_id", "source")
        .agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r"))
    )
    counted = count_tokens(documents, path).where("n_tokens > 0 and source is not null")
    counted = checkpoint(counted.join(mixes.select("source").distinct(), "source", "left_semi"))
    # One row per target: bounded by the table of mixes, not by the documents.
    targets = (
        mixes.join(counted.groupBy("source").agg(F.sum("n_tokens").alias("have")), "source", "left")
        .orderBy("mix_id", "source")
        .collect()
    )
    have = {t.source: t.have for t in targets if t.have}
    shards = {s: max(1, min(MOST_SHARDS, math.ceil(n / SHARD_TOKENS))) for s, n in have.items()}
    shard_rows = spark.createDataFrame([(s, n) for s, n in shards.items()] or [("", 0)], "source string, n_shards int")
    placed = counted.join(shard_rows, "source").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_shards")).cast("int")
    )
    in_shard: dict[str, list[tuple[int, int]]] = {}
    for row in placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).orderBy("source", "shard").collect():
        in_shard.setdefault(row.source, []).append((row.shard, row.n))  # at most MOST_SHARDS a source

    plan, report = [], []
    for mix in sorted({t.mix_id for t in targets}):
        own = [t for t in targets if t.mix_id == mix]
        live = [t for t in own if t.have]
        weight, reach = sum(t.w for t in own), sum(t.w for t in live)
        size = total_tokens or min((t.have * t.r * reach / t.w for t in live), default=0)
        # A source takes no seat beyond its weight's share, even if others cannot fill theirs.
        caps = [min(t.have * t.r // BLOCK, math.ceil(size * t.w / reach / BLOCK)) for t in live]
        seats = dict(zip([t.source for t in live], apportion([t.w for t in live], int(size // BLOCK), caps), strict=True))
        for t in own:
            report.append((mix, t.source, t.w / weight, t.w / reach if t.have else 0.0, t.r))
        for t in live:
            quota = seats[t.source] * BLOCK
            if seats[t.source] >= t.have * t.r // BLOCK:  # all it can give, the part of a block at its end too
                quota = t.have * t.r
            passes, rest = min(t.r, quota // t.have), quota % t.have
            sizes = in_shard[t.source]
            extra = apportion([float(n) for _, n in sizes], rest // BLOCK, [n // BLOCK + 1 for _, n in sizes])
            for (shard, _), blocks in zip(sizes, extra, strict=True):
                plan.append((mix, t.source, shard, passes, blocks * BLOCK if passes < t.r else 0))
    quotas = spark.createDataFrame(plan, "mix_id int, source string, shard int, passes int, quota bigint")
    shard = W.partitionBy("mix_id", "source", "shard")
    turn = F.struct(F.xxhash64("doc_id", "mix_id", F.lit(seed)).alias("h"), "doc_id")
    upto = F.sum("n_tokens").over(shard.orderBy(turn).rowsBetween(W.unboundedPreceding, 0))
    held = F.coalesce(F.max(F.when(F.col("upto") <= F.col("quota"), F.col("upto"))).over(shard), F.lit(0))
    off = F.abs(F.col("n_tokens") - F.col("gap"))
    nearest = F.when((F.col("upto") > F.col("quota")) & (off < F.col("gap")), F.struct(off.alias("off"), turn.alias("turn")))
    taken = (F.col("upto") <= F.col("quota")) | F.coalesce(F.col("near") == F.col("nearest"), F.lit(False))
    choice = (
        placed.join(quotas.where("passes > 0 or quota > 0"), ["source", "shard"])
        .withColumn("upto", upto)
        .withColumn("gap", F.col("quota") - held)
        .withColumn("near", nearest)
        .withColumn("nearest", F.min("near").over(shard))
        .withColumn("repeats", F.col("passes") + taken.cast("int"))
        .where("repeats > 0")
        .select("mix_id", "doc_id", "source", "repeats", "n_tokens")
    )
    used = choice.groupBy("mix_id", "source").agg(
        F.sum(F.col("repeats") * F.col("n_tokens")).alias("tokens"),
        F.count("*").alias("documents"),
        F.max("repeats").alias("most_repeats"),
    )
    listed = spark.createDataFrame(
        report, "mix_id int, source string, target_share double, reachable_share double, max_repeats int"
    )
    shares = (
        listed.join(used, ["mix_id", "source"], "left")
        .fillna(0, ["tokens", "documents", "most_repeats"])
        .withColumn("total", F.sum("tokens").over(W.partitionBy("mix_id")))
        .select(
            "mix_id",
            "source",
            "target_share",
            "reachable_share",
            F.coalesce(F.try_divide(F.col("tokens").cast("double"), "total"), F.lit(0.0)).alias("actual_share"),
            "tokens",
            "documents",
            "most_repeats",
            "max_repeats",
        )
    )
    return choice, shares
