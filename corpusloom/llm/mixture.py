"""Mixing sources to target token shares, with capped repeats.

A source's tokens are packed in hash order of its documents into blocks of ``block_tokens`` tokens, whatever the
documents' ends; the last block of a source may be shorter.  Each output shard draws its number of blocks
of each source from a multinomial law conditioned on the exact quotas (a multivariate hypergeometric
draw), so that the shares hold for the whole mix; the source's slots go through one pseudorandom index
permutation per pass over the source, and blocks are joined by index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.bpe import count_tokens
from corpusloom.runtime import materialise


#: Output shards that are drawn for; with more blocks the shards get larger, so the draws stay a small table.
MAX_SHARDS = 10_000


def source_name(c: Column) -> Column:
    """Source without letter case and surrounding white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1: a keyed Feistel network with cycle walking."""
    index, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.ceil(np.log2(np.maximum(size.astype(np.float64), 2)) / 2).astype(np.uint64)
    half += (np.uint64(1) << (half + half)) < size
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0x51ED2701 + 1)
            f = (f ^ f >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (f >> np.uint64(31) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


@dataclass
class Mixture:
    """``uses``: doc_id, source, n_tokens, uses (of its most used block), used_tokens; ``shares``: one row per row of the targets."""

    uses: DataFrame
    shares: DataFrame


def short_sources(m: Mixture) -> DataFrame:
    """``source`` of the targets whose drawn blocks have fewer tokens than their share of the mix, and whose capacity, all tokens as often as allowed, has too."""
    return m.shares.where("used_tokens < target_tokens AND unreachable").select("source")


def mix(documents: DataFrame, targets: DataFrame, *, block_tokens: int = 2048, shard_blocks: int = 4096, bucket_docs: int = 500_000, seed: int = 42, vocabulary: str | None = None) -> Mixture:
    """Mix ``documents`` (doc_id, text, source) to ``targets`` (source, target_share, max_repeats).

    The mix is as large as all texts together.  A null share counts as 0 and a null or negative cap
    as 0 repeats.  Targets whose names agree without case and blanks share their documents: shares
    add up, the larger cap holds.  Documents without a target, and sources without documents, are in
    no block; the latter still have a row in ``shares``, whose ``actual_share`` is of the mix aimed at
    and ``share_of_mix`` of the mix that came out (targets of one name each show its tokens).  The targets are a table of settings, one
    row per source, and are read by the driver.
    """
    spark = documents.sparkSession
    d = documents.select("doc_id", "text", source_name(F.col("source")).alias("name"))
    sized = materialise(count_tokens(d, ["doc_id", "name"], **({"vocabulary": vocabulary} if vocabulary else {})), "mix-sizes")
    rows = targets.select("source", source_name(F.col("source")).alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("repeats")).collect()
    wanted: dict[str, list[float]] = {}
    for r in rows:
        w = wanted.setdefault(r["name"], [0.0, 0])
        w[0], w[1] = w[0] + r["share"], max(w[1], r["repeats"])
    names = spark.createDataFrame([(k,) for k in wanted if k is not None], "name string")

    by_name = {r["name"]: (r["tokens"], r["docs"]) for r in sized.join(F.broadcast(names), "name").groupBy("name").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0

    # Blocks: a running sum within (source, hash bucket) and the tokens of the buckets before, so no source is laid out by a single task.
    buckets = max(1, -(-max([1, *(n for _, n in by_name.values())]) // bucket_docs))
    key = F.xxhash64("doc_id")
    keyed = sized.join(F.broadcast(names), "name").where("n_tokens > 0").select("*", key.alias("order"), F.pmod(key, F.lit(buckets)).alias("bucket"))
    per_bucket = keyed.groupBy("name", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = per_bucket.select("name", "bucket", (F.sum("n").over(Window.partitionBy("name").orderBy("bucket")) - F.col("n")).alias("base"))
    w = Window.partitionBy("name", "bucket").orderBy("order", "doc_id")
    run = keyed.withColumn("local", F.sum("n_tokens").over(w) - F.col("n_tokens")).join(F.broadcast(before) if len(wanted) * buckets <= 100_000 else before, ["name", "bucket"])
    at = F.col("base") + F.col("local")
    size = F.lit(block_tokens)
    parts = run.select("doc_id", "name", "n_tokens", at.alias("at"), F.explode(F.sequence(F.floor(at / size), F.floor((at + F.col("n_tokens") - 1) / size))).alias("block"))
    held = F.least(F.col("at") + F.col("n_tokens"), (F.col("block") + 1) * size) - F.greatest(F.col("at"), F.col("block") * size)
    laid = materialise(parts.select("doc_id", "name", "n_tokens", "block", held.alias("held")), "mix-blocks")
    blocks = {k: -(-int(t) // block_tokens) for k, (t, _) in by_name.items() if t}

    # Quotas and the shards' draws; one number per source and shard.
    order = sorted(k for k in blocks if k is not None)
    quota = np.array([min(blocks[k] * wanted[k][1], round(wanted[k][0] * total * blocks[k] / by_name[k][0])) for k in order], np.int64)
    shards = min(MAX_SHARDS, max(1, -(-int(quota.sum()) // shard_blocks)))
    rng, left, draws = np.random.default_rng(seed), quota.copy(), []
    for s in range(shards):
        size = int(left.sum()) // (shards - s)
        got = rng.multivariate_hypergeometric(left, size, method="marginals") if len(left) else left
        draws += [(s, k, int(quota[j] - left[j]), int(got[j]), int(blocks[k])) for j, k in enumerate(order) if got[j]]
        left = left - got
    slots = spark.createDataFrame(draws, "shard long, name string, first long, n long, blocks long")
    slots = slots.select("shard", "name", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))

    @F.pandas_udf("long")
    def block_at(slot: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        s, n = slot.to_numpy(), size.to_numpy()
        return pd.Series(permuted(s % n, n, key.to_numpy() ^ (s // n)))

    used = slots.select("name", block_at("slot", "blocks", F.xxhash64("name", F.lit(seed))).alias("block")).groupBy("name", "block").agg(F.count("*").alias("uses"))
    drawn = laid.join(used, ["name", "block"], "left").select("doc_id", "name", "n_tokens", "held", F.coalesce("uses", F.lit(0)).alias("uses"))
    uses = drawn.groupBy("doc_id", F.col("name").alias("source"), "n_tokens").agg(F.max("uses").alias("uses"), F.sum(F.col("held") * F.col("uses")).alias("used_tokens"))
    empty = sized.join(F.broadcast(names), "name").where("n_tokens = 0").select("doc_id", F.col("name").alias("source"), "n_tokens", F.lit(0).cast("long").alias("uses"), F.lit(0).cast("long").alias("used_tokens"))

    # Tokens drawn and tokens there of each source, from the blocks; a target's share and cap beside them.
    reached = drawn.groupBy("name").agg(F.sum(F.col("uses") * F.col("held")).alias("used_tokens"), F.max("uses").alias("most_uses"), F.sum("held").alias("source_tokens"))
    facts = spark.createDataFrame([(r["source"], r["name"], float(r["share"]), int(r["repeats"])) for r in rows], "source string, name string, target_share double, max_repeats int")
    zero = F.lit(0).cast("long")
    shares = facts.join(reached, "name", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("source_tokens", zero).alias("source_tokens"), F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce("most_uses", zero).alias("most_uses"),
        (F.col("target_share") * F.lit(int(total))).alias("target_tokens"))
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", F.lit(int(total))), F.lit(0.0))).withColumn("unreachable", F.col("target_tokens") > F.col("source_tokens") * F.col("max_repeats"))
    mixed = F.sum("used_tokens").over(Window.partitionBy())  # the table of targets
    shares = shares.withColumn("share_of_mix", F.coalesce(F.try_divide("used_tokens", mixed), F.lit(0.0)))
    return Mixture(uses.unionByName(empty), shares)
