"""Problem 8: mixing sources to target weights.

The tokens of a source, in a pseudorandom document order, are packed into blocks of fixed length.
The mixture is drawn in whole blocks: its size is the largest for which every source can give its
share without any block being used more than the source's cap. Each output shard draws its source counts from a
multinomial whose weights are what every source still has to give; a count beyond that is drawn anew among the
others, so the last shard takes what is left and the shares are met up to one block. Slot k
of a source maps to block perm(k mod N) of pass k div N, perm being a keyed Feistel permutation of the index,
another one in each pass, and slots join blocks by index.

Offsets come from a two-level prefix sum over hash buckets, so a source holding most rows is no hot
task. Slots are made in pieces of bounded length in parallel. Only one row per source, and sources x shards draws, ever reach the driver.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.tokenizer import VOCABULARY, count_tokens
from kgloom.sources.writers import materialise

# tokens of a block; hash buckets of the prefix sum; shards at least, and blocks of a shard at most; slots made together
BLOCK, BUCKETS, SHARDS, SHARD_BLOCKS, PIECE, SEED = 256, 256, 64, 1 << 20, 1 << 16, 20240607


def sized_documents(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of documents whose source has a target; a null source takes no part."""
    known = docs.join(F.broadcast(targets.select("source").where("source IS NOT NULL AND target_share > 0").distinct()), "source", "left_semi")  # one row per source of the recipe
    return count_tokens(known, ["doc_id", "source"], "text", vocabulary)


def packed_offsets(sizes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``first`` (offset of the document's first token within its source) by a two-level prefix sum."""
    b = sizes.where("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    sums = b.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows a source
    base = sums.select("source", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    v = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return b.join(base.hint("merge"), ["source", "bucket"]).withColumn("first", F.col("base") + F.coalesce(F.sum("n_tokens").over(v), F.lit(0))).drop("base", "bucket")


def plan(totals: list[tuple[str, float, int, int]], block: int = BLOCK, seed: int = SEED, blocks: int | None = None) -> list[dict]:
    """Blocks to draw from each source: rows of (source, share, cap, tokens). Shares of sources without tokens go to the others in proportion."""
    live = [(s, p, c, n, -(-n // block)) for s, p, c, n in sorted(totals) if n > 0 and p > 0 and c > 0]
    if not live:
        return []
    whole = sum(p for _, p, *_ in live)
    most = int(min(c * nb / (p / whole) for _, p, c, _, nb in live))
    total = most if blocks is None else min(blocks, most)
    ideal = [total * p / whole for _, p, *_ in live]
    take = [min(int(x), c * nb) for x, (_, _, c, _, nb) in zip(ideal, live)]
    for i in sorted(range(len(live)), key=lambda i: take[i] - ideal[i])[:max(0, total - sum(take))]:
        if take[i] < live[i][2] * live[i][4]:
            take[i] += 1
    return [{"source": s, "take": k, "n_blocks": nb} for (s, p, c, n, nb), k in zip(live, take)]


def shard_draws(rows: list[dict], shards: int = SHARDS, seed: int = SEED) -> list[tuple[int, str, int]]:
    """(shard, source, blocks): multinomial draws weighted by what each source still has to give; what exceeds that is drawn anew."""
    rng, left = np.random.default_rng(seed + 1), np.array([r["take"] for r in rows], np.int64)
    out, total = [], int(left.sum())
    for k in range(shards):
        size, got = total * (k + 1) // shards - total * k // shards, np.zeros(len(rows), np.int64)
        while size:
            new = np.minimum(rng.multinomial(size, left / left.sum()), left)
            got, left, size = got + new, left - new, size - int(new.sum())
        out += [(k, r["source"], int(g)) for r, g in zip(rows, got)]
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of 0..n-1: four Feistel rounds over the next even power of two, walked until inside."""
    half = np.uint64(((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << int(half)) - 1)

    def walk(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in range(4):
            f = (b + np.uint64((key * 4 + k) % (1 << 63))) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (a << half) | b
    y = walk(i.astype(np.uint64))
    while (out := y >= np.uint64(n)).any():
        y[out] = walk(y[out])
    return y.astype(np.int64)


def slots(spark, rows: list[dict], shards: int = SHARDS, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """(shard, source, block): one row per drawn slot, made in parallel from the draws in pieces of at most ``piece`` slots."""
    draws, at = [], {r["source"]: 0 for r in rows}
    by = {r["source"]: (r["n_blocks"], k) for k, r in enumerate(rows)}
    for k, s, g in shard_draws(rows, max(shards, -(-sum(r["take"] for r in rows) // SHARD_BLOCKS)), seed):
        if g:
            draws.append((k, s, at[s], at[s] + g, *by[s]))
            at[s] += g
    d = spark.createDataFrame(draws, "shard INT, source STRING, lo BIGINT, hi BIGINT, nb BIGINT, key INT")
    d = d.withColumn("lo", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(piece).cast("bigint")))).withColumn("hi", F.least("hi", F.col("lo") + piece))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in b.to_pylist():
                k = np.arange(r["lo"], r["hi"])
                block = np.empty(len(k), np.int64)
                for p in np.unique(k // r["nb"]):
                    here = k // r["nb"] == p
                    block[here] = permuted(k[here] % r["nb"], r["nb"], seed + 1_000_003 * r["key"] + 7919 * int(p))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), r["shard"], np.int32)), pa.array([r["source"]] * len(k), pa.string()), pa.array(block)], ["shard", "source", "block"])
    return d.repartition(max(1, min(len(draws), shards)), "shard", "source", "lo").mapInArrow(run, "shard int, source string, block bigint")


def _prepared(docs: DataFrame, targets: DataFrame, block: int, vocabulary: str, blocks: int | None) -> tuple[DataFrame, list[dict], list]:
    sizes = materialise(sized_documents(docs, targets, vocabulary), "sizes")
    t = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("p"), F.max("max_repeats").alias("c"))
    totals = t.join(sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")), "source", "left").orderBy("source").collect()  # one row per source of the recipe
    return sizes, plan([(r.source, r.p, r.c, r.n or 0) for r in totals], block, blocks=blocks), totals


def mix(docs: DataFrame, targets: DataFrame, block: int = BLOCK, vocabulary: str = VOCABULARY, blocks: int | None = None) -> DataFrame:
    """The chosen documents: (doc_id, source, n_tokens, repeats, tokens_used).

    ``repeats`` is how often the most used part of the document is drawn, at most the source's cap;
    ``tokens_used`` counts every drawn token. Documents of which nothing is drawn are left out, as are
    null sources, sources without target and documents without tokens; empty tables give no rows.
    """
    spark = docs.sparkSession
    sizes, rows, _ = _prepared(docs, targets, block, vocabulary, blocks)
    if not rows:
        return sizes.select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats"), F.lit(0).cast("bigint").alias("tokens_used")).where("false")
    uses = slots(spark, rows).groupBy("source", "block").agg(F.count("*").cast("int").alias("uses"))
    parts = packed_offsets(sizes).withColumn("block", F.explode(F.sequence((F.col("first") / block).cast("bigint"), ((F.col("first") + F.col("n_tokens") - 1) / block).cast("bigint"))))
    own = F.least(F.col("first") + F.col("n_tokens"), (F.col("block") + 1) * block) - F.greatest(F.col("first"), F.col("block") * block)
    j = parts.withColumn("own", own).join(uses.hint("merge"), ["source", "block"])  # grows with the corpus: never broadcast
    return j.groupBy("doc_id", "source", "n_tokens").agg(F.max("uses").alias("repeats"), F.sum(F.col("own") * F.col("uses")).cast("bigint").alias("tokens_used"))


def shares(docs: DataFrame, targets: DataFrame, block: int = BLOCK, vocabulary: str = VOCABULARY, blocks: int | None = None) -> DataFrame:
    """Per source of the recipe: target and actual share of the drawn tokens, tokens held and drawn, documents and blocks drawn, most repeats of a block."""
    spark = docs.sparkSession
    _, rows, totals = _prepared(docs, targets, block, vocabulary, blocks)
    held = {r.source: (r.p, r.c, r.n or 0, r.d or 0) for r in totals}
    drawn = {r["source"]: r for r in rows}
    out = []
    if rows:
        short = {s: n - (-(-n // block) - 1) * block for s, (_, _, n, _) in held.items() if n}  # length of the last block
        last = {(r.source): r.n for r in slots(spark, rows).join(F.broadcast(spark.createDataFrame([(r["source"], r["n_blocks"] - 1) for r in rows], "source STRING, block BIGINT")),
                                                                ["source", "block"], "left_semi").groupBy("source").agg(F.count("*").alias("n")).collect()}
        used = {s: r["take"] * block - last.get(s, 0) * (block - short[s]) for s, r in drawn.items()}
        whole = sum(used.values())
    for s, (p, c, n, d) in held.items():
        r = drawn.get(s)
        u = used[s] if r else 0
        out.append((s, p, float(u / whole) if r and whole else 0.0, n, u, d, r["take"] if r else 0, -(-r["take"] // r["n_blocks"]) if r else 0, c))
    return spark.createDataFrame(out, "source STRING, target_share DOUBLE, actual_share DOUBLE, tokens_held BIGINT, tokens_drawn BIGINT, documents_held BIGINT, blocks_drawn BIGINT, most_repeats INT, max_repeats INT")
