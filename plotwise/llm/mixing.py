"""Mixing sources to target weights, with capped repeats and exact quotas for every output shard.

A source's documents fall into blocks of about block_tokens tokens, by a hash of their id; larger sources have more blocks.
Whole passes over the blocks and a last, partial pass make up the source's target. The copies of blocks of all sources are then
dealt to the output shards by a splitting tree: the shards are halved again and again, and each half's share of every source is
drawn from the multivariate hypergeometric distribution, so all quotas are used exactly and each shard is a random sample of the
mix. The top of the tree is split in one task for each mix, its branches in a task each. Within a source the copies are permuted
by arithmetic and dealt in that order, and a shard's rows are shuffled where they lie. No task sees more than a shard's
documents, a branch's shards or a slice of a source's blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from plotwise.session import broadcast_if_small, materialize

#: Tokens of a block, and blocks of an output shard.
BLOCK_TOKENS, SHARD_BLOCKS = 50_000, 16
#: Branches into which the top of the splitting tree is cut, and slices in which a source's blocks are added up.
BRANCHES, SLICES = 1024, 4096


def plain_source(c: Column) -> Column:
    """A source regardless of case and surrounding white space; null where nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each row of targets: what its source has, should give and can give, in tokens.

    sizes: (source, tokens) of each document; documents with a null source count in the total only. targets: mix_id, source,
    target_weight, max_repeats, budget_ratio; weights count relative to their mix, null weights and repeats as 0, a null
    budget_ratio as 1. Columns: mix_id, source, src, share, max_repeats, available, total, target, capacity, reachable.
    """
    have = sizes.groupBy(plain_source(F.col("source")).alias("src")).agg(F.sum("tokens").alias("available"))
    have = materialize(have)  # a row for each source
    total = have.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("t")).first()["t"]
    w = Window.partitionBy("mix_id")
    want = targets.select("mix_id", "source", plain_source(F.col("source")).alias("src"), F.coalesce("target_weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("budget_ratio", F.lit(1.0)).alias("budget_ratio"))
    all_weights = F.sum("weight").over(w)
    want = want.withColumn("share", F.when(all_weights > 0, F.col("weight") / F.when(all_weights > 0, all_weights)).otherwise(0.0))
    q = want.join(have.where("src is not null"), "src", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("total", F.lit(total).cast("bigint"))
    q = q.withColumn("target", F.col("share") * F.col("budget_ratio") * F.col("total")).withColumn("capacity", F.col("max_repeats") * F.col("available"))
    return q.select("mix_id", "source", "src", "share", "max_repeats", "available", "total", "target", "capacity", (F.col("capacity") >= F.col("target")).alias("reachable"))


def _draw(colours: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k copies of all, by source: multivariate hypergeometric. NumPy draws from fewer than 10**9 copies only; from more, each source's
    share is drawn in turn from the normal distribution of the same mean and variance, within what is possible, so quotas stay exact."""
    total = int(colours.sum())
    if total < 10**9:
        return rng.multivariate_hypergeometric(colours, k, method="marginals")
    out = np.zeros_like(colours)
    for i, c in enumerate(map(int, colours)):
        p = c / total if total else 0.0
        sd = math.sqrt(max(0.0, k * p * (1 - p) * (total - k) / max(1, total - 1)))
        out[i] = min(max(round(rng.normal(k * p, sd)), k - (total - c), 0), c, k)
        total, k = total - c, k - int(out[i])
    return out


def split_tree(colours: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(parts, sources): how many copies of each source each part gets; columns add up to colours, rows to room."""
    out = np.zeros((len(room), len(colours)), dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(room)])
    todo = [(0, len(room), colours.astype(np.int64))]
    while todo:
        lo, hi, some = todo.pop()
        if hi - lo == 1:
            out[lo] = some
            continue
        mid = (lo + hi) // 2
        left = _draw(some, int(upto[mid] - upto[lo]), rng)
        todo += [(lo, mid, left), (mid, hi, some - left)]
    return out


def _room(copies: int, shards: int, lo: int, hi: int) -> np.ndarray:
    """How many copies the shards lo to hi - 1 hold, as even as they can be."""
    return copies // shards + (np.arange(lo, hi) < copies % shards).astype(np.int64)


_BRANCH = "mix_id string, src string, lo bigint, hi bigint, shards bigint, copies bigint, first bigint, dealt bigint"
_DEALT = "mix_id string, src string, shard bigint, first bigint, dealt bigint"


def _top(shard_blocks: int, branches: int, seed: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src").reset_index(drop=True)
        mix, counts = str(pdf["mix_id"].iloc[0]), pdf["copies"].to_numpy(dtype=np.int64)
        copies = int(counts.sum())
        shards = max(1, -(-copies // shard_blocks))
        edges = np.unique(np.linspace(0, shards, min(shards, branches) + 1).astype(np.int64))
        room = np.array([_room(copies, shards, lo, hi).sum() if hi - lo < 1 << 20 else (hi - lo) * (copies // shards) + max(0, min(hi, copies % shards) - lo) for lo, hi in zip(edges, edges[1:], strict=False)])
        dealt = split_tree(counts, room, np.random.default_rng([seed, *mix.encode()]))
        first = np.cumsum(dealt, axis=0) - dealt
        branch, src = np.nonzero(dealt)
        return pd.DataFrame({"mix_id": mix, "src": pdf["src"].to_numpy()[src], "lo": edges[:-1][branch], "hi": edges[1:][branch], "shards": shards, "copies": copies, "first": first[branch, src], "dealt": dealt[branch, src]})

    return split


def _leaves(seed: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src").reset_index(drop=True)
        mix, lo, hi = str(pdf["mix_id"].iloc[0]), int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        room = _room(int(pdf["copies"].iloc[0]), int(pdf["shards"].iloc[0]), lo, hi)
        dealt = split_tree(pdf["dealt"].to_numpy(dtype=np.int64), room, np.random.default_rng([seed, lo, hi, *mix.encode()]))
        first = np.cumsum(dealt, axis=0) - dealt
        shard, src = np.nonzero(dealt)
        return pd.DataFrame({"mix_id": mix, "src": pdf["src"].to_numpy()[src], "shard": lo + shard, "first": pdf["first"].to_numpy()[src] + first[shard, src], "dealt": dealt[shard, src]})

    return split


def _blocks(sizes: DataFrame, q: DataFrame, seed: int, block_tokens: int) -> DataFrame:
    """(doc, src, tokens, hash, block) of the documents of the sources in q."""
    per_source = q.select("src", "n_blocks").distinct()
    docs = sizes.withColumn("src", plain_source(F.col("source"))).join(F.broadcast(per_source), "src")  # a row for each source of mix_target
    return docs.withColumn("hash", F.xxhash64("doc", F.lit(seed))).select("doc", "src", "tokens", "hash", F.pmod(F.xxhash64("hash"), F.col("n_blocks")).alias("block"))


def _plan(sizes: DataFrame, targets: DataFrame, seed: int, block_tokens: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, blocks, plan). blocks: src, block. plan, a row for each source of a mix: n_blocks, full passes over them, and the
    blocks 0 to last_block of one more pass (-1: none), of the last of them so many tokens as room says; copies is their number.
    """
    t = targets.withColumn("source", plain_source(F.col("source"))).where("source is not null and mix_id is not null")
    t = t.groupBy("mix_id", "source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
    q = quotas(sizes, t).where("available > 0 and target > 0 and max_repeats > 0")
    q = q.withColumn("give", F.least(F.col("target"), F.col("capacity").cast("double"))).withColumn("full", F.floor(F.col("give") / F.col("available")))
    q = q.withColumn("rest", F.col("give") - F.col("full") * F.col("available")).withColumn("n_blocks", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("available") / block_tokens)))
    q = materialize(q.select("mix_id", "src", "full", "rest", "n_blocks"))
    docs = _blocks(sizes, q, seed, block_tokens)
    sums = materialize(docs.groupBy("src", "block").agg(F.sum("tokens").alias("size")))
    # Where the partial pass ends: first the slice of blocks, then the block within it.
    slice_of = F.floor(F.col("block") / F.ceil(F.col("n_blocks") / SLICES))
    met = sums.join(F.broadcast(q), "src").withColumn("slice", slice_of)  # a row for each source of a mix
    upto = lambda w: F.sum("size").over(w) - F.col("size")
    slices = met.groupBy("mix_id", "src", "slice", "rest").agg(F.sum("size").alias("size")).withColumn("before", upto(Window.partitionBy("mix_id", "src").orderBy("slice")))
    end = slices.where(F.col("before") < F.col("rest")).groupBy("mix_id", "src").agg(F.max_by(F.struct("slice", "before"), "slice").alias("e"))
    within = met.join(F.broadcast(end), ["mix_id", "src"]).where(F.col("slice") == F.col("e.slice"))
    within = within.withColumn("start", F.col("e.before") + upto(Window.partitionBy("mix_id", "src").orderBy("block"))).where(F.col("start") < F.col("rest"))
    cut = within.groupBy("mix_id", "src").agg(F.max("block").alias("last_block"), F.max_by(F.col("rest") - F.col("start"), "block").alias("room"))
    plan = q.join(cut, ["mix_id", "src"], "left").withColumn("last_block", F.coalesce("last_block", F.lit(-1).cast("bigint")))
    return docs, sums.select("src", "block"), materialize(plan.withColumn("copies", F.col("full") * F.col("n_blocks") + F.col("last_block") + 1))


def _deal(plan: DataFrame, seed: int, shard_blocks: int, branches: int) -> DataFrame:
    """(mix_id, src, shard, first, dealt): which of each source's permuted copies go to each shard."""
    top = materialize(plan.where("copies > 0").select("mix_id", "src", "copies").groupBy("mix_id").applyInPandas(_top(shard_blocks, branches, seed), _BRANCH))
    return top.groupBy("mix_id", "lo").applyInPandas(_leaves(seed), _DEALT)


def _step(copies: int) -> int:
    """A number near the golden section of copies that has no divisor in common with it: its multiples run through all places."""
    a = max(1, int(copies * 0.6180339887498949))
    while math.gcd(a, copies) != 1:
        a += 1
    return a % copies if copies > 1 else 0


@F.pandas_udf(LongType())
def _steps(copies: pd.Series) -> pd.Series:
    return copies.map(lambda n: _step(int(n)))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 7, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, branches: int = BRANCHES, key: str = "doc_id") -> DataFrame:
    """(mix_id, source, shard, pos, doc_id, pass, tokens): the documents of each mix, shuffled within their shards.

    sizes: (doc_id, source, tokens). A source gives its target, to half a document, or all it may if that is less; no
    document comes in more than max_repeats passes. Empty documents cost nothing and come along with their block. Sources
    that a mix names twice count once, with the sum of their weights and the larger max_repeats.
    """
    sizes = materialize(sizes.select(F.col(key).alias("doc"), "source", "tokens"))
    docs, blocks, plan = _plan(sizes, targets, seed, block_tokens)
    steps = materialize(plan.withColumn("step", _steps("copies")))  # a row for each source of a mix
    passes = F.sequence(F.lit(0).cast("bigint"), F.col("full") - F.when(F.col("block") <= F.col("last_block"), 0).otherwise(1))
    met = blocks.join(F.broadcast(steps.where("copies > 0")), "src").where(F.col("full") + F.when(F.col("block") <= F.col("last_block"), 1).otherwise(0) > 0)
    copies = met.select("mix_id", "src", "block", F.explode(passes).alias("pass"), "full", "last_block", "room", "n_blocks", "copies", "step")
    # The place is (number of the copy * step) modulo copies, multiplied in two parts so that it doesn't overflow.
    c, step, n, part = F.col("pass") * F.col("n_blocks") + F.col("block"), F.col("step"), F.col("copies"), 1 << 16
    copies = copies.withColumn("at", F.pmod(F.pmod(c * F.floor(step / part), n) * part + c * F.pmod(step, F.lit(part)), n))
    room = F.when((F.col("pass") == F.col("full")) & (F.col("block") == F.col("last_block")), F.col("room"))
    dealt = _deal(plan, seed, shard_blocks, branches).select("mix_id", "src", "shard", F.explode(F.sequence("first", F.col("first") + F.col("dealt") - 1)).alias("at"))
    placed = copies.withColumn("room", room).join(dealt, ["mix_id", "src", "at"]).select("mix_id", "src", "block", F.col("pass").cast("int").alias("pass"), "room", "shard")
    rows = docs.join(broadcast_if_small(materialize(placed), 64), ["src", "block"])
    # In a partial block documents come in the order of their hashes until the room is used, to half a document.
    whole = rows.where("room is null")
    part = rows.where("room is not null")
    used = F.sum("tokens").over(Window.partitionBy("mix_id", "src", "block").orderBy("hash", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = part.withColumn("used", used).where(F.col("used") - F.col("tokens") / 2 <= F.col("room")).drop("used")
    shuffled = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64("hash", "pass", F.lit(seed + 1)), "doc", "pass")
    out = whole.unionByName(part).withColumn("pos", F.row_number().over(shuffled))
    return out.select("mix_id", F.col("src").alias("source"), "shard", "pos", F.col("doc").alias(key), "pass", "tokens")


def short(sizes: DataFrame, targets: DataFrame, seed: int = 7, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, branches: int = BRANCHES, key: str = "doc_id") -> DataFrame:
    """(mix_id, source): the rows of targets whose source can't reach its share: the splitting tree has dealt every copy there may be,
    and what these hold is, by an exact check, less than the target. Sources without documents have no copies and are short of any target."""
    sizes = materialize(sizes.select(F.col(key).alias("doc"), "source", "tokens"))
    _, _, plan = _plan(sizes, targets, seed, block_tokens)
    dealt = _deal(plan, seed, shard_blocks, branches).groupBy("mix_id", "src").agg(F.sum("dealt").alias("dealt"))
    dealt = dealt.join(plan.select("mix_id", "src", "n_blocks"), ["mix_id", "src"])
    rows = quotas(sizes, targets).join(dealt, ["mix_id", "src"], "left")
    used = F.coalesce("dealt", F.lit(0)) >= F.coalesce(F.col("max_repeats") * F.col("n_blocks"), F.lit(0))
    return rows.where(used & ~F.col("reachable")).select("mix_id", "source")


def report(mixed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shares reached: (mix_id, source, target_share, tokens, share, copies, most_repeats) for each row of quotas()."""
    got = mixed.groupBy("mix_id", "source", "doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t"))
    got = got.groupBy("mix_id", F.col("source").alias("src")).agg(F.sum("t").alias("tokens"), F.sum("k").alias("copies"), F.max("k").alias("most_repeats"))
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_id"))
    rows = wanted.select("mix_id", "source", "src", "share").join(got, ["mix_id", "src"], "left")
    share = F.when(all_tokens > 0, F.coalesce("tokens", F.lit(0)) / F.when(all_tokens > 0, all_tokens)).otherwise(0.0)
    return rows.select("mix_id", "source", F.round("share", 6).alias("target_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(share, 6).alias("share"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
