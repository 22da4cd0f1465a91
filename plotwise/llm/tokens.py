"""Encoding a corpus with a public byte-level BPE vocabulary, without Python in the hot path.

The texts are cut into words by the tokenizer's pattern; a word occurs often but is encoded once. Each distinct word's bytes
are folded by Spark's higher-order functions: the fold holds the pieces and the ranks of their neighbours, and every step
joins the first pair of the lowest rank. Ranks come from a literal map in the plan, split by a hash of the key so that a
lookup touches a handful of entries.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plotwise.session import materialize

#: Where the vocabularies of public tokenizers lie.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: So many of the most frequent distinct words are broadcast with their ids: an upper bound whatever the corpus. The others join by a shuffle.
HOT_WORDS = 150_000
#: And no word of more bytes.
HOT_BYTES = 128
#: The fold's work grows with the square of a word's bytes; words beyond this (runs of letters without any break) are merged by a
#: heap instead, with the same result. A fold in chunks for words of any length was tried: it took twice the CPU for all words.
FOLD_BYTES = 4096

# Letters and numbers of Unicode 16 that Java 17 (Unicode 13) doesn't know.
_LETTERS = (
    "870-887 889-88e 8b5-8b5 8c8-8c9 c5d-c5d cdd-cdd 170d-170d 171f-171f 1b4c-1b4c 1c89-1c8a 2c2f-2c2f 2c5f-2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7cd a7d0-a7d1 a7d3-a7d3 a7d5-a7dc a7f2-a7f4 "
    "10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 105c0-105f3 10780-10785 10787-107b0 107b2-107ba 10d4a-10d65 10d6f-10d85 10ec2-10ec4 10f70-10f81 "
    "11071-11072 11075-11075 1123f-11240 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11740-11746 11ab0-11abf 11bc0-11be0 11f02-11f02 11f04-11f10 11f12-11f33 "
    "12f90-12ff0 1342f-1342f 13441-13446 13460-143fa 16100-1611d 16a70-16abe 16d40-16d6c 18cff-18cff 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132-1b132 1b155-1b155 1df00-1df1e 1df25-1df2a "
    "1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e5d0-1e5ed 1e5f0-1e5f0 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af"
)
_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 11f50-11f59 16130-16139 16ac0-16ac9 16d70-16d79 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 1e5f1-1e5fa"


def _newer(ranges: str) -> str:
    return r"[\x{870}-\x{10FFFF}&&[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in (r.split("-") for r in ranges.split())) + "]]"


_L, _N = rf"\p{{L}}{_newer(_LETTERS)}", rf"\p{{N}}{_newer(_NUMBERS)}"
#: The tokenizer's pattern in Java's dialect.
PATTERN = rf"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"

_BUCKETS = 1 << 14
_NONE = 2**31 - 1


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in load_ranks(path).items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % _BUCKETS][text] = rank
    return json.dumps(buckets, separators=(",", ":"))


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return json.dumps(pieces, separators=(",", ":"))


def _let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def word_ids(word: Column, path: str = VOCABULARY) -> Column:
    """The ids of one word: its bytes, one character each, folded by rank."""
    ranks = F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")  # constant: folded into a literal once
    text = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    def fold(table: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.coalesce(F.try_element_at(F.get(table, F.pmod(F.crc32(piece.cast("binary")), F.lit(_BUCKETS)).cast("int")), piece), F.lit(_NONE))

        def step(acc: Column, _: Column) -> Column:
            def join(low: Column) -> Column:
                return _let(F.array_position(acc["r"], low).cast("int"), lambda i: _let(F.concat(F.get(acc["p"], i - 1), F.get(acc["p"], i)), lambda new: F.struct(
                    F.concat(F.slice(acc["p"], F.lit(1), i - 1), F.array(new), F.slice(acc["p"], i + 2, F.size(acc["p"]))).alias("p"),
                    F.concat(
                        F.slice(acc["r"], F.lit(1), F.greatest(i - 2, F.lit(0))),
                        F.when(i > 1, F.array(rank(F.concat(F.get(acc["p"], i - 2), new)))).otherwise(F.array().cast("array<int>")),
                        F.when(i + 1 < F.size(acc["p"]), F.array(rank(F.concat(new, F.get(acc["p"], i + 1))))).otherwise(F.array().cast("array<int>")),
                        F.slice(acc["r"], i + 2, F.size(acc["p"])),
                    ).alias("r"),
                )))

            return _let(F.array_min(acc["r"]), lambda low: F.when(low.isNull() | (low == _NONE), acc).otherwise(join(low)))

        def folded(chars: Column) -> Column:
            pairs = F.transform(F.slice(chars, F.lit(1), F.size(chars) - 1), lambda c, i: rank(F.concat(c, F.get(chars, i + 1))))
            end = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(chars) - 1, F.lit(1))), F.struct(chars.alias("p"), pairs.alias("r")), step)
            return F.transform(end["p"], rank)

        return _let(rank(text), lambda whole: F.when(whole != _NONE, F.array(whole)).otherwise(_let(F.split(text, ""), folded)))

    return F.when(word.isNotNull(), _let(ranks, fold))


def decoded_text(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of ids: their binary pieces put together. Unknown ids give nothing; null ids give null."""
    pieces = F.from_json(F.lit(_piece_json(path)), "array<string>")
    joined = _let(pieces, lambda table: F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), ""))
    return F.when(ids.isNotNull(), F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8"))


def merge_by_heap(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as the fold's, in n log n steps."""
    n = len(data)
    if data in ranks:
        return [ranks[data]]
    end, left, right, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [i + 1 for i in range(n)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != stop:
            continue
        j = right[i]
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(data[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(data[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]


def _long_words(df: DataFrame, path: str) -> DataFrame:
    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = load_ranks(path)
        for b in batches:
            yield b.assign(ids=[merge_by_heap(w.encode(), ranks) for w in b["word"]])

    return df.mapInPandas(merge, "word string, n bigint, ids array<int>")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def dictionary(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(word, n, ids): each distinct word of the corpus encoded once. Words are counted before the shuffle, so frequent ones don't weigh."""
    counted = df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # The fold is much heavier than a row: give it as many tasks as the shuffle has, whatever AQE makes of so few bytes.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    counted = materialize(counted.repartition(parts, "word"))
    short = F.octet_length("word") <= FOLD_BYTES
    folded = counted.where(short).select("word", "n", word_ids(F.col("word"), path).alias("ids"))
    long = counted.where(~short)
    return materialize(folded if long.isEmpty() else folded.unionByName(_long_words(long, path)))


def _dictionaries(df: DataFrame, text: str, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(_word, _ids) of the frequent words, bounded and to be broadcast, and of the others, None if there are none."""
    known = dictionary(df, text, path)
    # The words of the greatest counts, as many counts as fit: from the numbers of words by count, never from sorted words.
    upto = F.sum("k").over(Window.orderBy(F.desc("n")))  # a row for each count there is
    least = known.groupBy("n").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", upto).where(F.col("upto") <= HOT_WORDS).agg(F.min("n")).first()[0]
    hot = known.where((F.octet_length("word") <= HOT_BYTES) & (F.col("n") >= F.lit(least).cast("bigint")))
    hot = hot.select(F.col("word").alias("_word"), F.col("ids").alias("_ids"))
    cold = known.select(F.col("word").alias("_word"), F.col("ids").alias("_ids")).join(F.broadcast(hot.select("_word")), "_word", "left_anti")
    return F.broadcast(hot), None if cold.isEmpty() else cold


def _cut(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(_k, _h, _words): each text's words, under its keys in one struct and the hash of its text.

    Hashed and cut before any explode: beside it the text would be hashed again for each word.
    """
    return df.select(F.struct(*keys).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))


def encode(df: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(keys, ids): the ids of each text, without special tokens, the text taken as it is.

    Null and empty texts give the empty list. Rows that repeat both keys and text give one row; keys with several texts
    give one row for each. Other columns of df don't matter. The texts are shuffled once, by their keys; frequent words are
    then looked up and put together within the task that has the text, and only the rare words' ids travel to it.
    """
    hot, cold = _dictionaries(df, text, path)
    at = ["_k", "_h"]
    texts = _cut(df, keys, text).repartition(*at).select(*at, words(F.col("_text")).alias("_words"))
    met = texts.select(*at, F.posexplode_outer("_words").alias("_pos", "_word")).join(hot, "_word", "left")
    rows = met.groupBy(*at).agg(F.collect_list(F.when(F.col("_ids").isNotNull(), F.struct("_pos", "_ids"))).alias("_w"))
    if cold is not None:
        rest = met.where("_ids is null and _word is not null").drop("_ids").join(cold, "_word")
        rare = rest.groupBy(*at).agg(F.collect_list(F.struct("_pos", "_ids")).alias("_r"))
        rows = rows.join(rare, at, "left").select(*at, F.concat("_w", F.coalesce("_r", F.array().cast("array<struct<_pos:int,_ids:array<int>>>"))).alias("_w"))
    once = _let(F.sort_array("_w"), lambda w: F.when(F.size(w) > F.element_at(w, -1)["_pos"] + 1, F.array_distinct(w)).otherwise(w))
    once = F.when(F.size("_w") > 0, once).otherwise(F.col("_w"))
    ids = F.flatten(F.transform(once, lambda x: x["_ids"])).cast("array<int>")
    return rows.select(*(F.col("_k")[k].alias(k) for k in keys), ids.alias("ids"))


def token_counts(df: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(keys, tokens): the number of ids of each text; 0 for null and empty texts. Repeated rows as in encode().

    Counts are added up before the shuffle: a row for each text travels, and the rare words with their keys.
    """
    hot, cold = _dictionaries(df, text, path)
    at = ["_k", "_h"]
    count = lambda d: d.select("_word", F.size("_ids").alias("_n"))
    cut = _cut(df, keys, text).select(*at, words(F.col("_text")).alias("_words"))
    met = cut.select(*at, F.posexplode_outer("_words").alias("_pos", "_word")).join(F.broadcast(count(hot)), "_word", "left").select(*at, "_pos", "_word", "_n")
    if cold is not None:
        rest = met.where("_n is null and _word is not null").drop("_n").join(count(cold), "_word").select(*at, "_pos", "_word", "_n")
        met = met.where("_n is not null or _word is null").unionByName(rest)
    rows = met.groupBy(*at).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_sum"), F.greatest(F.lit(1), F.count(F.when(F.col("_pos") == 0, 1))).alias("_rows"))
    return rows.select(*(F.col("_k")[k].alias(k) for k in keys), (F.col("_sum") / F.col("_rows")).cast("bigint").alias("tokens"))
