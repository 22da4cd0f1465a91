"""Encoding against the public library, decoding as an exact round trip, and mixing against its quotas."""

import pytest
from pyspark.sql import functions as F

from plotwise.llm import mixing, tokens

TEXTS = [
    None, "", " ", "\n\n  x", "Hello world, it's 2024! We'll see.", "東京都千代田区１−２−３、ビル名　5階", "naïve café ﬁ ​‍ 👩‍👩‍👧 ½ ٣ Ⅷ", "<|endoftext|>", "a" * 5000, "日本語" * 1500, "tab\there\r\nand nbsp　x  ", "ࡰ㈺f \U000323af", "don't DON'T 's", "x" * 10 + " " * 300 + "y", "\x00\x1f\x7f�",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, word string")


def test_ids(docs):
    lib = pytest.importorskip("tokenizers")
    own = lib.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    own.encode_special_tokens = True
    want = [own.encode(t, add_special_tokens=False).ids if t else [] for t in TEXTS]
    got = {r.doc_id: list(r.ids) for r in tokens.encode(docs).collect()}
    assert [got[k] for k in range(len(TEXTS))] == want and len(got) == len(TEXTS)
    assert {r.doc_id: r.tokens for r in tokens.token_counts(docs).collect()} == {k: len(w) for k, w in enumerate(want)}
    assert tokens.encode(docs).count() == len(TEXTS) and tokens.encode(docs.limit(0)).count() == 0


def test_round_trip(docs):
    got = {r.doc_id: r.t for r in tokens.encode(docs).select("doc_id", tokens.decoded_text(F.col("ids")).alias("t")).collect()}
    assert [got[k] for k in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_cold_words(docs, monkeypatch):
    want = sorted(map(repr, tokens.encode(docs).collect()))
    monkeypatch.setattr(tokens, "HOT_WORDS", 3)
    assert sorted(map(repr, tokens.encode(docs).collect())) == want
    monkeypatch.setattr(tokens, "FOLD_BYTES", 2)
    assert sorted(map(repr, tokens.encode(docs).collect())) == want


def test_mix(spark):
    rows = [(k, " Web" if k % 3 else "BOOK", 10 + k % 7) for k in range(3000)] + [(9000 + k, "tiny", 5) for k in range(10)] + [(9999, None, 500), (9998, "web", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("m", "web", 0.5, 3, 2.0), ("m", "Book ", 0.3, 9, 2.0), ("m", "tiny", 0.2, 4, 2.0), ("n", "none", 1.0, 2, 1.0), ("n", "web", None, 2, 1.0)], "mix_id string, source string, target_weight double, max_repeats int, budget_ratio double")
    q = {(r.mix_id, r.source): r for r in mixing.quotas(sizes, targets).collect()}
    assert {k for k, r in q.items() if not r.reachable} == {("m", "tiny"), ("n", "none")}
    out = mixing.mix(sizes, targets, block_tokens=500, shard_blocks=8)
    got = out.groupBy("mix_id", "source").agg(F.sum("tokens").alias("t")).collect()
    want = {"web": q["m", "web"].target, "book": q["m", "Book "].target, "tiny": 200}
    assert {r.source for r in got} == set(want) and all(abs(r.t - want[r.source]) <= 8 for r in got)
    most = out.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("most"), F.min("count").alias("least")).collect()
    assert {r.source: (r.least, r.most) for r in most} == {"web": (2, 3), "book": (3, 4), "tiny": (4, 4)} or all(r.most <= {"web": 3, "book": 9, "tiny": 4}[r.source] for r in most)
    assert out.select("source", "doc_id", "pass").distinct().count() == out.count()
    assert sorted(map(repr, out.collect())) == sorted(map(repr, mixing.mix(sizes, targets, block_tokens=500, shard_blocks=8).collect()))
    assert mixing.mix(sizes.limit(0), targets).count() == 0 and mixing.mix(sizes, targets.limit(0)).count() == 0
