"""Budgets of the mixture: repeated and null ids, equal rows, and a cut by brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from martlet.llm import mixing

ROWS = "doc_id long, text string, source string"


def dealt_tokens(out):
    return {r["source"]: (r["n"], r["w"]) for r in out.withColumn(
        "t", mixing.count_tokens(F.col("text"))).groupBy("source").agg(
        F.sum("t").alias("n"), F.max("mix_weight").alias("w")).collect()}


def test_null_ids_do_not_break_the_budget(spark):
    rows = [(None if i % 3 == 0 else i // 2, f"one two t{i} " * (1 + i % 3), "ab"[i % 2]) for i in range(3000)]
    docs = spark.createDataFrame(rows, ROWS)
    total = sum(len(t.split()) for _, t, _ in rows)
    got = dealt_tokens(mixing.mix(docs, budget=15_000 / total))
    for source, (n, weight) in got.items():
        assert 0 <= weight * 15_000 - n <= 10, source


def test_equal_rows_are_dealt_up_to_the_budget(spark):
    rows = [(None, "same text", "a")] * 500 + [(i, f"w{i} x", "b") for i in range(500)]
    docs = spark.createDataFrame(rows, ROWS).withColumn("more", F.lit(None).cast("string"))
    out = mixing.mix(docs, budget=0.5)
    assert dealt_tokens(out) == {"a": (500, 0.5), "b": (500, 0.5)}
    assert out.groupBy("doc_id", "text").count().where("doc_id is not null and count > 1").count() == 0


@pytest.mark.parametrize("bucket_rows", [8, 4096])
def test_last_block_equals_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(bucket_rows)
    keys = [rnd.randrange(-2 ** 63, 2 ** 63) for _ in range(400)]
    cells, room = [], {"a": 700, "b": 1, None: 0, "all": 90}
    for s in room:
        for k in rnd.sample(keys, 100):
            n = rnd.randrange(4)
            cells += [(s, k, n, room[s])] * rnd.choice([1, 1, 1, 40])
    # A group of equal rows with over a third of all tokens.
    cells += [("a", keys[0], 3, 700)] * 2000
    got = {r["c_s"]: (r["cut"], r["part"]) for r in mixing.last_block(spark.createDataFrame(
        cells, "s string, mix_key long, tokens long, room long"), max(Counter(c[0] for c in cells).values())).collect()}
    expected = {}
    for s, left in room.items():
        sums, each = defaultdict(int), defaultdict(int)
        for src, k, n, _ in cells:
            if src == s:
                sums[k] += n
                each[k] = max(each[k], n)
        for k in sorted(sums):
            if sums[k] > left:
                expected[s] = (k, left // each[k])
                break
            left -= sums[k]
    assert got == expected
