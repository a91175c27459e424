"""Importance resampling against a plain Python version of the contract."""
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from martlet.llm import importance as I
from martlet.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)


def plain(docs, target, percent=5):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in plain_features(text)[0]:
                counts[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        found, words = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    wide = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): n + 1 for n, r in enumerate(wide[:percent * len(wide) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("finish", [1, 4096])
def test_whole_table_equals_plain_version(spark, sf_dir, finish):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = I.resample(docs.repartition(7), target, finish=finish).select("doc_id", "n_features", "weight", "score", "rank")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert result(got) == want
    assert got.columns == I.importance_report(docs, target).columns


def test_features_of_odd_texts():
    rnd = random.Random(5)
    parts = ["Ab", "é", "É", " ", "-", "9", "\n", "中文", "\x00", "x" * 39, "y" * 40, "z" * 41, "w" * 300, " ", "😀"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(2000)] + ["", "a b " * 50_000]
    bucket, of, n = I.features(texts)
    split = {}
    for b, i in zip(bucket.tolist(), of.tolist()):
        split.setdefault(i, []).append(b)
    for i, text in enumerate(texts):
        found, words = plain_features(text)
        assert n[i] == words
        assert sorted(split.get(i, [])) == sorted(zlib.crc32(f.encode()) % 10000 for f in found)


def test_kth_key_with_ties_and_uneven_partitions(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([0, 0, 0, 5, rnd.randint(-9, 9)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartitionByRange(9, "a")
    for k in (1, 2, 1499, 1500, 2999, 3000):
        assert I.kth_key(df, ["a", "b"], k, 3000, finish=1) == sorted(rows)[k - 1]


def test_null_ids_repeated_rows_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(None, text, 1), (None, text, 2), (3, text, 3), (3, text, 3), (4, None, 0), (5, "", 0)]
        + [(i, text + f" more{i}", i) for i in range(10, 60)], "doc_id long, text string, rank int")
    docs = docs.withColumns({"score": F.lit("x"), "_row": F.lit(1), "weight": F.lit(None).cast("int")})
    target = spark.createDataFrame([(1, "word1 word2"), (2, None)], "item_id long, text string")
    got = result(I.importance_report(docs, target))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], ["word1 word2", None])
    assert I.importance_report(docs.limit(0), target).count() == 0
    none = result(I.importance_report(docs, target.limit(0)))
    assert none == plain([(r.doc_id, r.text) for r in docs.collect()], [])
