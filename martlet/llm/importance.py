"""Importance resampling towards a target distribution (operator 11).

Features are runs of one to three words, hashed to buckets.  The log ratio of a bucket's
share in the target and in the corpus is its gain; a document's weight is the sum of its
features' gains, read from one array of all buckets.  Gumbel noise, keyed by the id, is
added to the weight: the k highest sums are a draw of k documents without replacement.

The k-th highest key is found by weighted median of medians.  Every partition reports the
median of its keys that are still in question, and their number; the median of these
medians, weighted by the numbers, is the next pivot.  At least a quarter of the keys lies
on either side of it, so each round, which counts both sides, discards at least that share.
The rounds end with the exact cutoff key, or with so few keys that they are sorted at once.
Only the winners are then sorted, by ranges.

Edge cases: a null or empty text has no features (weight 0); a null id is keyed as the
empty text and comes last among ties; rows of one id are documents of their own, and rows
of equal score and id are ranked by number of features and weight; an empty table or an
empty target gives rows by the same formulas; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep

BUCKETS = 10_000
RUN = 3             # longest run of words
SEED = 42
PERCENT = 5
MIN_WORDS = 20
FINISH = 4096       # keys that are sorted at once
PART_ROWS = 2_000_000   # keys of a partition that reports medians, where Spark made more of them
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- hashed features --------------------------------------------------------------------

_JOINED = 40        # longest word (in bytes) whose checksum is shifted by table


def _shift_tables() -> np.ndarray:
    """``tables[n, k, byte]``: what byte k of a checksum becomes when n bytes follow.

    crc32(x + y) = shifted(crc32(x), len(y)) ^ crc32(y), and shifting is linear."""
    one = np.array([zlib.crc32(b"\0", v) ^ zlib.crc32(b"\0", 0) for v in (1 << i for i in range(32))], dtype=np.uint32)
    images = 1 << np.arange(32, dtype=np.uint32)   # no byte follows: each bit is itself
    out = np.empty((_JOINED + 2, 4, 256), dtype=np.uint32)
    values = np.arange(256)
    for n in range(_JOINED + 2):
        for k in range(4):
            acc = np.zeros(256, dtype=np.uint32)
            for bit in range(8):
                acc ^= np.where((values >> bit) & 1, images[8 * k + bit], np.uint32(0))
            out[n, k] = acc
        images = _apply(one, images)
    return out


def _apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    acc = np.zeros_like(values)
    for bit in range(32):
        acc ^= np.where((values >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return acc


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    return _shift_tables()


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    t = _tables()
    return t[n, 0, crc & 0xFF] ^ t[n, 1, (crc >> 8) & 0xFF] ^ t[n, 2, (crc >> 16) & 0xFF] ^ t[n, 3, crc >> 24]


def features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, its text's number, words of each text)."""
    words = [WORD.findall(t.encode("utf-8", "replace").lower()) for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(texts))
    flat = [w for ws in words for w in ws]
    size = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    own = np.fromiter(map(zlib.crc32, flat), dtype=np.uint32, count=len(flat))
    text = np.repeat(np.arange(len(texts)), n)
    space = zlib.crc32(b" ")
    long = np.flatnonzero(size > _JOINED)
    reach = np.minimum(size, _JOINED)
    spaced = _shifted(np.full(len(flat), space, dtype=np.uint32), reach) ^ own   # of " " + word
    for i in long.tolist():
        spaced[i] = zlib.crc32(flat[i], space)
    run, out, of = own, [own], [text]
    for k in range(1, RUN):
        inside = text[k:] == text[:-k] if len(flat) > k else np.zeros(0, dtype=bool)
        run = run[:len(flat) - k] if len(flat) > k else run[:0]
        run = _shifted(run, reach[k:] + 1) ^ spaced[k:]
        for i in (long[long >= k] - k).tolist():
            run[i] = zlib.crc32(b" ".join(flat[i:i + k + 1]))
        out.append(run[inside])
        of.append(text[k:][inside])
    return np.concatenate(out) % np.uint32(buckets), np.concatenate(of), n


def _slices(column, size: int = 2_000_000):
    from .token_memo import slices
    return slices(column, size)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: every task sums its own, Spark the rest."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in _slices(batch.column(0)):
                total += np.bincount(features(part.to_pylist(), buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])
    source = texts.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    sums = source.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in sums.collect():   # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket, in thousandths, rounded down."""
    b = len(corpus)
    s_all, t_all = float(corpus.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def noise(key: str, seed: int = SEED) -> int:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORES = [("n_words", T.LongType()), ("n_features", T.LongType()), ("weight", T.LongType()),
          ("score", T.LongType())]


def scores(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text",
           seed: int = SEED) -> DataFrame:
    """``key``, n_words, n_features, weight and score of every row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    source = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"),
                         F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"))
    schema = T.StructType([source.schema.fields[0], *[T.StructField(n, t) for n, t in SCORES]])

    def run(batches):
        out = to_arrow_schema(schema)
        for batch in batches:
            for at, part in _slices(batch.column(1)):
                bucket, of, n_words = features(part.to_pylist(), len(gain))
                n = len(part)
                weight = np.zeros(n, dtype=np.int64)
                np.add.at(weight, of, gain[bucket])
                score = weight + np.array([noise(k, seed) for k in batch.column(2).slice(at, n).to_pylist()], dtype=np.int64)
                columns = [batch.column(0).slice(at, n), pa.array(n_words),
                           pa.array(np.bincount(of, minlength=n)), pa.array(weight), pa.array(score)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)
    return source.mapInArrow(run, schema)


# ---- selection --------------------------------------------------------------------------

def _before(columns: list[str], pivot: tuple):
    """Whether a row's key comes before ``pivot`` in ascending lexicographic order."""
    out = F.lit(False)
    for c, v in reversed(list(zip(columns, pivot))):
        out = (F.col(c) < F.lit(v)) | ((F.col(c) == F.lit(v)) & out)
    return out


def kth_key(keys: DataFrame, columns: list[str], k: int, n: int, finish: int = FINISH) -> tuple:
    """The k-th smallest (from 1) of ``n`` keys, by weighted median of medians.  ``columns`` are
    longs without nulls that no two rows share, and ``keys`` a stored table."""
    keys = keys.select(*[F.col(c).cast("long") for c in columns])
    schema = ", ".join(["side int", "n long", *[f"`{c}` long" for c in columns]])

    def medians_of(pivot):
        """(side of the pivot, number of keys, their median) for each partition."""
        def run(batches):
            import pyarrow as pa
            found = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
            rows = np.concatenate(found, axis=1) if found else np.zeros((len(columns), 0), dtype=np.int64)
            side = np.ones(rows.shape[1], dtype=np.int8)      # 0 before the pivot, 2 the pivot
            if pivot is not None:
                side[:] = 2
                for c, v in reversed(list(zip(rows, pivot))):
                    side = np.where(c < v, 0, np.where(c > v, 1, side))
            for s in (0, 1, 2):
                own = rows[:, side == s]
                if own.shape[1]:
                    middle = np.lexsort(own[::-1])[own.shape[1] // 2]
                    yield pa.RecordBatch.from_pydict(
                        {"side": pa.array([s], pa.int32()), "n": pa.array([own.shape[1]], pa.int64()),
                         **{c: pa.array([int(v)], pa.int64()) for c, v in zip(columns, own[:, middle])}})
        return run

    live, pivot, size = keep(keys.coalesce(max(1024, n // PART_ROWS)), "keys"), None, None
    while True:
        found = live.mapInArrow(medians_of(pivot), schema).collect()   # at most 3 rows a partition
        count = [sum(r["n"] for r in found if r["side"] == s) for s in (0, 1, 2)]
        if pivot is not None and count[0] < k <= count[0] + count[2]:
            return pivot
        side = 1 if pivot is None or k > count[0] else 0
        if pivot is not None:
            k -= count[0] + count[2] if side else 0
            live = live.where(_before(columns, pivot) if side == 0 else
                              ~_before(columns, pivot) & ~_equal(columns, pivot))
        left = count[side]
        if left <= finish:
            return tuple(sorted(tuple(r) for r in live.collect())[k - 1])
        if size is not None and left < size / 4:
            live, size = keep(live, "keys"), left
        size = size or left
        # The next pivot: the median of the medians, each weighted by its number of keys.
        at = 0
        for *median, n_of in sorted((*[r[c] for c in columns], r["n"]) for r in found if r["side"] == side):
            at += n_of
            if 2 * at >= left:
                pivot = tuple(median)
                break


def _equal(columns: list[str], pivot: tuple):
    out = F.lit(True)
    for c, v in zip(columns, pivot):
        out &= F.col(c) == F.lit(v)
    return out


KEY = ["_by_score", "_no_id", "_by_id", "n_features", "weight", "_row"]


def ranked(winners: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``winners`` with their rank from 1: sorted by ranges, numbered range by range."""
    sorted_rows = winners.repartitionByRange(*columns).sortWithinPartitions(*columns)
    stored = keep(sorted_rows.withColumns({"_part": F.spark_partition_id(),
                                           "_at": F.monotonically_increasing_id()}), "winners")
    # Ids that grow in steps of one inside a partition number its rows from 0.
    starts, total = {}, 0
    for part, n, at in sorted(stored.groupBy("_part").agg(F.count(F.lit(1)), F.min("_at")).collect()):
        starts[part] = total - at
        total += n
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part")) \
        if starts else F.lit(0)
    return stored.withColumn(out, (F.col("_at") + shift + 1).cast("long")).drop("_part", "_at")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
             target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
             seed: int = SEED, buckets: int = BUCKETS, finish: int = FINISH) -> DataFrame:
    """``key``, n_words, n_features, weight, score and ``rank`` (1, 2, ... among the drawn,
    else null) of every row of ``docs``; ids must be castable to long."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    light = keep(scores(docs, gain, key, text, seed).withColumns({
        "_by_score": -F.col("score"), "_no_id": F.col(key).isNull().cast("long"),
        "_by_id": F.coalesce(F.col(key).cast("long"), F.lit(0)),
        "_row": F.monotonically_increasing_id()}), "scores")
    wide = F.col("n_words") >= min_words
    n = light.where(wide).count()
    k = percent * n // 100
    columns = [c for c in light.columns if not c.startswith("_")]
    if not k:
        return light.select(*columns, F.lit(None).cast("long").alias("rank"))
    cutoff = kth_key(light.where(wide), KEY, k, n, finish)
    drawn = wide & (_before(KEY, cutoff) | _equal(KEY, cutoff))
    winners = ranked(light.where(drawn), KEY, "rank")
    return light.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(
        winners.select(*columns, "rank"))


def importance_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns of :func:`resample`."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
