"""Language-model scoring with a log-frequency Bloom filter (operator 10).

Bigram counts of the training texts are quantised on a log scale: a bigram of
level q is inserted as (bigram, 1) .. (bigram, q).  A lookup probes level 1, 2, ...
until a miss, so the filter never underestimates a level.  Probabilities are Dirichlet-
smoothed: (c(hw) + MU * p(w)) / (c(h) + MU), p(w) add-one over the training tokens.

The filters, one of words and one of bigrams, are built in ``buckets`` by hash: map tasks
send sorted, pre-counted key blocks to the bucket, whose task merges them and sets the bits
of its own segment; no row per n-gram is shuffled.  The merge tasks, and past ``BUCKETS`` the
buckets, grow with the partitions of the texts, so that what a task or a bucket holds does not
grow with the corpus.  Segments hold ``BITS_PER_KEY`` bits for each insertion at every size of
input, and stay a stored table.  Up to ``MAX_BITS`` (what is broadcast at a time) both filters
are sent whole; beyond it the segments are sent in groups, and each group scores the tokens of
its own buckets.  The result is the same.

Every word has its own count c(w), also as a history c(h): the ``HEAD`` most frequent words
are broadcast with exact counts, for all others the word filter has the level, whose middle
count is taken.  ``lm_base`` uses exact counts throughout: the others are joined by 64-bit hash.

Edge cases: null or empty texts are one end token; null ids are scored but, having
no fold, neither held out nor learnt; an empty training part gives N = V = 0 and
probability one for every token; repeated rows count and are scored each; extra columns
pass through, but for those named ``lm_...`` like the operator's own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, keep, with_text_columns, without_own

SEED = 42
END = b"\n"           # whitespace: never a word
BASE = 1.6            # ratio of neighbouring count levels
MU = 10.0
HASHES = 3
BITS_PER_KEY = 9
MAX_BITS = 1 << 31    # 256 MB are broadcast at a time
BUCKETS = 512         # at least
BUCKETS_PER_PARTITION = 4
MERGES = 16           # merge tasks at least
MERGES_PER_PARTITION = 2
HEAD = 1 << 16
GROUP_CHARS = 2_000_000   # characters of texts that are scored together
CHUNK = 1_000_000     # tokens a map task holds before it sends counts on
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """word -> 64-bit hash, emptied when large."""

    def __missing__(self, word):
        import xxhash
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def _tokens(text: str | None, cache: _Hashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _GOLD
    return x ^ (x >> np.uint64(29))


def _bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Key of (previous token, token); ``first`` marks the tokens that start a text."""
    previous = np.empty_like(tokens)
    previous[1:] = tokens[:-1]
    previous[first] = np.uint64(7)
    return _mix(_mix(previous) + tokens * np.uint64(0xC2B2AE3D27D4EB4F))


def _level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


# Count taken for each level: the middle of its range on the log scale.
_LEVEL_COUNT = np.array([0.0, 1.0, 2.0] + [BASE ** (q - 0.5) for q in range(3, 200)])


def _probes(keys: np.ndarray, level: int, bits):
    """The HASHES bit positions of (key, level), one array after the other."""
    a = _mix(keys + np.uint64(level * int(_GOLD) % (1 << 64)))
    step = _mix(a) | np.uint64(1)
    for k in range(HASHES):
        yield (((a + np.uint64(k) * step) >> np.uint64(32)) * bits) >> np.uint64(32)


def _count(batches, shift: int):
    """Blocks of (kind, bucket, sorted keys, counts) for chunks of training texts."""
    cache, held, starts, size = _Hashes(), [], [], 0

    def flush():
        tokens = np.concatenate(held)
        first = np.array(starts)
        for kind, keys in (("uni", tokens), ("bi", _bigrams(tokens, first))):
            keys, counts = np.unique(keys, return_counts=True)
            bucket = (keys >> np.uint64(shift)).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            yield pd.DataFrame({
                "kind": kind, "bucket": bucket[edge[:-1]],
                "keys": [keys[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])],
                "counts": [counts[a:b].astype(np.uint32).tobytes() for a, b in zip(edge[:-1], edge[1:])]})

    for pdf in batches:
        for text in pdf["text"]:
            starts.append(size)
            held.append(_tokens(text, cache))
            size += len(held[-1])
            if size >= CHUNK:
                yield from flush()
                held, starts, size = [], [], 0
    if held:
        yield from flush()


def _merge(batches):
    """Merge the blocks of each (kind, bucket): a filter segment, and of words the
    exact counts beside it."""
    at, blocks = None, []

    def done():
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in blocks])
        counts = np.concatenate([np.frombuffer(c, np.uint32) for _, c in blocks]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[edge], np.add.reduceat(counts, edge)
        levels = _level(counts)
        bits = (max(64, BITS_PER_KEY * int(levels.sum())) + 63) // 64 * 64
        segment = np.zeros(bits, dtype=bool)
        for level in range(1, int(levels.max()) + 1):
            some = keys[levels >= level]
            for p in _probes(some, level, np.uint64(bits)):
                segment[p.astype(np.int64)] = True
        exact = at[0] == "uni"
        return {"keys": keys.tobytes() if exact else b"", "counts": counts.tobytes() if exact else b"",
                "segment": np.packbits(segment, bitorder="little").tobytes(), "bits": bits}

    for pdf in batches:
        for kind, bucket, keys, counts in zip(pdf["kind"], pdf["bucket"], pdf["keys"], pdf["counts"]):
            if (kind, bucket) != at:
                if blocks:
                    yield pd.DataFrame([{"kind": at[0], "bucket": at[1], **done()}])
                at, blocks = (kind, bucket), []
            blocks.append((keys, counts))
    if blocks:
        yield pd.DataFrame([{"kind": at[0], "bucket": at[1], **done()}])


class Filter:
    """The segments of the buckets ``lo`` to ``hi`` as one bit array, with lookups by
    repeated probes."""

    def __init__(self, sizes: dict[int, int], segments, buckets: int, lo: int, hi: int):
        self.shift, self.lo, self.hi = np.uint64(64 - int(math.log2(buckets))), lo, hi
        self.bits = np.zeros(buckets, dtype=np.uint64)
        self.start = np.zeros(buckets, dtype=np.uint64)
        at = 0
        for bucket, bits in sorted(sizes.items()):
            if lo <= bucket < hi:
                self.bits[bucket], self.start[bucket] = bits, at
                at += bits
        self.data = np.zeros(at // 8, np.uint8)
        for bucket, data in segments:   # one at a time: the driver holds one copy
            part = np.frombuffer(data, np.uint8)
            at = int(self.start[bucket]) // 8
            self.data[at:at + len(part)] = part

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether the keys' buckets are here."""
        bucket = (keys >> self.shift).astype(np.int64)
        return (bucket >= self.lo) & (bucket < self.hi)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The largest q for which (key, 1) .. (key, q) all seem present."""
        out = np.zeros(len(keys), dtype=np.int64)
        bucket = (keys >> self.shift).astype(np.int64)
        live = np.flatnonzero(self.bits[bucket] > 0)
        level = 1
        while len(live) and level < len(_LEVEL_COUNT):
            b = bucket[live]
            hit = np.ones(len(live), dtype=bool)
            for p in _probes(keys[live], level, self.bits[b]):
                p = (p + self.start[b]).astype(np.int64)
                hit &= (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            out[live] = level
            level += 1
        return out


def _buckets(partitions: int) -> int:
    """Buckets (a power of two) for texts in so many partitions."""
    return max(BUCKETS, 1 << (BUCKETS_PER_PARTITION * partitions - 1).bit_length())


def train(texts: DataFrame, buckets: int | None = None, max_bits: int = MAX_BITS,
          head: int = HEAD) -> tuple[dict, DataFrame]:
    """The model (stored segments, head words, N, V) and the exact word counts (key, c) of
    a one-column table of training texts; ``max_bits`` are broadcast at a time."""
    partitions = texts.rdd.getNumPartitions()
    buckets = buckets or _buckets(max(1, partitions))
    shift = 64 - int(math.log2(buckets))
    blocks = texts.select(F.col(texts.columns[0]).alias("text")).mapInPandas(
        lambda it: _count(it, shift), "kind string, bucket long, keys binary, counts binary")
    merges = min(buckets, max(MERGES, MERGES_PER_PARTITION * partitions))
    dealt = blocks.repartition(merges, "bucket", "kind") \
        .sortWithinPartitions("kind", "bucket")
    merged = keep(dealt.mapInPandas(
        _merge, "kind string, bucket long, keys binary, counts binary, segment binary, bits long"), "lm-counts")

    def rows(batches):
        for pdf in batches:
            for keys, counts in zip(pdf["keys"], pdf["counts"]):
                yield pd.DataFrame({"key": np.frombuffer(keys, np.uint64).view(np.int64),
                                    "c": np.frombuffer(counts, np.int64)})
    words = keep(merged.where("kind = 'uni'").select("keys", "counts").mapInPandas(
        rows, "key long, c long"), "lm-words")
    ends = int(np.uint64(_tokens("", _Hashes())[0]).view(np.int64))
    texts_n = words.where(F.col("key") == ends).agg(F.sum("c")).first()[0]
    total = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = words.orderBy(F.desc("c"), "key").limit(head).toPandas().sort_values("key")
    sizes = {"uni": {}, "bi": {}}
    for r in merged.select("kind", "bucket", "bits").collect():
        sizes[r["kind"]][r["bucket"]] = r["bits"]
    return {"N": int(total[0] or 0), "V": int(total[1]), "texts": float(texts_n or 0),
            "head": top["key"].to_numpy(np.int64), "head_c": top["c"].to_numpy(np.int64),
            "segments": merged.select("kind", "bucket", "segment"), "sizes": sizes,
            "buckets": buckets, "max_bits": max_bits}, words


def _load(model: dict, kind: str, lo: int, hi: int) -> Filter:
    stream = ((r["bucket"], r["segment"]) for r in model["segments"].where(
        (F.col("kind") == kind) & F.col("bucket").between(lo, hi - 1)).select(
        "bucket", "segment").toLocalIterator())
    return Filter(model["sizes"][kind], stream, model["buckets"], lo, hi)


def _groups(sizes: dict[int, int], buckets: int, max_bits: int) -> list[tuple[int, int]]:
    """Ranges of buckets of at most ``max_bits`` (or one bucket) that cover all of them."""
    edges, held = [0], 0
    for bucket, bits in sorted(sizes.items()):
        if held and held + bits > max_bits:
            edges.append(bucket)
            held = 0
        held += bits
    return list(zip(edges, [*edges[1:], buckets]))


def _texts_at_once(texts):
    """Ranges of texts that are scored together."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and chars < GROUP_CHARS:
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def _exact(m: dict, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are head words, and their counts."""
    head, signed = m["head"], tokens.view(np.int64)
    if not len(head):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(head, signed), len(head) - 1)
    in_head = head[at] == signed
    return in_head, np.where(in_head, m["head_c"][at], 0)


def _word_levels(m: dict, tokens: np.ndarray, in_head: np.ndarray) -> np.ndarray:
    """Levels of the words outside the head; 0 where the word's bucket is not here."""
    rest = np.flatnonzero(~in_head)
    out = np.zeros(len(tokens), np.uint8)
    keys, which = np.unique(tokens[rest], return_inverse=True)
    out[rest] = m["words"].levels(keys)[which]
    return out


def _log_p(m: dict, tokens, first, in_head, c, levels) -> np.ndarray:
    """log10 probability of each token whose bigram's bucket is here, 0 for others."""
    # Each distinct bigram of the group of texts is probed once.
    keys, which = np.unique(_bigrams(tokens, first), return_inverse=True)
    seen = _LEVEL_COUNT[m["filter"].levels(keys)][which]
    own = np.where(in_head, c, _LEVEL_COUNT[levels])
    # A text's first token has the text start as its history.
    history = np.empty(len(tokens))
    history[1:] = own[:-1]
    history[first] = m["texts"]
    p = (seen + MU * (own + 1) / (m["N"] + m["V"] + 1)) / (np.maximum(history, seen) + MU)
    return np.where(m["filter"].has(keys)[which], np.log10(np.minimum(p, 1.0)), 0.0)


def _in_groups(docs: DataFrame, model: dict, text: str) -> DataFrame:
    """(lm_row, lm_score) where the filters are too large to be sent at once: first the
    levels of every text's words, one byte a token, then the bigrams, both group by group."""
    spark = docs.sparkSession
    small = {k: model[k] for k in ("N", "V", "texts", "head", "head_c")}
    rows = docs.select("lm_row", F.col(text).cast("string").alias("text"))

    def each(kind, source, schema, run):
        out = None
        for lo, hi in _groups(model["sizes"][kind], model["buckets"], model["max_bits"]):
            name = "words" if kind == "uni" else "filter"
            shared = spark.sparkContext.broadcast({**small, name: _load(model, kind, lo, hi)})
            part = keep(source.mapInPandas(run(shared), schema), f"lm-{name}")
            shared.destroy()
            out = part if out is None else out.unionByName(part)
        return out

    def words_run(shared):
        def run(batches):
            m, cache = shared.value, _Hashes()
            for pdf in batches:
                found = []
                for t in pdf["text"]:
                    tokens = _tokens(t, cache)
                    found.append(_word_levels(m, tokens, _exact(m, tokens)[0]).tobytes())
                yield pd.DataFrame({"lm_row": pdf["lm_row"], "levels": found})
        return run

    def pairs_run(shared):
        def run(batches):
            m, cache = shared.value, _Hashes()
            for pdf in batches:
                texts, scores = pdf["text"].tolist(), []
                for a, b in _texts_at_once(texts):
                    parts = [_tokens(t, cache) for t in texts[a:b]]
                    sizes = np.array([len(p) for p in parts])
                    first, tokens = np.cumsum(sizes) - sizes, np.concatenate(parts)
                    levels = np.concatenate([np.maximum.reduce(
                        [np.frombuffer(x, np.uint8) for x in found]) for found in pdf["levels"].iloc[a:b]])
                    scores.append(np.add.reduceat(_log_p(m, tokens, first, *_exact(m, tokens), levels), first))
                if scores:
                    yield pd.DataFrame({"lm_row": pdf["lm_row"], "lm_score": np.concatenate(scores)})
        return run

    levels = each("uni", rows, "lm_row long, levels binary", words_run).groupBy("lm_row").agg(
        F.collect_list("levels").alias("levels"))
    marked = keep(rows.join(levels, "lm_row"), "lm-marked")
    return each("bi", marked, "lm_row long, lm_score double", pairs_run).groupBy("lm_row").agg(
        F.sum("lm_score").alias("lm_score"))


def score(docs: DataFrame, model: dict, words: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``lm_n_tokens``, ``lm_n_known``, ``lm_base``
    (add-one unigram log10 probability) and ``lm_score`` (filter model)."""
    docs = without_own(docs, "lm_")
    others = [c for c in docs.columns if c != text]
    source = docs.withColumn("lm_row", F.monotonically_increasing_id())
    at_once = sum(sum(s.values()) for s in model["sizes"].values()) <= model["max_bits"]
    if not at_once:
        source = keep(source, "lm-source")   # the row numbers must hold
    sent = {k: model[k] for k in ("N", "V", "texts", "head", "head_c")}
    if at_once:
        sent |= {"words": _load(model, "uni", 0, model["buckets"]),
                 "filter": _load(model, "bi", 0, model["buckets"])}
    shared = docs.sparkSession.sparkContext.broadcast(sent)
    del sent
    longs = T.ArrayType(T.LongType())
    fields = [("lm_n_tokens", T.LongType()), ("lm_head_known", T.LongType()),
              ("lm_head", T.DoubleType()), ("lm_tail", longs), ("lm_tail_n", longs)]
    fields += [("lm_score", T.DoubleType())] if at_once else []
    N, V = model["N"], model["V"]

    def make():
        m, cache = shared.value, _Hashes()
        bottom = m["N"] + m["V"] + 1

        def several(texts):
            parts = [_tokens(t, cache) for t in texts]
            sizes = np.array([len(p) for p in parts])
            first = np.cumsum(sizes) - sizes
            tokens = np.concatenate(parts)
            signed = tokens.view(np.int64)
            in_head, c = _exact(m, tokens)
            tails = [np.unique(signed[a:b][~in_head[a:b]], return_counts=True)
                     for a, b in zip(first, first + sizes)]
            out = [sizes, np.add.reduceat(in_head.astype(np.int64), first),
                   np.add.reduceat(np.where(in_head, np.log10((c + 1) / bottom), 0.0), first),
                   [t for t, _ in tails], [n for _, n in tails]]
            if "filter" in m:
                out.append(np.add.reduceat(_log_p(
                    m, tokens, first, in_head, c, _word_levels(m, tokens, in_head)), first))
            return out

        def compute(texts):
            out = [[] for _ in fields]
            for a, b in _texts_at_once(texts):
                for column, values in zip(out, several(texts[a:b])):
                    column.extend(values)
            return out
        return compute
    scored = keep(with_text_columns(source, text, fields, make), "lm-scored")
    shared.destroy()   # the scores are stored
    if not at_once:
        scored = scored.join(_in_groups(source, model, text), "lm_row")
    bottom = float(N + V + 1)
    tail = scored.select("lm_row", F.explode(F.arrays_zip("lm_tail", "lm_tail_n")).alias("t")).select(
        "lm_row", F.col("t.lm_tail").alias("key"), F.col("t.lm_tail_n").alias("n"))
    counted = tail.join(words, "key", "left").groupBy("lm_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("lm_known"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / bottom)).alias("lm_tail_base"))
    return scored.drop("lm_tail", "lm_tail_n").join(counted, "lm_row", "left").select(
        *others, "lm_n_tokens",
        (F.col("lm_head_known") + F.coalesce("lm_known", F.lit(0))).alias("lm_n_known"),
        (F.col("lm_head") + F.coalesce("lm_tail_base", F.lit(0.0))).alias("lm_base"), "lm_score")


def lm_report(docs: DataFrame) -> DataFrame:
    """The contract's digest: learnt outside fold 2 of 7, all rows scored."""
    texts = docs.select("doc_id", "text")
    model, words = train(texts.where(crc_fold(F.col("doc_id"), 7) != 2).select("text"))
    return score(texts, model, words).select(
        "doc_id", (F.coalesce(crc_fold(F.col("doc_id"), 7), F.lit(-1)) == 2).alias("held_out"),
        F.col("lm_n_tokens").alias("n_tokens"), F.col("lm_n_known").alias("n_known"),
        F.lit(model["N"]).cast("long").alias("train_tokens"),
        F.col("lm_base").alias("base_score"), F.col("lm_score").alias("score"))
