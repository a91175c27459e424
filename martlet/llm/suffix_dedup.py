"""Exact repeated-substring removal by prefix-free parsing (operator 1).

A byte goes when a ``LENGTH``-byte string that covers it also starts anywhere else
in the corpus.  Method:

1. *Parse.*  A rolling hash over ``GRAM`` bytes triggers phrase ends: a window start
   s belongs to the smallest hash among the ``SPAN`` positions behind s (leftmost on
   ties).  The trigger depends on bytes inside the window alone, so equal windows
   trigger at equal places, and each window meets one.  The window starts that share a
   trigger b form a phrase; each is written (b, a) with a = b - s.
2. *Parse order.*  Windows with the same trigger share at least the ``LENGTH - SPAN``
   bytes behind it.  Triggers whose bytes there occur once are dropped: no window of
   theirs repeats.  What is left falls into intervals of the parse's suffix order.
3. *Dictionary.*  Equal phrases (with all bytes their windows see) are one entry
   with a count: copies cost one row, however many there are.
4. *Corpus order.*  Inside an interval, entries are sorted by reversed phrase
   (dictionary suffixes) and by the bytes behind the trigger (parse suffixes), both
   with neighbour LCPs.  At distance a, two windows are equal exactly if no LCP
   below a separates them in the first order and none below LENGTH - a in the second.
   Intervals of over ``SPLIT`` entries are settled by window fingerprints instead,
   one aggregated row per window, so that no task holds such an interval.

Intermediate equality is by 64-bit fingerprints of bytes under a random table; the
corpus order itself compares bytes.

Edge cases: a null text is empty; texts shorter than LENGTH keep all bytes; rows that
repeat both id and text are occurrences of their own and count as copies of each other;
rows of one id with different texts are separate; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

LENGTH = 400
SPAN = 190
GRAM = 16
SPLIT = 20_000
BATCH = 40_000          # dictionary entries ordered at once
SEGMENT = 1 << 18       # window starts parsed at once
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POS_BITS = 24
_TABLE = np.random.default_rng(20240607).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Hasher:
    """Fingerprints of byte ranges from prefix sums of a polynomial hash."""

    def __init__(self):
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                powers = np.full(size, _B, dtype=np.uint64)
                powers[0] = 1
                self.up = np.cumprod(powers, dtype=np.uint64)
                powers[1:] = pow(_B, -1, 1 << 64)
                self.down = np.cumprod(powers, dtype=np.uint64)

    def load(self, data: bytes) -> None:
        raw = np.frombuffer(data, dtype=np.uint8)
        self._grow(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * self.up[:len(raw)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def parse(data: bytes, hasher: _Hasher, length: int = LENGTH, span: int = SPAN):
    """(b, amin, amax, ctx, ext) of every phrase of one text."""
    n = len(data)
    if n < length:
        return None
    hasher.load(data)
    out = []
    last = n - length          # the last window start
    for lo in range(0, last + 1, SEGMENT):
        hi = min(lo + SEGMENT - 1, last)
        at = np.arange(lo + 1, hi + span + 1)
        packed = hasher.ranges(at, at + GRAM) >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)
        best = _sliding_min(packed | (at - lo).astype(np.uint64), span)
        b = (best & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64) + lo
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        final = np.r_[first[1:] - 1, len(b) - 1]
        out.append((b[first], b[first] - (final + lo), b[first] - (first + lo)))
    b, amin, amax = (np.concatenate(x) for x in zip(*out))
    ctx = hasher.ranges(b, b + (length - span))
    ext = hasher.ranges(b - amax, b + length - amin) \
        + (amin * 1024 + amax).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return b, amin, amax, ctx.view(np.int64), ext.view(np.int64)


PHRASES = "key long, b long, amin int, amax int, ctx long, ext long"


def _parse_rows(length: int, span: int):
    def run(batches):
        hasher = _Hasher()
        for pdf in batches:
            parts, size = [], 0
            for key, text in zip(pdf["key"], pdf["text"]):
                found = parse(text.encode("utf-8", "replace"), hasher, length, span)
                if found is None:
                    continue
                b, amin, amax, ctx, ext = found
                parts.append(pd.DataFrame({"key": key, "b": b, "amin": amin, "amax": amax,
                                           "ctx": ctx, "ext": ext}))
                size += len(b)
                if size > 200_000:
                    yield pd.concat(parts)
                    parts, size = [], 0
            if parts:
                yield pd.concat(parts)
    return run


def _slices(length: int, span: int):
    """Bytes of each dictionary entry: the phrase before its trigger, and those behind
    the bytes that its interval shares."""
    def run(batches):
        for pdf in batches:
            out = []
            for text, entries in zip(pdf["text"], pdf["entries"]):
                data = text.encode("utf-8", "replace")
                for e in entries:
                    b, lo, hi = e["b"], e["amin"], e["amax"]
                    out.append((e["ctx"], e["ext"], e["n"], lo, hi, data[b - hi:b],
                                data[b + length - span:b + length - lo]))
            if out:
                yield pd.DataFrame(out, columns=["ctx", "ext", "n", "amin", "amax", "before", "behind"])
    return run


ENTRIES = "ctx long, ext long, n long, amin int, amax int, before binary, behind binary"


def _ordered(strings: list[bytes], group: np.ndarray, width: int):
    """Sort by (group, string): the order, and each one's LCP with its forerunner
    (-1 at the start of a group)."""
    order = np.array(sorted(range(len(strings)), key=lambda i: (group[i], strings[i])), dtype=np.int64)
    sizes = np.array([len(strings[i]) for i in order])
    grid = np.zeros((len(order), width + 1), dtype=np.uint8)
    grid[np.arange(width + 1)[None, :] < sizes[:, None]] = np.frombuffer(
        b"".join(strings[i] for i in order), dtype=np.uint8)
    lcp = np.full(len(order), -1, dtype=np.int64)
    if len(order) > 1:
        differ = grid[1:] != grid[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        same = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
        lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], same, -1)
    return order, lcp


def _solve(pdf: pd.DataFrame, length: int, span: int) -> pd.DataFrame:
    """Runs [alo, ahi] of repeated windows for each entry of whole intervals."""
    group = pdf["ctx"].to_numpy()
    group = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    weight = pdf["n"].to_numpy()
    amin, amax = pdf["amin"].to_numpy(), pdf["amax"].to_numpy()
    n = len(pdf)
    by_phrase, phrase_lcp = _ordered([s[::-1] for s in pdf["before"]], group, span)
    by_parse, parse_lcp = _ordered(list(pdf["behind"]), group, span)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    twice = np.zeros((n, span + 2), dtype=bool)
    for a in range(1, span + 1):
        part = np.flatnonzero((amin <= a) & (a <= amax))
        if not len(part):
            continue
        left[by_phrase] = np.cumsum(phrase_lcp < a)
        right[by_parse] = np.cumsum(parse_lcp < span - a)
        _, which = np.unique(left[part] * (n + 1) + right[part], return_inverse=True)
        twice[part, a] = np.bincount(which, weight[part])[which] > 1
    edge = np.diff(twice.astype(np.int8), axis=1, prepend=0)
    row, alo = np.nonzero(edge == 1)
    _, ahi = np.nonzero(edge == -1)
    ctx, ext = pdf["ctx"].to_numpy(), pdf["ext"].to_numpy()
    return pd.DataFrame({"ctx": ctx[row], "ext": ext[row], "alo": alo, "ahi": ahi - 1})


RUNS = "ctx long, ext long, alo int, ahi int"


def _solve_rows(length: int, span: int):
    def run(batches):
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            while len(rest) > BATCH:
                ctx = rest["ctx"].to_numpy()
                cut = int(np.searchsorted(ctx, ctx[BATCH], side="left")) \
                    or int(np.searchsorted(ctx, ctx[0], side="right"))
                if cut >= len(rest):
                    break
                yield _solve(rest.iloc[:cut], length, span)
                rest = rest.iloc[cut:]
        if rest is not None and len(rest):
            yield _solve(rest, length, span)
    return run


def _window_rows(length: int, span: int):
    """One row per window of each entry, for intervals too large for one task."""
    def run(batches):
        hasher = _Hasher()
        for pdf in batches:
            for e in pdf.itertuples(index=False):
                # Bytes that the interval shares are left out: they are equal anyway.
                hasher.load(e.before + e.behind)
                a = np.arange(e.amin, e.amax + 1)
                start = len(e.before) - a
                h = hasher.ranges(start, start + a + span - a)
                yield pd.DataFrame({"ctx": e.ctx, "ext": e.ext, "n": e.n, "a": a.astype(np.int32),
                                    "h": h.view(np.int64)})
    return run


def repeated_spans(docs: DataFrame, key: str, text: str = "text", length: int = LENGTH,
                   span: int = SPAN, split: int = SPLIT) -> DataFrame:
    """(key, spans): for each key, which must determine the text, the byte ranges
    [start, end) covered by repeated ``length``-byte strings, as array of structs."""
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = keep(texts.mapInPandas(_parse_rows(length, span), PHRASES), "phrases")
    # Stored, so that the join below has a size to plan with and may split a hot interval.
    shared = keep(found.groupBy("ctx").count().where("count > 1").select("ctx"), "shared-intervals")
    found = keep(found.join(shared, "ctx", "left_semi"), "shared-phrases")

    entries = keep(found.groupBy("ctx", "ext").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "b", "amin", "amax")).alias("at")), "entries")
    sizes = entries.groupBy("ctx").agg(F.count(F.lit(1)).alias("m"))
    contested = entries.join(sizes.where("m > 1"), "ctx")
    wanted = contested.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct(
        "ctx", "ext", "n", "at.b", "at.amin", "at.amax")).alias("entries"))
    # Ids that repeat hold the same text; any one of them serves.
    sliced = keep(texts.join(wanted, "key").mapInPandas(
        _slices(length, span), ENTRIES).dropDuplicates(["ctx", "ext"]), "entry-bytes")

    large = sizes.where(F.col("m") > split).select("ctx")
    runs = sliced.join(large, "ctx", "left_anti").repartition("ctx").sortWithinPartitions("ctx").mapInPandas(
        _solve_rows(length, span), RUNS)
    windows = sliced.join(large, "ctx", "left_semi").mapInPandas(
        _window_rows(length, span), "ctx long, ext long, n long, a int, h long")
    often = windows.groupBy("ctx", "a", "h").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    by_window = windows.join(often, ["ctx", "a", "h"], "left_semi").select(
        "ctx", "ext", F.col("a").alias("alo"), F.col("a").alias("ahi"))
    copies = entries.where("n > 1").select("ctx", "ext", F.col("at.amin").alias("alo"),
                                           F.col("at.amax").alias("ahi"))
    marks = keep(copies.unionByName(runs).unionByName(by_window), "runs")
    spans = found.join(marks, ["ctx", "ext"]).select(
        "key", F.struct((F.col("b") - F.col("ahi")).alias("start"),
                        (F.col("b") - F.col("alo") + length).alias("end")).alias("span"))
    return spans.groupBy("key").agg(F.collect_set("span").alias("spans"))


def cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of ``data``, bytes removed, and maximal removed runs."""
    kept, at, runs, removed = [], 0, 0, 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start > at or runs == 0:
            kept.append(data[at:start])
            runs += 1
            removed += end - start
        else:
            removed += max(0, end - at)
        at = max(at, end)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """One row per row of ``docs``: the key, ``sd_bytes``, ``sd_removed``, ``sd_spans``
    and ``sd_kept`` (the remaining bytes)."""
    marked = docs.select(F.col(key), F.xxhash64(key, text).alias("sd_key"),
                         F.coalesce(F.col(text), F.lit("")).alias("sd_text"))
    spans = repeated_spans(marked, "sd_key", "sd_text", length, span)
    joined = marked.join(spans, F.col("sd_key") == spans["key"], "left").select(
        *([key]), "sd_text", "spans")
    schema = joined.select(key).schema.add("sd_bytes", "long").add("sd_removed", "long") \
        .add("sd_spans", "long").add("sd_kept", "binary")

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text_, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text_.encode("utf-8", "replace")
                left, gone, n = cut(data, spans_ or ())
                sizes.append(len(data))
                removed.append(gone)
                runs.append(n)
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)
    return joined.mapInArrow(run, schema)


def repeat_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`remove_repeats`."""
    return remove_repeats(docs).select(
        "doc_id", F.col("sd_bytes").alias("n_bytes"), F.col("sd_removed").alias("n_removed"),
        F.col("sd_spans").alias("n_spans"), F.sha2("sd_kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[bytes, int, int]]:
    """The definition, for tests: every window of every text in one table."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            h = hashlib.md5(t[i:i + length]).digest()
            seen[h] = seen.get(h, 0) + 1
    return [cut(t, [{"start": i, "end": i + length} for i in range(len(t) - length + 1)
                    if seen[hashlib.md5(t[i:i + length]).digest()] > 1]) for t in texts]
