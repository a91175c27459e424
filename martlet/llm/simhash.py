"""SimHash near-duplicate components by anchor-point covering (operator 8).

Fingerprints: 64-bit SimHash over word shingles (XXH64, seed 42).  Two
fingerprints within ``MAX_BITS`` = 4 bits differ in at most 2 bits in one of their
32-bit halves.  The anchors of a half are a covering code: the direct sum of the
binary Golay code [23,12] (covering radius 3), the Hamming code [7,4] (radius 1)
and two free bits, together radius 4.  The point midway between two linked halves
is at most 1 bit from either and at most 4 from an anchor, so each fingerprint is
replicated to every anchor within 4 + 1 bits (15 on average) of each half, and
members of one anchor are compared over all 64 bits.  An anchor with more members
than ``SPLIT`` is compared in pairs of blocks, each a task of its own.  Links
leave an anchor as a star per local component, never as all pairs, and the
components of the stars are merged by alternating star contraction.

Edge cases: null and empty texts have fingerprint zero and link like any other;
rows with a null id take part and get the component of their fingerprint (null only
if nothing in it has an id); repeated rows share fingerprint and component; an
empty table gives an empty result; extra columns pass through, but for those named
``sh_...`` like the operator's own.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, with_text_columns, without_own

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SPLIT = 20_000
RADIUS = 5            # covering radius 4, plus half of the 2 bits a half may differ
GOLAY = 0b101011100011  # generator polynomial x^11+x^9+x^7+x^6+x^5+x+1
WINDOW_SHORT = 256    # longer runs of one anchor are compared row by row


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        part = h[at:at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, plus ``sh_fp`` (signed 64-bit)."""
    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts],
                                       dtype=np.uint64).view(np.int64)]
    return with_text_columns(docs, text, [("sh_fp", T.LongType())], make)


def _syndrome(x: np.ndarray) -> np.ndarray:
    """14 bits that are zero exactly for the code words of a 32-bit half."""
    low, mid = x & 0x7FFFFF, (x >> 23) & 0x7F
    for bit in range(22, 10, -1):
        low = np.where((low >> bit) & 1, low ^ (GOLAY << (bit - 11)), low)
    parity = np.zeros_like(mid)
    for i in range(7):
        parity ^= np.where((mid >> i) & 1, i + 1, 0)
    return low | (parity << 11)


@lru_cache(maxsize=1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """Error patterns of weight <= RADIUS ordered by syndrome, and where each
    syndrome's patterns start."""
    found = [np.zeros(1, dtype=np.int64)]
    for weight in range(1, RADIUS + 1):
        picks = np.array(list(combinations(range(32), weight)), dtype=np.int64)
        found.append((1 << picks).sum(axis=1))
    errors = np.concatenate(found)
    syndromes = _syndrome(errors)
    order = np.argsort(syndromes, kind="stable")
    starts = np.searchsorted(syndromes[order], np.arange(2 ** 14 + 1))
    return errors[order], starts


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) for every anchor of both halves."""
    errors, starts = _patterns()
    keys, rows = [], []
    for half in (0, 1):
        x = ((fps.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        s = _syndrome(x)
        n = starts[s + 1] - starts[s]
        row = np.repeat(np.arange(len(x)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
        keys.append((x[row] ^ errors[at]) | (half << 32))
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _replicate(batches):
    for pdf in batches:
        fps = pdf["fp"].to_numpy(dtype=np.int64)
        for at in range(0, len(fps), 20_000):
            part = fps[at:at + 20_000]
            anchor, row = anchors_of(part)
            yield pd.DataFrame({"anchor": anchor, "fp": part[row]})


def _local_roots(x: np.ndarray, group: np.ndarray, max_bits: int) -> np.ndarray:
    """For members sorted by group: index of the smallest member of each one's
    component among the links inside its group."""
    n = len(x)
    label = np.arange(n)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    size = np.diff(edge)
    short = np.repeat(size <= WINDOW_SHORT, size)
    us, vs = [], []
    longest = int(size[size <= WINDOW_SHORT].max(initial=0))
    for d in range(1, longest):
        near = (group[d:] == group[:-d]) & short[d:]
        i = np.flatnonzero(near)
        if not len(i):
            break
        i = i[np.bitwise_count(x[i] ^ x[i + d]) <= max_bits]
        us.append(i)
        vs.append(i + d)
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        while len(u):
            low = np.minimum(label[u], label[v])
            before = label.copy()
            np.minimum.at(label, u, low)
            np.minimum.at(label, v, low)
            label = label[label]
            if (before == label).all():
                break
    for k in np.flatnonzero(size > WINDOW_SHORT):
        a, b = edge[k], edge[k + 1]
        run, root = x[a:b], np.arange(b - a)
        for i in range(b - a):
            linked = np.unique(root[np.bitwise_count(run ^ run[i]) <= max_bits])
            if len(linked) > 1:
                root[np.isin(root, linked)] = linked[0]
        label[a:b] = root + a
    return label


def _link(max_bits: int):
    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            same = (pdf["anchor"] == pdf["anchor"].iloc[-1]) & (pdf["sub"] == pdf["sub"].iloc[-1]) \
                if len(pdf) else None
            if same is None:
                continue
            cut = int(np.argmax(same.to_numpy()))
            rest = pdf.iloc[cut:]
            yield from star(pdf.iloc[:cut])
        if rest is not None:
            yield from star(rest)

    def star(pdf):
        if not len(pdf):
            return
        anchor, sub = pdf["anchor"].to_numpy(), pdf["sub"].to_numpy()
        group = np.cumsum(np.r_[False, (anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])])
        fps = pdf["fp"].to_numpy(dtype=np.int64)
        root = _local_roots(fps.view(np.uint64), group, max_bits)
        linked = root != np.arange(len(root))
        yield pd.DataFrame({"a": fps[linked], "b": fps[root[linked]]}).drop_duplicates()
    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, split: int = SPLIT) -> DataFrame:
    """Star edges (a, b) that connect every two fingerprints within ``max_bits``
    (at most 4), for a table of distinct fingerprints in column ``fp``."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the anchors cover distances of at most {MAX_BITS} bits")
    spread = distinct.select("fp").mapInPandas(_replicate, "anchor long, fp long")
    hot = spread.groupBy("anchor").count().where(F.col("count") > split).select(
        "anchor", F.ceil(F.col("count") / split).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (
        F.least(block, j) * F.col("blocks") + F.greatest(block, j)).cast("long"))
    dealt = spread.join(hot, "anchor", "left").select("anchor", "fp", F.explode(
        F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)).alias("sub"))
    dealt = dealt.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "fp")
    return dealt.mapInPandas(_link(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges``: the smallest node of its component,
    by alternating large and small stars, each round stored in the shared folder."""
    current = keep(edges, "links")
    before = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where(F.col("b") != F.col("m")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        current = keep(small, "stars")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without its text, plus ``sh_fp``, ``sh_component`` (smallest key reachable
    over links) and ``sh_root`` (a fingerprint that names the component, keys or none)."""
    marked = keep(fingerprints(without_own(docs, "sh_"), text, shingle), "fingerprints")
    lowest = keep(marked.groupBy(F.col("sh_fp").alias("fp")).agg(F.min(key).alias("least")),
                  "distinct-fp")
    roots = components(links(lowest, max_bits))
    rooted = lowest.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("sh_component"))
    named = rooted.join(smallest, "root").select(
        F.col("fp").alias("sh_fp"), "sh_component", F.col("root").alias("sh_root"))
    return marked.join(named, "sh_fp").select(*marked.columns, "sh_component", "sh_root")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`near_duplicates`."""
    return near_duplicates(docs.select("doc_id", "text")).select(
        "doc_id", F.lower(F.lpad(F.hex("sh_fp"), 16, "0")).alias("fingerprint"),
        F.col("sh_component").alias("component_id"))
