"""Alignment of two tokenizers over the same texts by galloping intersection (operator 12).

Both tokenizers' tokens of a text are byte ranges without gaps, so each is given by its
list of end offsets.  The shorter list drives: every end of it is searched in the longer
list by exponential steps from where a neighbour before it was found, then by halving.
Ends that both lists hold cut the text into groups; the difference of two ranks is the
range of tokens of the longer list that a token of the shorter one overlaps, so links need
no pairwise test.

A pair of ids counts once for each document that links it.  Documents store their distinct
pairs with the number of links; pairs are counted from there, and the counts return to the
documents by a join on the pair (the pairs are broadcast while there are at most
``BROADCAST_PAIRS`` of them; beyond it Spark shuffles the join and splits hot pairs).

Edge cases: a null or empty text, or one whose joined token bytes differ from space + text
(U+2581, which the piece model takes for a space), has no tokens: counts are 0, the digest
is empty; rows with a null or repeated id are documents of their own; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep
from .token_memo import Memo, byte_bpe, cut_before_space, piece_model, slices, space_is_odd

BROADCAST_PAIRS = 2_000_000
STRIDES = (4096, 64, 1)


# ---- galloping intersection -------------------------------------------------------------

def gallop(ends: np.ndarray, targets: np.ndarray, floor: np.ndarray, ceil: np.ndarray) -> np.ndarray:
    """For each target the first index in [floor, ceil) whose end is not below it (else
    ceil): exponential steps from ``floor``, then halving.  All targets step at once."""
    low = floor.copy()                 # ends before ``low`` are below the target
    high = np.minimum(floor, ceil)
    step = np.ones(len(targets), dtype=np.int64)
    going = np.flatnonzero(high < ceil)
    while len(going):
        going = going[ends[high[going]] < targets[going]]
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step[going], ceil[going])
        step[going] *= 2
        going = going[high[going] < ceil[going]]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = ends[middle] < targets[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
        open_ = open_[low[open_] < high[open_]]
    return low


def ranks(short: np.ndarray, n_short: np.ndarray, long: np.ndarray, n_long: np.ndarray) -> np.ndarray:
    """For every end in ``short`` the index in ``long`` of the first end not below it, inside
    the same text.  Both hold texts in turn (``n_...`` ends each).  Few ends gallop from
    their text's start, the others from an end found before them."""
    first = np.repeat(np.cumsum(n_long) - n_long, n_short)
    last = first + np.repeat(n_long, n_short)
    start = np.repeat(np.cumsum(n_short) - n_short, n_short)
    inside = np.arange(len(short)) - start
    found = first.copy()
    known = np.zeros(len(short), dtype=bool)
    before = None
    for stride in STRIDES:
        at = np.flatnonzero((inside % stride == 0) & ~known)
        floor = first[at] if before is None else np.maximum(first[at], found[start[at] + inside[at] // before * before])
        found[at] = gallop(long, short[at], floor, last[at])
        known[at] = True
        before = stride
    return found


def intersect(short: np.ndarray, n_short: np.ndarray, long: np.ndarray,
              n_long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in ``long`` of the first and last token that each token of ``short`` overlaps,
    whether the token's end is common)."""
    last = ranks(short, n_short, long, n_long)
    common = long[last] == short       # both lists end with the text, so ``last`` exists
    after = last + common              # first long token that ends behind this end
    first = np.r_[0, after[:-1]] if len(after) else after
    return first, last, common


# ---- one slice of texts -----------------------------------------------------------------

class Aligner:
    """Two encoders (of words, see ``token_memo``) with the bytes of their ids."""

    def __init__(self, memo: Memo, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.memo, self.entries = memo, (bytes_a, bytes_b)
        self.sizes = [np.array([len(e) for e in entries], dtype=np.int64) for entries in self.entries]
        width = len(str(max(len(bytes_a), len(bytes_b)))) + 1
        decimal = lambda n, sign: np.array([f"{i}{sign}" for i in range(n)], dtype=f"S{width}")
        # Ids of A end with a comma or a bar, those of B with a comma or a semicolon.
        self.shown = np.concatenate([decimal(len(bytes_a), ","), decimal(len(bytes_a), "|"),
                                     decimal(len(bytes_b), ","), decimal(len(bytes_b), ";")])

    def tokens(self, texts) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids of A and of B, their numbers per text); none for texts that do not come back."""
        raw = [b" " + t.encode() for t in texts.to_pylist()]
        sides = self.memo.encode(texts)
        sound = np.fromiter((len(r) > 1 for r in raw), dtype=bool, count=len(raw))
        for entries, (ids, n) in zip(self.entries, sides):
            pieces = [entries[i] for i in ids.tolist()]
            at = 0
            for k, count in enumerate(n.tolist()):
                sound[k] &= b"".join(pieces[at:at + count]) == raw[k]
                at += count
        return ([ids[np.repeat(sound, n)] for ids, n in sides], [np.where(sound, n, 0) for _, n in sides])

    def align(self, texts) -> dict:
        """Per text: n_a, n_b, n_groups, n_links, groups (bytes of ``a1,a2|b1;a3|b2``); and all
        links as (text, id of A, id of B)."""
        (a, b), (n_a, n_b) = self.tokens(texts)
        ends_a, ends_b = _ends(self.sizes[0][a], n_a), _ends(self.sizes[1][b], n_b)
        driver = n_a <= n_b            # per text, the shorter list drives
        text_a, text_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        links = []
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        for a_drives in (True, False):
            in_a, in_b = np.flatnonzero(driver[text_a] == a_drives), np.flatnonzero(driver[text_b] == a_drives)
            of = driver == a_drives
            short, long = (in_a, in_b) if a_drives else (in_b, in_a)
            n_short, n_long = (n_a[of], n_b[of]) if a_drives else (n_b[of], n_a[of])
            ends_short, ends_long = (ends_a, ends_b) if a_drives else (ends_b, ends_a)
            first, last, common = intersect(ends_short[short], n_short, ends_long[long], n_long)
            n = last - first + 1
            s = np.repeat(np.arange(len(short)), n)
            at = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            links.append((short[s], long[at]) if a_drives else (long[at], short[s]))
            mark_short, mark_long = (last_a, last_b) if a_drives else (last_b, last_a)
            mark_short[short[common]] = True
            mark_long[long[last[common]]] = True
        at_a, at_b = (np.concatenate(x) for x in zip(*links))
        linked = text_a[at_a]
        count = lambda of: np.bincount(of, minlength=len(n_a))
        return {"n_a": n_a, "n_b": n_b, "n_groups": count(text_a[last_a]), "n_links": count(linked),
                "groups": self._groups(a, b, n_a, n_b, text_a, text_b, last_a, last_b),
                "links": (linked, a[at_a], b[at_b])}

    def _groups(self, a, b, n_a, n_b, text_a, text_b, last_a, last_b) -> list[bytes]:
        """Each group's ids of A, then its ids of B, written as text."""
        ka, kb = len(self.entries[0]), len(self.entries[1])
        codes = np.concatenate([a + ka * last_a, b + 2 * ka + kb * last_b])
        # Groups are numbered over all texts; B's tokens follow A's of the same number.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = self.shown[codes[order]]
        out, at = [], 0
        for n in (n_a + n_b).tolist():
            out.append(shown[at:at + n].tobytes().translate(None, b"\0")[:-1])
            at += n
        return out


def _ends(sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """End offsets inside each text."""
    upto = np.cumsum(sizes)
    whole = np.concatenate([[0], upto])
    return upto - np.repeat(whole[np.cumsum(n) - n], n)


# ---- the corpus -------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _aligner(ranks_path: str, pattern: str, model_path: str) -> Aligner:
    """One aligner a worker, kept from task to task."""
    encode_a, bytes_a = byte_bpe(ranks_path, pattern)
    encode_b, bytes_b = piece_model(model_path)
    return Aligner(Memo(encode_a, encode_b, odd=space_is_odd, cut=cut_before_space), bytes_a, bytes_b)


def public_aligner(ranks_path: str, pattern: str, model_path: str) -> Callable:
    """Maker of the aligner of a byte-level BPE (A) and a piece model (B) from their files."""
    return lambda: _aligner(ranks_path, pattern, model_path)


COUNTS = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()),
          ("n_links", T.LongType()), ("groups_sha256", T.StringType())]


def align_documents(docs: DataFrame, make: Callable, key: str = "doc_id", text: str = "text",
                    with_groups: bool = False) -> DataFrame:
    """``key``, counts, digest, and the document's distinct ``pairs`` of linked ids (id of A *
    ids of B + id of B, ascending) with the ``times`` they are linked; with ``with_groups``
    the groups' text."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    source = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    n_a, n_b = map(len, make().entries)
    span = n_a * n_b
    pair = T.IntegerType() if span < 2 ** 31 else T.LongType()
    schema = T.StructType([source.schema.fields[0], *[T.StructField(n, t) for n, t in COUNTS],
                           T.StructField("pairs", T.ArrayType(pair)),
                           T.StructField("times", T.ArrayType(T.IntegerType()))]
                          + [T.StructField("groups", T.StringType())] * with_groups)

    def run(batches):
        aligner, out = make(), to_arrow_schema(schema)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                found = aligner.align(texts)
                linked, a, b = found["links"]
                codes, times = np.unique(linked * span + a.astype(np.int64) * n_b + b, return_counts=True)
                of, pairs = np.divmod(codes, span)
                offsets = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
                groups = found["groups"]
                columns = [batch.column(0).slice(at, len(texts)),
                           *[pa.array(found[c]) for c in ("n_a", "n_b", "n_groups", "n_links")],
                           pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                           pa.ListArray.from_arrays(offsets, pa.array(pairs)),
                           pa.ListArray.from_arrays(offsets, pa.array(times))]
                if with_groups:
                    columns.append(pa.array([g.decode() for g in groups]))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)
    return source.mapInArrow(run, schema)


def align(docs: DataFrame, make: Callable, key: str = "doc_id", text: str = "text",
          with_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): the rows of :func:`align_documents` with ``n_best`` and
    ``count_sum`` in place of their pairs; and (id_a, id_b, docs, best) of the corpus, ``best``
    where no other pair of ``id_a`` is in more documents."""
    n_b = len(make().entries[1])
    rows = keep(align_documents(docs, make, key, text, with_groups).withColumn(
        "row", F.monotonically_increasing_id()), "aligned")
    counted = keep(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(
        F.count(F.lit(1)).alias("docs")).withColumn("id_a", F.expr(f"cast(pair div {n_b} as int)")), "pairs")
    top = counted.groupBy("id_a").agg(F.max("docs").alias("top"))
    pairs = keep(counted.join(top, "id_a").select(
        "pair", "id_a", (F.col("pair") % n_b).cast("int").alias("id_b"), "docs",
        (F.col("docs") == F.col("top")).alias("best")), "ranked-pairs")

    known = pairs.select("pair", "docs", "best")
    if pairs.count() <= broadcast_pairs:
        known = F.broadcast(known)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(known, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("docs") * F.col("times")).cast("long").alias("count_sum"))
    out = rows.drop("pairs", "times").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])
    return out, pairs.drop("pair")


def alignment_report(docs: DataFrame, ranks_path: str, pattern: str, model_path: str) -> DataFrame:
    """The contract's columns of :func:`align`."""
    return align(docs, public_aligner(ranks_path, pattern, model_path))[0].select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
