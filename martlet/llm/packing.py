"""Best-fit packing of token sequences by exact-complement hashing (operator 13).

Every document becomes its ids and a closing id; only documents longer than ``size`` are
cut, into pieces of ``size`` ids and a rest.  How pieces fall into sequences depends on
their lengths alone, so the plan is made on the histogram of lengths (at most ``size``
rows, however large the corpus): the longest piece left opens sequences, and their gap is
looked up among the sums of one, two and three lengths that are still available (counts
are indexed by length, so a sum's last part is one probe).  A combination that fills it exactly is consumed as often as its counts allow; what has
no exact complement is dealt by best fit.

The plan says which of the pieces of a length, by number, go to which sequences; pieces
are numbered per length inside the task that made them, and the tasks' counts, summed up
per length, turn that into a number over all.  Nothing is gathered but the histogram.

Edge cases: a null or empty text is its closing id alone; rows with a null or repeated id
are documents of their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep
from .token_memo import Memo, slices, word_bpe

SIZE = 2048
END_ID = 0


# ---- the plan, on the histogram of lengths ----------------------------------------------

@dataclass
class Group:
    """``n`` sequences that hold the same lengths, in order, and have ``gap`` left."""
    n: int
    lengths: list[int] = field(default_factory=list)
    gap: int = SIZE


class Complements:
    """Counts by length, and the combinations of one to three available lengths with a
    given sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """A combination that fills ``gap``: one length, else two, else three; the one
        with the longest first length."""
        c = self.counts
        if c[gap]:
            return (gap,)
        if pair := self._pair(gap, gap - 1):
            return pair
        for first in np.flatnonzero(c[:gap - 1])[::-1]:
            if 3 * first < gap:
                break
            left = c[first]
            c[first] -= 1
            rest = self._pair(gap - int(first), int(first))
            c[first] = left
            if rest:
                return (int(first), *rest)
        return None

    def _pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths of sum ``total``, the longer at most ``most``."""
        c, low = self.counts, (total + 1) // 2
        longer = np.arange(min(most, total - 1), low - 1, -1)
        if not len(longer):
            return None
        there = (c[longer] > 0) & (c[total - longer] > 0)
        if total % 2 == 0 and longer[-1] * 2 == total:
            there[-1] = c[low] > 1
        at = int(np.argmax(there))
        return (int(longer[at]), total - int(longer[at])) if there[at] else None

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))

    def take(self, lengths: tuple[int, ...], n: int) -> None:
        for x in lengths:
            self.counts[x] -= n


def plan_sequences(counts: np.ndarray, size: int = SIZE) -> list[Group]:
    """Groups of equal sequences that hold every piece, ``counts[length]`` of each length.

    Two plans are made: one looks a gap up again after every best-fit length, one leaves
    all pieces without an exact complement to the end; the one of fewer sequences counts.
    """
    return min((chained(counts, size), exact_first(counts, size)),
               key=lambda groups: sum(g.n for g in groups))


def chained(counts: np.ndarray, size: int = SIZE) -> list[Group]:
    """A gap without an exact complement takes the longest length that fits, and is looked
    up again.  Each group exhausts one of its lengths, so groups are few."""
    left = Complements(np.array(counts, dtype=np.int64))
    groups = []
    for length in range(size, 0, -1):
        while left.counts[length]:
            lengths, gap = [length], size - length
            left.take((length,), 1)
            while gap:
                found = left.exact(gap)
                if found is None:
                    fit = np.flatnonzero(left.counts[:gap + 1])
                    if not len(fit):
                        break
                    found = (int(fit[-1]),)
                for x in found:
                    left.take((x,), 1)
                lengths += found
                gap -= sum(found)
            more = left.times(tuple(lengths))
            for x in lengths:
                left.take((x,), more)
            groups.append(Group(more + 1, lengths, gap))
    return groups


def exact_first(counts: np.ndarray, size: int = SIZE) -> list[Group]:
    """All exact complements first, then best fit of the residuals."""
    left = Complements(np.array(counts, dtype=np.int64))
    groups, residual = [], np.zeros(size + 1, dtype=np.int64)
    for length in range(size, 0, -1):
        while left.counts[length]:
            left.take((length,), 1)
            found = left.exact(size - length) if length < size else ()
            left.take((length,), -1)
            if found is None:
                residual[length] = left.counts[length]
                left.counts[length] = 0
                break
            lengths = (length, *found)
            n = left.times(lengths)
            for x in lengths:
                left.take((x,), n)
            groups.append(Group(n, list(lengths), 0))
    return groups + best_fit(residual, size)


def best_fit(counts: np.ndarray, size: int = SIZE) -> list[Group]:
    """Longest first, each into the tightest gap that holds it; equal gaps at once."""
    open_by_gap: dict[int, list[Group]] = defaultdict(list)
    done = []

    def put(group: Group) -> None:
        (open_by_gap[group.gap] if group.gap else done).append(group)

    for length in range(size, 0, -1):
        n = int(counts[length])
        while n:
            gaps = [g for g, held in open_by_gap.items() if g >= length and held]
            if not gaps:
                fit = size // length
                whole, rest = divmod(n, fit)
                if whole:
                    put(Group(whole, [length] * fit, size - fit * length))
                if rest:
                    put(Group(1, [length] * rest, size - rest * length))
                break
            gap = min(gaps)
            group = open_by_gap[gap].pop()
            fit = gap // length
            whole = min(group.n, n // fit)
            if whole:
                put(Group(whole, group.lengths + [length] * fit, gap - fit * length))
                n -= whole * fit
            if whole < group.n:
                if n and n < fit:
                    put(Group(1, group.lengths + [length] * n, gap - n * length))
                    whole, n = whole + 1, 0
                if whole < group.n:
                    put(Group(group.n - whole, group.lengths, gap))
    return done + [g for held in open_by_gap.values() for g in held]


def slots(groups: list[Group]) -> np.ndarray:
    """Rows (length, first number, first sequence, sequences, offset), sorted: the pieces of
    ``length`` from ``first number`` on go to the group's sequences in turn, first all to
    ``offset``, then all behind it, as often as the length stands there."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for group in groups:
        offset = 0
        for length, same in groupby(sorted(group.lengths, reverse=True)):
            times = len(list(same))
            rows.append((length, used[length], base, group.n, offset))
            used[length] += group.n * times
            offset += length * times
        base += group.n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---- the pieces -------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    """One memo a worker, kept from task to task."""
    return Memo(word_bpe(path))


def word_ids(path: str) -> Callable:
    """Ids of an Arrow array of texts by the word BPE of a tokenizer file, as (ids of all
    texts in turn, number of ids of each)."""
    return lambda texts: _memo(path).encode(texts)[0]


PIECE = T.StructType([T.StructField(n, t) for n, t in (
    ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
    ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("number", T.LongType()))])


def pieces(docs: DataFrame, encode: Callable, key: str = "doc_id", text: str = "text",
           size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, its ids if asked for,
    and ``number``, which counts pieces of one length inside task ``part``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    source = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    fields = [source.schema.fields[0], *PIECE.fields]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches):
        import zlib

        from pyspark import TaskContext
        out, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, n = encode(texts)
                n = n + 1                                    # with the closing id
                ends = np.cumsum(n)
                all_ids = np.full(int(ends[-1]), end_id, dtype="<u4")
                inside = np.ones(len(all_ids), dtype=bool)
                inside[ends - 1] = False
                all_ids[inside] = ids
                cut = -(-n // size)                          # pieces of each document
                doc = np.repeat(np.arange(len(n)), cut)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)
                start = piece * size
                length = np.minimum(size, n[doc] - start)
                first = (ends - n)[doc] + start
                raw = memoryview(all_ids.tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a:4 * (a + b)]) for a, b in zip(
                    first.tolist(), length.tolist())), dtype=np.int64, count=len(doc))
                number = _running(length, seen)
                columns = [batch.column(0).slice(at, len(texts)).take(pa.array(doc)),
                           pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc),
                           pa.array(np.full(len(doc), part), pa.int32()), pa.array(number)]
                if with_ids:  # pieces lie in turn, without a gap between them
                    offsets = pa.array(np.concatenate([first, ends[-1:]]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(all_ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, out)], schema=out)
    return source.mapInArrow(run, schema)


def _running(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many equal values came before each one; ``seen`` counts those of earlier calls
    and is brought up to date."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, dtype=bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(ranked)), 0))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.arange(len(ranked)) - first + seen[ranked]
    np.add.at(seen, values, 1)
    return out


def pack(docs: DataFrame, encode: Callable, key: str = "doc_id", text: str = "text",
         size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``key``, piece, start, length, ids_crc32 (and ids), sequence_id and offset per piece."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    made = keep(pieces(docs, encode, key, text, size, end_id, with_ids), "pieces")
    per_part = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    per_part = keep(per_part, "pieces-by-part")
    histogram = per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    table = slots(plan_sequences(counts, size))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = made.join(before, ["part", "length"]).select(
        *[c for c in made.columns if c not in ("part", "number")],
        (F.col("before") + F.col("number")).alias("number"))
    schema = T.StructType([f for f in numbered.schema.fields if f.name != "number"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        out = to_arrow_schema(schema)
        reach = int(counts.max(initial=0)) + 1
        keys = table[:, 0] * reach + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy().astype(np.int64)
            _, since, base, n, offset = table[np.searchsorted(keys, length * reach + number, side="right") - 1].T
            turn, sequence = np.divmod(number - since, n)
            columns = [batch.column(f.name) for f in out if f.name not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(base + sequence), pa.array(offset + turn * length)], schema=out)
    return numbered.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``ids``, and ``ends`` of the pieces inside them, from
    :func:`pack` with ids.  A sequence holds at most ``size`` ids."""
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform(
        "parts", lambda p: p["offset"] + p["length"]).alias("ends"))


def packing_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns of :func:`pack`."""
    return pack(docs, word_ids(tokenizer)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
