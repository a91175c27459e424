"""Packing: pieces against direct encoding, the plan against bounds, places against the plan."""
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martlet.llm import packing as K
from martlet.llm import token_memo as M
from martlet.llm.common import table

public = pytest.importorskip("public_tokenizers")
FILE = public.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "É", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "̈", "Σ", "İ", "ﬁ", "中", "가",
         "ᄀ", "ᅡ", "1", "٣", "'s", "'LL", "<|", "<|endoftext|>", "</w>", "A", "😀", "\x00", "word", "_", "×", "ª", "²", "ß"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(FILE)


def direct_pieces(tokenizer, docs, size=K.SIZE):
    out = []
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), size)):
            part = ids[at:at + size]
            out.append((i, n, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out, key=str)


def places_hold(rows, size=K.SIZE):
    """Sequences without gaps or overlaps, of at most ``size`` ids; returns their number."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def test_whole_table(spark, sf_dir, tokenizer):
    docs = table(spark, sf_dir, "documents")
    rows = K.packing_report(docs.repartition(6), FILE).collect()
    want = direct_pieces(tokenizer, [(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r)[:5] for r in rows), key=str) == want
    least = math.ceil(sum(r.length for r in rows) / K.SIZE)
    assert least <= places_hold(rows) <= 1.01 * least + 1


def test_sequences_hold_the_ids(spark, tokenizer):
    texts = [(i, f"text number {i} " * (i % 9 + 1)) for i in range(60)]
    packed = K.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(4),
                    K.word_ids(FILE), size=50, with_ids=True)
    whole = {r.sequence_id: r for r in K.sequences(packed).collect()}
    got = defaultdict(dict)
    for r in packed.collect():
        assert whole[r.sequence_id].ids[r.offset:r.offset + r.length] == r.ids
        assert r.offset + r.length in whole[r.sequence_id].ends
        got[r.doc_id][r.piece] = r.ids
    for i, text in texts:
        assert sum((got[i][p] for p in sorted(got[i])), []) == tokenizer.encode(text, add_special_tokens=False).ids + [0]


def test_memo_equals_the_tokenizer(tokenizer):
    rnd = random.Random(9)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(20_000)] + ["a" * 30_000, "é " * 30_000, ""]
    for words in (1000, 10 ** 6):  # a memo that starts anew again and again, and one that holds all
        memo, got = M.Memo(M.word_bpe(FILE), words=words), []
        for _, part in M.slices(pa.array(texts), 20_000):
            ids, n = memo.encode(part)[0]
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def optimum(lengths, size):
    """Fewest sequences, by trying all ways for a handful of pieces."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= size:
                go(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1:])
        go(i + 1, [*bins, lengths[i]])
    go(0, [])
    return best[0]


def check_plan(groups, counts, size):
    held = np.zeros(size + 1, dtype=np.int64)
    for g in groups:
        assert g.n > 0 and sum(g.lengths) + g.gap == size and g.gap >= 0
        for x in g.lengths:
            held[x] += g.n
    assert (held == counts).all()
    return sum(g.n for g in groups)


def test_plan_against_all_ways():
    rnd = random.Random(10)
    over = 0
    for _ in range(150):
        lengths = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        n = check_plan(K.plan_sequences(counts, 20), counts, 20)
        over += n - optimum(lengths, 20)
        assert n <= optimum(lengths, 20) + 1
    assert over <= 3


def test_plan_of_planted_complements_is_full():
    """Sequences cut into up to four pieces are put together again without waste."""
    rng = np.random.default_rng(11)
    counts = np.zeros(K.SIZE + 1, dtype=np.int64)
    for _ in range(4000):
        cuts = np.sort(rng.choice(np.arange(1, K.SIZE), rng.integers(0, 4), replace=False))
        np.add.at(counts, np.diff(np.r_[0, cuts, K.SIZE]), 1)
    n = check_plan(K.plan_sequences(counts), counts, K.SIZE)
    assert n <= 4000 * 1.005
    many = check_plan(K.plan_sequences(counts * 10 ** 9), counts * 10 ** 9, K.SIZE)  # work does not grow
    assert many <= 4000 * 10 ** 9 * 1.005
    hot = np.zeros(K.SIZE + 1, dtype=np.int64)
    hot[700], hot[648], hot[3] = 10 ** 6, 5 * 10 ** 5, 7
    assert check_plan(K.plan_sequences(hot), hot, K.SIZE) == 5 * 10 ** 5 + 1


def test_slots_are_the_plan():
    counts = np.bincount([9, 9, 9, 9, 7, 5, 5, 5, 3, 3, 1, 20, 20], minlength=21)
    table_ = K.slots(K.plan_sequences(counts, 20))
    ends = {}
    for length, first, _, n, _ in table_.tolist():
        assert first == ends.get(length, 0)  # a length's numbers have no gap
        later = [r[1] for r in table_.tolist() if r[0] == length and r[1] > first]
        ends[length] = min(later, default=int(counts[length]))
        assert (ends[length] - first) % n == 0
    assert ends == {x: int(c) for x, c in enumerate(counts) if c}


def test_nulls_repeated_rows_and_empty_tables(spark, tokenizer):
    rows = [(None, "some text"), (1, "same"), (1, "same"), (2, None), (3, ""), (4, "long " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"part": F.lit(1), "number": F.lit("x"), "length": F.lit(None).cast("int")})
    got = K.packing_report(docs, FILE).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == direct_pieces(tokenizer, rows)
    places_hold(got)
    assert K.packing_report(docs.limit(0), FILE).count() == 0
