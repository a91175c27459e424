"""Tokenizer alignment against direct encoding and pairwise overlap of byte ranges."""
import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martlet.llm import alignment as L
from martlet.llm.common import table
from martlet.llm.token_memo import byte_values

public = pytest.importorskip("public_tokenizers")
FILES = [public.path("byte_bpe_50k.tiktoken"), public.PATTERN, public.path("piece_bpe_32k.model")]
PARTS = ["a", "B", "é", "É", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "Σ", "中", "가", "1",
         "'s", "<|", "<|endoftext|>", "A", "▁", "😀", "\x00", "<0x0A>", "<s>", "word", "_", "-", "\r", " "]


@pytest.fixture(scope="module")
def direct():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    values, entry = byte_values(), {i: k for k, i in a.get_vocab().items()}
    # The bytes of each token, read from the vocabularies here once more.
    piece = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode()

    def of(text):
        text = text or ""
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba, bb = [bytes(values[c] for c in entry[i]) for i in ia], [piece(b.id_to_piece(i)) for i in ib]
        if not text or not b"".join(ba) == b"".join(bb) == (" " + text).encode():
            return 0, 0, 0, 0, "", Counter()
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            ii, jj = ea.index(end, i) + 1, eb.index(end, j) + 1
            groups.append(",".join(map(str, ia[i:ii])) + "|" + ",".join(map(str, ib[j:jj])))
            i, j = ii, jj
        links, low = Counter(), 0
        for x in range(len(ia)):
            while eb[low] <= ea[x] - len(ba[x]):
                low += 1
            y = low
            while y < len(ib) and eb[y] - len(bb[y]) < ea[x]:
                links[ia[x], ib[y]] += 1
                y += 1
        return (len(ia), len(ib), len(groups), sum(links.values()),
                hashlib.sha256(";".join(groups).encode()).hexdigest(), links)
    return of


def expected(docs, direct):
    rows = [(i, *direct(t)) for i, t in docs]
    seen = Counter(p for r in rows for p in r[6])
    top = {}
    for (a, _), n in seen.items():
        top[a] = max(top.get(a, 0), n)
    return sorted(((i, na, nb, ng, nl, sum(m for p, m in links.items() if seen[p] == top[p[0]]),
                    sum(m * seen[p] for p, m in links.items()), sha)
                   for i, na, nb, ng, nl, sha, links in rows), key=str)


@pytest.mark.parametrize("most", [0, L.BROADCAST_PAIRS])
def test_whole_table_equals_direct_alignment(spark, sf_dir, direct, most):
    docs = table(spark, sf_dir, "documents")
    out, pairs = L.align(docs.repartition(5), L.public_aligner(*FILES), broadcast_pairs=most)
    got = out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()], direct)
    assert got.columns == L.alignment_report(docs, *FILES).columns
    assert pairs.columns == ["id_a", "id_b", "docs", "best"]


def test_odd_and_long_texts(direct):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 14))) for _ in range(3000)]
    texts += ["", "x", "a" * 20_000, "é y " * 20_000]
    found = L.public_aligner(*FILES)().align(pa.array(texts))
    of, a, b = found["links"]
    links = {}
    for i, x, y in zip(of.tolist(), a.tolist(), b.tolist()):
        links.setdefault(i, Counter())[x, y] += 1
    for i, text in enumerate(texts):
        want = direct(text)
        group = found["groups"][i]
        assert (found["n_a"][i], found["n_b"][i], found["n_groups"][i], found["n_links"][i],
                hashlib.sha256(group).hexdigest() if group else "", links.get(i, Counter())) == want, text[:50]


def test_gallop_equals_searchsorted():
    rng = np.random.default_rng(8)
    for _ in range(50):
        long = np.sort(rng.choice(5000, rng.integers(1, 900), replace=False))
        short = np.sort(rng.choice(long[-1] + 1, min(long[-1] + 1, rng.integers(1, 500)), replace=False))
        got = L.ranks(short, np.array([len(short)]), long, np.array([len(long)]))
        assert (got == np.searchsorted(long, short)).all()


def test_nulls_repeated_rows_and_empty_tables(spark, direct):
    rows = [(None, "some text"), (1, "some text"), (1, "some text"), (2, None), (3, ""), (4, "▁ odd"), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"pairs": F.lit(1), "row": F.lit("x"), "n_a": F.lit(None).cast("int")})
    got = L.alignment_report(docs, *FILES)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, direct)
    assert L.alignment_report(docs.limit(0), *FILES).count() == 0
