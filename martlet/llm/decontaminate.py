"""Benchmark decontamination by latent semantic retrieval (operator 4).

A passage of a text is two neighbouring blocks of ``BLOCK`` words; a benchmark item is
one passage, or equal parts of at most four blocks.  The term space is the benchmark's own vocabulary, since other
words add nothing to a product with an item (they do count in a passage's length).

1. *Distributed randomised SVD.*  One pass over all passages multiplies the term
   matrix A by a random V x SKETCH matrix and by its transpose, A'(A Omega), and counts
   document frequencies; partial sums are added term by term.  The left singular
   vectors of the sum, joined by those of the benchmark's own TF-IDF passages, span
   the latent space of at most RANK dimensions.
2. *Candidates.*  A second pass takes the (text, item) pairs whose passages have, in the
   latent space, a cosine of at least ``COSINE``.  A term adds to a cosine at most the largest
   product of its projection with an item passage; these maxima, taken over each of ``GROUPS``
   groups of item passages, bound a passage's cosines, and only passages whose bound reaches
   ``COSINE`` are projected.  No pair is lost by that.
3. *Checks.*  Around a candidate the longest common subsequence of words with the item
   is measured: at ``VERBATIM`` of the item's words it is a leak; from ``PARAPHRASE`` on
   the item's answer (column ``answer``, else its last sentence) must be found too.

The benchmark is a stated query set: it is handled in blocks of at most RANK - SKETCH
passages, so that every passage of a block has its own dimension and none is truncated.
A block's vocabulary times RANK bounds all that is broadcast or brought to the driver;
only an item of more passages than that has a block, and a larger space, of its own.
Each block reads the corpus twice.

Edge cases: null and empty texts and items never match; a row with a null id has no
pairs; a repeated row gets each of its matches; repeated items count once, items of equal
text and different ids all match; an empty
benchmark or corpus gives no pairs.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16
RANK = 256            # dimensions of the latent space,
SKETCH = 48           # of which the corpus' passages determine so many
COSINE = 0.4
GROUPS = 32           # groups of item passages with a bound of their own on the cosine,
SLACK = 1e-3          # which is taken for so much more than it is, since sums are rounded
COMMON = 0.1          # terms in a larger share of all passages weigh nothing,
HOT = 0.5             # but this share of the rarest term's weight where they make up most of an item
VERBATIM = 0.8
PARAPHRASE = 0.6
ANSWER = 0.75
SEED = 11
_EDGES = b".,;:!?()[]{}\"'|*%&#$<>"


def norm_words(text: str | None) -> list[bytes]:
    """Words in lower case without punctuation at their ends."""
    words = (w.strip(_EDGES) for w in (text or "").encode("utf-8", "replace").lower().split())
    return [w for w in words if w]


class _Ids:
    """Term numbers of a text's words (as ``norm_words`` has them), -1 for other words.  Nothing
    is remembered of other words: most are rare, and looking them up in a large memo costs more
    than stripping them again."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.number = {**vocabulary, b"": -2}.get   # bare punctuation is no word

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "replace").lower().split()
        words = map(bytes.strip, raw, repeat(_EDGES))
        ids = np.fromiter(map(self.number, words, repeat(-1)), dtype=np.int64, count=len(raw))
        return ids[ids > -2] if len(ids) and ids.min() == -2 else ids


def _sum_blocks(rows: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Rows added up by their (sorted) block number."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    if len(rows):
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        out[block[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _sketch_rows(vocabulary, rank):
    """Per task: for each term its passage count and its row of A'(A Omega)."""
    def run(batches):
        ids_of = _Ids(vocabulary.value)
        size = len(vocabulary.value)
        omega = np.random.default_rng(SEED).standard_normal((size, rank)).astype(np.float32)
        total, df, passages = np.zeros((size, rank), np.float32), np.zeros(size, np.int64), 0

        def add(ids, passage, n):
            nonlocal passages
            passages += n
            z = _sum_blocks(omega[ids], passage, n)
            order = np.argsort(ids.astype(np.uint16) if size <= 1 << 16 else ids, kind="stable")  # radix sort
            term, at = ids[order], passage[order]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            total[term[first]] += np.add.reduceat(z[at], first, axis=0)
            # The sort is stable, so a term's passages are in order: equal pairs are neighbours.
            new = np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])]
            df[:] += np.bincount(term[new], minlength=size)

        for pdf in batches:
            held, places, size_held, n = [], [], 0, 0
            for text in pdf["text"]:
                ids = ids_of.of(text)
                where = np.flatnonzero(ids >= 0)
                held.append(ids[where])
                places.append(where // (2 * BLOCK) + n)
                n += -(-len(ids) // (2 * BLOCK))
                size_held += len(where)
                if size_held > 100_000:
                    add(np.concatenate(held), np.concatenate(places), n)
                    held, places, size_held, n = [], [], 0, 0
            if size_held:
                add(np.concatenate(held), np.concatenate(places), n)
            else:
                passages += n
        used = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-1, used], "df": np.r_[passages, df[used]],
                            "row": [np.zeros(0, np.float32), *total[used]]})
    return run


def _add_rows(batches):
    df, rows = {}, {}
    for pdf in batches:
        for term, n, row in zip(pdf["term"], pdf["df"], pdf["row"]):
            df[term] = df.get(term, 0) + n
            rows[term] = rows[term] + row if term in rows else np.array(row, dtype=np.float32)
    if df:
        yield pd.DataFrame({"term": list(df), "df": list(df.values()), "row": [rows[t] for t in df]})


def _passages(words: int) -> list[tuple[int, int]]:
    """An item's passages: equal word ranges of at most four blocks."""
    n = -(-words // (4 * BLOCK))
    edges = [words * i // n for i in range(n + 1)] if n else []
    return list(zip(edges, edges[1:]))


def _answer(text: str, answer: str | None) -> list[bytes]:
    if answer:
        return norm_words(answer)
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if norm_words(s)]
    return norm_words(sentences[-1]) if sentences else []


def blocks_of(items, passages: int = RANK - SKETCH):
    """The items that have words, (id, text, answer), in blocks of at most so many passages;
    an item of more is a block by itself."""
    block, held = [], 0
    for item in items:
        n = len(_passages(len(norm_words(item[1]))))
        if block and held + n > passages:
            yield block
            block, held = [], 0
        if n:
            block.append(item)
            held += n
    if block:
        yield block


def fit(docs: DataFrame, items: list[tuple], sketch_size: int = SKETCH) -> dict | None:
    """The latent space of the corpus' passages and one block of items
    (id, text, answer), and the items' passages in it."""
    spark = docs.sparkSession
    words = [norm_words(t) for _, t, _ in items]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    if not vocabulary:
        return None
    size = len(vocabulary)
    sketch_size = min(sketch_size, size)
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = "term long, df long, row array<float>"
    partial = docs.mapInPandas(_sketch_rows(shared, sketch_size), schema)
    summed = partial.repartition(16, "term").mapInPandas(_add_rows, schema).toPandas()
    sketch, df, passages = np.zeros((size, sketch_size)), np.zeros(size), 0
    for term, n, row in summed.itertuples(index=False):
        if term < 0:
            passages = n
        else:
            df[term], sketch[term] = n, row
    rarest = float(np.log(passages + 2.0))
    common = df > max(COMMON * passages, 10)
    idf = np.where(common, 0.0, np.log((passages + 2.0) / (df + 1.0)))
    parts = []
    for i, ws in enumerate(words):
        ids = np.array([vocabulary[w] for w in ws], dtype=np.int64)
        parts += [(i, ids[a:b]) for a, b in _passages(len(ids))]
    for _, ids in parts:
        terms = np.unique(ids)
        if 2 * common[terms].sum() > len(terms):   # the item itself is common: it must stay visible
            idf[terms[common[terms]]] = HOT * rarest
    sketch *= idf[:, None]
    rows, owner = np.zeros((len(parts), size)), [i for i, _ in parts]
    for row, (_, ids) in zip(rows, parts):
        np.add.at(row, ids, idf[ids])
    own = rows
    corpus, _, _ = np.linalg.svd(sketch, full_matrices=False)
    bench, values, _ = np.linalg.svd(own.T, full_matrices=False)
    bench = bench[:, values > 1e-9 * max(values[0], 1e-30)]
    space, _ = np.linalg.qr(np.hstack([bench, corpus]))
    latent = own @ space
    latent = (latent / np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]).astype(np.float32)
    project = (idf[:, None] * space).astype(np.float32)
    groups = np.array_split(latent, min(GROUPS, len(latent)))
    return {"vocabulary": vocabulary, "project": project, "latent": latent,
            "bound": np.stack([(project @ g.T).max(axis=1) for g in groups], axis=1),
            "idf2": (idf ** 2).astype(np.float32), "rarest2": rarest ** 2,
            "owner": np.array(owner), "words": words,
            "answers": [_answer(t or "", a) for _, t, a in items], "ids": [i for i, _, _ in items]}


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def candidates(texts: list[np.ndarray], model: dict, cosine: float) -> list[dict[int, list]]:
    """For each text's term numbers: item -> [(cosine, first block of the passage)]."""
    found: list[dict[int, list]] = [{} for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    blocks = -(-sizes // BLOCK)
    n = int(blocks.sum())
    if not n:
        return found
    start = np.cumsum(blocks) - blocks
    doc = np.repeat(np.arange(len(texts)), blocks)
    ids = np.concatenate(texts)
    block = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // BLOCK \
        + np.repeat(start, sizes)
    known = np.flatnonzero(ids >= 0)
    squares = np.full(len(ids), model["rarest2"], dtype=np.float64)
    squares[known] = model["idf2"][ids[known]]
    length = np.bincount(block, squares, n)
    used = known[squares[known] > 0]
    # A passage is a block and its follower; a last block stands alone only as a first.
    follows = np.append(doc[1:] == doc[:-1], False)
    pair = np.flatnonzero(follows | (np.arange(n) == start[doc]))

    def of_passages(values):
        joined, more = values[pair], follows[pair]
        joined[more] += values[pair[more] + 1]
        return joined

    root = np.sqrt(np.maximum(of_passages(length), 1e-9))
    bound = of_passages(_sum_blocks(model["bound"][ids[used]], block[used], n))
    reached = bound.max(axis=1) >= (cosine - SLACK) * root
    if not reached.any():
        return found
    needed = np.zeros(n, dtype=bool)
    needed[pair[reached]] = True
    needed[pair[reached & follows[pair]] + 1] = True
    used = used[needed[block[used]]]
    # Passages out of reach stay in their places: a cosine's last digits depend on the product's shape.
    joined = of_passages(_sum_blocks(model["project"][ids[used]], block[used], n))
    joined /= root[:, None].astype(np.float32)
    near = joined @ model["latent"].T
    at, q = np.nonzero((near >= cosine) & reached[:, None])
    for score, p, item in zip(near[at, q].tolist(), pair[at].tolist(), model["owner"][q].tolist()):
        d = doc[p]
        found[d].setdefault(item, []).append((score, p - int(start[d])))
    return found


def _search(shared, cosine: float, verbatim: float, paraphrase: float, need: float):
    def run(batches):
        model = shared.value
        ids_of = _Ids(model["vocabulary"])
        def matched(rows, texts, terms):
            for row, text, found in zip(rows, texts, candidates(terms, model, cosine)):
                words = norm_words(text) if found else None
                for item, places in found.items():
                    own, best = model["words"][item], None
                    regions, reach = [], len(own) + BLOCK
                    for _, p in sorted(places, key=lambda x: x[1]):
                        a, b = max(0, p * BLOCK - reach), (p + 2) * BLOCK + reach
                        if regions and a <= regions[-1][0] + BLOCK:
                            regions[-1][1] = b
                        else:
                            regions.append([a, b])
                    for a, b in regions:
                        part = words[a:b]
                        share = lcs(own, part) / len(own)
                        if best is None or share > best[0]:
                            answer = model["answers"][item]
                            best = (share, not answer or lcs(answer, part) >= need * len(answer))
                    if best[0] >= verbatim or (best[0] >= paraphrase and best[1]):
                        yield row, model["ids"][item], max(places)[0], best[0], best[1]

        for pdf in batches:
            out, rows, texts, terms, held = [], [], [], [], 0
            for row, text in zip(pdf["row"], pdf["text"]):
                rows.append(row)
                texts.append(text)
                terms.append(ids_of.of(text))
                held += len(terms[-1])
                if held > 30_000:
                    out += matched(rows, texts, terms)
                    rows, texts, terms, held = [], [], [], 0
            out += matched(rows, texts, terms)
            if out:
                yield pd.DataFrame(out, columns=["row", "item", "cosine", "share", "answered"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item: str = "item_id", cosine: float = COSINE, verbatim: float = VERBATIM,
          paraphrase: float = PARAPHRASE, need: float = ANSWER) -> DataFrame:
    """(key, item, cosine, lcs_share, answer_found) for every leak."""
    spark = docs.sparkSession
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    wanted = benchmark.select(F.col(item).cast("long").alias("id"), F.col("text"), answer.alias("answer")).distinct()
    texts = docs.select(F.col(key).cast("long").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "row long, item long, cosine double, share double, answered boolean"
    found = spark.createDataFrame([], schema)
    # Items stream to the driver in a fixed order; it holds one block at a time.
    for items in blocks_of(tuple(r) for r in wanted.orderBy("id", "text", "answer").toLocalIterator()):
        model = fit(texts.select("text"), items)
        if model is not None:
            shared = spark.sparkContext.broadcast(model)
            found = found.unionByName(texts.where(F.col("row").isNotNull()).mapInPandas(
                _search(shared, cosine, verbatim, paraphrase, need), schema))
    return found.select(F.col("row").alias(key), F.col("item").alias(item), "cosine",
                        F.col("share").alias("lcs_share"), F.col("answered").alias("answer_found"))
