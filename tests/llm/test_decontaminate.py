"""Candidates of the decontamination: bounded before they are projected, none lost."""

import numpy as np
import pytest

from martlet.llm import decontaminate as D

RNG = np.random.default_rng(5)
VOCABULARY = [b"w%d" % i for i in range(400)]


def _text(words):
    return b" ".join(words).decode()


def _said(n):
    return [VOCABULARY[i] if i < len(VOCABULARY) else b"other%d" % i for i in RNG.integers(0, 1200, n)]


@pytest.fixture(scope="module")
def case(spark):
    items = [(i, _text(RNG.choice(VOCABULARY, 20 + i)), None) for i in range(70)]
    texts = [_text(_said(n)) for n in RNG.integers(0, 300, 60)]
    for i in range(0, 60, 3):       # an item, whole or in part, in the middle of a text
        words = items[i][1].split()
        texts[i] = " ".join([texts[i], *words[:len(words) - i // 6], texts[i + 1]])
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = D.fit(docs, items)
    ids = D._Ids(model["vocabulary"])
    return [ids.of(t) for t in [*texts, "", None]], model


def _projected_all(text, model, cosine):
    """Every passage of one text projected: item -> [(cosine, first block)]."""
    blocks = [text[i:i + D.BLOCK] for i in range(0, len(text), D.BLOCK)]
    found = {}
    for first in range(max(1, len(blocks) - 1) if blocks else 0):
        words = np.concatenate(blocks[first:first + 2])
        known = words[words >= 0]
        square = model["idf2"][known].sum(dtype=float) + model["rarest2"] * (len(words) - len(known))
        used = known[model["idf2"][known] > 0]
        near = model["latent"] @ model["project"][used].sum(axis=0) / np.sqrt(max(square, 1e-9))
        for q in np.flatnonzero(near >= cosine):
            found.setdefault(model["owner"][q], []).append((near[q], first))
    return found


@pytest.mark.parametrize("cosine", [0.1, 0.2, D.COSINE])
def test_no_candidate_is_lost_to_the_bound(case, cosine):
    texts, model = case
    total = 0
    for text, found in zip(texts, D.candidates(texts, model, cosine)):
        wanted = _projected_all(text, model, cosine)
        assert {k: sorted(p for _, p in v) for k, v in found.items()} == {
            k: sorted(p for _, p in v) for k, v in wanted.items()}
        for item, places in found.items():
            assert np.allclose(sorted(s for s, _ in places), sorted(s for s, _ in wanted[item]), atol=1e-5)
        total += len(found)
    assert total > 10


def test_only_passages_within_reach_are_projected(case, monkeypatch):
    texts, model = case
    rows, plain = [], D._sum_blocks
    monkeypatch.setattr(D, "_sum_blocks", lambda values, *a: rows.append(values.shape) or plain(values, *a))
    D.candidates(texts, model, D.COSINE)
    width = model["project"].shape[1]
    used = sum(int((model["idf2"][t[t >= 0]] > 0).sum()) for t in texts)
    assert width > 64 and 0 < sum(n for n, w in rows if w == width) < used / 2


def test_term_numbers_are_those_of_the_words():
    ids = D._Ids({b"a": 0, b"b.c": 1, "é".encode(): 2})
    for text in ["", None, "A  (b.c), -- ... é! x a", "a a [a] ***", "…a ?"]:
        words = D.norm_words(text)
        assert ids.of(text).tolist() == [{b"a": 0, b"b.c": 1, "é".encode(): 2}.get(w, -1) for w in words]
