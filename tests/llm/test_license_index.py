"""Licence labels come from the index: against brute force and on texts that must not match."""

import math
import re
from collections import Counter

from martlet.llm import license_scan as L

ROWS = "doc_id long, text string"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def runs(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i:i + len(phrase)] == phrase]


def labels_by_force(texts):
    files = [words_of(t) for t in texts]
    seen = Counter(w for f in files for w in set(f))
    idf = lambda w: math.log((len(files) + 1) / (seen[w] + 1))
    good = lambda w: w not in L.STOP_WORDS and len(w) >= L.MIN_INDEX_LENGTH
    out = []
    for f in files:
        got = {label for p, label in L.BASE_PHRASES.items() if runs(f, p.split())}
        for label, (wording, must) in L.TEMPLATES.items():
            t, musts = wording.split(), [m.split() for m in must]
            inside = {i + d for m in musts for i in runs(t, m) for d in range(len(m))}
            outside = {t[i] for i in range(len(t)) if i not in inside and good(t[i])}
            top = sorted(outside & set(f), key=lambda w: (-idf(w), w))[:L.TOP_WORDS]
            if not all(runs(f, m) for m in musts):
                continue
            for offset in range(-len(t), len(f)):
                agree = {w for i, w in enumerate(t) if i not in inside and w in top
                         and 0 <= i + offset < len(f) and f[i + offset] == w}
                stands = all(any(all(not good(x) or (0 <= i + d + offset < len(f) and f[i + d + offset] == x)
                                     for d, x in enumerate(m)) for i in runs(t, m)) for m in musts)
                if len(agree) >= L.MIN_AGREE and stands:
                    got.add(label)
                    break
        out.append(",".join(sorted(got)))
    return out


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS)
    got = {r["doc_id"]: r["labels"] for r in L.license_report(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_a_phrase_alone_is_no_licence(spark):
    assert scanned(spark, ["we dislike the mozilla public license a lot",
                           "the gnu general public license is discussed in this essay",
                           "creative commons attribution is fine", None, ""]) == [""] * 5


def test_notices_are_found_and_shuffled_words_are_not(spark):
    import random
    rnd = random.Random(2)
    whole = [w for w, _ in L.TEMPLATES.values()]
    shuffled = []
    for wording in whole:
        words = wording.split()
        rnd.shuffle(words)
        shuffled.append(" ".join(words))
    texts = [f"some code. {w}. more" for w in whole] + shuffled
    got = scanned(spark, texts)
    assert all(label in got[i].split(",") for i, label in enumerate(L.TEMPLATES))
    assert got[len(whole):] == [""] * len(whole) and got == labels_by_force(texts)


def test_labels_equal_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    texts = [r["text"] for r in rows] + [None, "", L.TEMPLATES["gpl"][0] * 2, "license " * 3000]
    assert scanned(spark, texts) == labels_by_force(texts)


def test_a_very_long_text(spark):
    texts = ["free software license under the terms " * 40_000 + " " + L.TEMPLATES["bsd"][0], "x"]
    assert "bsd" in scanned(spark, texts)[0].split(",")
