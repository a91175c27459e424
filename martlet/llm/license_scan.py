"""Licence scan with a positional rare-token index (operator 7, native).

Template words are indexed with their positions.  Inverse document frequencies
of these words come from the whole corpus.  Of each file and template the highest-IDF
words outside the mandatory phrases are looked up, and the postings are intersected by
relative position (file position minus template position).  A template counts as found
at an offset on which enough of these words agree, once its mandatory phrases are
verified: they stand in the file, and their words at that same offset.  A phrase alone,
or a template's words in another order, is no licence.
Exact key phrases ("base") are counted beside it; their labels always stay.

Edge cases: null and empty texts have no words, no labels and score 0; repeated
rows are scanned each on its own; an empty corpus gives an empty result; extra columns
pass through, but for those named ``lic_...`` like the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, without_own

# Fixed values of the contract: phrase -> label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Templates: label -> (characteristic wording, mandatory phrases).  The wording is
# the public licences' own notice text.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files released under the mit license",
            ("mit license",)),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of "
                 "this software and associated documentation files",
                 ("permission is hereby granted",)),
    "apache-2": ("licensed under the apache license version 2 0 you may not use this file except "
                 "in compliance with the license", ("apache license",)),
    "gpl": ("this work is licensed under the gnu general public license version 3 this program is "
            "free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation",
            ("gnu general public license",)),
    "lgpl": ("this library is free software under the terms of the gnu lesser general public "
             "license as published by the free software foundation",
             ("gnu lesser general public license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
            ("redistribution and use",)),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",
              ("mozilla public license",)),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial license "
                 "licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike license "
                 "licensed under cc by sa 4 0", ("cc by sa",)),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international "
              "license", ("creative commons attribution",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted", ("permission to use copy modify",)),
    "unlicense": ("this is free and unencumbered software released into the public domain",
                  ("unencumbered software",)),
}
TOP_WORDS = 12       # licence words looked up per file and template
MIN_AGREE = 2        # words outside the phrases that must agree on one offset
MIN_INDEX_LENGTH = 2  # shorter words are not indexed
# Function words are never a licence word.
STOP_WORDS = ("a", "and", "any", "are", "as", "by", "can", "for", "in", "is", "it", "of", "or",
              "that", "the", "this", "to", "use", "with", "you", "may", "not", "no")
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def marked_words(text: Column) -> Column:
    """The text as ``<word><word>...`` with A-Z lowered.

    ``lower`` also folds other scripts; the only two characters it would turn into
    ASCII letters (dotted capital I, Kelvin sign) are replaced first by another
    non-ASCII letter, which keeps word boundaries and never meets a phrase.
    """
    t = F.coalesce(text, F.lit(""))
    for odd in ("İ", "K"):
        t = F.replace(t, F.lit(odd), F.lit("é"))
    t = F.regexp_replace(F.lower(t), NON_WORD, "><")
    return F.replace(F.concat(F.lit("<"), t, F.lit(">")), F.lit("<>"), F.lit(""))


def _marked(phrase: str) -> str:
    return "".join(f"<{w}>" for w in phrase.split())


def _words_in(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit("<"), F.lit("")))


def _places(wording: list[str], phrase: list[str]) -> list[list[int]]:
    """The places that each standing of a phrase covers in a wording."""
    n = len(phrase)
    return [list(range(i, i + n)) for i in range(len(wording) - n + 1) if wording[i:i + n] == phrase]


def _indexed(word: str) -> bool:
    return word not in STOP_WORDS and len(word) >= MIN_INDEX_LENGTH


def _postings(templates) -> dict[str, list[tuple[str, int, bool]]]:
    """Word -> (label, place, whether a mandatory phrase covers the place)."""
    index: dict[str, list[tuple[str, int, bool]]] = {}
    for label, (wording, must) in templates.items():
        words = wording.split()
        covered = {i for m in must for places in _places(words, m.split()) for i in places}
        for at, word in enumerate(words):
            if _indexed(word):
                index.setdefault(word, []).append((label, at, at in covered))
    return index


def _in_place(templates, label: Column, places: Column) -> Column:
    """Whether ``places`` hold a standing of each mandatory phrase of the template."""
    out = None
    for name, (wording, must) in templates.items():
        words = wording.split()
        ok = F.lit(True)
        for m in must:
            standings = [[i for i in s if _indexed(words[i])] for s in _places(words, m.split())]
            if standings:
                ok = ok & _any([F.size(F.array_except(F.array(*map(F.lit, s)), places)) == 0
                                for s in standings if s] or [F.lit(True)])
        out = F.when(label == name, ok) if out is None else out.when(label == name, ok)
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``lic_n_words``, ``lic_n_base``,
    ``lic_first_word``, ``lic_last_word``, ``lic_base`` and ``lic_labels`` (sorted
    arrays) and ``lic_score`` (share of a template's looked-up words found in place)."""
    docs = without_own(docs, "lic_")
    others = [c for c in docs.columns if c != text]
    index = _postings(templates)
    vocabulary = F.array(*[F.lit(w) for w in index])
    marked = docs.withColumn("lic_marked", marked_words(F.col(text))).drop(text)
    s = F.col("lic_marked")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        p = _marked(phrase)
        there = s.contains(p)
        counts.append(F.when(there, F.size(F.split(s, p)) - 1).otherwise(0))
        firsts.append(F.when(there, _words_in(F.substring_index(s, p, 1))))
        lasts.append(F.when(there, _words_in(s) - _words_in(F.substring_index(s, p, -1))
                            - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    verified = F.array_compact(F.array(*[
        F.when(_all([s.contains(_marked(m)) for m in must]), F.lit(label))
        for label, (_, must) in templates.items()]))
    pick = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    out = marked.select(
        *others, F.monotonically_increasing_id().alias("lic_row"),
        _words_in(s).cast("long").alias("lic_n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("lic_n_base"),
        pick(F.least, firsts).cast("long").alias("lic_first_word"),
        pick(F.greatest, lasts).cast("long").alias("lic_last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("lic_base"),
        verified.alias("lic_verified"),
        # A regex over the index vocabulary spares most files the word split.
        F.when(s.rlike("<(" + "|".join(index) + ")>"), F.filter(F.transform(
            F.split(F.regexp_replace(s, "^<|>$", ""), "><"),
            lambda w, i: F.when(F.array_contains(vocabulary, w), F.struct(
                w.alias("word"), i.alias("at")))), lambda x: x.isNotNull())).alias("lic_found"))
    out = keep(out, "license-files")

    hits = out.where(F.col("lic_found").isNotNull()).select(
        "lic_row", "lic_verified", F.explode("lic_found").alias("f")).select(
        "lic_row", "lic_verified", "f.word", "f.at")
    # Document frequencies over the whole corpus; at most one row per template word.
    frequencies = {r["word"]: r["df"] for r in hits.groupBy("word").agg(
        F.count_distinct("lic_row").alias("df")).collect()}
    total = max(out.count(), 1)
    weights = {w: math.log((total + 1) / (frequencies.get(w, 0) + 1)) for w in index}
    # Highest IDF first; ties by word.
    ranked = {label: sorted({w for w, places in index.items() if any(x[0] == label and not x[2] for x in places)},
                            key=lambda w: (-weights[w], w)) for label in templates}
    there = F.array_distinct(F.col("lic_found.word"))
    looked = F.filter(F.array(*[F.struct(
        F.lit(label).alias("label"),
        F.slice(F.array_intersect(F.array(*map(F.lit, words)), there), 1, TOP_WORDS).alias("words"))
        for label, words in ranked.items() if words]), lambda x: F.size(x["words"]) >= MIN_AGREE)
    postings = docs.sparkSession.createDataFrame(
        [(w, label, at, must) for w, places in index.items() for label, at, must in places],
        "word string, label string, place int, must boolean")
    # One row per template word, so the postings are always small enough to send.
    asked = out.where(F.col("lic_found").isNotNull()).select(
        "lic_row", "lic_verified", "lic_found", F.explode(looked).alias("t")).select(
        "lic_row", "lic_verified", F.col("t.label").alias("label"), F.col("t.words").alias("words"),
        F.explode("lic_found").alias("f"))
    votes = asked.join(F.broadcast(postings), (F.col("f.word") == F.col("word")) & (
        asked["label"] == postings["label"])).drop(postings["label"]).where(
        F.col("must") | F.array_contains("words", F.col("word")))
    agreed = votes.groupBy("lic_row", "label", (F.col("f.at") - F.col("place")).alias("offset")).agg(
        F.collect_set(F.when(~F.col("must"), F.col("word"))).alias("agree"),
        F.collect_set(F.when(F.col("must"), F.col("place"))).alias("places"),
        F.first("lic_verified").alias("lic_verified"))
    size_of = F.create_map(*[x for label, words in ranked.items() for x in (
        F.lit(label), F.lit(max(1, min(TOP_WORDS, len(words)))))])
    found = agreed.where((F.size("agree") >= MIN_AGREE) & F.array_contains("lic_verified", F.col("label"))
                         & _in_place(templates, F.col("label"), F.col("places"))).groupBy("lic_row").agg(
        F.collect_set("label").alias("lic_m_labels"),
        F.max(F.least(F.lit(1.0), F.size("agree") / size_of[F.col("label")])).alias("lic_m_score"))
    joined = out.drop("lic_found", "lic_verified").join(found, "lic_row", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *others, "lic_n_words", "lic_n_base", "lic_first_word", "lic_last_word", "lic_base",
        F.array_sort(F.array_union("lic_base", F.coalesce("lic_m_labels", none))).alias("lic_labels"),
        F.when(F.size("lic_base") > 0, F.lit(1.0)).otherwise(
            F.coalesce("lic_m_score", F.lit(0.0))).alias("lic_score"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def license_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`scan`."""
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", F.col("lic_n_words").alias("n_words"), F.col("lic_n_base").alias("n_base"),
        F.col("lic_first_word").alias("first_word"), F.col("lic_last_word").alias("last_word"),
        F.array_join("lic_base", ",").alias("base_labels"),
        F.array_join("lic_labels", ",").alias("labels"), F.col("lic_score").alias("score"))
