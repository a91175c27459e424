"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from martlet.checking import compare, duckdb_connection
from martlet.llm import (bloom_lm, chat_format, decontaminate, license_scan, mixing, pii_surrogates,
                         quality_rules, registry, simhash, suffix_dedup)

DOC = "doc_id long, text string, lang string, source string, n_chars long, tokens string"


def frame(spark, texts):
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, "x")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " \n\t", "a", "word " * 3000, "same text here twice", "same text here twice",
       "\x00odd\x0b#*$%&|<> ÉÀ K İ", "line\nline\nline\n" * 30]


def test_suffix_dedup_equals_brute_force(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab ") for _ in range(900)) for _ in range(5)]
    texts = [None, "", "a" * 1500, "ab" * 700, base[0], base[0][:450] + "x" + base[0][450:],
             base[1] + base[0][100:600], "x" * 399, base[2] * 2, "é" * 500,
             *(base[3][:300 + i] + "q" + base[3][300 + i:] for i in range(12))]
    expected = [(len((t or "").encode()), r, n, k) for t, (k, r, n) in zip(
        texts, suffix_dedup.brute_force([(t or "").encode() for t in texts]))]
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["sd_bytes"], r["sd_removed"], r["sd_spans"], bytes(r["sd_kept"]))
           for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    # Intervals over the split size give the same spans.
    keyed = docs.where(F.col("doc_id") > 1)
    spans = [{r["key"]: suffix_dedup.cut((texts[r["key"]] or "").encode(), r["spans"])
              for r in suffix_dedup.repeated_spans(keyed, "doc_id", split=n).collect()} for n in (2, 20_000)]
    assert spans[0] == spans[1] and spans[0]


def test_chat_digest(spark, sf_dir):
    con = duckdb_connection(sf_dir)
    got = registry.QUERIES["op2_chat_format"](spark, sf_dir)
    assert compare(got, con, chat_format.CHAT_ORACLE)["match"]
    rows = [(1, 0, "us\ner", "a&amp;<|b|> <|im_end|>\n"), (1, 1, "assistant", None), (2, 0, None, "<")]
    digest = {r["conv_id"]: r for r in chat_format.chat_digest(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")).collect()}
    said = "us\ner\na&amp;<|b|> <|im_end|>\n\nassistant\n\n"
    assert digest[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digest[1]["loss_chars"] == 0 and digest[2]["n_turns"] == 1


def test_license_base_counts(spark):
    text = "Under the MIT License under the mit license. Apache License, Version 2.0 CC BY-NC 4.0 İx"
    rows = {r["doc_id"]: r for r in license_scan.license_report(frame(spark, [text, *ODD])).collect()}
    r = rows[0]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (19, 4, 0, 13)
    assert r["base_labels"] == "apache-2,cc-by-nc,mit"
    assert set(r["base_labels"].split(",")) <= set(r["labels"].split(","))
    assert rows[1]["n_words"] == 0 and rows[1]["labels"] == "" and len(rows) == len(ODD) + 1


def components_by_force(prints, max_bits):
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= max_bits:
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("split", [10, 20_000])
def test_simhash_components_equal_brute_force(spark, split):
    rnd = random.Random(5)
    prints = [0]
    for _ in range(150):
        x = rnd.choice(prints) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(7)):
            x ^= 1 << rnd.randrange(64)
        prints.append(x)
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), split=split)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    labels = [roots.get(x, x) for x in signed]
    expected = components_by_force(prints, 4)
    assert len(set(zip(labels, expected))) == len(set(labels)) == len(set(expected))


def test_simhash_odd_texts(spark):
    rows = {r["doc_id"]: r for r in simhash.near_duplicate_report(frame(spark, ODD)).collect()}
    assert rows[0]["fingerprint"] == "0" * 16 and rows[2]["component_id"] == 0
    assert rows[5]["component_id"] == rows[6]["component_id"] == 5


def test_quality_counts(spark):
    texts = [*ODD, "a b c x a b c d", "one two three four " * 20 + "\nend"]
    rows = {r["doc_id"]: r for r in quality_rules.quality_report(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        covered = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        assert rows[i]["n_words"] == len(words)
        assert rows[i]["n_repeat_words"] == len(covered)
        assert rows[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert rows[i]["word_chars"] == sum(len(w.decode()) for w in words)
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def test_quality_keeps_most_good_documents(spark, sf_dir):
    read = lambda t: spark.read.parquet(os.path.join(sf_dir, t + ".parquet"))
    verdicts = quality_rules.quality_report(read("documents")).join(
        read("labels").where("quality = 1"), "doc_id").where("not base_failed")
    assert verdicts.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.95


def test_toxicity_odd_and_held_out(spark):
    rnd = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet"]
    texts = [" ".join(rnd.choices(words, k=30)) + (" vile slur" if i % 4 == 0 else "") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    from martlet.llm import toxicity
    rows = toxicity.toxicity_report(frame(spark, texts + ODD), labels).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 200]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) and len(rows) == 209
    none = toxicity.toxicity_report(frame(spark, ODD), labels.limit(0)).collect()
    assert len(none) == len(ODD)


def test_lm_base_score(spark):
    texts = ["the cat sat", "The dog sat", *ODD, *(f"the cat {i} ran" for i in range(30))]
    rows = bloom_lm.lm_report(frame(spark, texts)).collect()
    tokens = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    counts = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["train_tokens"]) == (len(t), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in t)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] <= 0
    assert bloom_lm.lm_report(frame(spark, ODD).limit(0)).count() == 0


def test_decontamination_finds_planted_items(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    items = [say(rnd.randint(15, 90)) + "." for _ in range(30)]
    texts = [say(200) for _ in range(60)]
    for i, item in enumerate(items):
        texts[i] = say(rnd.randrange(70)) + " " + item + " " + say(60)
    bench = spark.createDataFrame([*enumerate(items), (98, ""), (99, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, texts + ODD), bench).collect()}
    planted = {(i, i) for i in range(30)}
    assert len(found & planted) >= 0.9 * len(planted) and not found - planted
    assert decontaminate.leaks(frame(spark, ODD), bench.limit(0)).count() == 0


def test_lcs():
    assert decontaminate.lcs([b"a", b"b", b"c", b"b"], [b"b", b"x", b"c", b"b"]) == 3


def test_mixing_meets_its_weights(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"s{i % 3}", 0) for i in range(3000)]
    docs = spark.createDataFrame([*rows, (None, None, None, 1), (9000, "", None, 1)],
                                 "doc_id long, text string, source string, mix_s int")
    out = mixing.mix(docs, target_entropy=0.9).withColumn("n", mixing.count_tokens(F.col("text")))
    got = {r["source"]: r for r in out.groupBy("source").agg(
        F.sum("n").alias("n"), F.max("mix_weight").alias("w"), F.max("mix_block").alias("b")).collect()}
    total = sum(len(t.split()) for _, t, _, _ in rows)
    weights = {s: r["w"] for s, r in got.items()}
    entropy = -sum(w * math.log(w) for w in weights.values())
    assert abs(sum(weights.values()) - 1) < 1e-9
    assert max(r["b"] for r in got.values()) <= mixing.MAX_REPEATS + 1
    assert entropy >= 0.9 * math.log(len(weights)) - 1e-6 or max(r["b"] for r in got.values()) >= mixing.MAX_REPEATS
    assert all(abs(r["n"] - r["w"] * total) <= 16 for r in got.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pii_surrogates(spark):
    texts = ["Mr John Smith called +1 (017) 555-7713 or +1 017 555 7713, ann.b@mail.example.com.",
             "ann.b@mail.example.com and bob.c@mail.example.com 10.20.30.40 4845168114407329", *ODD]
    out = {r["doc_id"]: r for r in pii_surrogates.pseudonymise(frame(spark, texts)).collect()}
    assert out[0]["pii_entities"] == 4 and out[1]["pii_entities"] == 4
    for secret in ("Smith", "555", "ann.b", "bob.c", "10.20.30.40", "4845168114407329"):
        assert secret not in out[0]["text"] + out[1]["text"]
    mail = out[1]["text"].split()[0]
    assert mail in out[0]["text"] and mail != out[1]["text"].split()[2]
    assert out[0]["text"].startswith("Mr ") and len(out) == len(texts)
    assert [out[i + 2]["text"] for i in range(len(ODD))] == ODD


def test_pii_surrogates_are_distinct(spark):
    table = pii_surrogates.assign_surrogates(spark.createDataFrame(
        [("ip", f"1.1.{i // 250}.{i % 250}") for i in range(1500)] + [("secret", f"{i:04x}") for i in range(900)],
        "kind string, canon string")).collect()
    assert len({(r["kind"], r["surrogate"]) for r in table}) == len(table) == 2400
    assert not {(r["kind"], r["surrogate"]) for r in table} & {(r["kind"], r["canon"]) for r in table}


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and set(corpus_pipeline.COLUMNS) < set(out.columns)
