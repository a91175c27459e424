"""Crowded formats, long addresses, scripts and coreference of the surrogates."""

import re

from martlet.llm import pii_surrogates as P

ROWS = "doc_id long, text string"


def rewritten(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), ROWS)
    got = {r["doc_id"]: r["text"] for r in P.pseudonymise(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_a_crowded_format_gets_distinct_surrogates(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{x}@{y}.co" for x in letters for y in letters]
    table = P.assign_surrogates(spark.createDataFrame(
        [("email", m) for m in mails] + [("email", "%@-.co"), ("phone", "9")], "kind string, canon string")).collect()
    out = {(r["kind"], r["canon"]): r["surrogate"] for r in table}
    assert len(out) == len(set(out.items())) == 678 and len(set(out.values())) == 678
    assert all(s != c for (_, c), s in out.items())
    assert all(re.fullmatch("[a-z]@[a-z]\\.co", out["email", m]) for m in mails)


def test_a_very_long_address(spark):
    long = "a@" + "b.cd." * 200_000 + "com"
    out = rewritten(spark, [f"to {long}, x", "y@a.com5 z@x.5.6.com... end"])
    assert out[0].startswith("to ") and out[0].endswith(".com, x") and len(out[0]) == len(long) + 6
    assert long not in out[0]
    assert re.fullmatch(r"[a-xz]@[a-z]\.com5 [a-y]@[a-z]\.\d\.\d\.com\.\.\. end", out[1]), out[1]


def test_names_keep_script_and_person(spark):
    out = rewritten(spark, ["Mr John Smith met Mr Smith. John Smith left, John Smithson stayed.",
                            "Mr Γιώργος Παπαδόπουλος and Mrs Ελένη Παππά", "Господин Иван Петров", "John Smith alone",
                            "Ms Mary Jones, Mary Jones; Mr Peter Smith"])
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mr (\w+)\. (\w+) (\w+) left, John Smithson stayed\.", out[0])
    assert m and m[1] == m[4] != "John" and m[2] == m[3] == m[5] != "Smith"
    assert re.fullmatch(r"Mr [Ͱ-Ͽ]+ [Ͱ-Ͽ]+ and Mrs [Ͱ-Ͽ]+ [Ͱ-Ͽ]+", out[1]) and "Παπαδόπουλος" not in out[1]
    assert re.fullmatch(r"Господин [а-яА-Я]+ [а-яА-Я]+", out[2])
    assert out[3] == "John Smith alone"
    w = re.fullmatch(r"Ms (\w+ \w+), (\w+ \w+); Mr (\w+) (\w+)", out[4])
    assert w and w[1] == w[2] and w[4] == m[2] and w[3] != m[1]
