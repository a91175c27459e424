"""The near-duplicate stage of the pipeline: which row of equal and of similar ones stays."""
import corpus_pipeline as C

BASE = " ".join(f"word{i}" for i in range(120))
OTHER = " ".join(f"else{i}" for i in range(120))


def test_one_row_of_each_component_stays(spark):
    rows = [(7, BASE, "en", "a", 1), (3, BASE, "en", "b", 1), (3, BASE, "en", "b", 1),   # equal rows of the least id
            (None, BASE, "en", "a", 1), (9, OTHER, "en", "a", 1),
            (None, "odd " + OTHER[:300] * 3, None, None, None), (None, "odd " + OTHER[:300] * 3, None, None, None),
            (0, "zero " * 40, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((tuple(r) for r in C.near_duplicate(spark, docs, None).collect()), key=str)
    assert kept == sorted({rows[1], rows[4], rows[5], rows[7]}, key=str)
    # With no key few enough to be sent the same rows stay.
    most, C.SENT_KEYS = C.SENT_KEYS, -1
    try:
        assert sorted((tuple(r) for r in C.near_duplicate(spark, docs, None).collect()), key=str) == kept
    finally:
        C.SENT_KEYS = most
    assert C.near_duplicate(spark, docs.limit(0), None).count() == 0
