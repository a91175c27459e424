"""Stored intermediates of the operators."""

import glob

from martlet.llm.common import keep
from martlet.session import materialize


def test_intermediates_are_stored_compressed(spark):
    import pyarrow.parquet as pq
    rows = [(i, "some words of a text " * 20) for i in range(50)]
    for store in (keep, materialize):
        kept = store(spark.createDataFrame(rows, "id long, text string"), "stored")
        assert sorted(map(tuple, kept.collect())) == rows
        files = [f.replace("file://", "") for f in kept.inputFiles()]
        groups = [pq.ParquetFile(f).metadata for f in files]
        assert {m.row_group(0).column(1).compression for m in groups if m.num_rows} == {"ZSTD"}
