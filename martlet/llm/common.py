"""Helpers shared by the operators: reading, stored intermediates, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.session import ensure_checkpoint_dir

# The whitespace of the word contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` as Parquet in the shared checkpoint folder and read it back:
    the lineage is cut and the copy outlives any executor.  zstd keeps the texts that an
    operator or a stage stores smaller than Parquet's default does."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/martlet-llm/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_own(docs: DataFrame, prefix: str) -> DataFrame:
    """``docs`` without columns named like an operator's own (they start with its prefix)."""
    return docs.drop(*[c for c in docs.columns if c.lower().startswith(prefix)])


def space_words(text: Column) -> Column:
    """Words of a text as an array: maximal runs of non-whitespace (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % folds


def with_text_columns(docs: DataFrame, text: str, fields: list[tuple], make: Callable) -> DataFrame:
    """``docs`` without its text, plus ``fields`` (name, Spark type) that ``make()(texts)``
    computes batch by batch.  Other columns pass through as Arrow, nulls and all."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in docs.columns if c != text]
    source = docs.select(F.col(text).cast("string").alias(text), *others)
    schema = T.StructType(source.schema.fields[1:]
                          + [T.StructField(n, t) for n, t in fields])

    def run(batches):
        compute, kinds = make(), to_arrow_schema(schema)
        for batch in batches:
            new = compute(batch.column(0).to_pylist())
            old = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*old, *(pa.array(v, type=kinds.field(n).type) for (n, _), v in zip(fields, new))],
                names=kinds.names)
    return source.mapInArrow(run, schema)
