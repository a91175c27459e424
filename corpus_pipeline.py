"""The corpus pipeline: quality rules, near duplicates, decontamination, personal
data, mixing.  ``STAGES`` are applied in order, each stored before the next.  Texts are
not shuffled: the quality verdict is computed on the row from its group's few parameters,
and what other stages drop is stored as bare keys, counted, and sent to the executors while
there are at most ``SENT_KEYS`` of them (beyond it Spark joins by shuffle).

Edge cases: every stage decides on rows, not ids.  Rows with a null id are judged like any
other; rows of one id and different content each get their own decision; of rows equal in
id and content the near-duplicate stage keeps one.  Null and empty texts fail the quality
rules.  Columns beyond those of ``documents`` are left out; empty tables pass every stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from martlet.llm.common import keep, table
from martlet.llm.decontaminate import leaks
from martlet.llm.mixing import mix
from martlet.llm.pii_surrogates import pseudonymise
from martlet.llm.quality_rules import judge
from martlet.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def content():
    """What a row says, as a hash; a null language and a null source differ."""
    return F.xxhash64("text", F.col("lang").isNull(), "lang", "source")


SENT_KEYS = 4_000_000   # of up to 24 bytes


def counted(keys):
    """Stored keys, to be sent to the executors if they are few enough."""
    return F.broadcast(keys) if keys.count() <= SENT_KEYS else keys


def quality(spark, docs, sf_dir):
    """Drop the documents that the quality rules reject (operator 9)."""
    judged = judge(docs.select(*COLUMNS, F.col("text").alias("whole")))
    return judged.where("q_kept").withColumnRenamed("whole", "text").select(*COLUMNS)


ROW = ["no_id", "id", "content"]


def near_duplicate(spark, docs, sf_dir):
    """Keep one row of each SimHash component (operator 8): the smallest id, else content.
    Rows are told apart by id and content; of equal rows, which are rare, one is kept."""
    docs = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("no_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), content().alias("content"))
    groups = keep(near_duplicates(docs.select(*ROW, "text"), key="id"), "groups")
    firsts = keep(groups.groupBy("sh_root").agg(
        F.min(F.struct(*ROW)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    members = keep(groups.join(counted(firsts), "sh_root").select(
        *ROW, (F.struct(*ROW) == F.col("first")).alias("is_first")), "members")
    dropped = keep(members.where("not is_first").select(*ROW).distinct(), "copies")
    equal = keep(members.where("is_first").groupBy(*ROW).count().where("count > 1").select(*ROW), "equal-rows")
    docs = docs.join(counted(dropped), ROW, "left_anti")
    once = docs.join(counted(equal), ROW, "left_anti").select(*COLUMNS)
    return once.union(docs.join(counted(equal), ROW, "left_semi").dropDuplicates(ROW).select(*COLUMNS))


def decontamination(spark, docs, sf_dir):
    """Drop the documents that hold a benchmark item (operator 4).  Whether one does is a
    matter of its text alone, so texts are told apart by hash."""
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("said"))
    found = leaks(docs.select("said", "text"), table(spark, sf_dir, "benchmark"), key="said")
    return docs.join(counted(keep(found.select("said").distinct(), "leaks")), "said", "left_anti").select(*COLUMNS)


def personal_data(spark, docs, sf_dir):
    """Replace personal data by surrogates (operator 6)."""
    return pseudonymise(docs.select(*COLUMNS)).select(*COLUMNS)


def mixing(spark, docs, sf_dir):
    """Deal the documents out by source weights (operator 5)."""
    return mix(docs.select(*COLUMNS))


STAGES = [("quality", quality), ("near_duplicates", near_duplicate),
          ("decontamination", decontamination), ("personal_data", personal_data),
          ("mixing", mixing)]
ORACLE_SQL = None  # covariance estimates, XXH64 fingerprints and the SVD are not SQL


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
