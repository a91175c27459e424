"""Mixing sources to target weights by temperature (operator 5, native).

Source weights are token shares raised to an exponent in [0, 1] and normalised.  The
exponent is the largest whose mixture still has the target entropy (as a share of the
greatest possible, ln k); where its budget would repeat a source more than
``max_repeats`` times, it is raised just far enough.  It is found by repeated section:
each aggregate over the source table evaluates ``SECTIONS`` exponents at once.

A budget of tokens is then dealt out in blocks.  Every block is a keyed permutation of
the source (sort by ``mix_key``); a source worth r + f times its tokens yields r whole
blocks and the first documents of one more, up to its budget.  The cut of that last
block is found from sums per hash bucket and then inside one bucket per source, so no
task holds a source, and texts are never shuffled.

Edge cases: a null source is a source of its own; null and empty texts weigh no tokens
and follow their source's whole blocks (and its last one, if their key lies before the
cut); equal rows share a key and are dealt together; an empty table, or one without
tokens, gives no rows; input columns pass through, but for those named as an output or ``_mix_plan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

MIX_COLUMNS = ("mix_block", "mix_key", "mix_weight", "_mix_plan")
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0
BUDGET = 1.0          # tokens to deal out, as a multiple of the corpus
SEED = 17
SECTIONS = 32
ROUNDS = 5
BUCKET_ROWS = 4096    # documents of a source that a hash bucket should hold


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def find_exponent(sources: DataFrame, total: int, budget: float, target_entropy: float,
                  max_repeats: float) -> float:
    """The exponent for a table with a positive ``tokens`` per source."""
    q = F.col("tokens") / F.lit(float(total))
    k = sources.count()
    if k < 2:
        return 1.0

    def measure(exponents):
        cells = sources.agg(*[f for a in exponents for f in (
            F.sum(F.pow(q, F.lit(a))), F.sum(F.pow(q, F.lit(a)) * F.log(q)),
            F.max(F.pow(q, F.lit(a - 1.0))))]).first()
        out = []
        for i, a in enumerate(exponents):
            z, zl, top = cells[3 * i:3 * i + 3]
            out.append((math.log(z) - a * zl / z, top / z * budget / total))
        return out

    def section(holds) -> float:
        """Boundary of a condition that holds below it (0 always, 1 never tested)."""
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [lo + (hi - lo) * i / SECTIONS for i in range(SECTIONS + 1)]
            kept = [holds(m) for m in measure(grid)]
            if kept[-1]:
                return hi
            if not kept[0]:
                return lo
            at = kept.index(False)
            lo, hi = grid[at - 1], grid[at]
        return lo

    wanted = target_entropy * math.log(k)
    exponent = section(lambda m: m[0] >= wanted - 1e-12)
    if measure([exponent])[0][1] > max_repeats:
        repeated = section(lambda m: m[1] > max_repeats)
        exponent = max(exponent, min(1.0, repeated + SECTIONS ** -float(ROUNDS)))
    return exponent


def row_hash(docs: DataFrame) -> Column:
    """What a row holds in all its columns, nulls told apart; maps cannot be hashed."""
    held = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    cells = [F.col(f"`{c}`") for c in held]
    return F.xxhash64(F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("string") for c in held]), *cells)


def _edge(cells: DataFrame, by: str) -> DataFrame:
    """Of (s, ``by``, n, room): the cell of each source in which the budget ends, and what
    of the room is left before it.  Sources whose budget covers all cells have none."""
    running = Window.partitionBy("s").orderBy(by)
    return cells.withColumn("upto", F.sum("n").over(running)).where(
        (F.col("upto") > F.col("room")) & (F.col("upto") - F.col("n") <= F.col("room"))).select(
        F.col("s").alias("e_s"), F.col(by).alias("e_by"),
        (F.col("room") - F.col("upto") + F.col("n")).alias("left"))


def last_block(rows: DataFrame, largest: int) -> DataFrame:
    """(c_s, cut, part) of (s, mix_key, tokens, room): rows with a key below ``cut`` fit the
    source's room, and ``part`` of the equal rows at it.  Ranges of keys are summed first,
    about the root of the number of buckets each time, then the keys of one bucket."""
    bits = max(0, math.ceil(math.log2(max(1, largest / BUCKET_ROWS))))
    for width in sorted({bits // 2, bits} - {0}):
        rows = rows.withColumn("bucket", F.shiftright("mix_key", 64 - width))
        ends = keep(_edge(rows.groupBy("s", "bucket").agg(
            F.sum("tokens").alias("n"), F.first("room").alias("room")), "bucket"), "mix-edges")
        rows = rows.join(ends, F.col("s").eqNullSafe(F.col("e_s")) & (F.col("bucket") == F.col("e_by"))).select(
            "s", "mix_key", "tokens", F.col("left").alias("room"))
    keys = keep(rows.groupBy("s", "mix_key").agg(
        F.sum("tokens").alias("n"), F.max("tokens").alias("each"), F.first("room").alias("room")), "mix-keys")
    ends = _edge(keys, "mix_key")
    return keys.join(ends, F.col("s").eqNullSafe(F.col("e_s")) & (F.col("mix_key") == F.col("e_by"))).select(
        F.col("s").alias("c_s"), F.col("mix_key").alias("cut"), F.expr("left div each").cast("int").alias("part"))


def mix(docs: DataFrame, source: str = "source", text: str = "text",
        target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS,
        budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """``docs``, each row as often as its source's blocks hold it, plus ``mix_block``
    (1, 2, ...), ``mix_key`` (order inside the block) and ``mix_weight``."""
    docs = docs.drop(*MIX_COLUMNS)
    place = lambda block, said: F.xxhash64(F.lit(seed), block, said)
    said = row_hash(docs)
    light = keep(docs.select(said.alias("said"), F.col(source).alias("src"),
                             count_tokens(F.col(text)).alias("tokens")), "mix-rows")
    sources = keep(light.groupBy(F.col("src").alias("s")).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).where("tokens > 0"), "mix-sources")
    total, largest = sources.agg(F.sum("tokens"), F.max("docs")).first()
    if not total:
        none = docs.limit(0)
        return none.withColumns({"mix_block": F.lit(1), "mix_key": F.lit(0).cast("long"),
                                 "mix_weight": F.lit(0.0)})
    wanted = budget * total
    exponent = find_exponent(sources, total, wanted, target_entropy, max_repeats)
    z = sources.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(exponent)))).first()[0]
    shares = sources.withColumn("mix_weight", F.pow(F.col("tokens") / total, F.lit(exponent)) / z)
    shares = shares.withColumn("quota", F.floor(F.col("mix_weight") * wanted).cast("long")).withColumns({
        "whole": F.expr("quota div tokens").cast("int"), "room": F.col("quota") % F.col("tokens")})
    shares = keep(shares, "mix-shares")

    rows = light.join(shares.select("s", "whole", "room"), F.col("src").eqNullSafe(F.col("s"))).select(
        "s", place(F.col("whole") + 1, F.col("said")).alias("mix_key"), "tokens", "room")
    cut = last_block(rows, largest)
    plan = keep(shares.join(cut, F.col("s").eqNullSafe(F.col("c_s")), "left").select(
        F.col("s").alias("mix_s"), F.col("whole").alias("mix_whole"), "mix_weight",
        F.col("cut").alias("mix_cut"), F.col("part").alias("mix_part")), "mix-plan")
    in_part = not plan.where("mix_part > 0").isEmpty()
    plan = plan.select(F.struct("*").alias("_mix_plan"))

    whole, end = F.col("_mix_plan.mix_whole"), F.col("_mix_plan.mix_cut")
    weight = F.col("_mix_plan.mix_weight").alias("mix_weight")
    planned = docs.join(plan, F.col(source).eqNullSafe(F.col("_mix_plan.mix_s")))
    last = place(whole + 1, said)
    copies = whole + F.when(end.isNotNull() & (last < end), 1).otherwise(0)
    dealt = planned.withColumn("mix_block", F.explode(F.sequence(F.lit(0), copies))).where(
        "mix_block > 0").withColumn("mix_key", place(F.col("mix_block"), said)).select(
        *docs.columns, "mix_block", "mix_key", weight)
    if not in_part:
        return dealt
    # The budget ends among equal rows: one of them, as often as they fit.
    at_cut = planned.where((last == end) & (F.col("_mix_plan.mix_part") > 0)).groupBy("_mix_plan").agg(
        F.first(F.struct(*docs.columns)).alias("row"))
    some = at_cut.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_plan.mix_part")))).select(
        "row.*", (whole + 1).alias("mix_block"), end.alias("mix_key"), weight)
    return dealt.unionByName(some)


def mixing_report(docs: DataFrame) -> DataFrame:
    """The dealt rows without their texts."""
    return mix(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", "mix_block", "mix_key", "mix_weight")
