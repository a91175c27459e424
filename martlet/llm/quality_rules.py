"""Quality rules: robust multivariate outliers (operator 9, native).

Each text becomes a vector of transformed statistics.  Per (language, source)
group a minimum-covariance-determinant estimate is found by concentration
steps: centre and scatter of the h closest rows, distances anew, and so on;
then one reweighting step.  A document is rejected when its Mahalanobis
distance exceeds the cut-off.  Everything is a mergeable aggregate per group,
so a hot source costs no more per task than its share of map-side sums.

Edge cases: a null or empty text has no words and fails the base rules; null
language or source form groups of their own (null-safe joins); an empty table
gives an empty result; repeated rows are judged each on its own; a group too
small to have a scatter falls back on the floor of each statistic; extra columns pass
through, but for those named ``q_...`` like the operator's own.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, count_chars, keep, space_words, without_own

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SUBSET = 0.75          # h / n of the concentration steps
STEPS = 3
# Chi-square quantiles for 5 statistics: median, 0.975 (reweighting), and the
# rejection cut-off, far out (1e-6) so that ordinary documents stay.
CHI2_MEDIAN, CHI2_REWEIGHT, CHI2_REJECT = 4.351, 12.83, 35.89
# Statistic -> smallest standard deviation it is taken to have (regularises
# groups in which most documents share one value).
FLOORS = {"q_word_len": 0.06, "q_symbols": 0.05, "q_dup_lines": 0.10,
          "q_repeats": 0.10, "q_upper": 0.05}


def repeat_words(words: Column, n: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    Windows are compared by 64-bit hash: (hash, position) pairs are sorted
    inside the row and equal neighbours mark repeats.
    """
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1),
                                      F.get(words, i + 2)).alias("h"), i.alias("p"))))
    return windows


def _covered(windows: Column) -> Column:
    """Words covered by the repeated windows of a sorted (hash, position) array."""
    def repeated(w: Column, i: Column) -> Column:
        before, after = F.get(windows, i - 1)["h"], F.get(windows, i + 1)["h"]
        return F.coalesce(w["h"] == before, F.lit(False)) | F.coalesce(w["h"] == after, F.lit(False))
    starts = F.transform(F.filter(windows, repeated), lambda w: w["p"])
    return F.size(F.array_distinct(F.flatten(F.transform(
        starts, lambda p: F.array(p, p + 1, p + 2)))))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (prefixed ``q_``) beside its own columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    staged = docs.withColumns({
        "q_words": space_words(F.col(text)),
        "q_lines": lines,
        "q_word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "q_n_symbols": count_chars(t, SYMBOLS).cast("long"),
        "q_n_upper": count_chars(t, string.ascii_uppercase).cast("long"),
    })
    staged = staged.withColumns({
        "q_n_words": F.size("q_words").cast("long"),
        "q_n_lines": F.size("q_lines").cast("long"),
        "q_n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_windows": F.when(F.size("q_words") >= 3,
                            repeat_words(F.col("q_words"), F.size("q_words"))),
    }).drop("q_words", "q_lines")
    return staged.withColumn(
        "q_n_repeat_words",
        F.when(F.col("q_windows").isNull(), F.lit(0)).otherwise(_covered(F.col("q_windows")))
        .cast("long")).drop("q_windows")


def _features() -> dict[str, Column]:
    words = F.greatest(F.col("q_n_words"), F.lit(1))
    chars = F.greatest(F.col("q_word_chars"), F.lit(1))
    lines = F.greatest(F.col("q_n_lines"), F.lit(1))
    return {
        "q_word_len": F.log(F.greatest(F.col("q_word_chars"), F.lit(1)) / words),
        "q_symbols": F.sqrt(F.col("q_n_symbols") / chars),
        "q_dup_lines": F.sqrt(F.col("q_n_dup_lines") / lines),
        "q_repeats": F.sqrt(F.col("q_n_repeat_words") / words),
        "q_upper": F.sqrt(F.col("q_n_upper") / chars),
    }


def _distance(names: list[str], mean: dict[str, Column], cov: dict[tuple, Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution over the Cholesky
    factor stored per group (``cov[i, j]`` for j <= i)."""
    z: dict[str, Column] = {}
    total = F.lit(0.0)
    for i, a in enumerate(names):
        rest = F.col(a) - mean[a]
        for b in names[:i]:
            rest = rest - cov[a, b] * z[b]
        z[a] = rest / cov[a, a]
        total = total + z[a] * z[a]
    return total


def _cholesky(scatter: DataFrame, names: list[str], floors: dict[str, float]) -> DataFrame:
    """Add the factor of the floored covariance, one column per entry."""
    out = scatter
    for i, a in enumerate(names):
        for j, b in enumerate(names[:i + 1]):
            s = F.col(f"q_s_{a}_{b}") - F.col(f"q_m_{a}") * F.col(f"q_m_{b}")
            if a == b:
                s = F.greatest(s, F.lit(0.0)) + F.lit(floors[a] ** 2)
            for c in names[:j]:
                s = s - F.col(f"q_l_{a}_{c}") * F.col(f"q_l_{b}_{c}")
            value = F.sqrt(F.greatest(s, F.lit(floors[a] ** 2 / 4))) if a == b \
                else s / F.col(f"q_l_{b}_{b}")
            out = out.withColumn(f"q_l_{a}_{b}", value)
    return out


def _join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    renamed = groups.select(*[F.col(k).alias(f"q_g_{k}") for k in keys],
                            *[c for c in groups.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"q_g_{k}")) for k in keys]
    return rows.join(renamed, on).drop(*[f"q_g_{k}" for k in keys])


def mcd_distances(rows: DataFrame, keys: list[str], floors: dict[str, float],
                  subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """``rows`` with ``q_d2``, the squared robust distance within its group."""
    names = list(floors)

    def fit(frame: DataFrame, inside: Column, label: str) -> DataFrame:
        aggs = []
        for i, a in enumerate(names):
            aggs.append(F.avg(F.when(inside, F.col(a))).alias(f"q_m_{a}"))
            aggs += [F.avg(F.when(inside, F.col(a) * F.col(b))).alias(f"q_s_{a}_{b}")
                     for b in names[:i + 1]]
        scatter = _cholesky(frame.groupBy(*keys).agg(*aggs), names, floors)
        wanted = [f"q_m_{a}" for a in names] + [f"q_l_{a}_{b}" for i, a in enumerate(names)
                                              for b in names[:i + 1]]
        return keep(scatter.select(*keys, *wanted), label)

    def measured(groups: DataFrame) -> DataFrame:
        joined = _join_groups(rows, groups, keys)
        mean = {a: F.col(f"q_m_{a}") for a in names}
        factor = {(a, b): F.col(f"q_l_{a}_{b}") for i, a in enumerate(names)
                  for b in names[:i + 1]}
        return joined.select(*rows.columns, _distance(names, mean, factor).alias("q_d2"))

    def quantile(frame: DataFrame, share: float, label: str) -> DataFrame:
        return keep(frame.groupBy(*keys).agg(
            F.percentile_approx("q_d2", F.lit(share), F.lit(10000)).alias("q_cut")), label)

    # Start: coordinate-wise medians and quartile ranges.
    quartiles = rows.groupBy(*keys).agg(*[
        F.percentile_approx(a, [0.25, 0.5, 0.75], 10000).alias(a) for a in names])
    start = keep(quartiles.select(
        *keys, *[F.col(a)[1].alias(f"q_m_{a}") for a in names],
        *[(F.lit(0.0) if a != b else F.greatest((F.col(a)[2] - F.col(a)[0]) / 1.349,
                                                F.lit(floors[a]))).alias(f"q_l_{a}_{b}")
          for i, a in enumerate(names) for b in names[:i + 1]]), "mcd-start")
    groups = start
    for step in range(steps):
        current = measured(groups)
        cuts = quantile(current, subset, f"mcd-cut{step}")
        groups = fit(_join_groups(current, cuts, keys), F.col("q_d2") <= F.col("q_cut"),
                     f"mcd-fit{step}")
    # Consistency: the median distance of a group is set to the chi-square median,
    # then rows within the 0.975 quantile give the final estimate.
    current = measured(groups)
    medians = quantile(current, 0.5, "mcd-median")
    scaled = _join_groups(current, medians, keys)
    inside = F.col("q_d2") * CHI2_MEDIAN <= CHI2_REWEIGHT * F.greatest(F.col("q_cut"), F.lit(CHI2_MEDIAN))
    return measured(fit(scaled, inside, "mcd-final"))


def judge(docs: DataFrame, keys: tuple[str, ...] = ("lang", "source"), text: str = "text",
          reject: float = CHI2_REJECT) -> DataFrame:
    """Statistics, robust distance ``q_d2``, ``q_base_failed`` and ``q_kept`` per
    document; the text itself is not carried (join back on a key if wanted)."""
    docs = without_own(docs, "q_")
    others = [c for c in docs.columns if c != text]
    stats = text_statistics(docs, text).drop(text)
    stats = keep(stats.withColumns(_features()), "quality-stats")
    measured = mcd_distances(stats, list(keys), FLOORS)
    failed = (F.col("q_n_words") < MIN_WORDS) | \
        (100 * F.col("q_n_repeat_words") > REPEAT_PERCENT * F.col("q_n_words"))
    return measured.withColumn("q_base_failed", failed).withColumn(
        "q_kept", ~failed & (F.col("q_d2") <= reject)).select(
        *others, *[c for c in stats.columns if c not in others],
        "q_d2", "q_base_failed", "q_kept")


def quality_report(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`judge`."""
    return judge(docs).select(
        "doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"), F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
        F.col("q_d2").alias("distance2"))


__all__ = ["SPACE_CLASS", "judge", "mcd_distances", "quality_report", "text_statistics"]
