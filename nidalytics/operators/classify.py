"""Classify segments as present, absent or uncertain, and label the readings."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nidalytics.plans.quantiles import MANY_VALUES, exact_quantiles, value_cell
from nidalytics.plans.stages import cut, spread

PRESENT, ABSENT, UNCERTAIN = "present", "absent", "uncertain"
STATES = (PRESENT, ABSENT, UNCERTAIN)
SENSITIVITY = 0.3
IQR_SENSITIVITY = 0.5
MIN_RANGE = 5.0
MIN_IQR = 2.0
MAX_ITERATIONS = 200
TOLERANCE = 1e-5
VARIANCE_FLOOR = 1e-6


def median_counts(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct segment medians per key with the number of segments that have them."""
    return segments.groupBy(*keys, "seg_median").agg(F.count(F.lit(1)).alias("_w"))


def cluster_viable(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: at least two distinct rounded medians and a range of 5 or more."""
    m = F.col("seg_median")
    return segments.groupBy(*keys).agg(
        ((F.count_distinct(F.bround(m)) >= 2) & (F.max(m) - F.min(m) >= MIN_RANGE)).alias("viable")
    )


def best_cut(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Optimal two-cluster split of the medians of each key: the two centres and the highest value of the lower.

    In one dimension the best split is a cut of the sorted values, so all cuts
    are scored with running sums and the best is kept (the lowest cut on ties).
    The sums run over cells of values first, then inside each cell, so that no
    task holds all distinct medians of a key.
    """
    counts = counts.withColumn("_cell", value_cell(F.col("seg_median").cast("double")))
    m, w = F.col("seg_median"), F.col("_w")
    below = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    cells = counts.groupBy(*keys, "_cell").agg(F.sum(w).alias("_cn"), F.sum(w * m).alias("_cs"))
    cells = cells.select(
        *keys,
        "_cell",
        F.coalesce(F.sum("_cn").over(below), F.lit(0)).alias("_bn"),
        F.coalesce(F.sum("_cs").over(below), F.lit(0.0)).alias("_bs"),
        F.sum("_cn").over(whole).alias("_n"),
        F.sum("_cs").over(whole).alias("_s"),
    )
    upto = Window.partitionBy(*keys, "_cell").orderBy("seg_median").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(cells, [*keys, "_cell"]).select(
        *keys,
        "seg_median",
        (F.col("_bn") + F.sum(w).over(upto)).alias("_n1"),
        (F.col("_bs") + F.sum(w * m).over(upto)).alias("_s1"),
        "_n",
        "_s",
    )
    n2, s2 = F.col("_n") - F.col("_n1"), F.col("_s") - F.col("_s1")
    # the within-cluster sum of squares is lowest where this is highest
    between = F.col("_s1") * F.col("_s1") / F.col("_n1") + s2 * s2 / n2
    scored = sums.where(n2 > 0).withColumn("_score", F.round(between, 6))
    best = F.struct(F.col("_score"), -F.col("seg_median"))
    picked = scored.groupBy(*keys).agg(
        F.max_by(
            F.struct(
                (F.col("_s1") / F.col("_n1")).alias("centre_lo"),
                (s2 / n2).alias("centre_hi"),
                F.col("seg_median").alias("cut"),
            ),
            best,
        ).alias("_c")
    )
    return picked.select(*keys, "_c.*")


def two_means(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Optimal two-cluster split of the medians of each key, as two centres."""
    return best_cut(median_counts(segments, keys), keys).drop("cut")


def _three_way(value: Column, low: Column, high: Column) -> Column:
    return F.when(value < low, PRESENT).when(value > high, ABSENT).otherwise(UNCERTAIN)


def classify_kmeans(segments: DataFrame, keys: Sequence[str], sensitivity: float = SENSITIVITY) -> DataFrame:
    """State by distance from the midpoint between the two cluster centres."""
    keys = list(keys)
    middle = (F.col("centre_lo") + F.col("centre_hi")) / 2
    margin = F.lit(float(sensitivity)) * (F.col("centre_hi") - F.col("centre_lo")) / 2
    decided = segments.join(two_means(segments, keys), keys, "left").join(
        cluster_viable(segments, keys), keys, "left"
    )
    state = _three_way(F.col("seg_median"), middle - margin, middle + margin)
    return decided.withColumn(
        "state_auto", F.when(F.col("viable") & F.col("centre_lo").isNotNull(), state).otherwise(UNCERTAIN)
    ).select(*segments.columns, "state_auto")


def fit_mixture(x: np.ndarray, w: np.ndarray, equal_var: bool = False, iterations: int = MAX_ITERATIONS):
    """Two-component Gaussian mixture of weighted values by expectation-maximisation.

    Starts from the best two-cluster split, so it has no random part. Returns
    (weights, means, variances) with the lower mean first, or None where the fit
    degenerates or does not converge.
    """
    order = np.argsort(x, kind="stable")
    x, w = x[order].astype(float), w[order].astype(float)
    n1, s1 = np.cumsum(w)[:-1], np.cumsum(w * x)[:-1]
    n2, s2 = w.sum() - n1, (w * x).sum() - s1
    if len(n1) == 0:
        return None
    cut = int(np.argmax(np.round(s1 * s1 / n1 + s2 * s2 / n2, 6)))
    resp = (np.arange(len(x)) <= cut).astype(float)
    previous = -math.inf
    for _ in range(iterations):
        share = np.array([(w * resp).sum(), (w * (1 - resp)).sum()])
        if share.min() <= 0 or not np.isfinite(share).all():
            return None
        mean = np.array([(w * resp * x).sum(), (w * (1 - resp) * x).sum()]) / share
        spread = np.array([(w * resp * (x - mean[0]) ** 2).sum(), (w * (1 - resp) * (x - mean[1]) ** 2).sum()])
        var = np.full(2, spread.sum() / share.sum()) if equal_var else spread / share
        var = np.maximum(var, VARIANCE_FLOOR)
        pi = share / share.sum()
        log_p = np.log(pi) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = log_p.max(axis=1)
        total = top + np.log(np.exp(log_p - top[:, None]).sum(axis=1))
        resp = np.exp(log_p[:, 0] - total)
        likelihood = float((w * total).sum())
        if abs(likelihood - previous) <= TOLERANCE * (1 + abs(likelihood)):
            break
        previous = likelihood
    else:
        return None
    low = int(np.argmin(mean))
    pick = [low, 1 - low]
    return pi[pick], mean[pick], var[pick]


def _log_densities() -> tuple[Column, Column]:
    """Log of weight times density of both components (columns _p, _m, _v) at a median."""
    x = F.col("seg_median").cast("double")
    return tuple(
        F.log(f"_p{i}") - 0.5 * F.log(2 * math.pi * F.col(f"_v{i}")) - F.pow(x - F.col(f"_m{i}"), 2) / (2 * F.col(f"_v{i}"))
        for i in (0, 1)
    )


def _maximised(rows: DataFrame, keys: Sequence[str], share: Column, total: Column, equal_var: bool) -> DataFrame:
    """The mixture after one step, a row per key, from each median's share in the lower component.

    ``rows`` carries the mixture before the step; deviations are taken from its means, so that the sums of
    squares do not cancel. One aggregation, combined before the shuffle: a key is never one task.
    """
    before = [f"_{c}{i}" for i in (0, 1) for c in "pmv"]
    x, w = F.col("seg_median").cast("double"), F.col("_w")
    sums = [F.sum(w * total).alias("_like")]
    for i, part in enumerate((share, 1 - share)):
        off = x - F.col(f"_m{i}")
        for j in range(3):
            sums.append(F.sum(w * part * F.pow(off, j)).alias(f"_s{i}{j}"))
    summed = rows.groupBy(*keys, *before, "_previous").agg(*sums)
    n = F.col("_s00") + F.col("_s10")
    squares = [F.col(f"_s{i}2") - F.col(f"_s{i}1") * F.col(f"_s{i}1") / F.col(f"_s{i}0") for i in (0, 1)]
    after = {}
    for i in (0, 1):
        spread_of = (squares[0] + squares[1]) / n if equal_var else squares[i] / F.col(f"_s{i}0")
        after[f"_next_p{i}"] = F.col(f"_s{i}0") / n
        after[f"_next_m{i}"] = F.col(f"_m{i}") + F.col(f"_s{i}1") / F.col(f"_s{i}0")
        after[f"_next_v{i}"] = F.greatest(spread_of, F.lit(VARIANCE_FLOOR))
    alive = (F.col("_s00") > 0) & (F.col("_s10") > 0) & ~F.isnan(n)
    settled = F.abs(F.col("_like") - F.col("_previous")) <= TOLERANCE * (1 + F.abs(F.col("_like")))
    settled = settled & ~F.isnan("_like")
    stepped = summed.select("*", alive.alias("_alive"), settled.alias("_settled"))
    return stepped.select(
        *keys, *before, "_like", "_alive", "_settled", *[F.when(F.col("_alive"), c).alias(name) for name, c in after.items()]
    )


def distributed_mixtures(
    counts: DataFrame, keys: Sequence[str], equal_var: bool = False, iterations: int = MAX_ITERATIONS
) -> DataFrame:
    """:func:`fit_mixture` for keys with many distinct medians, all of them at once, each until it converges.

    A step is one scan of the counted medians: expectation as columns, maximisation as a grouped sum. What a
    step leaves is a row per key, written, so a lost executor costs one step. Keys that have converged or
    degenerated take no part in later steps. Returns (keys, _p0, _m0, _v0, _p1, _m1, _v1) of converged keys.
    """
    keys = list(keys)
    parts = [f"_{c}{i}" for i in (0, 1) for c in "pmv"]
    # means to take deviations from; the weights and variances here are not used
    start = best_cut(counts, keys).withColumns(
        {"_cut": F.col("cut"), "_m0": F.col("centre_lo"), "_m1": F.col("centre_hi"), "_previous": F.lit(-math.inf)}
        | {c: F.lit(1.0) for c in ("_p0", "_p1", "_v0", "_v1")}
    )
    below = (F.col("seg_median") <= F.col("_cut")).cast("double")
    step = cut(_maximised(counts.join(F.broadcast(start), keys), keys, below, F.lit(0.0), equal_var))
    fitted = step.select(*keys, *parts).where("false")
    previous = F.lit(-math.inf).alias("_previous")
    for _ in range(iterations):
        now = step.where(F.col("_alive") & ~F.col("_settled")).select(
            *keys, *[F.col(f"_next{c}").alias(c) for c in parts], previous
        )
        first, second = _log_densities()
        top = F.greatest(first, second)
        total = top + F.log(F.exp(first - top) + F.exp(second - top))
        step = cut(_maximised(counts.join(F.broadcast(now), keys), keys, F.exp(first - total), total, equal_var))
        done, going = step.agg(F.count_if("_settled"), F.count_if(F.col("_alive") & ~F.col("_settled"))).first()
        if done:
            fitted = fitted.unionByName(step.where("_settled").select(*keys, *parts))
        if not going:
            break
        previous = F.col("_like").alias("_previous")
    return fitted


def mixture_posteriors(
    segments: DataFrame, keys: Sequence[str], equal_var: bool = False, many: int = MANY_VALUES
) -> DataFrame:
    """Per key and distinct median: posterior of the lower and the upper component.

    Keys with at most ``many`` distinct medians are fitted in a task each, the others by scans of all of them.
    """
    keys = list(keys)
    counts = cut(median_counts(segments, keys))
    schema = T.StructType(
        [
            *[counts.schema[k] for k in keys],
            counts.schema["seg_median"],
            T.StructField("p_low", T.DoubleType()),
            T.StructField("p_high", T.DoubleType()),
        ]
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["seg_median"].to_numpy(dtype=float)
        fitted = fit_mixture(x, pdf["_w"].to_numpy(dtype=float), equal_var)
        if fitted is None:
            return pdf.assign(p_low=np.nan, p_high=np.nan)[schema.names].iloc[:0]
        pi, mean, var = fitted
        log_p = np.log(pi) - 0.5 * np.log(var) - (x[:, None] - mean) ** 2 / (2 * var)
        p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return pdf.assign(p_low=p[:, 0], p_high=p[:, 1])[schema.names]

    # at most one key for every ``many`` distinct medians
    wide = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > many).drop("_d")
    if wide.isEmpty():
        return spread(counts, keys).groupBy(*keys).applyInPandas(fit, schema)
    wide = cut(wide)
    narrow = spread(counts.join(F.broadcast(wide), keys, "left_anti"), keys).groupBy(*keys).applyInPandas(fit, schema)
    large = cut(counts.join(F.broadcast(wide), keys, "left_semi"))
    first, second = _log_densities()
    share = F.exp(first - F.greatest(first, second)) / (
        F.exp(first - F.greatest(first, second)) + F.exp(second - F.greatest(first, second))
    )
    low = F.when(F.col("_m1") < F.col("_m0"), 1 - share).otherwise(share)
    posteriors = large.join(F.broadcast(distributed_mixtures(large, keys, equal_var)), keys).select(
        *keys, "seg_median", low.alias("p_low"), (1 - low).alias("p_high")
    )
    return narrow.unionByName(posteriors)


def classify_gmm(
    segments: DataFrame, keys: Sequence[str], sensitivity: float = SENSITIVITY, equal_var: bool = False
) -> DataFrame:
    """State by posterior of a two-component mixture; k-means where no mixture was fitted.

    A segment is uncertain when its larger posterior is below 0.5 + sensitivity / 2.
    With unequal variances the decision need not be monotone in the distance.
    """
    keys = list(keys)
    fallback = classify_kmeans(segments, keys, sensitivity).withColumnRenamed("state_auto", "_kmeans")
    with_p = fallback.join(mixture_posteriors(segments, keys, equal_var), [*keys, "seg_median"], "left").join(
        cluster_viable(segments, keys), keys, "left"
    )
    low, high = F.col("p_low"), F.col("p_high")
    state = (
        F.when(F.greatest(low, high) < 0.5 + float(sensitivity) * 0.5, UNCERTAIN)
        .when(low > high, PRESENT)
        .otherwise(ABSENT)
    )
    return with_p.withColumn(
        "state_auto",
        F.when(~F.col("viable"), UNCERTAIN).when(low.isNull(), F.col("_kmeans")).otherwise(state),
    ).select(*segments.columns, "state_auto")


def inversions(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key, how many absent segments lie below every present one.

    A mixture with unequal variances can produce them; k-means cannot.
    """
    m = F.col("seg_median")
    lowest = classified.groupBy(*keys).agg(F.min(F.when(F.col("state_auto") == PRESENT, m)).alias("_low"))
    odd = (F.col("state_auto") == ABSENT) & (m < F.col("_low"))
    return classified.join(lowest, list(keys)).groupBy(*keys).agg(
        F.count_if(F.coalesce(odd, F.lit(False))).alias("n_inversions")
    )


def classify_iqr(
    signal: DataFrame, segments: DataFrame, keys: Sequence[str], value: str, sensitivity: float = IQR_SENSITIVITY
) -> DataFrame:
    """State by distance from the median of all readings, in units of their IQR (at least 2)."""
    keys = list(keys)
    q = exact_quantiles(signal, keys, F.col(value), {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    margin = F.lit(float(sensitivity)) * F.greatest(F.col("_q3") - F.col("_q1"), F.lit(MIN_IQR))
    state = _three_way(F.col("seg_median"), F.col("_q2") - margin, F.col("_q2") + margin)
    return segments.join(q, keys, "left").withColumn("state_auto", state).select(*segments.columns, "state_auto")


def classify_segments(
    segments: DataFrame,
    keys: Sequence[str],
    method: str = "gmm",
    sensitivity: float = SENSITIVITY,
    signal: DataFrame | None = None,
    value: str | None = None,
) -> DataFrame:
    """Dispatch on the classification method."""
    if method == "gmm":
        return classify_gmm(segments, keys, sensitivity)
    if method == "kmeans":
        return classify_kmeans(segments, keys, sensitivity)
    if method == "iqr":
        return classify_iqr(signal, segments, keys, value, sensitivity)
    raise ValueError(f"unknown classification method {method!r}")


def apply_labels(
    readings: DataFrame, labelled: DataFrame, row_id: Sequence[str], night: str | None = "is_night"
) -> DataFrame:
    """Write segment and state back to the readings.

    ``labelled`` has the row id, ``segment_id`` and ``state_auto``. Night readings
    are present whatever their segment says.
    """
    joined = readings.join(labelled.select(*row_id, "segment_id", "state_auto"), list(row_id), "left")
    is_night = F.col(night) if night else F.lit(False)
    state = F.when(is_night, PRESENT).otherwise(F.col("state_auto"))
    return joined.withColumn("state_auto", state).withColumns(
        {
            "state_corrected": F.col("state_auto"),
            "correction_source": F.when(is_night, "night_auto").when(F.col("state_auto").isNotNull(), "auto"),
        }
    )


def state_counts(df: DataFrame, keys: Sequence[str], state: str = "state_auto") -> DataFrame:
    """Readings per state (zeros kept) and without a state."""
    s = F.col(state)
    return df.groupBy(*keys).agg(
        *[F.count_if(F.coalesce(s == v, F.lit(False))).alias(f"n_{v}") for v in STATES],
        F.count_if(s.isNull()).alias("n_unclassified"),
    )
