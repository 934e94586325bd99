"""Group-relative statistics over repeated responses: windows over the group key, a scalar per response.

A group is the responses of one prompt, a handful of rows, so its window is small however large the table.
Groups of one row have no deviation: by default they raise, with ``on_singleton="null"`` they give NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str):
    """Registers an advantage estimator, called as f(df, **options), under a name."""
    def add(f):
        ESTIMATORS[name] = f
        return f
    return add


def advantages(name: str, df: DataFrame, **options) -> DataFrame:
    """Calls the estimator of that name; unknown names raise."""
    if name not in ESTIMATORS:
        raise NotImplementedError(f"no estimator {name!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](df, **options)


def _alone(size: Column, value: Column, on_singleton: str) -> Column:
    if on_singleton == "null":
        return F.when(size > 1, value)
    return F.when(size > 1, value).otherwise(F.raise_error(F.lit("a group of one row has no deviation")).cast("double"))


@estimator("grpo")
def normalised(df: DataFrame, score: str = "score", group: str = "uid", on_singleton: str = "raise", **_) -> DataFrame:
    """(score - mean) / (sample deviation + eps) within the group."""
    w = Window.partitionBy(group)
    value = (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + EPS)
    return df.withColumn("advantage", _alone(F.count("*").over(w), value, on_singleton))


@estimator("grpo_passk")
def best_margin(df: DataFrame, score: str = "score", group: str = "uid", order: str = "slot", on_singleton: str = "raise", **_) -> DataFrame:
    """The best row has (best - second) / (deviation + eps), all others 0; of equal rows the first in ``order`` is best."""
    w = Window.partitionBy(group)
    by = w.orderBy(F.col(score).desc(), F.col(order))
    margin = (F.col(score) - F.lead(score).over(by)) / (F.stddev_samp(score).over(w) + EPS)
    value = F.when(F.row_number().over(by) == 1, margin).otherwise(F.lit(0.0))
    return df.withColumn("advantage", _alone(F.count("*").over(w), value, on_singleton))


@estimator("rloo")
def leave_one_out(df: DataFrame, score: str = "score", group: str = "uid", on_singleton: str = "raise", **_) -> DataFrame:
    """Score less the mean of the group's other scores."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    value = F.col(score) - F.try_divide(F.sum(score).over(w) - F.col(score), n - 1)
    return df.withColumn("advantage", _alone(n, value, on_singleton))


@estimator("remax")
def less_baseline(df: DataFrame, rewards: str = "rewards", mask: str = "mask", baseline: str = "baseline", **_) -> DataFrame:
    """Total reward less the greedy response's; returns are the masked rewards to go."""
    from ..functions import sequences as S

    masked = F.zip_with(F.col(rewards), F.col(mask), lambda r, m: r * m)
    total = F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x)
    spread = F.transform(mask, lambda m: (total - F.col(baseline)) * m)
    return df.withColumn("advantages", spread).withColumn("returns", S.to_go(masked, 1.0))


@estimator("reinforce_plus_plus")
def whitened_returns(df: DataFrame, rewards: str = "rewards", mask: str = "mask", gamma: float = 1.0, **_) -> DataFrame:
    """Discounted rewards to go, reset behind the end, whitened over the batch."""
    from ..functions import sequences as S

    return S.whitened(df.withColumn("returns", S.to_go(F.col(rewards), gamma, F.col(mask))), "returns", mask, "advantages")


@estimator("gae")
def generalised(df: DataFrame, rewards: str = "rewards", values: str = "values", mask: str = "mask", gamma: float = 1.0, lam: float = 1.0, **_) -> DataFrame:
    """Generalised advantage estimation, masked positions carried over row by row, whitened over the batch."""
    from ..functions import sequences as S

    raw = df.withColumn("_raw", S.advantage_scan(F.col(rewards), F.col(values), F.col(mask), gamma, lam))
    raw = raw.withColumn("returns", F.zip_with("_raw", values, lambda a, v: a + v))
    return S.whitened(raw, "_raw", mask, "advantages").drop("_raw")


def injected(df: DataFrame, reference: DataFrame, slots: int, replace: int = -1, group: str = "uid", slot: str = "slot") -> DataFrame:
    """Overwrites one response of each group by the group's reference response and flags it ``is_gt_row``.

    Groups whose reference is NULL or blank keep all their responses. ``reference`` has one row per group.
    """
    at = replace if replace >= 0 else slots + replace
    good = reference.where(F.col("reference").isNotNull() & (F.trim("reference") != "")).select(group, "reference")
    hit = (F.col(slot) == at) & F.col("reference").isNotNull()
    return df.join(good, group, "left").withColumn("is_gt_row", hit).withColumn("response", F.when(hit, F.col("reference")).otherwise(F.col("response"))).drop("reference")


def injection_diagnostics(df: DataFrame, score: str = "score", advantage: str = "advantage", flag: str = "is_gt", group: str = "uid") -> DataFrame:
    """How reference rows shift the groups' baselines: metric, value in long form; NULL values are left out.

    Deviations are of the population. Groups of one row or without an own response do not count; ratios only take
    groups whose own deviation is at least 0.001. An empty input gives no metric.
    """
    s, a, own = F.col(score), F.col(advantage), ~F.coalesce(F.col(flag), F.lit(False))
    per = df.groupBy(group).agg(
        F.count("*").alias("n"), F.count(F.when(own, 1)).alias("n_op"), F.avg(s).alias("mu_g"), F.stddev_pop(s).alias("sd_g"),
        F.avg(F.when(own, s)).alias("mu_op"), F.stddev_pop(F.when(own, s)).alias("sd_op"),
    ).where("n >= 2 AND n_op >= 1")
    rows = df.join(per, group).withColumn("_base", (s - F.col("mu_g")) / (F.col("sd_g") + EPS))
    flip = ((a > 0) & (F.col("_base") < 0)) | ((a < 0) & (F.col("_base") > 0))
    group_rows = rows.groupBy(group).agg(
        *[F.first(c).alias(c) for c in ("mu_g", "sd_g", "mu_op", "sd_op")],
        F.count(F.when(own & flip, 1)).alias("flips"), F.count(F.when(own, 1)).alias("ops"), F.max(F.when(own, F.col("_base"))).alias("best"),
        F.sum(F.when(own & (a > 0), F.abs(a))).alias("pos"), F.count(F.when(own & (a > 0), 1)).alias("n_pos"),
        F.sum(F.when(own & (a < 0), F.abs(a))).alias("neg"), F.count(F.when(own & (a < 0), 1)).alias("n_neg"),
        F.sum(F.when(~own, F.abs(a))).alias("gt"), F.count(F.when(~own, 1)).alias("n_gt"), F.max(F.when(~own, F.abs(a))).alias("gt_max"),
    )
    firm = F.col("sd_op") >= 1e-3
    ratio = lambda x, y: F.when(y > 0, x / y)
    total = lambda c: F.sum(c).cast("double")
    mean = {c: F.avg(c) for c in ("mu_op", "mu_g", "sd_op", "sd_g")}
    metrics = {
        "mu_op_mean": mean["mu_op"], "mu_g_mean": mean["mu_g"], "sigma_op_mean": mean["sd_op"], "sigma_g_mean": mean["sd_g"],
        "sigma_ratio_per_group": F.coalesce(F.avg(F.when(firm, F.col("sd_g") / F.col("sd_op"))), F.lit(0.0)),
        "sigma_ratio_of_means": F.coalesce(ratio(mean["sd_g"], mean["sd_op"]), F.lit(0.0)),
        "contamination_per_group": F.coalesce(F.avg(F.when(firm, F.abs(F.col("mu_g") - F.col("mu_op")) / F.col("sd_op"))), F.lit(0.0)),
        "contamination_of_means": F.coalesce(ratio(F.abs(mean["mu_g"] - mean["mu_op"]), mean["sd_op"]), F.lit(0.0)),
        "degenerate_op_groups": F.count(F.when(~firm, 1)).cast("double"),
        "sign_flip_count": total("flips"), "sign_flip_rate": ratio(total("flips"), total("ops")),
        "groups_with_no_op_pos_baseline": F.count(F.when(F.col("best") <= 0, 1)).cast("double"), "n_groups": F.count("*").cast("double"),
        "gt_adv_mag_mean": ratio(F.sum("gt"), total("n_gt")), "gt_adv_mag_max": F.max("gt_max"),
        "op_adv_pos_mean": ratio(F.sum("pos"), total("n_pos")), "op_adv_pos_count": total("n_pos"),
        "op_adv_neg_mean": ratio(F.sum("neg"), total("n_neg")), "op_adv_neg_count": total("n_neg"),
    }
    one = group_rows.agg(*[v.alias(k) for k, v in metrics.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("m")).select("m.*")
    return long.where("value IS NOT NULL")


def adaptive_coefficient(steps: DataFrame, init: float, target: float, horizon: float, step: str = "step", kl: str = "kl", n: str = "n_steps") -> DataFrame:
    """The KL coefficient after each step: a running product of clipped factors, as a sum of logarithms in step order.

    One row per training step, so the ordered window is as long as the training, not as the data.
    """
    error = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col(kl) / target - 1))
    running = F.sum(F.ln(1 + error * F.col(n) / horizon)).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("coefficient", init * F.exp(running))


def smoothed_best(steps: DataFrame, window: int, min_step: int, step: str = "step", metric: str = "metric") -> DataFrame:
    """Steps at which the trailing mean over a full window beats all before it, with the mean."""
    w = Window.orderBy(step)
    trail = w.rowsBetween(-(window - 1), 0)
    rows = steps.withColumn("smoothed", F.when((F.count("*").over(trail) == window) & (F.col(step) >= min_step), F.avg(metric).over(trail)))
    best = F.max("smoothed").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_best", best).where("smoothed IS NOT NULL AND (_best IS NULL OR smoothed > _best)").drop("_best")


def time_left(steps: DataFrame, step: str, seconds: str, last: int) -> DataFrame:
    """Adds ``left``: the mean of the steps so far times those to come. One row per training step."""
    so_far = F.avg(seconds).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("left", so_far * (last - F.col(step)))


def learning_rate(step: Column, warmup: int, total: int, kind: str = "constant", start: float = 0.0, least: float = 0.0, cycles: float = 0.5) -> Column:
    """The factor of the rate at a step: a linear warm-up from ``start``, then constant, or a cosine down to ``least``."""
    s = step.cast("double")
    rise = F.lit(start) + (1 - start) * s / max(1, warmup)
    if kind == "constant":
        return F.least(F.lit(1.0), rise)
    if kind != "cosine":
        raise NotImplementedError(f"no schedule {kind!r}")
    part = (s - warmup) / max(1, total - warmup)
    wave = F.cos(F.lit(2 * math.pi * cycles) * part)
    return F.when(s < warmup, rise).otherwise(F.greatest(F.lit(least), wave * (1 - least) / 2 + (1 + least) / 2))
