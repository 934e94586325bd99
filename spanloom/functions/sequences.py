"""Operators over token sequences held as arrays."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def _last(items: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit(default))


def to_go(values: Column, gamma: float, mask: Column | None = None) -> Column:
    """Discounted sums from each position to the end; the run is set to 0 behind a position whose mask is 0."""
    mask = mask if mask is not None else F.transform(values, lambda _: F.lit(1.0))
    both = F.reverse(F.arrays_zip(values.alias("v"), mask.alias("m")))
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("run"))

    def step(acc: Column, x: Column) -> Column:
        now = x["v"].cast("double") + gamma * acc["run"]
        return F.struct(F.array_append(acc["out"], now).alias("out"), (now * x["m"]).cast("double").alias("run"))

    return F.reverse(F.aggregate(both, start, step, lambda acc: acc["out"]))


def advantage_scan(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """The backward recursion of generalised advantages; masked positions carry the last value on."""
    rows = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("next"), F.lit(0.0).alias("gae"))

    def step(acc: Column, x: Column) -> Column:
        gae = x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["gae"]
        on = x["m"] > 0
        kept = F.when(on, gae).otherwise(acc["gae"])
        return F.struct(F.array_append(acc["out"], kept).alias("out"), F.when(on, x["v"]).otherwise(acc["next"]).alias("next"), kept.alias("gae"))

    return F.reverse(F.aggregate(rows, start, step, lambda acc: acc["out"]))


def masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: v * m), F.lit(0.0), lambda a, x: a + x)


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of a row's values where the mask is 1; the small term keeps an empty mask at 0."""
    return masked_sum(values, mask) / (F.aggregate(mask, F.lit(0.0), lambda a, x: a + x) + EPS)


def batch_moments(df: DataFrame, values: str, mask: str) -> tuple[float, float]:
    """Masked mean and variance (of the sample) over the whole batch; two numbers come to the driver."""
    v, m = F.col(values), F.col(mask)
    weight = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
    n, total = df.agg(F.sum(weight), F.sum(masked_sum(v, m))).first()
    n, total = n or 0.0, total or 0.0
    mean = total / (n + EPS)
    square = df.agg(F.sum(masked_sum(F.transform(v, lambda x: (x - mean) * (x - mean)), m))).first()[0] or 0.0
    var = square / (n + EPS)
    return mean, var * (n / (n - 1) if n > 1 else 1.0)


def whitened(df: DataFrame, values: str, mask: str, out: str) -> DataFrame:
    """Values less the batch's masked mean, over its deviation."""
    mean, var = batch_moments(df, values, mask)
    return df.withColumn(out, F.transform(values, lambda x: (x - mean) / (var + EPS) ** 0.5))


def loss(df: DataFrame, values: str, mask: str, mode: str) -> Column:
    """The averaging of a loss, as an aggregate: ``token`` over all tokens, ``seq`` as the mean of the rows' means."""
    v, m = F.col(values), F.col(mask)
    if mode == "token":
        return F.sum(masked_sum(v, m)) / (F.sum(F.aggregate(m, F.lit(0.0), lambda a, x: a + x)) + EPS)
    if mode == "seq":
        return F.avg(masked_mean(v, m))
    raise NotImplementedError(f"no mode {mode!r}")


def kl(log_probs: Column, reference: Column, kind: str) -> Column:
    """KL penalties per token: kl, abs, mse, low_var_kl."""
    def one(p: Column, q: Column) -> Column:
        if kind == "kl":
            return p - q
        if kind == "abs":
            return F.abs(p - q)
        if kind == "mse":
            return 0.5 * (p - q) * (p - q)
        if kind == "low_var_kl":
            x = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), q - p))
            return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(x) - x - 1))
        raise NotImplementedError(f"no penalty {kind!r}")
    return F.zip_with(log_probs, reference, one)


def policy_terms(df: DataFrame, old: str, new: str, advantage: str, mask: str, low: float, high: float, dual: float, kind: str = "default") -> DataFrame:
    """Adds ``loss``, ``clip_high``, ``clip_low`` and ``kl`` per token. Kinds: default, gspo, gspo_token, cispo."""
    import math

    df = df.withColumn("_d", F.zip_with(new, old, lambda n, o: n - o))
    if kind in ("gspo", "gspo_token"):
        mean = masked_mean(F.col("_d"), F.col(mask))
        df = df.withColumn("_r", F.transform(mask, lambda m: mean * m if kind == "gspo" else mean))
    else:
        df = df.withColumn("_r", F.col("_d"))
    lo, hi = math.log(1 - low), math.log(1 + high)
    ratio = lambda x: F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x)))
    clip = lambda x: F.exp(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))
    rows = F.arrays_zip(F.col("_r").alias("r"), F.col(new).alias("p"), F.col(advantage).alias("a"), F.col("_d").alias("d"))

    def term(x: Column) -> Column:
        a = x["a"]
        if kind == "cispo":
            return F.struct((-a * x["p"] * clip(x["r"])).alias("loss"), F.lit(0.0).alias("high"), F.lit(0.0).alias("low"), (-x["d"]).alias("kl"))
        one, two, three = -a * ratio(x["r"]), -a * clip(x["r"]), -a * dual
        upper = F.greatest(one, two)
        return F.struct(
            F.when(a < 0, F.least(upper, three)).otherwise(upper).alias("loss"), (one < two).cast("double").alias("high"),
            ((upper > three) & (a < 0)).cast("double").alias("low"), (-x["d"]).alias("kl"))

    out = df.withColumn("_t", F.transform(rows, term)).drop("_d", "_r")
    return out.select("*", F.col("_t.loss").alias("loss"), F.col("_t.high").alias("clip_high"), F.col("_t.low").alias("clip_low"), F.col("_t.kl").alias("kl")).drop("_t")


def response_mask(tokens: Column, ends: list[int]) -> Column:
    """1 up to and including the first end token, 0 behind it."""
    at = F.array_min(F.array(*[F.nullif(F.array_position(tokens, F.lit(e)), F.lit(0)) for e in ends]))
    n = F.size(tokens)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(at.isNull() | (i <= at), 1).otherwise(0))).otherwise(F.array().cast("array<int>"))


def padded(items: Column, length: int, value, left: bool = False) -> Column:
    """Padded to a length; longer arrays stay."""
    pad = F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - F.size(items)))
    return F.concat(pad, items) if left else F.concat(items, pad)


def truncated(items: Column, length: int, side: str = "right") -> Column:
    """Cut to a length at the named side; ``error`` raises for longer arrays."""
    if side == "left":
        return F.when(F.size(items) > length, F.slice(items, -length, length)).otherwise(items)
    if side == "right":
        return F.slice(items, 1, length)
    return F.when(F.size(items) <= length, items).otherwise(F.raise_error(F.lit("too long")).cast("array<int>"))


def position_ids(mask: Column) -> Column:
    """Running sums of the mask less one, at least 0."""
    zero = F.array().cast("array<int>")
    summed = F.aggregate(mask, zero, lambda acc, m: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + m.cast("int")))
    return F.transform(summed, lambda x: F.greatest(F.lit(0), x - 1))


def unpadded(items: Column, mask: Column) -> Column:
    """The items whose mask is 1."""
    return F.transform(F.filter(F.arrays_zip(items.alias("i"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["i"])


def chosen_log_probs(tokens: Column, tables: Column) -> Column:
    """For each token its log-prob in the table of its position; where it is missing the table's first entry, flagged."""
    both = F.arrays_zip(tokens.alias("t"), tables.alias("m"))

    def one(x: Column) -> Column:
        own = F.try_element_at(x["m"], x["t"])
        return F.struct(F.coalesce(own, F.get(F.map_values(x["m"]), F.lit(0)), F.lit(0.0)).alias("log_prob"), own.isNull().alias("missing"))

    return F.transform(both, one)


def media_positions(tokens, grids, image: int, video: int, merge: int, time_scale: float | None = None):
    """Positions of tokens on three axes (time, height, width) as three lists.

    Text counts up on all axes together. A media token starts a grid of (t, h / merge, w / merge) cells, in whose tokens the
    axes count apart; the text after it goes on behind the largest position. Videos are grids of one time step each, or,
    with ``time_scale``, one grid whose time axis counts in steps of that, rounded down.
    """
    import numpy as np

    frames = [(g[0] if time_scale else 1, g[1], g[2], 1) for g in grids if g[3] for _ in range(1 if time_scale else g[0])]
    left = {image: [g for g in grids if not g[3]], video: frames}
    out, at, n = [], 0, len(tokens)
    base = 0
    while at < n:
        kind = tokens[at]
        if left.get(kind):
            t, h, w, timed = left[kind].pop(0)
            cells = np.indices((t, h // merge, w // merge)).reshape(3, -1)[:, : n - at]
            if timed and time_scale:
                cells[0] = np.floor(cells[0] * time_scale)
            cells = cells + base
        else:
            end = at + 1
            while end < n and not left.get(tokens[end]):
                end += 1
            cells = np.tile(np.arange(end - at), (3, 1)) + base
        out.append(cells)
        at += cells.shape[1]
        base = int(cells.max()) + 1
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), int)


def media_position_udf(image: int, video: int, merge: int, time_scale: float | None = None):
    """:func:`media_positions` of columns ``tokens`` (array<long>) and ``grids`` (array<array<long>>), as an array of (t, h, w). Rows laid out alike
    are reckoned once per batch."""
    @F.pandas_udf("array<struct<t:long,h:long,w:long>>")
    def place(tokens: pd.Series, grids: pd.Series) -> pd.Series:
        held, out = {}, []
        for row, grid in zip(tokens, grids):
            key = (tuple(row), tuple(tuple(g) for g in grid))
            if key not in held:
                held[key] = [{"t": int(a), "h": int(b), "w": int(c)} for a, b, c in media_positions(list(key[0]), list(key[1]), image, video, merge, time_scale).T]
            out.append(held[key])
        return pd.Series(out, dtype=object)

    return place


def padded_back(items: Column, mask: Column, fill) -> Column:
    """The reverse of :func:`unpadded`: each item to the next place whose mask is 1, ``fill`` elsewhere."""
    start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, m: Column) -> Column:
        on = m == 1
        item = F.when(on, F.get(items, acc["used"])).otherwise(F.lit(fill)).cast("long")
        return F.struct(F.array_append(acc["out"], item).alias("out"), (acc["used"] + on.cast("int")).alias("used"))

    return F.aggregate(mask, start, step, lambda acc: acc["out"])


def rolled(items: Column) -> Column:
    """Labels: each place has the next item, the last one the first."""
    return F.when(F.size(items) > 1, F.concat(F.slice(items, F.lit(2), F.size(items) - 1), F.slice(items, 1, 1))).otherwise(items)


def packed_lengths(positions: Column) -> Column:
    """``at`` and ``length`` of the sequences packed in one: each begins where the position is 0, the first at the start."""
    starts = F.filter(F.sequence(F.lit(0), F.size(positions) - 1), lambda i: (i == 0) | (F.get(positions, i) == 0))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(positions)))
    return F.when(F.size(positions) > 0, F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a).alias("length"))))


def rank_slices(items: Column, ranks: int, fill) -> Column:
    """Padded to a multiple of ``ranks``; ``rank`` and ``part`` of each."""
    width = F.ceil(F.size(items) / ranks).cast("int")
    full = F.concat(items, F.array_repeat(F.lit(fill), width * ranks - F.size(items)))
    return F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda r: F.struct(r.alias("rank"), F.slice(full, r * width + 1, width).alias("part")))


#: Share of chosen tokens that may be missing in their tables.
MOST_MISSING = 0.01


def checked_log_probs(df: DataFrame, tokens: str, tables: str, length: int, out: str = "log_probs") -> DataFrame:
    """Adds the log-probs of the chosen tokens (:func:`chosen_log_probs`), padded with 0 to ``length``.

    Raises where a sequence has no tables, and where more than ``MOST_MISSING`` of all chosen tokens are missing. The counts
    are taken of the whole table before anything is returned.
    """
    found = df.withColumn("_p", F.when(F.size(tables) > 0, chosen_log_probs(F.slice(F.col(tokens), F.lit(1), F.least(F.size(tokens), F.size(tables))), F.col(tables))))
    lost, missing, total = found.agg(
        F.sum(F.col("_p").isNull().cast("long")), F.sum(F.coalesce(F.size(F.filter("_p", lambda x: x["missing"])), F.lit(0))), F.sum(F.coalesce(F.size("_p"), F.lit(0)))).first()
    if lost:
        raise ValueError(f"{lost} sequences without log-probs")
    if total and missing / total > MOST_MISSING:
        raise ValueError(f"{missing} of {total} chosen tokens without a log-prob")
    return found.withColumn(out, padded(F.transform("_p", lambda x: x["log_prob"]), length, 0.0)).drop("_p")


def value_terms(df: DataFrame, predicted: str, returns: str, old: str, clip: float) -> DataFrame:
    """Adds ``vf_most``, the larger of the squared errors of the values and of the values held within ``clip`` of the old ones, and
    ``vf_clipped``, 1 where that is the held one's."""
    z = F.arrays_zip(F.col(predicted).alias("p"), F.col(returns).alias("r"), F.col(old).alias("o"))
    own = lambda x: (x["p"] - x["r"]) * (x["p"] - x["r"])
    held = lambda x: F.greatest(x["o"] - clip, F.least(x["o"] + clip, x["p"])) - x["r"]
    both = F.transform(z, lambda x: F.struct(own(x).alias("a"), (held(x) * held(x)).alias("b")))
    return df.withColumn("vf_most", F.transform(both, lambda x: F.greatest(x["a"], x["b"]))).withColumn("vf_clipped", F.transform(both, lambda x: (x["a"] < x["b"]).cast("double")))
