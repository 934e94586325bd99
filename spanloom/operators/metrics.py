"""Roll-ups of training and evaluation into long metric tables (metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long(one: DataFrame) -> DataFrame:
    """A one-row frame of numbers as metric, value; NULLs are left out."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in one.columns]
    return one.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("value IS NOT NULL")


def spread(name: str, value: Column, when: Column | None = None) -> list[Column]:
    """Mean, most and least of a number."""
    v = value if when is None else F.when(when, value)
    return [F.avg(v).alias(f"{name}/mean"), F.max(v).alias(f"{name}/max"), F.min(v).alias(f"{name}/min")]


def lengths(rows: DataFrame, prompt: str, response: str, most_prompt: int, most_response: int) -> DataFrame:
    """Lengths of prompts and responses and the share of each that is cut at its limit."""
    clip = lambda c, most: F.avg(F.when(F.col(c) == most, 1.0).otherwise(0.0))
    return long(rows.agg(
        *spread("response_length", F.col(response)), clip(response, most_response).alias("response_length/clip_ratio"),
        *spread("prompt_length", F.col(prompt)), clip(prompt, most_prompt).alias("prompt_length/clip_ratio")))


def explained_variance(returns: Column, values: Column) -> Column:
    """1 less the variance of what values leave unexplained, over that of the returns."""
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def means(metrics: DataFrame) -> DataFrame:
    """The mean of each metric."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("value"))


def finite(value: Column) -> Column:
    """NaN and infinities as 0."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), 0.0).otherwise(value)


def flops(rows: DataFrame, length: str, seconds: float, weights: float, head_dim: int, heads: int, layers: int, by: list[str] | None = None) -> DataFrame:
    """Floating-point operations of training on sequences, and per second in units of 1e12, in all or per group."""
    n = F.col(length).cast("double")
    total = 6.0 * weights * F.sum(n) + 12.0 * F.sum(n * n) * head_dim * heads * layers
    return rows.groupBy(*(by or [])).agg(F.sum(F.col(length).cast("long")).alias("tokens"), total.alias("flops"), (total / seconds / 1e12).alias("tflops"))


def weights(hidden: int, vocab: int, layers: int, heads: int, kv_heads: int, mlp: int, head_dim: int) -> float:
    """Parameters of a transformer's linear maps: gated MLP, attention, embedding and head."""
    attention = hidden * head_dim * (heads + 2 * kv_heads + heads)
    return float((3 * hidden * mlp + attention) * layers + 2 * vocab * hidden)


def in_unit(number: float, unit: str) -> float:
    """A number in units of powers of 1000: B (none), K, M, G, T, P."""
    return number / 1000.0 ** "BKMGTP".index(unit) if number > 0 else number


def nested(metrics: DataFrame, key: str = "metric", value: str = "value") -> DataFrame:
    """Each metric's head and the map of what is under it."""
    head = F.substring_index(key, "/", 1)
    rest = F.when(F.col(key).contains("/"), F.substring(F.col(key), F.length(head) + 2, F.length(key))).otherwise(F.lit(""))
    return metrics.select(head.alias("head"), rest.alias("rest"), value).groupBy("head").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rest", value)))).alias("values"))


def flat(nested_: DataFrame) -> DataFrame:
    """The reverse of :func:`nested`."""
    return nested_.select("head", F.explode("values").alias("rest", "value")).select(F.concat_ws("/", "head", F.nullif(F.col("rest"), F.lit(""))).alias("metric"), "value")


def moe_weights(hidden: int, vocab: int, layers: int, heads: int, kv_heads: int, expert_mlp: int, experts: int, active: int, head_dim: int) -> float:
    """As :func:`weights` where ``active`` of ``experts`` are used for a token: their maps and the gate."""
    mlp = 3 * hidden * active * expert_mlp + hidden * experts
    return float((mlp + hidden * head_dim * (2 * heads + 2 * kv_heads)) * layers + 2 * vocab * hidden)


# Peak operations a second of devices, by a part of their names; the first that fits counts.
DEVICE_PEAKS = [("H100", 989e12), ("H800", 989e12), ("A100", 312e12), ("A800", 312e12), ("L40", 181.05e12), ("L20", 119.5e12), ("H20", 148e12), ("910B", 354e12)]


def device_peak(name: Column) -> Column:
    """Peak operations a second of a device; infinite for one that is not known."""
    out = F.lit(float("inf"))
    for part, peak in reversed(DEVICE_PEAKS):
        out = F.when(name.contains(part), F.lit(peak)).otherwise(out)
    return out


def utilisation(tflops: Column, device: Column, devices: Column) -> Column:
    """The share of the devices' peak that is used."""
    return tflops * 1e12 / (device_peak(device) * devices)


def timing_per_token(df: DataFrame, sections: list[tuple[str, float, str]]) -> DataFrame:
    """Milliseconds per token of each section, for rows with the token counts that the sections name."""
    cells = F.array(*[F.struct(F.lit(name).alias("section"), (F.lit(seconds) * 1000 / F.col(of)).alias("ms_per_token")) for name, seconds, of in sections])
    keys = [c for c in df.columns if c not in {of for _, _, of in sections}]
    return df.select(*keys, F.explode(cells).alias("t")).select(*keys, "t.*")


def token_totals(df: DataFrame, length: str, *by: str) -> DataFrame:
    """Tokens per group."""
    return df.groupBy(*by).agg(F.sum(length).cast("long").alias("tokens"))


def throughput(totals: DataFrame, seconds: float, devices: int) -> DataFrame:
    """Adds tokens per second and device."""
    return totals.withColumn("throughput", F.col("tokens") / (seconds * devices))


def size_rollup(df: DataFrame, by: str, size: str, unit: str) -> DataFrame:
    """Files, bytes and bytes in a unit, per group; NULL sizes count as files of none."""
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    return df.groupBy(by).agg(F.count("*").alias("files"), total.alias("bytes"), (total / 1000.0 ** "BKMGTP".index(unit)).alias("shown"))
