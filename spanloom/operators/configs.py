"""Runs as rows: defaults, derived sizes and what keeps a run from starting, for any number of configurations at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completed(df: DataFrame, defaults: list[tuple[str, str]]) -> DataFrame:
    """Each unset column taken from another, in order, so that defaults reach through several."""
    return reduce(lambda d, pair: d.withColumn(pair[0], F.coalesce(*pair)), defaults, df)


def run_faults(micro: str = "micro_batch", mini: str = "mini_batch", rollout: str = "rollout_batch") -> Column:
    """What is wrong with a run, as an array of texts; columns as named, ``estimator``, ``n``, ``inject``, ``replace``, ``log_probs``."""
    def uneven(small: str, large: str) -> Column:
        bad = F.col(small).isNull() | (F.col(small) <= 0) | (F.when(F.col(small) > 0, F.col(large) % F.col(small)) != 0)
        return F.when(bad, F.lit(f"{large} is no multiple of {small}"))

    return F.array_compact(F.array(
        uneven(micro, mini), uneven(mini, rollout),
        F.when(F.col("estimator").isin("grpo", "grpo_passk", "rloo") & (F.col("n") <= 1), "the estimator needs groups"),
        F.when(F.col("inject") & F.col("log_probs"), "injected answers have no log-probs of the rollout"),
        F.when(F.col("inject") & ~F.col("replace").between(-1, F.col("n") - 1), "replaced slot out of range"),
    ))


def training_steps(rows: Column, batch: Column, epochs: Column, most: Column) -> Column:
    """Steps of a run: the limit where there is one, else the whole batches of all epochs."""
    return F.coalesce(most, F.floor(rows / batch) * epochs).cast("long")


def scaled(size: Column, n: Column, devices: Column, micro: Column) -> Column:
    """A global batch size times the samples per prompt, over the devices; ``fault`` where that comes to nothing or is no multiple
    of the micro-batch."""
    per = F.floor(size * n / devices).cast("long")
    fault = F.when(per <= 0, "nothing is left per device").when(per % micro != 0, "no multiple of the micro-batch")
    return F.struct((size * n).cast("long").alias("whole"), per.alias("per_device"), fault.alias("fault"))


def special_tokens(model: Column, eos: Column, pad: Column, families: dict[str, int]) -> Column:
    """The end token, which some families of models have their own of, and the padding token, by default the end token."""
    end = eos
    for part, own in families.items():
        end = F.when(F.lower(model).contains(part), F.lit(own)).otherwise(end)
    return F.struct(end.alias("eos"), F.coalesce(pad, end).alias("pad"))


def overridden(params: Column, asked: Column) -> Column:
    """A map of parameters with the known ones among those asked for replaced; unknown ones are ignored, the map itself stays."""
    return F.transform_values(params, lambda k, v: F.coalesce(F.try_element_at(asked, k), v))


def checked_size(params: Column, most: float = 9e9) -> Column:
    """The number of parameters; raises where it is 0 or less or above ``most``."""
    return F.when((params > 0) & (params <= most), params).otherwise(F.raise_error(F.concat(F.lit("model of "), F.coalesce(params.cast("string"), F.lit("no")), F.lit(" parameters"))).cast("double"))


def within_size(params: Column, most: float = 9e9) -> Column:
    """Whether :func:`checked_size` would let a model pass."""
    return F.coalesce((params > 0) & (params <= most), F.lit(False))


def existing(rows: DataFrame, listing: DataFrame, path: str, what: str) -> DataFrame:
    """Adds ``found``, the absolute path if the listing has it, and else ``message``. A NULL path has neither."""
    there = listing.select(F.col("file").alias("_file")).distinct()
    full = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit("/"), F.col(path)))
    out = rows.withColumn("_full", full).join(there, F.col("_full") == F.col("_file"), "left")
    return out.withColumn("found", F.col("_file")).withColumn("message", F.when(F.col("_full").isNotNull() & F.col("_file").isNull(), F.concat(F.lit(f"no {what} at "), F.col("_full")))).drop("_full", "_file")


def save_layout(steps: DataFrame, ranks: int) -> DataFrame:
    """The files of a sharded save of each ``step``: model, optimizer and further state of every rank, the configuration and the data
    state of the first."""
    each = F.transform(F.sequence(F.lit(0), F.lit(ranks - 1)), lambda r: F.array(*[F.concat(F.lit(f"{kind}_world_size_{ranks}_rank_"), r.cast("string"), F.lit(".pt")) for kind in ("model", "optim", "extra_state")]))
    names = F.concat(F.flatten(each), F.array(F.lit("huggingface/config.json"), F.lit("dataloader.pt")))
    return steps.select("step", F.explode(names).alias("file")).select("step", F.concat(F.lit("global_step_"), F.col("step").cast("string"), F.lit("/"), F.col("file")).alias("path"))


def restorable(layout: DataFrame, listing: DataFrame) -> DataFrame:
    """Per step: files wanted and missing; a step can be restored where none is.

    A listing is as long as the layout, and its size is estimated before its paths are exploded, so that it is never broadcast."""
    there = listing.select("path").distinct().withColumn("_in", F.lit(1))
    met = layout.join(there.hint("merge"), "path", "left")
    return met.groupBy("step").agg(F.count("*").alias("wanted"), F.sum(F.col("_in").isNull().cast("long")).alias("missing"))


def stale(derived: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Adds ``rebuild`` to derived files (``key``, ``mtime``): whether it is missing or no newer than the newest of its sources."""
    newest = sources.groupBy(key).agg(F.max("mtime").alias("_newest"))
    return newest.join(derived.select(key, F.col("mtime").alias("_own")), key, "left").select(key, F.coalesce(F.col("_own") <= F.col("_newest"), F.lit(True)).alias("rebuild"))
