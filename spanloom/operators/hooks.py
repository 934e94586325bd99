"""What a user plugs in: reward functions, builders of ground truths, dispatch, functions on workers, sinks."""

from __future__ import annotations

import contextlib
import importlib
import importlib.util
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def function_spec(spec: Column, default: str = "main") -> Column:
    """``where`` and ``name`` of ``module:function`` or ``file:function``; without a name it is ``default``. Only the last
    colon parts them, so a drive or scheme in a file's path stays."""
    named = spec.rlike(r":\w+$")
    return F.struct(F.when(named, F.regexp_replace(spec, r":\w+$", "")).otherwise(spec).alias("where"), F.when(named, F.regexp_extract(spec, r":(\w+)$", 1)).otherwise(F.lit(default)).alias("name"))


def load_function(spec: str, default: str = "main") -> Callable:
    """The function a spec names, of a module that can be imported or of a Python file. Raises where there is none."""
    where, colon, name = spec.rpartition(":")
    where, name = (where, name) if colon and name.isidentifier() else (spec, default)
    if where.endswith(".py"):
        found = importlib.util.spec_from_file_location("plugin_" + str(abs(hash(where))), where)
        module = importlib.util.module_from_spec(found)
        found.loader.exec_module(module)
    else:
        module = importlib.import_module(where)
    return getattr(module, name)


def scored_by(df: DataFrame, score: Callable, key: str, fields: list[str], mode: str = "batch") -> DataFrame:
    """``key`` and ``score`` by a user's function: ``batch`` gives it a list of dicts and takes a list of numbers, ``sequential``
    one dict at a time. Raises for another mode, or a list of another length."""
    if mode not in ("batch", "sequential"):
        raise ValueError(f"no mode {mode!r}")
    kind = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf[fields].to_dict("records")
            got = list(score(rows)) if mode == "batch" else [score(r) for r in rows]
            if len(got) != len(rows):
                raise ValueError(f"{len(got)} scores for {len(rows)} rows")
            yield pd.DataFrame({key: pdf[key], "score": pd.Series(got, index=pdf.index, dtype="float64")})

    return df.select(key, *[f for f in fields if f != key]).mapInPandas(run, f"{key} {kind[key]}, score double")


def ground_truths(df: DataFrame, build: Callable, truth: str, extra: list[str], name: str = "built") -> DataFrame:
    """Adds the text that ``build`` makes of a ground truth and a dict of further fields, NULL where it returns None.

    A ``build`` that takes columns (``build.columns = True``) stays an expression; any other is called row by row in
    batches.
    """
    if getattr(build, "columns", False):
        return df.withColumn(name, build(F.col(truth), {c: F.col(c) for c in extra}))

    @F.pandas_udf("string")
    def made(rows: pd.DataFrame) -> pd.Series:
        out = [build(r.pop(truth), r) for r in rows.to_dict("records")]
        return pd.Series(out, dtype=object, index=rows.index)

    return df.withColumn(name, made(F.struct(truth, *extra)))


def executed(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function sent to the workers, applied to batches of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield work(pdf)

    return df.mapInPandas(run, schema)


def _to_all(df: DataFrame, ranks: int) -> DataFrame:
    return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def _in_stretches(df: DataFrame, ranks: int) -> DataFrame:
    rows = df.count()
    if rows % ranks:
        raise ValueError(f"{rows} rows do not make {ranks} equal stretches")
    return df.withColumn("rank", F.floor(F.col("pos") / max(1, rows // ranks)).cast("int"))


#: Ways of dispatch: how rows get their ranks, and which ranks' results are collected.
DISPATCH: dict[str, tuple[Callable[[DataFrame, int], DataFrame], Callable[[DataFrame], DataFrame]]] = {
    "one_to_all": (_to_all, lambda out: out),
    "all_to_all": (lambda df, ranks: df, lambda out: out),
    "stretches": (_in_stretches, lambda out: out),
    "first_of_all": (_to_all, lambda out: out.where("rank = 0")),
}


def dispatched(df: DataFrame, mode, ranks: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each rank, the results collected. ``mode`` names a way of ``DISPATCH``, or is a pair of one's own
    (``dispatch(df, ranks)`` adding ``rank``, ``collect(out)``). Rows are ordered by ``pos`` within a rank; the result has ``rank`` as well.
    ``all_to_all`` takes rows that have a ``rank`` already."""
    if isinstance(mode, str) and mode not in DISPATCH:
        raise ValueError(f"no mode {mode!r}")
    send, collect = DISPATCH[mode] if isinstance(mode, str) else mode

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = work(pdf.sort_values("pos"))
        return out.assign(rank=int(pdf["rank"].iloc[0]))

    return collect(send(df, ranks).groupBy("rank").applyInPandas(run, schema + ", rank int"))


#: Sinks by name: each takes a table of metrics (or samples), a place and a step.
SINKS: dict[str, Callable[[DataFrame, str, int], None]] = {}


def sink(name: str):
    """Registers a sink; a name is taken once."""
    def add(f):
        if name in SINKS:
            raise ValueError(f"sink {name!r} is there already")
        SINKS[name] = f
        return f
    return add


@sink("lines")
def _lines(df: DataFrame, place: str, step: int) -> None:
    df.withColumn("step", F.lit(step)).write.mode("append").json(f"{place}/lines")


@sink("table")
def _table(df: DataFrame, place: str, step: int) -> None:
    df.withColumn("step", F.lit(step)).write.mode("append").parquet(f"{place}/table")


@sink("text")
def _text(df: DataFrame, place: str, step: int) -> None:
    shown = F.concat(F.lit(f"step {step}: "), F.concat_ws(", ", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in df.columns]))
    df.select(shown.alias("value")).write.mode("append").text(f"{place}/text")


def tracked(df: DataFrame, names: list[str], place: str, step: int) -> None:
    """Writes to each of the named sinks. Raises for an unknown one before anything is written."""
    for name in names:
        if name not in SINKS:
            raise ValueError(f"no sink {name!r}")
    for name in names:
        SINKS[name](df, place, step)


def sample_blocks(df: DataFrame) -> Column:
    """A generated sample as a block of text: prompt, output, label, score and, where the table has it, the problem's id."""
    parts = [("prompt", "prompt"), ("output", "output"), ("label", "label"), ("score", "score"), ("problem_id", "problem_id")]
    return F.concat_ws("\n", *[F.concat(F.lit(f"[{shown}] "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for shown, c in parts if c in df.columns])


def isolated(jobs: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables that jobs write and return, by name, and the errors of those that failed; a failure ends its own job
    alone. A job must do its work before it returns (a written table), as an error in a later action is not caught."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = job()
        except Exception as e:  # noqa: BLE001
            failed[name] = type(e).__name__
    return done, failed


@contextlib.contextmanager
def timed(name: str, into: dict[str, float]):
    """Adds the seconds a section takes to ``into``, whether it ends well or not."""
    began = time.perf_counter()
    try:
        yield
    finally:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began


def timings(spark: SparkSession, held: dict[str, float]) -> DataFrame:
    """Sections and their seconds as a table of metrics."""
    return spark.createDataFrame([(f"timing/{k}", float(v)) for k, v in held.items()], "metric string, value double")
