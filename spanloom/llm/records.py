"""What the problems on ``records`` share: the valid row of a record, its split, its video ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The spellings of the three splits.
SPLIT_SPELLINGS = {
    "train": ["train", "training"],
    "val": ["val", "valid", "validation", "dev", "development"],
    "test": ["test", "testing"],
}

#: What re-encoding or copying adds to a file name, any number of times, besides endings.
ADDED_TO_NAMES = (
    r"(?:\.[a-z0-9]{1,5}"
    r"|[_-]\d{3,4}[pi]"
    r"|[_ -](?:reenc|reencoded|transcoded|copy|kopie|h26[45]|x26[45]|hevc|av1|vp9)\d*"
    r"|[_-]v\d+(?:-fps\d+)?"
    r"|[_-]fps\d+"
    r"|\s*\(\d+\)"
    r"|\s+)+$"
)


def video_id(path: Column) -> Column:
    """The id of a video path; NULL where the path is NULL, blank or names no file.

    Folders (``/`` or ``\\``), query and fragment, percent-escapes, endings and the marks
    of re-encoding or copying go away, the rest is in lower case.
    """
    text = F.regexp_replace(path, r"[?#].*$", "")
    text = F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)
    name = F.regexp_extract(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"([^/\\]*)$", 1)
    name = F.trim(F.regexp_replace(name, ADDED_TO_NAMES, ""))
    return F.when(name.rlike("[a-z0-9]"), name)


def video_ids(videos: Column) -> Column:
    """The sorted distinct ids of an array of paths; empty where there is none."""
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(videos, video_id), lambda x: x.isNotNull())))
    return F.coalesce(ids, F.array().cast("array<string>"))


def split_name(split: Column) -> Column:
    """``train``, ``val`` or ``test`` whatever the spelling; other names in lower case, blank as NULL."""
    name = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    out = F.when(name == "", None)
    for plain, spellings in SPLIT_SPELLINGS.items():
        out = out.when(name.isin(spellings), F.lit(plain))
    return out.otherwise(name)


# The spellings of the problem types after case and separators are levelled.
TYPE_SPELLINGS = {"tg": "temporal grounding", "videoqa": "video qa", "mcq": "multiple choice"}


def problem_type_name(kind: Column) -> Column:
    """Problem types with case, blanks, ``_`` and ``-`` levelled; NULL and blank as ``unknown``."""
    name = F.trim(F.regexp_replace(F.lower(kind), r"[\s_-]+", " "))
    out = F.when(name.isNull() | (name == ""), F.lit("unknown"))
    for short, plain in TYPE_SPELLINGS.items():
        out = out.when(name == short, F.lit(plain))
    return out.otherwise(name)


def valid_rows(records: DataFrame, **columns: Column) -> DataFrame:
    """One row per ``record_id``: that of the latest ``ingested_at``, with the named columns.

    Rows that tie are equal. A NULL ``ingested_at`` counts as earliest, rows with a NULL
    ``record_id`` name no record and are left out. Only the named columns are shuffled.
    """
    when = F.coalesce(F.unix_micros("ingested_at"), F.lit(-(2**62)))
    row = records.where("record_id IS NOT NULL").select(
        F.col("record_id"), when.alias("_at"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_row")
    )
    last = row.groupBy("record_id").agg(F.max_by("_row", "_at").alias("_row"))
    return last.select("record_id", *[F.col(f"_row.{n}").alias(n) for n in columns])
