"""Problem 5: encoding of a whole corpus with a public tokenizer, by a table of distinct words.

The tokenizer never merges across the words of its pattern, so a text's ids are its words' ids in their order.
Words are split by Spark; each distinct word of the corpus is encoded once. To join the ids back by position without
sending a row per word, documents are put into blocks of bounded size: the words of a block, each once, meet the
table of distinct words, and the block's documents then look their words up in the block's own dictionary.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..storage import materialise

TOKENIZERS = "/opt/tokenizers"
#: Bytes of text in a block, on average; a block's words are held by one task.
BLOCK_BYTES = 2 << 20
# Fixed value: the pattern that splits a text into words, with white space in the sense of Unicode.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_ENCODERS: dict[str, object] = {}


def vocabulary(path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> bytes:
    """The vocabulary file, pieces and ranks; about 1 MB whatever the corpus, so it is sent along with tasks."""
    with open(f"{path}/{name}.tiktoken", "rb") as f:
        return f.read()


def _encoder(raw: bytes):
    key = f"{len(raw)}-{hash(raw)}"
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def words(text: Column) -> Column:
    """The words of a text in their order; concatenated they are the text. None for NULL and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


#: What the JVM's Unicode tables don't know; letters among it would be split otherwise than by the tokenizer.
_UNASSIGNED = r"\p{Cn}"


@F.pandas_udf(ArrayType(StringType()))
def _words_by_later_tables(text: pd.Series) -> pd.Series:
    """:func:`words` with the tables of Python's ``regex``, which are those of a later Unicode; NULL for NULL."""
    import regex

    pattern = regex.compile(PATTERN.removeprefix("(?U)"), regex.V0 | regex.UNICODE)
    return pd.Series([None if t is None else pattern.findall(t) for t in text], dtype=object)


def later_words(text: Column) -> Column:
    """The words of the rare texts with characters that the JVM does not know, split in Python; NULL for all others."""
    return _words_by_later_tables(F.when(text.rlike(_UNASSIGNED), text))


def _word_encoder(spark: SparkSession, path: str, name: str):
    raw = spark.sparkContext.broadcast(vocabulary(path, name))

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(word: pd.Series) -> pd.Series:
        encoder = _encoder(raw.value)
        return word.map(lambda w: encoder._encode_single_piece(w))

    return encode


def _per_word(docs: pa.Table, dictionary: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """What the dictionary has for each word of the block, and the words' boundaries by document."""
    words = docs["words"].combine_chunks()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))))
    place = pc.index_in(words.flatten(), value_set=dictionary["word"].combine_chunks())
    return dictionary["ids"].combine_chunks().take(place), ends


def _look_up(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    ids, ends = _per_word(docs, dictionary)
    upto = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64))))
    lists = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), ids.flatten().cast(pa.int32()))
    return pa.table({"doc_id": docs["doc_id"].combine_chunks(), "ids": lists})


def _add_up(docs: pa.Table, dictionary: pa.Table) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "tokens": pa.array([], pa.int32())})
    sizes, ends = _per_word(docs, dictionary)
    upto = np.concatenate(([0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))))
    return pa.table({"doc_id": docs["doc_id"].combine_chunks(), "tokens": pa.array(np.diff(upto[ends]).astype(np.int32))})


def _by_words(documents: DataFrame, id_col: str, text_col: str, path: str, name: str, counts_only: bool) -> DataFrame:
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    base = docs.where("text IS NOT NULL AND text <> ''").select(block, "doc_id", "text", later_words(F.col("text")).alias("late"))
    own = F.coalesce("late", words(F.col("text")))
    used = materialise(base.select("block", F.explode(F.array_distinct(own)).alias("word")).distinct(), "block-words")
    # texts are sent to their blocks and split there: as words they would be several times as large
    split = base.repartition("block").select("block", "doc_id", own.alias("words"))
    encode = _word_encoder(spark, path, name)
    table = used.select("word").distinct().withColumn("ids", encode("word"))
    if counts_only:
        table = table.withColumn("ids", F.size("ids"))
    dictionary = used.join(table, "word").select("block", "word", "ids")
    if counts_only:
        found = split.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(_add_up, "doc_id long, tokens int")
        rest = docs.where("text IS NULL OR text = ''").select("doc_id", F.lit(0).alias("tokens"))
    else:
        found = split.groupBy("block").cogroup(dictionary.groupBy("block")).applyInArrow(_look_up, "doc_id long, ids array<int>")
        rest = docs.where("text IS NULL OR text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    return found.unionByName(rest)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id`` and ``ids`` of each row of ``documents``, without special tokens.

    Empty and NULL texts have the empty list. Strings that look like special tokens are ordinary text. Texts of any
    length are read whole. Rows that repeat, and rows without an id, come out as they came in, an empty table gives
    an empty one, other columns are ignored whatever their names.
    """
    return _by_words(documents, id_col, text_col, path, name, False)


def sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id`` and ``tokens``, the number of ids :func:`encode` gives."""
    return _by_words(documents, id_col, text_col, path, name, True)


def pieces(spark: SparkSession, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``id``, ``piece`` (bytes): the vocabulary as a table."""
    rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in (line.split() for line in vocabulary(path, name).splitlines() if line)]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, path: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``: each id meets its piece, pieces are put together by position.

    An empty list gives the empty text, a NULL list NULL. Ids outside the vocabulary give nothing. ``doc_id`` must not
    repeat. The vocabulary has a fixed size and is sent to every task.
    """
    one = encoded.select("doc_id", F.posexplode("ids").alias("at", "id"))
    hexed = pieces(encoded.sparkSession, path, name).select("id", F.hex("piece").alias("piece"))
    text = (
        one.join(F.broadcast(hexed), "id").groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
        .select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8").alias("text"))
    )
    return encoded.select("doc_id", (F.size("ids") == 0).alias("_none")).join(text, "doc_id", "left").select(
        "doc_id", F.when(F.col("_none"), F.lit("")).otherwise(F.col("text")).alias("text"))
