"""Problem 2: the same or nearly the same records in evaluation and training splits.

Texts are cut at sentence marks and quotes. Passages that stand beside very many different others are instructions,
counted over all records; all passages that are left, taken together, say what is asked for.

The hashes of the word n-grams of the evaluation records are partitioned by the entity (video) they belong to,
training records are scanned for hits on them, and a pair's containment is the share of the n-grams of the
shorter text that hit. Pairs over a low containment, which no edit of a few words of a long text goes under, are then
checked word by word. Where one text is short, a changed word breaks most of its shingles, and a single shingle of two words is enough.

An entity of more than ``BLOCK`` records is partitioned further, in ways that keep every pair that would be looked at in a
smaller one. Its different texts are cut into blocks on both sides, every one of which meets every one of the other side, as
long as a text is sent at most ``TIMES`` times for that on average. Beyond, a text is sent once to each of its shingles (of
``WORDS`` words, and of two words where one text of the pair is short) and meets all that share one, so it is sent as often as
it has words, however many records the entity has. Only where one shingle itself has more than ``BLOCK`` texts is it cut into blocks.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..storage import materialise

#: Words of a shingle.
WORDS = 5
#: Containment of shingles from which a pair is looked at word by word: five changed words in 25 stay above it.
CANDIDATE = 0.15
#: Share of the words of the shorter text that must be in the other.
SIMILAR = 0.8
#: Share of the words of the shorter text that may be misspelt.
MISSPELT = 0.3
#: Words of the shorter text that may be replaced by others, as a share; texts under SHORT words allow none.
REPLACED, SHORT = 0.135, 16
#: Rows of one entity that are compared in one task, on average; entities of more rows are partitioned by blocks or shingles.
BLOCK = 6000
#: Times that the different texts of an entity are sent, on average, up to which it is partitioned by blocks: about as often
#: as shingles would send them.
TIMES = 24
#: Different rests of texts that a passage stands beside from which it is an instruction: at least so many, and this share
#: of all texts. An event stands beside as many as there are instructions.
BESIDE, BESIDE_SHARE = 20, 0.0005

# Words that tell events apart, one pair or row of them each.
OPPOSITES = """
left right | before after | up down | upwards downwards | first second third last | open close | opens closes | on off | above below | inside outside
forwards backwards | forward backward | one two three four five six seven eight nine ten | man woman | boy girl | he she | with without
links rechts | linke rechte | linken rechten | vor nach | gauche droite | avant après | izquierda derecha | antes después
"""
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіѕԁјһӏοαν", "aeopcyxisdjhloav")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠﻿]")
_TAG = re.compile(r"</?\w+>")
_BREAK = re.compile(r"[.:?!;\n\"“”«»„¿¡。？！：；]+")
_CHOICE = re.compile(r"^[ \t]*\(?[^\W_][).:][^\n]*$", re.MULTILINE)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_APART = {w: n for n, row in enumerate(OPPOSITES.replace("\n", "|").split("|")) for w in row.split()}


def plain(text: str) -> str:
    """Case, look-alike letters, invisible characters, character references and ``&`` levelled."""
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return text.lower().replace("&", " and ")
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).lower()
    if re.search("[Ͱ-ӿ]", text) and re.search("[a-z]", text):
        text = text.translate(LOOKALIKES)
    return text.replace("&", " and ")


@lru_cache(maxsize=8192)
def _words(part: str) -> str:
    return " ".join(_WORD.findall(part))


def passages(text: str) -> tuple[list[str], list[str]]:
    """The passages between sentence marks or quotes, their words set off by blanks, and the listed answer choices."""
    text = _TAG.sub(" ", plain(text)) if "<" in text else plain(text)
    choices = _CHOICE.findall(text) if "\n" in text else []
    if len(choices) > 1:
        text = _CHOICE.sub("\n", text)
    else:
        choices = []
    parts = dict.fromkeys(map(_words, _BREAK.split(text)))
    parts.pop("", None)
    return list(parts), [_words(c) for c in choices]


class Instructions:
    """The passages that are instructions, and the misspelt ones that are much like them."""

    def __init__(self, passages: list[str]):
        self.passages = frozenset(passages)
        self.words = [(p.count(" ") + 1, frozenset(p.split(" "))) for p in sorted(passages)]
        self.all = frozenset().union(*(w for _, w in self.words))
        self.longest = max((n for n, _ in self.words), default=0)
        self.known: dict[str, bool] = {}

    def __contains__(self, passage: str) -> bool:
        if passage not in self.known:
            self.known[passage] = passage in self.passages or self._like(passage)
        return self.known[passage]

    def _like(self, passage: str) -> bool:
        n = passage.count(" ") + 1
        if SIMILAR * n > self.longest:
            return False
        if n <= 2:  # too few words for a share of them: each is the same or a misspelling
            own = passage.split(" ")
            return any(m == n and all(any(w == o or _typo(w, o) for o in there) for w in own) for m, there in self.words)
        words = frozenset(passage.split(" "))
        if len(words & self.all) < (SIMILAR - MISSPELT) * len(words):
            return False
        return any(SIMILAR * max(n, m) <= min(n, m) and same_request(w, words) >= SIMILAR for m, w in self.words)


def _left(parts: list[str], choices: list[str], instructions: Instructions) -> list[str]:
    return [p for p in parts if p not in instructions] or choices or parts


def asked_for(text: str, instructions: Instructions) -> str:
    """What is asked for: the words of all passages that are no instructions. Where nothing else stands in the text, its
    answer choices count, or else all of its passages."""
    return " ".join(_left(*passages(text), instructions))


@F.pandas_udf(StringType())
def _read(texts: pd.Series) -> pd.Series:
    """The passages of a text, one a line, and its answer choices behind a form feed."""
    def read(text: str) -> str:
        parts, choices = passages(text)
        return "\n".join(parts) + ("\f" + "\n".join(choices) if choices else "")

    known = {t: read(t) for t in texts.unique()}
    return pd.Series([known[t] for t in texts], dtype=object)


def _parts(read: Column) -> Column:
    return F.filter(F.split(F.substring_index(read, "\f", 1), "\n"), lambda p: p != "")


def _instructions(read: DataFrame) -> Instructions:
    """As :func:`instructions`, of a column ``read``."""
    least = max(BESIDE, math.ceil(BESIDE_SHARE * read.count()))
    parts = read.select(_parts(F.col("read")).alias("parts"))
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a.bitwiseXOR(F.xxhash64(p)))
    pairs = parts.select(whole.alias("whole"), F.explode("parts").alias("part")).select(F.xxhash64("part").alias("key"), F.col("whole").bitwiseXOR(F.xxhash64("part")).alias("rest"))
    keys = [r["key"] for r in pairs.groupBy("key").agg(F.countDistinct("rest").alias("beside")).where(F.col("beside") >= least).select("key").collect()]
    if not keys:
        return Instructions([])
    return Instructions([r["part"] for r in parts.select(F.explode("parts").alias("part")).where(F.xxhash64("part").isin(keys)).distinct().collect()])


def instructions(texts: DataFrame, text: str = "problem") -> Instructions:
    """The instructions among the passages of a table of texts. There are at most ``1 / BESIDE_SHARE`` times the average
    number of passages of a text, whatever the table's size."""
    return _instructions(materialise(texts.where(F.col(text).isNotNull()).select(_read(F.col(text)).alias("read")), "p2-read"))


def _asked(read: Column, around: Instructions) -> Column:
    """:func:`asked_for` of a column ``read``. Only passages that could be misspelt instructions are looked at in Python."""
    @F.pandas_udf("string")
    def looked_at(reads: pd.Series) -> pd.Series:
        out = {}
        for r in reads.dropna().unique():
            parts, _, choices = r.partition("\f")
            out[r] = " ".join(_left(parts.split("\n") if parts else [], choices.split("\n") if choices else [], around))
        return pd.Series([out.get(r) for r in reads], dtype=object)

    parts = _parts(read)
    left = F.filter(parts, lambda p: ~p.isin(sorted(around.passages))) if around.passages else parts
    unsure = F.exists(left, lambda p: F.size(F.split(p, " ")) * SIMILAR <= around.longest)
    choices = F.substring_index(read, "\f", -1)
    otherwise = F.when(F.size(left) > 0, F.array_join(left, " ")).when(read.contains("\f"), F.replace(choices, F.lit("\n"), F.lit(" "))).otherwise(F.array_join(parts, " "))
    return F.coalesce(looked_at(F.when(unsure | (F.size(left) == 0), read)), otherwise)


def _typo(a: str, b: str) -> bool:
    """Whether one word is a misspelling of the other: one letter changed, missing, doubled or swapped."""
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[2:] == y[2:] and x[:2] == y[1::-1])


def _apart(left: list[str], others: list[str]) -> bool:
    """Whether a word of one side stands for one of the other that tells events apart, or a number for another number."""
    rows = {_APART[w] for w in others if w in _APART}
    if any(_APART.get(w, -1) in rows for w in left):
        return True
    return any(w.isdecimal() for w in left) and any(w.isdecimal() for w in others)


def same_request(a: frozenset, b: frozenset) -> float:
    """The share of the words of the shorter text found in the other, misspelt ones too; 0 where they differ in more
    words than ``REPLACED`` allows."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    same = len(a & b)
    if same < (SIMILAR - MISSPELT) * len(a):
        return 0.0
    mine, others = a - b, list(b - a)
    left = []
    for w in mine:
        k = next((k for k, o in enumerate(others) if _typo(w, o)), None)
        if k is None:
            left.append(w)
        else:
            others.pop(k)
    allowed = math.floor(REPLACED * len(a)) if len(a) >= SHORT else 0
    if min(len(left), len(others)) > allowed or _apart(left, others):
        return 0.0
    return 1 - len(left) / len(a)


class _Read:
    """Texts of one side of a block as arrays: word numbers, keys of the shingles with their owner, and marks."""

    def __init__(self, texts: list[str], entities: list[str], numbers: dict[str, int]):
        n = np.array([text.count(" ") + 1 for text in texts])
        flat = np.fromiter(map(numbers.__getitem__, " ".join(texts).split(" ")), np.uint64, n.sum())
        self.ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(flat)) - np.repeat(self.ends - n, n)
        # a shingle's key mixes its words, and the words' number where a text is shorter than a shingle, with the entity
        mixed = _mix(flat)
        entity = _mix(np.array([hash(e) & (2**64 - 1) for e in entities], np.uint64))
        key = entity[owner]
        left = np.repeat(n, n) - place
        for k in range(WORDS):
            behind = np.minimum(np.arange(len(flat)) + k, len(flat) - 1)
            key = _mix(key + np.where(k < left, mixed[behind], np.uint64(k + 1)))
        starts = (left >= WORDS) | ((place == 0) & (left < WORDS))
        self.owner, self.keys = _distinct(owner[starts], key[starts])
        self.length, self._flat, self._owner, self._mixed = n, flat.astype(np.int64), owner, mixed
        self._inner, self._entity = left > 1, entity
        self.shingles = np.bincount(self.owner, minlength=len(texts))

    def words(self, i: int) -> np.ndarray:
        """The word numbers of a text."""
        return self._flat[self.ends[i] - self.length[i] : self.ends[i]]

    def mark(self, spellings: np.ndarray) -> None:
        """256 bits, one per group of like spellings; the number of different words, and of those that share a bit with another."""
        owner, word = _distinct(self._owner, self._flat)
        bit = (_mix(spellings[word]) & np.uint64(255)).astype(np.int64)
        self.bits = np.zeros((len(self.length), 4), np.uint64)
        np.bitwise_or.at(self.bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        self.distinct = np.bincount(owner, minlength=len(self.length))
        self.shared = self.distinct - np.bitwise_count(self.bits).sum(axis=1)

    def twos(self, chosen: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Owners and keys of the two-word shingles of the chosen passages, those of words in the vocabulary only."""
        at = np.flatnonzero(self._inner & chosen[self._owner])
        if vocabulary is not None:
            at = at[vocabulary[self._flat[at]]]
            at = at[vocabulary[self._flat[at + 1]]]
        owner = self._owner[at]
        return _distinct(owner, _mix(_mix(self._entity[owner] + self._mixed[at]) + self._mixed[at + 1]))

    def vocabulary(self, chosen: np.ndarray, size: int) -> np.ndarray:
        """Which of ``size`` word numbers occur in the chosen passages."""
        out = np.zeros(size, bool)
        out[self._flat[chosen[self._owner]]] = True
        return out


def _hits(owner: np.ndarray, keys: np.ndarray, others: np.ndarray, other_keys: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a text and another, as ``text * width + other``, with the number of keys they share. ``other_keys`` are sorted."""
    lo, hi = np.searchsorted(other_keys, keys, "left"), np.searchsorted(other_keys, keys, "right")
    n = hi - lo
    hit = n > 0
    lo, n, who = lo[hit], n[hit], owner[hit]
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    code = np.repeat(who, n) * width + others[place]
    if len(code) * 8 < height * width:
        return np.unique(code, return_counts=True)
    counts = np.bincount(code)
    pairs = np.flatnonzero(counts)
    return pairs, counts[pairs]


def _short_pairs(t: _Read, e: _Read, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_hits`, the pairs of which one text at least is short, and their containment of two-word shingles."""
    found = []
    t_short, e_short = t.length < SHORT, e.length < SHORT
    if e_short.any():
        found.append(_hits(*t.twos(np.ones(len(t.length), bool), e.vocabulary(e_short, size)), *e.twos(e_short), len(e.length), len(t.length)))
    if t_short.any() and not e_short.all():
        found.append(_hits(*t.twos(t_short), *e.twos(~e_short, t.vocabulary(t_short, size)), len(e.length), len(t.length)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs, counts = (np.concatenate(x) for x in zip(*found))
    share = counts / (np.minimum(t.length[pairs // len(e.length)], e.length[pairs % len(e.length)]) - 1)
    return pairs, np.minimum(share, 1.0)


def _distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of each owner, in the order of the values. Owners come in their order."""
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _spellings(numbers: dict[str, int]) -> np.ndarray:
    """A group for each word number; words that are misspellings of one another are in one group."""
    group = list(range(len(numbers)))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    # a word and its misspelling are alike, or one is the other, once a letter of each is left out
    near: dict[str, list[str]] = {}
    for w in numbers:
        if len(w) >= 3:
            for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                near.setdefault(key, []).append(w)
    for words in near.values():
        for k, w in enumerate(words[1:], 1):
            for o in words[:k] if k < 20 else words[:1]:
                if k >= 20 or _typo(w, o):
                    group[top(numbers[w])] = top(numbers[o])
    return np.array([top(i) for i in range(len(group))], np.uint64)


def _may_agree(a: _Read, b: _Read, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether texts can have as many words in common, misspelt ones too, as ``SIMILAR`` asks for; never denies one that has."""
    common = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1) + np.minimum(a.shared[i], b.shared[j])
    return common >= SIMILAR * np.minimum(a.distinct[i], b.distinct[j])


def _by_text(side: pd.DataFrame) -> tuple[list[tuple[str, str]], list[list[int]]]:
    """The different (entity, text) and the ids that have each."""
    held: dict[tuple[str, str], list[int]] = {}
    for entity, text, i in zip(side["entity"], side["text"], side["id"]):
        held.setdefault((entity, text), []).append(i)
    return list(held), list(held.values())


def _block_pairs(pdf: pd.DataFrame) -> Iterator[tuple[int, int, float, float]]:
    """Pairs (evaluation id, training id, containment, similarity) within one block, once per entity."""
    ev = pdf[pdf["evaluation"]]
    tr = pdf[~pdf["evaluation"]]
    tr = tr[tr["entity"].isin(set(ev["entity"]))]
    if not len(ev) or not len(tr):
        return
    # copies are read and compared once, as one text of an entity, and their ids put in at the end
    (e_keys, ids), (t_keys, tids) = _by_text(ev), _by_text(tr)
    ttext, tent = [t for _, t in t_keys], [e for e, _ in t_keys]
    numbers = {w: n for n, w in enumerate(dict.fromkeys(" ".join(t for _, t in (*e_keys, *t_keys)).split(" ")))}
    names, spellings = list(numbers), _spellings(numbers)
    e_read = _Read([t for _, t in e_keys], [e for e, _ in e_keys], numbers)
    e_read.mark(spellings)
    step = max(1, 4_000_000 // len(ids))
    for at in range(0, len(tids), step):
        t_read = _Read(ttext[at : at + step], tent[at : at + step], numbers)
        t_read.mark(spellings)
        pairs, counts = _hits(t_read.owner, t_read.keys, e_read.owner, e_read.keys, len(ids), len(t_read.length))
        share = counts / np.minimum(t_read.shingles[pairs // len(ids)], e_read.shingles[pairs % len(ids)])
        pairs, share = pairs[share >= CANDIDATE], share[share >= CANDIDATE]
        also, part = _short_pairs(t_read, e_read, len(numbers))
        more = ~np.isin(also, pairs)
        pairs, share = np.concatenate((pairs, also[more])), np.concatenate((share, part[more]))
        t_i, e_i = pairs // len(ids), pairs % len(ids)
        near = np.flatnonzero(_may_agree(e_read, t_read, e_i, t_i))
        for j in near:
            e, t = e_i[j], t_i[j]
            alike = same_request(frozenset(names[i] for i in e_read.words(e)), frozenset(names[i] for i in t_read.words(t)))
            if alike >= SIMILAR:
                for a in ids[e]:
                    for b in tids[at + t]:
                        yield a, b, float(share[j]), alike


_PAIRS = "evaluation_id long, training_id long, containment double, similarity double"


def _find(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(list(_block_pairs(pdf)), columns=["evaluation_id", "training_id", "containment", "similarity"])


def _shingle_hashes(words: Column, size: int, kind: str) -> Column:
    """Hashes of the shingles of an array of words within an entity, apart for each kind."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64("entity", F.lit(kind), F.slice(words, i, size)))


def _different(rows: DataFrame) -> DataFrame:
    """The different texts of each entity and side; ``id`` is the same for equal texts of an entity."""
    return rows.select("evaluation", "entity", "text", F.xxhash64("entity", "text").alias("id")).distinct()


def _sent(texts: DataFrame) -> DataFrame:
    """``key``, ``id``, ``evaluation``, ``text``: a text once for its entity if that is cut into blocks, else once for each
    shingle by which a pair of it could be looked at: two long texts share one of ``WORDS`` words, two of which one is
    short share one of two words, or are the same word."""
    words, evaluation = F.split("text", " "), F.col("evaluation")
    short = F.size(words) < SHORT
    e, t = F.col("_e"), F.col("_t")
    per = texts.groupBy("entity").agg(
        F.count_if(evaluation).alias("_e"), F.count_if(~evaluation).alias("_t"), F.bool_or(evaluation & short).alias("_e_short"), F.bool_or(~evaluation & short).alias("_t_short"))
    # one row per entity; the written table's size decides how it is joined
    per = materialise(per.select("entity", (e * F.ceil(t / BLOCK) + t * F.ceil(e / BLOCK) > TIMES * (e + t)).alias("_by_shingles"), "_e_short", "_t_short"), "p2-per-entity")
    none = F.array().cast("array<long>")
    # a short evaluation text meets all training texts, a long one the short ones
    with_short = F.when(F.when(evaluation, short).otherwise(F.col("_e_short")), _shingle_hashes(words, 2, "short evaluation")).otherwise(none)
    short_only = F.when(F.when(evaluation, ~short & F.col("_t_short")).otherwise(short), _shingle_hashes(words, 2, "short training")).otherwise(none)
    long = F.when(short, none).otherwise(_shingle_hashes(words, WORDS, "long"))
    keys = F.when(~F.col("_by_shingles"), F.array(F.xxhash64("entity"))).when(F.size(words) == 1, F.array(F.xxhash64("entity", "text"))).otherwise(F.array_distinct(F.concat(with_short, short_only, long)))
    keyed = materialise(texts.join(per, "entity").select("id", "evaluation", "text", keys.alias("keys")), "p2-keyed")
    return keyed.select("id", "evaluation", "text", F.explode("keys").alias("key"))


def _by_shingles(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs within the entities of ``hot``, the same as if each entity were compared at once."""
    own = materialise(rows.join(hot, "entity").select("id", "evaluation", F.xxhash64("entity", "text").alias("same"), "entity", "text"), "p2-of-hot")
    sent = _sent(materialise(_different(own), "p2-texts"))
    counts = sent.groupBy("key").agg(F.sum(F.col("evaluation").cast("int")).alias("_e"), F.count("*").alias("_all"))
    large = materialise(counts.where(F.col("_all") > BLOCK).select(
        "key", F.greatest(F.ceil((F.col("_all") - F.col("_e")) / BLOCK), F.lit(1)).cast("int").alias("_nt"), F.greatest(F.ceil(F.col("_e") / BLOCK), F.lit(1)).cast("int").alias("_ne")), "p2-large")
    buckets = max(1, math.ceil(sent.count() / (2 * BLOCK)))
    nt, ne = F.coalesce("_nt", F.lit(1)), F.coalesce("_ne", F.lit(1))
    mine = F.when(F.col("evaluation"), F.pmod(F.hash("id"), ne)).otherwise(F.pmod(F.hash("id"), nt))
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("evaluation"), nt).otherwise(ne) - 1))
    placed = sent.join(large, "key", "left").select("id", "evaluation", "text", "key", F.isnotnull("_nt").alias("_large"), mine.alias("_own"), meets.alias("_other"))
    t_block = F.when(F.col("evaluation"), F.col("_other")).otherwise(F.col("_own"))
    e_block = F.when(F.col("evaluation"), F.col("_own")).otherwise(F.col("_other"))
    own_block = F.when(F.col("_large"), F.xxhash64("key", t_block, e_block)).otherwise(F.pmod("key", F.lit(buckets)))
    block = placed.select(own_block.alias("block"), "id", "evaluation", F.col("key").cast("string").alias("entity"), "text")
    pairs = block.groupBy("block").applyInPandas(_find, _PAIRS).groupBy("evaluation_id", "training_id").agg(F.max("containment").alias("containment"), F.max("similarity").alias("similarity"))
    sides = [own.where(F.col("evaluation") if e else ~F.col("evaluation")).select(F.col("same").alias(key), F.col("id").alias(name)) for e, key, name in ((True, "evaluation_id", "_e"), (False, "training_id", "_t"))]
    return pairs.join(sides[0], "evaluation_id").join(sides[1], "training_id").select(F.col("_e").alias("evaluation_id"), F.col("_t").alias("training_id"), "containment", "similarity")


def overlaps(records: DataFrame, id_col: str = "record_id", split: str = "split", text: str = "problem", entities: str = "entities") -> DataFrame:
    """``evaluation_id``, ``training_id``, ``containment``, ``similarity``: one row per pair of records of the training
    split and the ``val`` or ``test`` split that share an entity and ask for the same in the same or nearly the same words.

    ``records`` holds one row per id. NULL ids, NULL or blank texts, NULL or empty ``entities`` and other splits
    pair with nothing.
    Texts of fewer than five words are one shingle, and those of fewer than 16 are compared by two-word shingles as well. Long texts are read whole. Empty input gives no pairs.
    """
    read = materialise(records.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(split).alias("split"), F.col(entities).alias("entities"), _read(F.col(text)).alias("read")), "p2-read")
    around = _instructions(read)
    rows = materialise(
        read.where("split IN ('train', 'val', 'test') AND id IS NOT NULL AND size(entities) > 0 AND read <> ''")
        .select("id", (F.col("split") != "train").alias("evaluation"), "entities", _asked(F.col("read"), around).alias("text"))
        .select("id", "evaluation", F.explode("entities").alias("entity"), "text").where("entity IS NOT NULL AND text <> ''"), "p2-asked")
    counts = materialise(rows.groupBy("entity").agg(F.count("*").alias("_n")), "p2-entities")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # at most rows / BLOCK entities; the written table's size decides how they are joined
    hot = materialise(counts.where(F.col("_n") > BLOCK).select("entity"), "p2-hot")
    any_hot = hot.count() > 0
    buckets = max(1, math.ceil(total / (2 * BLOCK)))
    cold = rows.join(hot, "entity", "left_anti") if any_hot else rows
    block = cold.select(F.pmod(F.xxhash64("entity"), F.lit(buckets)).alias("block"), "id", "evaluation", "entity", "text")
    found = block.groupBy("block").applyInPandas(_find, _PAIRS)
    if any_hot:
        found = found.unionByName(_by_shingles(rows, hot))
    return found.groupBy("evaluation_id", "training_id").agg(F.max("containment").alias("containment"), F.max("similarity").alias("similarity"))
