"""Problem 7: the subject areas of documents.

For each language and subject an interpolated bigram model of its sentences, and a background model of all documents of
the language, which is told from the text (the column is often wrong). A sentence's
evidence for a subject is its cross-entropy under the background minus that under the subject's model, summed over the
tokens. The models are trained on a bounded sample of labelled documents by expectation-maximisation over sentences,
since a label says that a document is about a subject, not which of its sentences are, and raters err. A document's
sentences are then shared out among the subjects (or none) given the document's own mixture, and a subject is accepted
by thresholds on its sentences that are calibrated on labelled documents left out of the training.

Every text is read once, into the numbers of its words; counting and judging work on arrays of those, a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import unit_hash
from ..storage import materialise
from .defects import STOPWORDS

#: Labelled documents, by hash order, that models are trained and calibrated on, in all and of one value of ``lang``;
#: everything else covers all documents. Those that would bring the sample over MAX_BYTES of text are left out of it.
MAX_LABELLED, MAX_OF_LANG, MAX_BYTES = 9000, 1500, 64 << 20
#: More subjects than these are an error.
MAX_SUBJECTS = 1000
#: Interpolation: weight of the bigram by (count / (count + KAPPA)), and of the subject's unigram against the background.
KAPPA, MU = 8.0, 0.85
#: Prior of a sentence that is about no subject, of one about a subject the document is not labelled with, and rounds of training and of a document's mixture.
NONE_PRIOR, STRAY, ROUNDS, MIX_ROUNDS = 0.3, 0.1, 9, 4
#: How much a word that no labelled document has speaks for no subject (in nats).
UNKNOWN = 0.5
#: Words that are read, counted and judged at once as arrays, about, and whose rows of the models are held at once.
BATCH_WORDS, BLOCK_WORDS = 2_000_000, 500_000

_TAGS = re.compile(r"<[^<>]{0,40}>")
_CJK = "぀-ヿ一-鿿가-힯"
#: A token (a word, or one character of a script without blanks) or what ends a sentence.
_PART = re.compile(rf"[{_CJK}]|[^\W\d_{_CJK}]+(?:['’][^\W\d_]+)?|(?<=[.!?])\s+|[。！？\n|]+")
_ONE_CJK = re.compile(f"[{_CJK}]")
LANGUAGES = sorted([*STOPWORDS, *(["zh"] if "zh" not in STOPWORDS else [])])


def parts(text: str) -> list[str]:
    """The tokens of a text in lower case, in their order, and the marks between its sentences."""
    return _PART.findall((_TAGS.sub(" ", text) if "<" in text else text).lower())


class Vocabulary(dict):
    """Numbers of words: those of the labelled sample, the stopwords, two for unknown words, and -1 for what ends a sentence."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        n = len(words)
        self.words, self.unknown, self.unknown_cjk, self.size = words, n, n + 1, n + 2
        self.stop = np.zeros((self.size, len(LANGUAGES)), np.float32)
        listed: dict[str, list[int]] = {}
        for lang, row in STOPWORDS.items():
            for w in row.split():
                listed.setdefault(w, []).append(LANGUAGES.index(lang))
        for w, langs in listed.items():
            self.stop[self[w], langs] = 1 / len(langs)
        self.cjk = np.array([bool(_ONE_CJK.search(w)) for w in words] + [False, True])

    def __missing__(self, word: str) -> int:
        if word[0].isalpha():
            return self.unknown_cjk if _ONE_CJK.match(word) else self.unknown
        return -1 if not _ONE_CJK.match(word) else self.unknown_cjk

    @classmethod
    def of(cls, texts: list[list[str]]) -> Vocabulary:
        words = {w for text in texts for w in text if w[0].isalpha() or _ONE_CJK.match(w)}
        return cls(sorted(words.union(*(row.split() for row in STOPWORDS.values()))))


class Texts:
    """Texts as arrays: ``ids`` of all their tokens, ``lengths`` of their sentences in tokens, ``sentences`` of each text in
    sentences, and ``lang``, the number of its language, -1 where it can't be told."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sentences: np.ndarray, lang: np.ndarray):
        self.ids, self.lengths, self.sentences, self.lang = ids, lengths, sentences, lang
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(sentences))).astype(np.int64)  # first sentence of each text
        self.tokens = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)[self.first]  # first token of each text

    @classmethod
    def read(cls, texts: list[list[str]], vocabulary: Vocabulary) -> Texts:
        n = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(texts)), np.int32, n.sum())
        text = np.repeat(np.arange(len(texts)), n)
        kept = ids >= 0
        sentence = (np.cumsum(~kept) + text)[kept]  # a text and a mark each begin another one
        ids, text = ids[kept], text[kept]
        new = np.ones(len(ids), bool)
        new[1:] = (sentence[1:] != sentence[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(ids))).astype(np.int32)
        sentences = np.bincount(text[starts], minlength=len(texts)).astype(np.int32)
        return cls(ids, lengths, sentences, cls._voted(ids, text, len(texts), vocabulary))

    @staticmethod
    def _voted(ids: np.ndarray, text: np.ndarray, n: int, vocabulary: Vocabulary) -> np.ndarray:
        """The language that most stopwords of a text vote for, at least one and clearly more than for the next."""
        votes = np.zeros((n, len(LANGUAGES)))
        at = np.flatnonzero(vocabulary.stop.any(axis=1)[ids])
        for c in range(len(LANGUAGES)):
            votes[:, c] = np.bincount(text[at], vocabulary.stop[ids[at], c], n)
        best = votes.argmax(axis=1)
        ranked = np.sort(votes, axis=1)
        out = np.where((ranked[:, -1] >= 1) & (ranked[:, -1] >= 1.2 * ranked[:, -2]), best, -1)
        cjk = np.bincount(text, vocabulary.cjk[ids], n)
        return np.where((cjk >= 4) & (cjk > 2 * (np.bincount(text, minlength=n) - cjk)), LANGUAGES.index("zh"), out).astype(np.int32)

    def slices(self) -> Iterator[Texts]:
        """Runs of texts of about BATCH_WORDS words (a longer text by itself)."""
        at = 0
        while at < len(self.lang):
            end = max(at + 1, int(np.searchsorted(self.tokens, self.tokens[at] + BATCH_WORDS, "right")) - 1)
            yield self if at == 0 and end == len(self.lang) else self.chosen(np.arange(at, end))
            at = end

    def chosen(self, which: np.ndarray) -> Texts:
        """The texts of these numbers, in their order."""
        sent = _ranges(self.first[which], self.sentences[which])
        return Texts(self.ids[_ranges(self.starts[sent], self.lengths[sent])], self.lengths[sent], self.sentences[which], self.lang[which])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Grams:
    """The tokens, and pairs of neighbouring tokens that occur twice, of the labelled documents of one language."""

    def __init__(self, texts: Texts, vocabulary: Vocabulary):
        self.row = np.full(vocabulary.size, -1, np.int32)  # of a token's number
        own = np.unique(texts.ids)
        own = own[own < vocabulary.unknown]
        self.row[own] = np.arange(len(own))
        self.width, self.tokens = vocabulary.size, len(own)
        codes, counts = np.unique(self._codes(texts), return_counts=True)
        self.pairs = codes[(codes >= 0) & (counts >= 2)]
        self.first, self.second = self.row[self.pairs // self.width], self.row[self.pairs % self.width]
        self.size = self.tokens + len(self.pairs)

    def _codes(self, texts: Texts) -> np.ndarray:
        """Of each token, a number for it and the one before it in its sentence; -1 for the first."""
        out = np.full(len(texts.ids), -1, np.int64)
        out[1:] = texts.ids[:-1].astype(np.int64) * self.width + texts.ids[1:]
        out[texts.starts] = -1
        return out

    def places(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the row of it and that of its pair, both -1 where there is none."""
        codes = self._codes(texts)
        at = np.searchsorted(self.pairs, codes)
        at[at == len(self.pairs)] = 0
        hit = self.pairs[at] == codes if len(self.pairs) else np.zeros(len(codes), bool)
        return self.row[texts.ids], np.where(hit, at, -1)


class SubjectModels:
    """Of one language, the log-ratios of the interpolated bigram models of the subjects, and of the remarks that are
    about none, to the background's: a row for each token and each pair of tokens, a column for each model."""

    def __init__(self, grams: Grams, table: np.ndarray):
        """``table``: the rows of the tokens, those of the pairs, and one for unknown tokens."""
        self.grams, self.table = grams, table

    def evidence(self, texts: Texts) -> np.ndarray:
        """Per sentence and model, how much better it foretells the sentence than the background does (in nats)."""
        token, pair = self.grams.places(texts)
        rows = np.where(pair >= 0, self.grams.tokens + pair, np.where(token >= 0, token, len(self.table) - 1))
        out = np.zeros((len(texts.starts), self.table.shape[1]))
        for lo in range(0, len(rows), BLOCK_WORDS):  # a sentence may go on over several blocks
            first, last = np.searchsorted(texts.starts, lo, "right") - 1, np.searchsorted(texts.starts, lo + BLOCK_WORDS, "left")
            out[first:last] += np.add.reduceat(self.table[rows[lo : lo + BLOCK_WORDS]], np.maximum(texts.starts[first:last] - lo, 0), axis=0)
        return out


def _posterior(scores: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Per sentence, the probabilities of each subject and, last, of none."""
    logs = scores + np.log(np.maximum(prior, 1e-6))
    logs -= logs.max(axis=1, keepdims=True)
    p = np.exp(logs)
    return p / p.sum(axis=1, keepdims=True)


def shares(scores: np.ndarray, sentences: np.ndarray) -> np.ndarray:
    """The expected number of sentences of each subject in each text, given the text's own mixture. ``scores`` are of the
    sentences of texts of so many ``sentences``, none of them 0."""
    k, starts = scores.shape[1] - 1, np.cumsum(sentences) - sentences
    mix = np.full((len(sentences), k + 1), (1 - NONE_PRIOR) / k)
    mix[:, k] = NONE_PRIOR
    for _ in range(MIX_ROUNDS):
        p = np.add.reduceat(_posterior(scores, np.repeat(mix, sentences, axis=0)), starts, axis=0)
        mix = (p + np.append(np.full(k, 0.05), 0.3)) / (sentences + 0.05 * k + 0.3)[:, None]
    return np.add.reduceat(_posterior(scores, np.repeat(mix, sentences, axis=0)), starts, axis=0)[:, :k]


def _train(texts: Texts, own: np.ndarray, grams: Grams, bg: np.ndarray, total: float) -> SubjectModels:
    """``own``: per text, which subjects it is labelled with. ``bg``: the counts of the grams in all documents of the
    language, which have ``total`` words."""
    k = own.shape[1]
    at, pair_at = grams.places(texts)
    n = len(texts.lengths)
    owner = np.repeat(np.arange(n), texts.lengths)
    known, has = at >= 0, pair_at >= 0
    in_bg, first, second = bg[: grams.tokens], grams.first, grams.second
    p_bg = (in_bg + 0.5) / (total + 1.0 + 0.5 * (grams.tokens + 1))
    lam_bg = in_bg[first] / (in_bg[first] + KAPPA)
    pair_bg = lam_bg * bg[grams.tokens :] / np.maximum(in_bg[first], 1) + (1 - lam_bg) * p_bg[second]
    labelled = np.repeat(own / np.maximum(own.sum(axis=1, keepdims=True), 1), texts.sentences, axis=0)
    weights = np.concatenate([(1 - NONE_PRIOR) * labelled, np.full((n, 1), NONE_PRIOR)], axis=1)
    unknown = np.append(np.zeros(k), UNKNOWN)[None]
    model = None
    for r in range(ROUNDS):
        spread = weights[owner]
        uni = np.stack([np.bincount(at[known], spread[known, c], grams.tokens) for c in range(k + 1)], axis=1)
        two = np.stack([np.bincount(pair_at[has], spread[has, c], len(grams.pairs)) for c in range(k + 1)], axis=1)
        mixed = MU * uni / np.maximum(uni.sum(axis=0), 1e-9) + (1 - MU) * p_bg[:, None]
        lam = uni[first] / (uni[first] + KAPPA)
        pair = lam * two / np.maximum(uni[first], 1e-9) + (1 - lam) * mixed[second]
        base = np.log(mixed / p_bg[:, None])
        pair = np.log(np.maximum(pair, 1e-12) / np.maximum(pair_bg, 1e-12)[:, None])
        model = SubjectModels(grams, np.concatenate([base, pair, unknown]).astype(np.float32))
        if r < ROUNDS - 1:
            # raters err and remarks are made in passing: after some rounds other subjects are allowed for, at little weight
            stray = STRAY if r >= 2 else 0.0
            prior = np.concatenate([(1 - NONE_PRIOR - stray) * labelled + stray / k, np.full((n, 1), NONE_PRIOR)], axis=1)
            weights = _posterior(model.evidence(texts), prior)
    return model


class Judge:
    """Models by language, the subjects, and the thresholds (sentences, share) from which a subject is accepted."""

    def __init__(self, models: dict[int, SubjectModels], names: list[str], least: float = 1.5, share: float = 0.15):
        self.models, self.names, self.least, self.share = models, names, least, share

    def tallies(self, texts: Texts) -> np.ndarray:
        """Per text and subject, the expected number of its sentences. A text of no language that can be told is read in the one that
        knows most of its tokens; one of a language without labelled documents has no sentences about anything."""
        out = np.zeros((len(texts.lang), len(self.names)))
        if not self.models or not self.names:
            return out
        lang = texts.lang.copy()
        untold = np.flatnonzero((lang < 0) & (texts.sentences > 0))
        if len(untold):
            some, order = texts.chosen(untold), sorted(self.models, reverse=True)
            starts = some.tokens[:-1]
            lang[untold] = np.array(order)[np.stack([np.add.reduceat((self.models[x].grams.row[some.ids] >= 0).astype(int), starts) for x in order]).argmax(axis=0)]
        for x, model in self.models.items():
            which = np.flatnonzero((lang == x) & (texts.sentences > 0))
            if len(which):
                some = texts.chosen(which)
                out[which] = shares(model.evidence(some), some.sentences)
        return out

    def accepted(self, n: np.ndarray, least: float | None = None, share: float | None = None) -> np.ndarray:
        """The subjects that make up the matter: of at least ``least`` sentences (or all there are) and this share."""
        least, share = least or self.least, share or self.share
        total = n.sum(axis=1, keepdims=True)
        return (n >= np.minimum(least, np.maximum(0.8, 0.7 * total))) & (n >= share * total) & (n > 0.5)


_ENCODED = "doc_id string, lang int, ids array<int>, lengths array<int>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


def _encoded(documents: DataFrame, vocabulary) -> DataFrame:
    """Each text as numbers; texts are read once."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            held, docs, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append(parts(text))
                docs.append(doc)
                size += len(held[-1])
                if size > BATCH_WORDS:
                    yield out(docs, Texts.read(held, words))
                    held, docs, size = [], [], 0
            if held:
                yield out(docs, Texts.read(held, words))

    def out(docs: list, texts: Texts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.string()), pa.array(texts.lang, pa.int32()), _lists(texts.ids, texts.tokens), _lists(texts.lengths, texts.first)],
            names=["doc_id", "lang", "ids", "lengths"])

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text IS NOT NULL")
    return materialise(rows.mapInArrow(encode, _ENCODED), "p7-encoded")


def _texts(batch: pa.RecordBatch) -> Texts:
    ids, lengths = batch.column("ids"), batch.column("lengths")
    return Texts(
        ids.flatten().to_numpy(zero_copy_only=False), lengths.flatten().to_numpy(zero_copy_only=False),
        lengths.value_lengths().to_numpy(zero_copy_only=False), batch.column("lang").to_numpy(zero_copy_only=False))


def _labelled(documents: DataFrame, labels: DataFrame, names: list[str]) -> list[tuple[str, list[str]]]:
    """Texts and labels of the sample that models are fitted on, at most ``MAX_LABELLED``."""
    votes = labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    named = F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2))
    pool = documents.where("text IS NOT NULL").select("doc_id", named.alias("_lang"), F.octet_length("text").alias("_size")).join(votes, "doc_id")
    pool = materialise(pool.withColumn("_order", unit_hash(F.lit("labelled"), F.col("doc_id"))), "p7-labelled")
    counts = pool.groupBy("_lang").agg(F.count("*").alias("_n"))
    # a threshold on the hash lets a little more through than is wanted; nothing is ranked, whatever a language holds
    near = pool.join(counts, "_lang").where(F.col("_order") * F.col("_n") <= 1.2 * MAX_OF_LANG + 50).orderBy("_order", "doc_id").limit(MAX_LABELLED * 5 // 4)
    picked: dict[int, list[str]] = {}
    of_lang: dict[str, int] = {}
    held = 0
    for r in near.collect():
        if len(picked) < MAX_LABELLED and r["doc_id"] not in picked and held + r["_size"] <= MAX_BYTES and of_lang.get(r["_lang"], 0) < MAX_OF_LANG:
            picked[r["doc_id"]] = list(r["labels"])
            of_lang[r["_lang"]] = of_lang.get(r["_lang"], 0) + 1
            held += r["_size"]
    sample = documents.sparkSession.createDataFrame(list(picked.items()), "doc_id long, labels array<string>")
    rows = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").collect()
    return [(r["text"], r["labels"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[Judge, DataFrame]:
    """The judge, and the documents as numbers for :meth:`Judge.tallies`."""
    names = sorted(r["subject"] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    number = {s: i for i, s in enumerate(names)}
    sample = _labelled(documents, labels, names)
    read = [parts(text) for text, _ in sample]
    words = Vocabulary.of(read)
    texts = Texts.read(read, words)
    own = np.zeros((len(sample), len(names)), bool)
    for i, (_, given) in enumerate(sample):
        own[i, [number[x] for x in given]] = True
    spark = documents.sparkSession
    encoded = _encoded(documents, spark.sparkContext.broadcast(words))
    of = {x: np.flatnonzero((texts.lang == x) & (texts.sentences > 0)) for x in sorted(set(texts.lang.tolist()) - {-1})}
    grams = {x: Grams(texts.chosen(which), words) for x, which in of.items()}
    known = spark.sparkContext.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = {x: np.zeros(g.size + 1, np.int64) for x, g in known.value.items()}
        for batch in batches:
            for every in _texts(batch).slices():
                for x, g in known.value.items():
                    token, pair = g.places(every.chosen(np.flatnonzero(every.lang == x)))
                    tally[x] += np.concatenate([np.bincount(token[token >= 0], minlength=g.tokens), np.bincount(pair[pair >= 0], minlength=len(g.pairs)), [len(token)]])
        for x, n in tally.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "at", "n"])

    # one row per n-gram of the labelled sample at most comes to the driver; the counts are of all documents
    counts = encoded.select("lang", "ids", "lengths").mapInArrow(count, "lang int, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    bg = {x: np.zeros(g.size + 1) for x, g in grams.items()}
    for x, rows in counts.groupby("lang"):
        bg[x][rows["at"].to_numpy()] = rows["n"].to_numpy()

    def trained(which: np.ndarray) -> dict[int, SubjectModels]:
        """A model of each language, from those labelled documents."""
        inside = {x: np.intersect1d(n, which) for x, n in of.items()}
        return {x: _train(texts.chosen(n), own[n], grams[x], bg[x][:-1], bg[x][-1]) for x, n in inside.items() if len(n)}

    every = np.arange(len(sample))
    judge = Judge(trained(every[every % 3 > 0]), names)
    held = every[::3]
    n = judge.tallies(texts.chosen(held)) if len(held) else np.zeros((0, len(names)))
    best = (-1.0, judge.least, judge.share)
    for least in (1.5, 1.3, 1.7, 2.5):
        for share in (0.15, 0.1, 0.12, 0.2, 0.25, 0.3):
            got = judge.accepted(n, least, share)
            f1 = 2 * (got & own[held]).sum() / max(1, got.sum() + own[held].sum())
            if f1 > best[0] + 0.002:
                best = (f1, least, share)
    return Judge(trained(every), names, *best[1:]), encoded


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id``, ``subject``, ``sentences``, ``share``: the subjects that make up the matter of each document.

    NULL, empty and blank texts, and texts no sentence of which is about a subject, have no row. Repeated labels count
    once, labels of unknown subjects or documents not at all; without labels nothing is found. Texts are read whole,
    documents without an id come out with a NULL one. ``share`` is that of the sentences about any subject.
    """
    judge, encoded = fit(documents, labels, subjects)
    known = documents.sparkSession.sparkContext.broadcast(judge)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tallied = [known.value.tallies(some) for some in _texts(batch).slices()]
            n = np.concatenate(tallied) if tallied else np.zeros((0, len(known.value.names)))
            doc, subject = np.nonzero(known.value.accepted(n))
            found = n[doc, subject]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array([known.value.names[i] for i in subject], pa.string()), pa.array(found, pa.float64()), pa.array(found / n.sum(axis=1)[doc], pa.float64())],
                names=["doc_id", "subject", "sentences", "share"])

    found = encoded.mapInArrow(decide, "doc_id string, subject string, sentences double, share double")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
