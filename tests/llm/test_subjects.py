import random

import pytest

from spanloom.llm import subjects as S

NOUNS = {
    "en": {"law": "court judge trial witness verdict clause".split(), "sport": "goal match racket referee medal lap".split(), "music": "violin chord melody drummer choir tempo".split()},
    "de": {"law": "Gericht Richterin Klage Vertrag Zeugin Urteil".split(), "sport": "Tor Spiel Schläger Medaille Runde Aufschlag".split(), "music": "Geige Akkord Melodie Chor Takt Klavier".split()},
}
SAYS = {"en": "Without the {}, we hear, there would be no {}.", "de": "Danach geht es lange um die {} und das {}."}
REMARKS = {"en": ["The picture is steady and the sound is clear.", "Please keep the end time inside the recording."], "de": ["Ton und Bild sind sauber und die Ansicht wechselt nicht.", "Der Ausschnitt beginnt mit einem leeren Bild."]}


def document(rng):
    lang = rng.choice(["en", "de"])
    own = rng.sample(sorted(NOUNS["en"]), rng.choice([0, 1, 1, 1, 2]))
    out = [SAYS[lang].format(*rng.sample(NOUNS[lang][s], 2)) for s in own for _ in range(4)]
    others = [s for s in NOUNS["en"] if s not in own]
    if own and rng.random() < 0.4:
        out.append(SAYS[lang].format(*rng.sample(NOUNS[lang][rng.choice(others)], 2)))  # a remark in passing
    out += [rng.choice(REMARKS[lang]) for _ in range(3)]
    rng.shuffle(out)
    return " ".join(out), set(own)


def test_held_out(spark):
    rng = random.Random(5)
    docs = [(i, *document(rng)) for i in range(1200)]
    texts = [(i, t, None, "x", 1) for i, t, _ in docs] + [(5000, None, "en", "x", 1), (5001, "", "en", "x", 1), (5002, " \n", None, "x", 1), (5003, "[rank0] step 116 reward=0.87\n" * 50, "en", "x", 1), (5004, "word " * 50_000, "en", "x", 1)]
    labels = [(i, rng.choice(sorted(NOUNS["en"])) if rng.random() < 0.05 else s, "r") for i, _, own in docs[:600] for s in own]
    labels += labels[:50] + [(None, "law", "r"), (3, None, "r"), (4, "unknown", None), (99999, "law", "r")]
    documents = spark.createDataFrame(texts, "doc_id long, text string, lang string, subject string, labels int")
    args = (spark.createDataFrame(labels, "doc_id long, subject string, rater string"), spark.createDataFrame([(s, s, s) for s in NOUNS["en"]], "subject string, title string, scope string"))
    got = {}
    for r in S.subject_areas(documents, *args).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    hits = sum(got.get(i, set()) == own for i, _, own in docs[600:])
    assert hits >= 0.93 * 600
    assert not set(got) & {5000, 5001, 5002, 5003, 5004}
    assert S.subject_areas(documents.where("false"), *args).count() == 0
    assert S.subject_areas(documents, args[0].where("false"), args[1]).count() == 0


def test_too_many_subjects_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_SUBJECTS", 2)
    docs = spark.createDataFrame([(1, "a text", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, "law")], "doc_id long, subject string")
    with pytest.raises(ValueError, match="subjects"):
        S.fit(docs, labels, spark.createDataFrame([("law",), ("sport",), ("music",)], "subject string"))


def test_slices_and_blocks_change_nothing(monkeypatch):
    rng = random.Random(3)
    read = [S.parts(document(rng)[0]) for _ in range(60)] + [[], S.parts("court " * 700)]
    words = S.Vocabulary.of(read[:40])
    texts = S.Texts.read(read, words)
    own = S.np.zeros((len(read), 2), bool)
    own[:, 0] = True
    english = S.np.flatnonzero((texts.lang == S.LANGUAGES.index("en")) & (texts.sentences > 0))
    grams = S.Grams(texts.chosen(english), words)
    model = S._train(texts.chosen(english), own[english], grams, S.np.ones(grams.size), 1000.0)
    judge = S.Judge({S.LANGUAGES.index("en"): model}, ["law", "sport"])
    whole = judge.tallies(texts)
    assert len(list(texts.slices())) == 1
    monkeypatch.setattr(S, "BATCH_WORDS", 100)
    monkeypatch.setattr(S, "BLOCK_WORDS", 7)
    slices = list(texts.slices())
    assert len(slices) > 5 and sum(len(t.lang) for t in slices) == len(read) and sum(len(t.ids) for t in slices) == len(texts.ids)
    assert S.np.allclose(S.np.concatenate([judge.tallies(t) for t in slices]), whole, atol=1e-4)
