import os
import random
from collections import defaultdict

import pytest

from spanloom.llm import cross_split as X
from spanloom.llm import queries as Q

SCHEMA = "record_id long, split string, problem string, entities array<string>, id long, text string, block int"
WHO = ["a cook with grey gloves", "a dancer in a striped coat", "a porter in rolled-up sleeves", "an old man"]
DOES = ["carefully folds the rusty rope behind the desk", "twice drops the blue pillow near the gate", "hastily wipes the shiny mirror past the oven", "gently rolls the empty crate below the shelf"]
ENDS = ["and finally bows until the music returns", "and then calmly waves after the lamp starts", "smiles and shrugs while the alarm is out of view"]
AROUND = ["<video>Find the moment \"{}\" in this recording. Reply in seconds.", "<video>Locate the clip: {}", "<video>{}. When does this take place?"]


def events():
    return [f"{a} {b} {c}" for a in WHO for b in DOES for c in ENDS]


def changed(rng, text):
    words = text.split()
    k = rng.choice(["same", "typo", "case", "filler", "clause", "letters", "blanks"])
    if k == "typo":
        i = max(range(len(words)), key=lambda i: len(words[i]) * rng.random())
        words[i] = words[i][:2] + words[i][1] + words[i][2:]
    if k == "case":
        words = [w.upper() for w in words]
    if k == "filler":
        words.insert(rng.randint(1, len(words) - 1), "really")
    if k == "letters":
        words = [w.replace("o", "о") for w in words]
    out = ("  " if k == "blanks" else " ").join(words)
    return out.replace(" and ", " & ") if k == "clause" else out


def records(seed=1, n=260):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        e = rng.randrange(len(events()))
        v = ["hot"] if rng.random() < 0.5 else [f"v{rng.randint(0, 8)}"]
        v += [f"v{rng.randint(0, 8)}"] if rng.random() < 0.1 else []
        out.append((i, rng.choice(["train", "train", "val", "test", "other"]), e, rng.choice(AROUND).format(changed(rng, events()[e])), v))
    return out


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 20)  # the hot entity is partitioned by shingles, and its frequent shingles by blocks
    data = records()
    want = {(a[0], b[0]) for a in data for b in data if a[1] in ("val", "test") and b[1] == "train" and a[2] == b[2] and set(a[4]) & set(b[4])}
    df = spark.createDataFrame([(i, s, p, v, 0, "x", 1) for i, s, _, p, v in data], SCHEMA)
    got = [(r.evaluation_id, r.training_id) for r in X.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_odd_rows(spark):
    text = AROUND[0].format(events()[0])
    rows = [
        (1, "train", text, ["v"]), (2, "val", text, ["v"]), (3, "val", text, ["w"]), (4, "val", None, ["v"]), (5, "test", "", ["v"]), (6, "test", text, None), (7, "test", text, []),
        (8, None, text, ["v"]), (9, "val", "<video>", ["v"]), (10, "val", text + " word" * 20000, ["v"]), (None, "val", text, ["v"]), (11, "train", "short one", ["v"]), (12, "val", "short one", ["v"]),
    ]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    assert {(r.evaluation_id, r.training_id) for r in X.overlaps(df).collect()} == {(2, 1), (10, 1), (12, 11)}  # 10 asks for the same, with more words after it
    assert X.overlaps(df.where("false")).count() == 0


def test_other_events_of_one_video(spark):
    rows = [(1, "train", AROUND[0].format(events()[0]), ["v"], 0, "", 0), (2, "val", AROUND[0].format(events()[1]), ["v"], 0, "", 0), (3, "test", AROUND[1].format(events()[40]), ["v"], 0, "", 0)]
    assert X.overlaps(spark.createDataFrame(rows, SCHEMA)).count() == 0


FRENCH = "<video>À quel moment voit-on ceci : {} ? Indique le début et la fin en secondes."


def test_events_shorter_than_their_instruction(spark):
    who, does = ["la vendeuse", "un cycliste", "le gardien", "une peintre", "deux élèves"], ["jette l'éponge", "pose le seau", "ouvre la caisse", "attache la corde", "roule le tapis"]
    short = [f"{a} {b} devant le garage" for a in who for b in does]
    rows = [(i, "train" if i % 2 else "val", FRENCH.format(e), ["v"]) for i, e in enumerate(short)]
    rows += [(100, "test", f"<video>Combien de temps dure ce moment de la vidéo que tu viens de voir : {short[1]} ?", ["v"]), (101, "val", FRENCH.format(short[3]), ["v"]), (102, "test", FRENCH.replace("secondes", "secnodes").format(short[4]), ["v"])]
    # two events in one text: all of them are compared, an event beside another one in each text is no case
    rows += [(103, "train", FRENCH.format(f"{short[6]}. Puis {events()[0]}"), ["w"]), (104, "val", AROUND[1].format(events()[0]), ["w"]), (105, "test", f"<video>{events()[5]}; {events()[0]}", ["w"])]
    got = {(r.evaluation_id, r.training_id) for r in X.overlaps(spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)).collect()}
    assert got == {(100, 1), (101, 3), (104, 103)}


def test_instructions_stand_beside_many_events(spark):
    rows = [(FRENCH.format(f"{a} {b}"),) for a in WHO for b in DOES * 2 for b in (b, b + " again")] + [(AROUND[1].format(WHO[0]),)] * 50
    found = X.instructions(spark.createDataFrame(rows, "problem string"))
    assert "indique le début et la fin en secondes" in found and "indique le début et la fin en secnodes" in found
    assert "locate the clip" not in found and "a cook with grey gloves" not in found
    text = FRENCH.format("elle dort") + "\nA. the tiny plank\nB. the rusty blanket"
    assert X.asked_for(text, found) == "elle dort" and X.asked_for("<video>Indique le début et la fin en secondes.", found)


def test_a_misspelt_word_in_the_middle_of_a_short_event(spark):
    words = "nine girls quietly paint their wooden bench near home"
    rows = [(1, "train", "<video>" + words, ["v"]), (2, "val", "<video>" + words.replace("their", "thier"), ["v"]), (3, "val", "<video>" + words.replace("their", "seven"), ["v"])]
    rows += [(4, "train", f"<video>{words} before the old clock on the tower strikes midnight again", ["v"]), (5, "test", "<video>" + words.replace("their", "theirr"), ["w"])]
    got = {(r.evaluation_id, r.training_id) for r in X.overlaps(spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)).collect()}
    assert got == {(2, 1), (2, 4)}


def test_three_misspelt_words_of_eight(spark):
    words, wrong = "nine girls quietly paint wooden benches near home", "nine grils quietly piant wooden bencehs near home"
    rows = [(1, "train", "<video>" + words, ["v"]), (2, "val", "<video>" + wrong, ["v"]), (3, "val", "<video>nine birds quickly carry golden beads near home", ["v"])]
    got = {(r.evaluation_id, r.training_id) for r in X.overlaps(spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)).collect()}
    assert got == {(2, 1)}


def test_misspellings_share_a_group():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    numbers = {w: n for n, w in enumerate(dict.fromkeys(words))}
    group = X._spellings(numbers)
    assert all(group[numbers[a]] == group[numbers[b]] for a in numbers for b in numbers if X._typo(a, b))


def pairs_of(spark, rows):
    return {(r.evaluation_id, r.training_id) for r in X.overlaps(spark.createDataFrame([(*r, ["v"], 0, "x", 1) for r in rows], SCHEMA)).collect()}


def test_asked_in_columns_as_in_python(spark):
    """Nothing but choices, nothing but instructions, misspelt instructions, blanks, and many events."""
    around = X.Instructions(["indique le début et la fin en secondes", "return", "locate the clip"])
    texts = ["A. the tiny plank\nB. the rusty blanket", "Return", "Retrun. " + events()[0], "", " ?!", FRENCH.format("elle dort"), "Locate the clip: x.\nA. one\nB. two", "Locate the clip:\nA. one\nB. two", "Locate the clip.", *events()[:9]]
    df = spark.createDataFrame([(t,) for t in texts], "problem string").select("problem", X._read("problem").alias("read"))
    got = {r.problem: r.asked for r in df.select("problem", X._asked(X.F.col("read"), around).alias("asked")).collect()}
    assert got == {t: X.asked_for(t, around) for t in texts}
    assert got[texts[2]] == events()[0] and got[texts[7]] == "a one b two"


def test_events_beside_the_same_long_passage(spark):
    """No table is large enough here to tell which passages are instructions."""
    ask = "<video>Please watch the whole recording carefully and find the start and end of the following event in seconds: "
    first = "A cook with grey gloves carefully folds the rusty rope behind the desk and finally bows. "
    rows = [(1, "train", ask + "a dog runs"), (2, "val", ask + "two men shake hands"), (3, "train", first + "Then an old man waves."), (4, "val", first + "Then the lamp breaks down.")]
    side = "a dancer in a striped coat twice drops the blue pillow near the gate and bows to the {} side of the stage"
    rows += [(5, "train", side.format("left")), (6, "test", side.format("right")), (7, "test", side.format("lefft"))]
    assert pairs_of(spark, rows) == {(7, 5)}


def test_what_is_sent_of_a_hot_entity_grows_with_its_records(spark):
    rng = random.Random(5)
    made = [f"{a} number{rng.randrange(400)} {b} tool{rng.randrange(400)} {c} at{rng.randrange(400)}" for a in WHO for b in DOES for c in ENDS for _ in range(20)]
    rng.shuffle(made)
    hot = spark.createDataFrame([("v",)], "entity string")
    sent = []
    for n in (300, 900):
        rows = spark.createDataFrame([(i, i % 3 == 0, "v", t) for i, t in enumerate(made[:n])], "id long, evaluation boolean, entity string, text string")
        sent.append(X._sent(X._different(rows.join(hot, "entity"))).count())
    assert 2.7 * sent[0] < sent[1] < 3.3 * sent[0]


@pytest.mark.parametrize("block", [6000, 150])
def test_recall_against_all_pairs_of_the_records(spark, monkeypatch, block):
    """Evaluation records whose id is divisible by 20 against all training records of their videos; with a small block the hot
    video is partitioned by shingles."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no such tables")
    monkeypatch.setattr(X, "BLOCK", block)
    df = Q._p2(spark, folder)
    rows = [r for r in df.collect() if r.problem is not None and r.split in ("train", "val", "test")]
    around = X.instructions(df)
    words = {r.record_id: frozenset(X.asked_for(r.problem, around).split()) for r in rows}
    training = defaultdict(set)
    for r in rows:
        if r.split == "train":
            for v in r.entities:
                training[v].add(r.record_id)
    asked = [r for r in rows if r.split != "train" and r.record_id % 20 == 0]
    want = {(r.record_id, t) for r in asked for v in r.entities for t in training[v] if X.same_request(words[r.record_id], words[t]) >= X.SIMILAR}
    got = {(r.evaluation_id, r.training_id) for r in X.overlaps(df).collect()}
    assert len(want) >= 5 and len(want & got) >= 0.95 * len(want)
    every = {r.record_id for r in asked}
    assert {p for p in got if p[0] in every} <= want


def made_of_common_words(rng, n):
    """Texts of 1 to 40 words, most of them very common, with every second other word misspelt in each second text."""
    rare = ["".join(rng.choice("bdfglmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    between = ["in the", "as a", "of the", "and then", "with one"]
    bases = [[w for _ in range(k) for w in (rng.choice(rare), *rng.choice(between).split(" "))] for k in (2, 3, 4, 5, 7, 9, 13) for _ in range(n)] + [[rng.choice(rare)] for _ in range(n)]
    for words in bases:
        yield words
        yield [w[:2] + w[1:] if i % 6 == 0 and len(w) == 8 else w for i, w in enumerate(words)]


@pytest.mark.parametrize("times", [24, 0])
def test_a_hot_entity_gives_the_pairs_of_one_that_is_compared_at_once(spark, monkeypatch, times):
    rng = random.Random(7)
    texts = [" ".join(words) for words in made_of_common_words(rng, 12)]
    rows = [(i, rng.choice(["train", "val"]), t, ["hot"], 0, "x", 1) for i, t in enumerate(texts + rng.sample(texts, 40))]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in X.overlaps(df).collect()}
    monkeypatch.setattr(X, "BLOCK", 25)  # the common shingles are cut into blocks, too
    monkeypatch.setattr(X, "TIMES", times, raising=False)
    got = [tuple(r) for r in X.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
