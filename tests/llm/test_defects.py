import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import defects as D

EN = '<video>Find the moment "a cook with grey gloves gently drops the heavy pillow behind the stage and then calmly bows" in this recording. Reply with its time range between <answer> and </answer>.'
EX = "<video>In which part does a cook with grey gloves gently drop the heavy pillow? Give the seconds inside <answer> tags, for instance <answer> 4.5 to 9.0 </answer>."
FR = "<video>À quel moment voit-on ceci : un serveur essuie le miroir près du four ? Indique le début et la fin en secondes."
MC = '<video>Which option fits the moment "a cook drops the heavy pillow behind the stage and bows"?\nA. the torn jar\nB. the empty blanket'
QA = '<video>At the time when "a cook drops the heavy pillow behind the stage and bows", which thing is closest to the camera? Answer in a few words.'
EVENT = "a cook with grey gloves gently drops the heavy pillow behind the stage and then calmly bows"

CASES = [
    (EN, "<answer> 1.0 to 2.5 </answer>", "span", None), (EN, "It starts at 1.2 s and is over at 3.4 s.", "span", None), (EN, "1.2 - 3.4", "span", None),
    (EN, "I cannot be fully certain, but it is <answer>from 00:13 to 00:14</answer>", "span", None), (EN, "<think>Somebody refuses to move.</think>\n<answer>{\"time\": [1, 2]}</answer>", "span", None),
    (EN, EVENT + " - <answer> 2.0 to 3.0 </answer>", "span", None), (FR, "Cela se passe de 7.2 à 8.8 secondes.", "span", None), (MC, "B", "letter", None), (MC, "the torn jar", "letter", None),
    (QA, "a torn jar near the gate", "phrase", None), (QA, 'The wall says "Ausgang nur links", which does not matter. <answer>a torn jar</answer>', "phrase", None),
    (EN, None, "span", "empty"), (EN, "", "span", "empty"), (EN, " \n\t\u200b", "span", "empty"), (EN, "<think></think><answer> </answer>", "span", "empty"), (EN, "<answer>{}</answer>", "span", "empty"), (EN, "...", "span", "empty"),
    (EN, "<answer> 1.0 to 2.5", "span", "truncated"), (EN, "<answer> 4.1 to 6.5 </ans", "span", "truncated"), (EN, "<think>It begins at 3 s and", "span", "truncated"), (EN, "The last frames show the result. The event happens fr", "span", "truncated"),
    (EN, "45.6 to ", "span", "truncated"), (EN, '<answer>{"time": [10.9, ', "span", "truncated"), (QA, "<think>Fine.</think>\nThis take", "phrase", "truncated"),
    (EN, "I'm sorry, but I can't help with that.", "span", "refusal"), (EN, "<answer>declined</answer>", "span", "refusal"), (EN, "Withuot being able to see the footage, I can't say anything about it.", "span", "refusal"),
    (FR, "Je n'ai pas accès à la vidéo.", "span", "refusal"), (QA, "I won't identify what this person is doing.", "phrase", "refusal"), (EN, "annotator declined to label this clip", "span", "refusal"),
    (EN, EVENT, "span", "copied_question"), (EN, EVENT.upper(), "span", "copied_question"), (EN, EN, "span", "copied_question"), (EX, EX, "span", "copied_question"), (MC, MC.replace("<video>", ""), "letter", "copied_question"),
    (EN, "<answer> " + EVENT + " </answer>", "span", "copied_question"), (EN, "The question is: " + EVENT.replace("heavy", "heavvy"), "span", "copied_question"),
    (EN, "<think>Die Kamera bewegt sich kurz, aber die Szene bleibt gleich.</think>\n<answer> 1.0 to 2.0 </answer>", "span", "other_language"), (QA, "<answer>ein blauer Eimer neben der Treppe</answer>", "phrase", "other_language"),
    (QA, "<answer>楼梯旁边的蓝色水桶</answer>", "phrase", "other_language"), (FR, "Die beschriebene Handlung beginnt wohl kurz danach. 3.0 - 4.0", "span", "other_language"),
    # answers in words, and complete sentences that are neither an answer of a known form nor a refusal
    (EN, "It begins around three seconds and is over by nine seconds.", "span", None), (EN, "From two to five seconds.", "span", None), (FR, "De trois à neuf secondes.", "span", None), (EN, "The pillow lands near the stage.", "span", None),
    # refusals by words that no list of phrases has
    (EN, "Sorry, this clip is beyond me.", "span", "refusal"), (EN, "That is nothing I would ever comment on.", "span", "refusal"), (EN, "Regrettably this is nothing for us.", "span", "refusal"), (EN, "I would rathher not say.", "span", "refusal"),
    (EN, "Não posso responder a esta pergunta.", "span", "refusal"), (EN, "Infelizmente isto fica sem resposta.", "span", "refusal"), (EN, "Daar kan ik niet op antwoorden.", "span", "refusal"), (EN, "Helaas blijft dit zonder antwoord.", "span", "refusal"),
    (EN, "申し訳ありませんが、お答えできません。", "span", "refusal"), (EN, "Niestety nie mogę odpowiedzieć.", "span", "refusal"), (EN, "К сожалению, я не могу ответить.", "span", "refusal"),
    # complete answers in further languages
    (EN, "Zdarzenie trwa od 3 do 9 sekund.", "span", "other_language"), (EN, "Это событие длится с 3 до 9 секунд.", "span", "other_language"), (EN, "O evento começa depois e vai de 3 até 9 segundos.", "span", "other_language"),
    (EN, "De gebeurtenis is van 3 tot 9 seconden.", "span", "other_language"), (EN, "その出来事は3秒から9秒までです。", "span", "other_language"),
]


@pytest.mark.parametrize("problem,text,kind,want", CASES)
def test_case(problem, text, kind, want):
    assert D.defect(problem, text, None, None, kind) == want


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        prompt = [rng.choice("abcde") for _ in range(rng.randint(0, 30))]
        said = [rng.choice("abcdef") for _ in range(rng.randint(1, 20))]
        runs = {tuple(prompt[i : i + 3]) for i in range(len(prompt) - 2)}
        covered = {j for i in range(len(said) - 2) if tuple(said[i : i + 3]) in runs for j in range(i, i + 3)}
        assert D.PromptAutomaton(prompt).covered(said) == len(covered) / len(said)


def test_operator(spark):
    rows = [(i, "run", p, t, t, 5 if i % 2 else None, "clash", 1) for i, (p, t, _, _) in enumerate(CASES)]
    rows += rows[:5] + [(None, "none", None, None, None, None, "clash", 1), (900, None, None, "x" * 200_000, "<answer> 1 to 2 </answer>", None, None, None)]
    df = spark.createDataFrame(rows, "rollout_id long, run_tag string, problem string, response string, ground_truth string, response_length int, kind string, limit int")
    runs = spark.createDataFrame([("run", 256), (None, 3)], "run_tag string, max_response_length int")
    got = {(r.rollout_id, r.field): r.defect for r in D.defective_fields(df, runs, F.lit("unknown")).collect()}
    for i, (p, t, kind, want) in enumerate(CASES):
        if kind != "letter":
            assert got.get((i, "response")) == want, (p, t)
    assert got[None, "response"] == "empty" and (900, "response") in got and (900, "ground_truth") not in got
    assert D.defective_fields(df.where("false"), runs, F.lit("unknown")).count() == 0
