"""Problem 4: broken prompt and response pairs.

Each field is read once: a delimiter stack tells whether tags, brackets and quotes are closed; what is left when
reasoning is taken out is matched with the forms of an answer; without an answer, a suffix automaton of the prompt
measures how much of the field is copied from it, and an automaton of refusal phrases looks for refusals; the
language of the free text is voted by stopwords. Fields that are nothing but a complete bare answer never leave the
JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cross_split import _typo

# Phrases by which an answer is declined, in lower case, apostrophes as '.
REFUSALS = """
i can't help | i cannot help | can't help with | help with that | i'm sorry, but | i am sorry, but | sorry, but i can't | sorry, no answer | no answer can be
answer can be provided | for this kind of question | unable to answer | cannot answer | can't answer | won't answer | will not answer | don't answer
do not answer | decline to | to decline | i have to decline | must decline | request declined | declined to | declined | refused to | reviewer refused | refuse to answer
refuse to label | not labelled | not labeled | no label given | no label | can't annotate | cannot annotate | unable to annotate | can't label | cannot label | unable to label
would rather not | rather not say | cannot comply | can't comply | unable to comply | my guidelines | guidelines do not | do not allow me | don't allow me | not allow me to
against the rules | rules i follow | leave it unanswered | must respectfully | respectfully pass | pass on this | not permitted | i am permitted | am permitted to | nothing i am
outside of what i | what i can do | rather not comment | i'd rather not | apologies - | apologies, | isn't possible for me | not possible for me | process the attached | describe it in words
text model | no access to | not able to watch | able to watch | cannot watch | can't watch | so i cannot give | cannot give a | can't give a | without being able | able to see the footage | can't say anything | cannot say anything
won't identify | will not identify | can't identify | cannot identify | what this person is doing | ask a human | human annotator | do not judge | don't judge
surveillance material | questions on surveillance | not something i | something i take part | watching people is | talk about something | something else instead | let's talk | unfortunately this request
as an ai | language model | on request of the
kann ich nicht | ich kann nicht | kann die frage nicht | nicht beantworten | keinen zugriff | zugriff auf das video | tut mir leid | es tut mir | leider kann | darf ich nicht | möchte ich nicht | verweigere | nicht weiterhelfen | lehne ich ab | leider ablehnen | muss ich ablehnen | sage ich nichts | dazu sage ich
je ne peux pas | ne peux pas | ne puis | pas accès | accès à la vidéo | je n'ai pas accès | désolé | je regrette | refuse de | ne suis pas en mesure | ne peux répondre | répondre à cette | refuse de répondre | je préfère ne pas | je dois refuser
no puedo | no tengo acceso | acceso al vídeo | lo siento | no me es posible | no estoy en condiciones | puedo responder | me niego | prefiero no | debo rechazar | no voy a responder
non posso | mi dispiace | non ho accesso
无法回答 | 无法观看 | 不能回答 | 抱歉 | 对不起 | 无法访问 | 我不能 | 无法
não posso | não consigo | não vou responder | não quero responder | não me é possível | prefiro não | recuso-me | me recuso | sem acesso ao vídeo
kan ik niet | ik kan niet | ik kan deze | mag ik niet | wil ik niet | ik weiger | geen toegang | ik geef hier geen | niet beantwoorden | liever niet
nie mogę | nie jestem w stanie | nie odpowiem | odmawiam | nie mam dostępu | wolę nie
не могу | не буду отвечать | отказываюсь | нет доступа | не имею доступа | предпочитаю не
お答えできません | 答えられません | できません | お断りします | 申し訳ありません | 申し訳ございません | 답변할 수 없습니다 | 죄송합니다 | 할 수 없습니다
""".replace("\n", "|")

# Words of regret or inability, and, by language, those that deny and those by which speakers mean themselves.
REGRET = """sorry apologies apologise apologize unfortunately regret afraid refuse refusing decline declining unable leider verweigere ablehnen désolé désolée regrette malheureusement
lamento lamentablemente desafortunadamente desculpe desculpa infelizmente helaas spijt weiger spiacente purtroppo rifiuto przykro przepraszam niestety odmawiam извините простите сожалению отказываюсь"""
DENIAL = {
    "en": "not no never nothing cannot can't won't don't couldn't wouldn't shouldn't isn't i'd | i me my we us our",
    "de": "nicht kein keine keinen nichts | ich mir mich mein wir uns", "fr": "ne pas n'ai aucun aucune rien | je j'ai me moi mon nous", "es": "no nada ningún ninguna | yo me mi puedo quiero debo voy tengo",
    "it": "non nessun nessuna niente | io mi posso voglio ho devo", "pt": "não nada nenhum nenhuma | eu me meu posso quero vou tenho", "nl": "niet geen niets | ik mij me mijn wij",
    "pl": "nie nic | ja mi mogę chcę mam", "ru": "не нет ничего | я мне могу хочу мы",
}

# Frequent words by language.
STOPWORDS = {
    "en": "the a an of and to in is it that with as at by from for on this be not no which but only so one somebody nothing again there first last then i my me can are was has before after near beside behind below front left right between seconds does any",
    "de": "der die das ein eine einen einem einer und ist nicht zu im in den dem mit von vor nach bei aus auf wieder nur sonst ich es sich wird kommt bis geschieht neben hinter unter etwa deshalb genau diesen wohl kurz kein keine dies hier ins zum zur am",
    "fr": "le la les un une des du de et est ne pas dans que qui se sur au aux ce cette je il elle donc après vers avec devant derrière près passe seconde secondes même mais rien juste ceci sans quelqu'un l'enregistrement depuis reste entre d'autre jusqu'à",
    "es": "el la los las un una unos de del y es no en que se por con al lo su este esta eso esto como para nada más pero después hacia alguien desde detrás delante junto cerca hasta segundo segundos va sigue igual tramo solo",
    "it": "il lo la gli le un una di del della e è non nei nel si in che da con per sul alla questo quindi soltanto verso dopo primi secondi qualcuno ma sempre niente altro davanti dietro vicino fino",
    "pt": "o os as um uma de do da e é não no na em que se por com ao mais mas depois até alguém segundo segundos apenas",
    "nl": "de het een en is niet van op te met voor bij na aan er ik dat die uit naar maar alleen iemand seconden",
    "pl": "jest się nie że od przez który która które oraz sekundy sekund sekundach po przed między ale tylko jak tam ktoś początek koniec zdarzenie trwa już potem jego jej przy pod nad",
    "ru": "и в не на что от до с это по как он она но из за у к секунды секунд секунде начало конец потом кто-то затем событие там только длится между",
}
# Number words up to twelve by language, those that mean something else in another left out.
NUMBERS = """zero one two three four five six seven eight nine ten eleven twelve | null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf
zéro _ deux trois quatre cinq _ sept huit neuf dix onze douze | cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce"""
_NUMBER = {w: str(n) for row in NUMBERS.replace("\n", "|").split("|") for n, w in enumerate(row.split()) if w != "_"}
_NUMBER_WORD = re.compile(r"\b(?:" + "|".join(_NUMBER) + r")\b", re.I)
_STOP: dict[str, list[str]] = {}
for _l, _ws in STOPWORDS.items():
    for _w in _ws.split():
        _STOP.setdefault(_w, []).append(_l)

NUM = r"[+-]?\d+(?:[.,]\d+)?"
TIME = rf"(?:\d+(?::\d\d){{1,2}}(?:\.\d+)?|{NUM})"
_UNIT = r"(?:\s*(?:s|sec|secs|seconds?|sekunden?|secondes?|segundos?|secondi|seconden|sekundy?|секунды?|秒)\b\.?)?"
_LINK = r"(?:to|and|until|till|bis|und|à|a|et|al|y|hasta|jusqu'à|e|até|ao|às|fino a|tot|en|do|i|до|и|から|到|至|-|–|—|~)"
#: A stretch between two times.
SPAN = re.compile(
    rf"(?<![\w.])(?:(?:seconds?|sekunde|seconde|segundo|la seconde|del segundo|第)\s*)?{TIME}{_UNIT}\s*,?\s*{_LINK}\s*(?:(?:is over (?:at|by)|ends? (?:at|by)|sekunde|la seconde|seconde|segundo|第)\s*)?{TIME}(?![\w:]|\.\d)", re.I
)
OVER = re.compile(rf"(?:starts?|begins?)\s+(?:at|around|about)\s+{TIME}.*?(?:over|ends?|stops?)\s+(?:(?:at|by|around)\s+)?{TIME}", re.I | re.S)
_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_ANSWER = re.compile(r"<answer>(.*?)</answer>", re.S | re.I)
_ANY_TAG = re.compile(r"</?[a-z]+>", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CJK = re.compile("[一-鿿぀-ヿ가-힯]")
_ENDS = tuple(".!?。！？…")
_LETTER = re.compile(r"\(?([A-Ha-h])\)?\.?")
_JSON_NUMBERS = re.compile(rf"\{{[^<>]*{NUM}[^<>]*{NUM}[^<>]*\}}|\[\s*{NUM}(?:\s*,\s*{NUM})+\s*\]", re.S)

#: Share of a field's words that copied stretches must cover, and the least words of such a stretch.
COPIED, STRETCH = 0.5, 3


class PromptAutomaton:
    """The suffix automaton of a sequence of words."""

    def __init__(self, words: list[str]):
        self.go: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.go)
            self.go.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.go[p]:
                self.go[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.go[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.go)
                    self.go.append(dict(self.go[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.go[p].get(w) == q:
                        self.go[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words: list[str], least: int = STRETCH) -> float:
        """The share of ``words`` that lies in stretches of ``least`` or more words of the sequence."""
        if not words:
            return 0.0
        marks, state, run = [0] * (len(words) + 1), 0, 0
        for i, w in enumerate(words):
            while state and w not in self.go[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.go[state]:
                state, run = self.go[state][w], run + 1
            else:
                run = 0
            if run >= least:
                marks[i - run + 1] += 1
                marks[i + 1] -= 1
        total = depth = 0
        for m in marks[:-1]:
            depth += m
            total += depth > 0
        return total / len(words)


@lru_cache(maxsize=1)
def _refusal_automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase in REFUSALS.split("|"):
        if phrase.strip():
            out.add_word(phrase.strip(), len(phrase.strip()))
    out.make_automaton()
    return out


def refuses(text: str) -> bool:
    """Whether a refusal phrase stands in the text at word boundaries."""
    text = text.lower().replace("’", "'")
    for end, n in _refusal_automaton().iter(text):
        before, after = text[end - n : end - n + 1], text[end + 1 : end + 2]
        if (not before.isalpha() or _CJK.match(text[end])) and (not after.isalpha() or _CJK.match(text[end])):
            return True
    return False


_CUES = frozenset(REGRET.split())
_DENIES = [(frozenset(a.split()), frozenset(b.split())) for a, b in (row.split("|") for row in DENIAL.values())]
_KANA, _HANGUL = re.compile("[぀-ヿ]"), re.compile("[가-힯]")


def declines(text: str) -> bool:
    """Whether a text that gives no answer speaks of regret, or denies something of its speaker, misspelt words too."""
    words = [w.replace("’", "'") for w in _WORD.findall(text.lower())]
    if any(w in _CUES or (len(w) > 4 and any(_typo(w, c) for c in _CUES)) for w in words):
        return True
    own = set(words)
    return any(own & denial and own & speaker for denial, speaker in _DENIES)


def language(text: str) -> str | None:
    """The language most words vote for; None when the votes are too few or tied."""
    return voted(_WORD.findall(text.lower().replace("’", "'")), "" if text.isascii() else "".join(_CJK.findall(text)))


def voted(words: list[str], cjk: str) -> str | None:
    """:func:`language` of words in lower case, and the Chinese, Japanese and Korean letters among them."""
    if len(cjk) >= 4 and len(cjk) > 2 * sum(not _CJK.search(w) for w in words):
        if len(_HANGUL.findall(cjk)) > len(cjk) / 2:
            return "ko"
        return "ja" if len(_KANA.findall(cjk)) > len(cjk) / 5 else "zh"
    votes: dict[str, float] = {}
    for w, n in Counter(words).items() if len(words) > 200 else ((w, 1) for w in words):
        for lang in _STOP.get(w, ()):
            votes[lang] = votes.get(lang, 0) + n / len(_STOP[w])
    if not votes:
        return None
    ranked = sorted(votes.items(), key=lambda kv: (-kv[1], kv[0]))
    if ranked[0][1] < 1 or (len(ranked) > 1 and ranked[0][1] < 1.2 * ranked[1][1]):
        return None
    return ranked[0][0]


def unclosed(text: str) -> bool:
    """Whether the text ends inside a tag, a bracket or an element of the delimiter stack."""
    stack: list[str] = []
    for m in re.finditer(r"<(/?)(think|answer)>|[\[{]|[\]}]", text, re.I):
        if m[2]:
            name = m[2].lower()
            if not m[1]:
                stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
        elif m[0] in "[{":
            stack.append(m[0])
        elif stack and stack[-1] == {"]": "[", "}": "{"}[m[0]]:
            stack.pop()
    return bool(stack) or re.search(r"<(?:/?[a-z]*)?$", text.rstrip(), re.I) is not None


def _blank(text: str) -> bool:
    return not any(unicodedata.category(c)[0] in "LN" for c in _ANY_TAG.sub(" ", text))


class _Prompt:
    """What is asked of a prompt; its automaton is built when a field without an answer needs it."""

    def __init__(self, problem: str):
        text = _ANY_TAG.sub(" ", problem)
        self.words = [w.lower() for w in _WORD.findall(text)]
        self.language = voted([w.replace("’", "'") for w in self.words], "" if text.isascii() else "".join(_CJK.findall(text)))
        self.options = [o.strip().lower() for o in re.findall(r"(?m)^\s*\(?[A-H][).]\s*(.+)$", text)] if "\n" in text else []

    @cached_property
    def automaton(self) -> PromptAutomaton:
        return PromptAutomaton(self.words)


_prompt = lru_cache(maxsize=4096)(_Prompt)


def _times(body: str) -> bool:
    """Whether two times stand in the text as a span, in digits or in words."""
    if SPAN.search(body) or OVER.search(body):
        return True
    if not _NUMBER_WORD.search(body):
        return False
    body = _NUMBER_WORD.sub(lambda m: _NUMBER[m[0].lower()], body)
    return bool(SPAN.search(body) or OVER.search(body))


def defect(problem: str | None, text: str | None, length: float | None, limit: float | None, by_kind: str | None = None) -> str | None:
    """The kind of defect of one field, or None. The first that holds of: empty, truncated, refusal, copied_question,
    other_language; a copied question or a refusal that breaks off is told by what it is. A complete field that is not
    recognised as an answer is no defect for that alone."""
    if text is None or _blank(text):
        return "empty"
    prompt = _prompt(problem or "")
    asked, options = prompt.language, prompt.options
    open_ = unclosed(text) and not _tag_of_prompt(text, problem or "")
    rest = _THINK.sub(" ", text)
    blocks = _ANSWER.findall(rest)
    final = blocks[-1] if blocks else None
    free = _ANY_TAG.sub(" ", text)
    outside = _ANY_TAG.sub(" ", rest).strip()
    if blocks and _blank(final) and _blank(_ANSWER.sub(" ", text)):
        return "empty"
    if blocks and len(final.strip()) > 3 and final.strip().lower() in (problem or "").lower():
        said = [w.lower() for w in _WORD.findall(outside)]
        if len(said) >= 6 and prompt.automaton.covered(said) >= 0.9:  # the example answer of the prompt is copied too
            return "copied_question"
    # an answer of some form: times, boxes or a letter, whatever was asked for, or a phrase where one was
    phrase_wanted = by_kind in ("phrase", "letter")
    answered = False
    if not open_:
        body = final if blocks else outside
        letter = bool(_LETTER.fullmatch(body.strip())) or body.lower().strip(" .\n") in options
        answered = letter or bool(_JSON_NUMBERS.search(body)) or _times(body)
        if answered and not blocks and not letter and not body.endswith(_ENDS) and not re.search(rf"(?:{TIME}{_UNIT}|[}}\]])\s*$", body, re.I):
            answered = False
    if not answered:
        core = final if blocks and not open_ and len(_WORD.findall(final)) > 1 else outside if not open_ else free
        said = [w.lower() for w in _WORD.findall(core)]
        if not open_ and len(said) >= 6 and prompt.automaton.covered(said) >= COPIED:
            return "copied_question"
        if not open_ and refuses(core):
            return "refusal"
        if not open_ and (_names_thing(final) or phrase_wanted if blocks else phrase_wanted and _names_thing(outside)):
            answered = not _blank(core)
        if not answered and blocks and not open_ and language(final) not in (None, asked):
            return "other_language"
        if not answered:
            at_limit = length is not None and limit is not None and length >= limit
            ended = not open_ and (bool(blocks) or outside.endswith(_ENDS))
            if not ended or at_limit:
                return "truncated"
            if not re.search(r"\d", core) and declines(core):
                return "refusal"
            # what is neither known as an answer nor shows a defect is no case, but for its language
    spoken = free if by_kind == "phrase" else _ANSWER.sub(" ", text)
    lang = language(_ANY_TAG.sub(" ", spoken))
    if lang and asked and lang != asked and _enough(spoken):
        return "other_language"
    return None


def _tag_of_prompt(text: str, problem: str) -> bool:
    """Whether what follows the last opened tag stands in the prompt as well, as where an instruction names the tag."""
    at = text.lower().rfind("<answer>")
    tail = text[at:].strip().lower() if at >= 0 else ""
    return len(tail) > len("<answer>") + 3 and tail in problem.lower()


# How a phrase that names a thing begins, and words of place in it.
_ARTICLE = re.compile(r"(?:an?|one|un|una|une|ein|eine|einen|some)\s", re.I)
_DEFINITE = re.compile(r"(?:the|el|la|los|las|le|les|der|die|das)\s", re.I)
_PLACE = re.compile(r"\b(?:in|on|at|under|beside|behind|below|near|opposite|past|front|above|next|auf|neben|hinter|unter|vor|bei|am|sur|sous|devant|derrière|près|junto|detrás|delante|frente|sobre)\b", re.I)


def _names_thing(text: str) -> bool:
    """Whether a short text is one phrase that names a thing, as an answer in words does."""
    text = text.strip()
    if not _one_phrase(text):
        return False
    if _CJK.search(text):
        return True
    return bool(_ARTICLE.match(text) or (_DEFINITE.match(text) and _PLACE.search(text)))


def _one_phrase(text: str) -> bool:
    """A line without a sentence end inside."""
    text = text.strip().rstrip("".join(_ENDS))
    return bool(text) and "\n" not in text and not re.search(r"[.!?。]\s", text) and len(_WORD.findall(text)) <= 16


def _enough(text: str) -> bool:
    return bool(_CJK.search(text)) or len(_WORD.findall(text)) >= 4


#: The kinds of answers by problem type; a type not listed is told from the prompt.
KINDS = {"temporal grounding": "span", "spatial grounding": "box", "tracking": "box", "multiple choice": "letter", "video qa": "phrase"}


def answer_kind(problem_type: Column, problem: Column) -> Column:
    """``span``, ``box``, ``letter`` or ``phrase``: the answer a prompt asks for."""
    out = F.when(problem.rlike(r"(?m)^\s*\(?[A-H][).]\s"), "letter")
    for name, kind in KINDS.items():
        out = out.when(problem_type == name, kind)
    return (
        out.when(problem.rlike(r"(?i)\bbox\b"), "box")
        .when(problem.rlike(r"(?i)second|sekunde|segundo|secondi|秒|<answer> begin|start and an end"), "span").otherwise("phrase")
    )


#: Runs up to which their limits are sent along with every task.
MAX_RUNS = 100_000

_N = r"\d+(?:\.\d+)?"
_PLAIN = rf"(?:{_N} (?:to|-) {_N}|{_N} and {_N}|from \d+:\d\d to \d+:\d\d|[A-H]|\{{\"(?:time|boxes)\": \[{_N}(?:, {_N})+\]\}})"


def _plainly_answered(field: Column) -> Column:
    """Whether the field is nothing but one complete bare answer. Those have no language and no other defect."""
    return field.isNotNull() & field.rlike(rf"^\s*(?:<answer>\s*{_PLAIN}\s*</answer>|{_PLAIN})\s*$")


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = lru_cache(maxsize=20_000)(defect)
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            length = None if pd.isna(row.response_length) else row.response_length
            limit = None if pd.isna(row.limit) else row.limit
            if row.check_response and (found := defect(row.problem, row.response, length, limit, row.kind)):
                out.append((row.rollout_id, "response", found))
            if row.check_truth and (found := seen(row.problem, row.ground_truth, None, None, row.kind)):
                out.append((row.rollout_id, "ground_truth", found))
        yield pd.DataFrame(out, columns=["rollout_id", "field", "defect"])


def defective_fields(pairs: DataFrame, runs: DataFrame, problem_type: Column) -> DataFrame:
    """``rollout_id``, ``field`` (``response`` or ``ground_truth``), ``defect``: one row per defective field.

    ``pairs`` is RewardInput rows with ``rollout_id`` and ``run_tag``; ``problem_type`` the type with its spelling
    levelled. Repeated rows give one case, rows without an id one of NULL. A NULL field is ``empty``, a NULL prompt is read as an empty one (nothing
    can be copied from it, no language differs from it), a NULL length or a run that is not listed is no evidence. Texts
    of any length are read whole. A field has one defect, the first that holds in the order of :func:`defect`.
    """
    limits = runs.where("run_tag IS NOT NULL").groupBy("run_tag").agg(F.max("max_response_length").alias("limit"))
    if limits.limit(MAX_RUNS + 1).count() <= MAX_RUNS:
        limits = F.broadcast(limits)  # else the join is left to the optimizer
    rows = pairs.select(
        F.col("rollout_id").cast("string").alias("rollout_id"), "problem", "response", "ground_truth", F.col("response_length").cast("double"), "run_tag",
        answer_kind(problem_type, F.coalesce("problem", F.lit(""))).alias("kind"),
        (~_plainly_answered(F.col("response"))).alias("check_response"), (~_plainly_answered(F.col("ground_truth"))).alias("check_truth"),
    ).where("check_response OR check_truth")
    found = rows.join(limits, "run_tag", "left").drop("run_tag").mapInPandas(_judge, "rollout_id string, field string, defect string")
    return found.select(F.col("rollout_id").cast("long").alias("rollout_id"), "field", "defect").distinct()
