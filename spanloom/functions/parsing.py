"""Spans, boxes, segments and points out of free text, all as built-in expressions.

Three span parsers differ on purpose, since training data, evaluation and reward read answers differently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of numbers, clock times and answer blocks.
NUMBER = r"\d+\.?\d*"
CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?\b"
BLOCK_ANY_LINES = r"(?s)<answer>(.*?)</answer>"
BLOCK_ONE_LINE = r"<answer>\s*([^\n]*?)\s*</answer>"
# How the ends of a span, the coordinates of a box and signed numbers are written.
BARE_NUMBER = r"\b(?:\d+\.\d+|\d+)\b"
EVALUATED_LINKS = [r"\s*-\s*", r"\s+to\s+"]
REWARDED_LINKS = ["to|and", "-"]
COORDINATE = r"\d+(?:\.\d+)?"
SIGNED = r"-?\d+\.?\d*"
# How a prompt leads up to its event, and what follows the event.
LEAD = r"(?i)(?:pinpoint|locate|find)\s+(?:the\s+)?(?:event|clip|moment)\s+"
QUOTED = [r'"([^"]+)"', "[\"“]([^\"”]+)[\"”]"]
INSTRUCTION_BEHIND = r"(?is)\s*(?:Provide the start|Please provide|Determine the precise).*$"


def number(text: Column) -> Column:
    """A double, or NULL where the text is none."""
    return text.try_cast("double")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a group, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once per row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def span(start: Column, end: Column) -> Column:
    """A span, NULL unless both ends are there."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def strip(text: Column) -> Column:
    """White space off both ends, line ends included."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def first_numbers(text: Column) -> Column:
    """The span of the first two numbers (how training data are converted)."""
    numbers = found(text, NUMBER)
    return span(number(F.get(numbers, F.lit(0))), number(F.get(numbers, F.lit(1))))


def answer_body(text: Column, pattern: str = BLOCK_ANY_LINES) -> Column:
    """The first answer block's content, or the whole text where there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def last_answer(text: Column) -> Column:
    """The last answer block, stripped; NULL without one."""
    return strip(last(found(text, BLOCK_ANY_LINES, 1)))


def seconds(clock: Column) -> Column:
    """Seconds of ``h:mm:ss`` or ``m:ss``."""
    parts = F.transform(F.split(clock, ":"), lambda x: x.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total * 60 + x)


def evaluated_spans(text: Column) -> Column:
    """All spans an evaluated answer names: clock times, else ``a - b``, else ``a to b``, else numbers in pairs."""
    return once(answer_body(F.lower(text), BLOCK_ONE_LINE), _spans_of_body)


def _spans_of_body(body: Column) -> Column:
    def pairs(items: Column) -> Column:
        upto = F.floor(F.size(items) / 2).cast("int")
        return F.when(upto > 0, F.transform(F.sequence(F.lit(0), upto - 1), lambda i: F.struct(
            F.get(items, (2 * i).cast("int")).alias("start"), F.get(items, (2 * i + 1).cast("int")).alias("end"))))

    def linked(link: str) -> Column:
        pattern = rf"({NUMBER}){link}({NUMBER})"
        a, b = found(body, pattern, 1), found(body, pattern, 2)
        return once(a, lambda x: F.when(F.size(x) > 0, F.zip_with(x, b, lambda x, y: F.struct(number(x).alias("start"), number(y).alias("end")))))

    clocks = once(found(body, CLOCK), lambda x: pairs(F.transform(x, seconds)))
    plain = once(found(body, BARE_NUMBER), lambda x: pairs(F.transform(x, number)))
    return F.coalesce(clocks, *map(linked, EVALUATED_LINKS), plain)


def evaluated_span(text: Column) -> Column:
    """The first of :func:`evaluated_spans`."""
    return F.get(evaluated_spans(text), F.lit(0))


def rewarded_span(text: Column) -> Column:
    """The span a reward reads: the last ``a to b`` or ``a and b``, else the last ``a - b``, else the first two numbers."""
    return once(answer_body(text), _rewarded_of_body)


def _rewarded_of_body(body: Column) -> Column:
    def linked(link: str) -> Column:
        pair = last(found(body, rf"{NUMBER}\s*(?:{link})\s*{NUMBER}"))
        ends = rf"^({NUMBER})\s*(?:{link})\s*({NUMBER})$"
        return once(pair, lambda p: span(number(F.regexp_extract(p, ends, 1)), number(F.regexp_extract(p, ends, 2))))

    bounded = once(found(body, rf"\b({NUMBER})\b", 1), lambda n: span(number(F.get(n, F.lit(0))), number(F.get(n, F.lit(1)))))
    return F.coalesce(*map(linked, REWARDED_LINKS), bounded)


def box(text: Column) -> Column:
    """A box as four doubles: ``(a,b),(c,d)``, else the first four numbers, else NULL."""
    n = f"({COORDINATE})"
    corners = rf"\({n}\s*,\s*{n}\)\s*,?\s*\({n}\s*,\s*{n}\)"
    first = once(found(text, COORDINATE), lambda x: F.when(F.size(x) >= 4, F.transform(F.slice(x, 1, 4), number)))
    return F.when(text.rlike(corners), F.array(*[number(F.regexp_extract(text, corners, i)) for i in (1, 2, 3, 4)])).otherwise(first)


def segments(text: Column) -> Column:
    """Pairs of numbers in brackets after the word ``segments``; NULL without any."""
    pattern = rf"\[\s*({SIGNED})\s*,\s*({SIGNED})\s*\]"
    rest = F.substring(text, F.instr(text, "segments"), F.length(text))
    a, b = found(rest, pattern, 1), found(rest, pattern, 2)
    return F.when(text.contains("segments") & (F.size(a) > 0), F.zip_with(a, b, lambda x, y: F.struct(number(x).alias("start"), number(y).alias("end"))))


# The keys under which a point may be given.
POINT_KEYS = ["center", "subject_center", "focus", "point", "cxcy"]


def focus_point(text: Column, width: Column, height: Column) -> Column:
    """A point scaled to 0..1: of the last JSON object, by the last key that has one, else the last two numbers.

    Up to 1.5 a number is a share, up to 1000 thousandths, beyond that pixels.
    """
    objects = found(text, r"\{[^{}]*\}")

    def of(obj: Column) -> Column:
        values = [F.from_json(F.get_json_object(obj, f"$.{key}"), "array<double>") for key in reversed(POINT_KEYS)]
        return F.coalesce(*[F.when(F.size(v) >= 2, F.slice(v, 1, 2)) for v in values])

    named = last(F.filter(F.transform(objects, of), lambda v: v.isNotNull()))
    numbers = F.transform(found(text, SIGNED), number)
    point = F.coalesce(named, F.when(F.size(numbers) >= 2, F.slice(numbers, -2, 2)))

    def scaled(v: Column, size: Column) -> Column:
        n = F.when(v <= 1.5, v).when((v > 1000) & (size > 0), v / size).otherwise(v / 1000)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), n))

    return F.when(point.isNotNull(), F.struct(scaled(point[0], width).alias("x"), scaled(point[1], height).alias("y")))


def basename(path: Column) -> Column:
    return last(F.split(path, "/"))


def rebased(path: Column, prefixes: list[str], root: str) -> Column:
    """The first matching prefix off, the root in front."""
    rest = None
    for prefix in prefixes:
        rest = (F if rest is None else rest).when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1)))
    rest = path if rest is None else rest.otherwise(path)
    return F.concat(F.lit(root.rstrip("/") + "/"), rest)


def question(message: Column) -> Column:
    """What a wrapped prompt asks for: the quoted event, else the text without instructions on the answer."""
    text = strip(F.regexp_replace(message, "<video>", ""))
    straight, curly = (LEAD + q for q in QUOTED)
    bare = strip(F.regexp_replace(text, INSTRUCTION_BEHIND, ""))
    asked = F.when(text.rlike(straight), F.regexp_extract(text, straight, 1)).when(text.rlike(curly), F.regexp_extract(text, curly, 1)).when(bare != "", bare)
    return F.concat(F.lit("<video>"), asked.otherwise(text))


def levelled_query(query: Column) -> Column:
    """Blanks run together, dots and blanks off both ends."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(query, r"\s+", " ")), r"^\.+|\.+$", ""))


def clipped(text: Column, most: int) -> Column:
    """Head and tail of a text over ``most`` characters, with the number left out between them."""
    head, tail = most // 2, most - most // 2
    note = F.concat(F.lit("\n... [truncated "), (F.length(text) - most).cast("string"), F.lit(" chars] ...\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(tail))))


def cents(value: Column) -> Column:
    """A number as text with two decimals, halves of a cent to even as by binary rounding."""
    c = F.rint(value * 100).cast("long")
    return F.concat((F.floor(c / 100)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def reference_response(truth: Column) -> Column:
    """The response that states a ground truth; NULL where none can be read."""
    s = rewarded_span(truth)
    return F.when(s.isNotNull(), F.concat(F.lit("<answer> "), cents(s["start"]), F.lit(" to "), cents(s["end"]), F.lit(" </answer>")))


def answer_text(start: Column, end: Column, json: bool = False) -> Column:
    """A span as an answer: in a block of tags, or as JSON."""
    if json:
        return F.to_json(F.struct(F.array(start, end).alias("time")))
    return F.concat(F.lit("<answer> "), start.cast("string"), F.lit(" to "), end.cast("string"), F.lit(" </answer>"))


def artifact_name(*parts: Column) -> Column:
    """Half of the md5 of the parts, joined by ``_``, NULL ones left out."""
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 16)


def run_tag(path: Column) -> Column:
    """``experiment@step`` of a checkpoint's path; empty where it is none."""
    pattern = r"([^/]+)/global_step_(\d+)"
    return F.when(path.rlike(pattern), F.concat(F.regexp_extract(path, pattern, 1), F.lit("@"), F.regexp_extract(path, pattern, 2))).otherwise(F.lit(""))


def duration_text(seconds: Column) -> Column:
    """``1h02m03s`` from an hour on, else ``2m03s``; negative ones as 0, NULL and NaN as ``n/a``."""
    t = F.greatest(F.lit(0).cast("long"), F.floor(F.nanvl(seconds.cast("double"), F.lit(0.0))))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tail = F.concat(two(F.floor(t % 60)), F.lit("s"))
    shown = F.when(t >= 3600, F.concat(F.floor(t / 3600).cast("string"), F.lit("h"), two(F.floor(t % 3600 / 60)), F.lit("m"), tail)).otherwise(F.concat(F.floor(t / 60).cast("string"), F.lit("m"), tail))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")), "n/a").otherwise(shown)


def metric_text(value: Column, places: int = 4) -> Column:
    """A number with so many decimals, ``n/a`` where there is none."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "n/a").otherwise(F.format_string(f"%.{places}f", value.cast("double")))


def scientific(number: Column) -> Column:
    """Whether a text is a number in scientific notation."""
    return number.rlike(r"^[+-]?\d+(?:\.\d*)?[eE][+-]?\d+$")


def configured_number(number: Column) -> Column:
    """A number's text as a configuration file shows it: scientific notation keeps, with a decimal point, others have three decimals."""
    pointed = F.when(number.contains("."), number).otherwise(F.regexp_replace(number, "e", ".0e"))
    return F.when(scientific(number), pointed).otherwise(F.round(number.try_cast("double"), 3).cast("string"))
