"""Grading of mathematical answers. Brace matching and repairs of notation go from state to state, so they are Python
functions over strings; ``graded`` applies them to columns in Arrow batches. Nothing in an answer is executed."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.operators.tools import evaluate
from knotwork.session import ship

# Units and notations that an answer loses.
UNITS = "degree cm centimeter meter mile second minute hour day week month year foot feet inch yard liter".split()
DROPPED = (r"\!", r"\left", r"\right", r"^{\circ}", r"^\circ", r"\$", "$", r"\%", "%", r"\,", r"\;", r"\ ")
CLOSE = 1e-4
#: What stands before an answer, after one, and, nearer to it, between its subject and it; what an expression
#: must not hold to be worked out; values of pi that an answer may have been written with.
BEFORE_ANSWER = ("answer:", "answer is", "answers are")
AFTER_ANSWER = ("is answer", "is the answer", "are answers", "are the answers")
LINKS = ("be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n")
NEVER = ("^{", "^(")
NEVER_MATCHING = (r"\^[0-9]+\^", r"\^[0-9][0-9]+")
PI = (math.pi, 3.14)


def last_boxed(text: str | None) -> str | None:
    r"""The last ``\boxed{...}`` with its braces matched, without one the last ``\fbox{...}``; a ``\boxed x`` anywhere is
    read first, up to the next dollar sign."""
    if not text:
        return None
    head, plain_box, tail = text.rpartition("\\boxed ")
    if plain_box:
        return plain_box + tail.partition("$")[0]
    at = text.rfind("\\boxed")
    at = text.rfind("\\fbox") if at < 0 else at
    if at < 0:
        return None
    depth = 0
    for k in range(at, len(text)):
        if text[k] == "{":
            depth += 1
        elif text[k] == "}":
            depth -= 1
            if depth == 0:
                return text[at : k + 1]
    return None


def unboxed(text: str | None) -> str | None:
    """What is in the box, NULL if it isn't a box."""
    m = re.fullmatch(r"(?s)\\(?:boxed|fbox)\s*\{(.*)\}|\\boxed (.*)", text or "")
    return None if m is None else m.group(1) if m.group(1) is not None else m.group(2)


def repaired(text: str) -> str:
    r"""An answer in one notation: spaces, units and signs dropped, ``\frac12`` and ``1/2`` as ``\frac{1}{2}``, ``\sqrt3``
    with braces, a leading zero before a point, what stands before a lone equals sign left out."""
    out = text.replace("\n", "").replace("tfrac", "frac").replace("dfrac", "frac")
    out = re.split(r"\\text\{ ", out)[0] if r"\text{ " in out else out
    for x in DROPPED:
        out = out.replace(x, "")
    out = re.sub(r"(^|[ {])\.", r"\g<1>0.", out)
    head, mark, tail = out.partition("=")
    if mark and len(head.strip()) <= 2 and "=" not in tail:
        out = tail
    out = re.sub(r"\\sqrt\s*([^{\s])", r"\\sqrt{\1}", out)
    out = out.replace(" ", "")
    out = re.sub(r"\\frac(\d)(\d)", r"\\frac{\1}{\2}", out)
    out = re.sub(r"\\frac(\d)\{", r"\\frac{\1}{", out)
    out = re.sub(r"\\frac(\{[^{}]*\})(\w)", r"\\frac\1{\2}", out)
    if out == "0.5":
        out = r"\frac{1}{2}"
    m = re.fullmatch(r"(-?\d+)/(-?\d+)", out)
    return rf"\frac{{{m.group(1)}}}{{{m.group(2)}}}" if m else out


def same_answer(a: str | None, b: str | None) -> bool:
    """Whether two answers are one after repair; two missing ones are, one isn't."""
    if a is None or b is None:
        return a is None and b is None
    return repaired(a) == repaired(b)


def plain(text: str | None) -> str | None:
    """The looser form that grading compares: text unwrapped, currency, units and words for numbers gone, small letters."""
    if text is None:
        return None
    out = re.sub(r"^\\text\{(.+)\}$", r"\1", text.strip())
    for a, b in ((r"\%", "%"), (r"\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , ")):
        out = out.replace(a, b)
    for word, zeros in (("million", 6), ("billion", 9), ("trillion", 12)):
        out = re.sub(rf"\s*{word}", f"*10^{zeros}", out)
    for unit in UNITS:
        out = re.sub(rf"{unit}(?:es)?s? *(?:\^[0-9]+)?", "", out)
    out = re.sub(r"\^\s*\\circ", "", out)
    if re.fullmatch(r"\{.*\}", out):
        out = out[1:-1]
    out = re.sub(r",\\!\s*", "", out)
    number = as_number(out)
    if number is not None and abs(number - round(number)) <= 1e-7:
        out = str(round(number))
    out = re.sub(r"(\d) +(\d+/\d+)", r"\1+\2", out)
    return re.sub(r"(\d),(?=\d{3}(?:$|\D))", r"\1", repaired(out)).lower()


def as_number(text: str | None) -> float | None:
    """A number as written, thousands in commas, a fraction or a percentage read too; None of anything else."""
    if not text:
        return None
    t = re.sub(r"(\d),(?=\d{3}(?:$|\D))", r"\1", text.strip().replace("$", "").replace("\\%", "").replace("%", ""))
    m = re.fullmatch(r"(-?)\\?d?frac\{(-?\d+)\}\{(-?\d+)\}|(-?\d+)\s*/\s*(-?\d+)", t)
    try:
        if m:
            top, bottom = (m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5))
            return (-1 if m.group(1) else 1) * int(top) / int(bottom)
        out = float(t)
    except (ValueError, ZeroDivisionError, OverflowError):
        return None
    return out if math.isfinite(out) else None


def close_numbers(a: str | None, b: str | None) -> bool:
    """Whether two numbers are within a relative 1e-4, one of them perhaps a percentage."""
    x, y = as_number(a), as_number(b)
    return x is not None and y is not None and any(math.isclose(x, r, rel_tol=CLOSE) for r in (y / 100, y, y * 100))


def elements(text: str) -> list[str]:
    """Elements of a bracketed list, or the text itself."""
    if len(text) > 2 and text[0] in "([" and text[-1] in ")]" and not any(c in text[1:-1] for c in "()[]"):
        return [x.strip() for x in text[1:-1].split(",")]
    return [text]


def second_form(answer: str | None) -> str | None:
    """The other notation that answers are compared in: unwrapped text, the same repairs of fractions and roots, but signs
    for money and spacing commands stay. What can't be repaired (a root or a fraction of nothing, two units) stays as it
    is."""
    if answer is None:
        return None
    whole = answer.strip()
    m = re.match(r"\\text\{(.+?)\}$", whole)
    whole = m.group(1).strip() if m else whole
    out = whole
    for a, b in (("\n", ""), (r"\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), (r"\left", ""), (r"\right", ""), (r"^{\circ}", ""), (r"^\circ", ""), (r"\$", "")):
        out = out.replace(a, b)
    units = out.split(r"\text{ ")
    if len(units) > 2:
        return whole
    out = units[0].replace(r"\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not out:
        return out
    out = "0" + out if out[0] == "." else out
    sides = out.split("=")
    out = sides[1] if len(sides) == 2 and len(sides[0]) <= 2 else out
    if out.endswith(r"\sqrt"):
        return whole
    out = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", out).replace(" ", "")
    if out.endswith(r"\frac"):
        return whole
    if not re.search(r"\\frac[^{]$|\\frac[^{]\\frac", out):
        out = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", out)
        out = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", out)
    if out == "0.5":
        return r"\frac{1}{2}"
    m = re.fullmatch(r"(0|-?[1-9]\d*)/(0|-?[1-9]\d*)", out)
    return rf"\frac{{{m.group(1)}}}{{{m.group(2)}}}" if m else out


def may_be_worked_out(expression: str) -> bool:
    """Whether an expression has at most two letters (roots and fractions aside) and none of the powers that take for ever."""
    letters = {c for c in expression.replace("sqrt", "").replace("frac", "") if c.isalpha()}
    return len(letters) <= 2 and not any(x in expression for x in NEVER) and not any(re.search(x, expression) for x in NEVER_MATCHING)


def worked_out(expression: str) -> float | None:
    """Value of an arithmetic expression, fractions and roots written as commands read too; None of anything else. Nothing
    is executed."""
    if not may_be_worked_out(expression):
        return None
    out = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", expression)
    out = re.sub(r"\\?sqrt\{?\(?([^{}()]*)\)?\}?", r"((\1)**0.5)", out)
    return evaluate(out.replace("^", "**").replace("\\cdot", "*").replace("\\times", "*"))


def _whole(text: str) -> bool:
    number = as_number(text)
    return number is not None and "/" not in text and "frac" not in text and abs(number - round(number)) <= 1e-7


def grade(given: str | None, truth: str | None) -> bool:
    """Whether an answer is right: equal in either notation or in plain form, else element by element, where fractions must
    be written alike, a whole number isn't any other number, and other expressions must have one value."""
    if given is None or truth is None:
        return False
    if second_form(given) == second_form(truth):
        return True
    a, b = plain(given), plain(truth)
    if a == b:
        return True
    if not a or not b:
        return False
    left, right = elements(a), elements(b)
    if len(left) != len(right) or len(right) > 1 and (a[0], a[-1]) != (b[0], b[-1]):
        return False
    return all(_equal(x, y) for x, y in zip(left, right))


def _equal(a: str, b: str) -> bool:
    if a == b:
        return True
    if ("frac" in a or re.fullmatch(r"-?\d+/\d+", a)) and ("frac" in b or re.fullmatch(r"-?\d+/\d+", b)) or _whole(a) != _whole(b):
        return False
    x, y = worked_out(a), worked_out(b)
    return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12)


def found_answer(response: str) -> tuple[bool, str]:
    """Whether an answer could be made out in a response, which needs a digit, and what it is: what follows the last mark
    of an answer or stands before one, the box in it, without its last sentence mark's rest, behind the last link word.
    Marks are tried one after the other, each on what the one before left."""
    text, marked = response, False
    for markers, side in ((BEFORE_ANSWER, 2), (AFTER_ANSWER, 0)):
        for m in markers:
            text, hit = _beside(text, m, side)
            marked |= hit
    box = _in_last_box(text)
    if box:
        text, marked = box, True
    head, dot, _ = text.rpartition(". ")
    text = head.strip() if dot else text
    for m in LINKS:
        text, hit = _beside(text, m, 2)
        marked |= hit
    return marked and any(c.isdigit() for c in text), text


def _beside(text: str, marker: str, side: int) -> tuple[str, bool]:
    """The part before (0) or after (2) the marker's last occurrence, in any case, and whether it is there."""
    at = text.lower().rfind(marker)
    if at < 0:
        return text, False
    return (text[:at] if side == 0 else text[at + len(marker) :]).strip(), True


def _in_last_box(text: str) -> str | None:
    """What is in the last box with braces, whatever stands before its first brace."""
    at = text.rfind("\\boxed")
    at = text.rfind("\\fbox") if at < 0 else at
    first, depth = None, 0
    for k in range(max(at, 0), len(text) if at >= 0 else 0):
        if text[k] == "{":
            depth += 1
            first = k if first is None else first
        elif text[k] == "}":
            depth -= 1
            if depth == 0:
                return None if first is None else text[first + 1 : k].strip()
    return None


def _number(x: str | float) -> float | None:
    try:
        return float(str(x).replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def with_pi(text: str, pi: float) -> str | float:
    r"""A text with ``\pi`` as its value, times the number before it, worked out if it is arithmetic; others as they are."""
    if r"\pi" not in text:
        return text
    written = re.sub(r"(?<=\d)\\pi", f"*{pi}", text)
    written = written.replace(r"\pi", f"1*{pi}")
    value = evaluate(written)
    return written if value is None else value


def in_base(text: str) -> str | int:
    """A number with its base as an index is taken as written, a whole number; ``ValueError`` if it is none."""
    return int(float(text.split("_")[0])) if "_" in text else text


def _read(text: str, pi: float) -> str | float:
    if re.match(r"\$\d", text):
        return text[1:]
    if re.fullmatch(r"\d+(?:\.\d+)?\\?%", text):
        return text.rstrip("%").rstrip("\\")
    based = in_base(text)
    return with_pi(based, pi) if isinstance(based, str) else based


def in_brackets(text: str) -> str:
    """An interval written as a call, in brackets: closed ends square, open ones round."""
    m = re.match(r"Interval(\.Ropen|\.Lopen|\.open|)\((.*)\)$", text)
    if not m:
        return text
    open_left, open_right = m.group(1) in (".Lopen", ".open"), m.group(1) in (".Ropen", ".open")
    return ("(" if open_left else "[") + m.group(2) + (")" if open_right else "]")


def same_math(given: str, truth: str, pi: float = math.pi, percentage: bool = True) -> bool:
    """Whether two answers mean one thing: alike as texts; numbers within a relative 1e-4 (one perhaps a percentage); alike
    but for brackets; lists, intervals and points element by element; or expressions of one value. A base that is no
    number raises ``ValueError``."""
    a, b = _read(given, pi), _read(truth, pi)
    if isinstance(a, str) and isinstance(b, str) and (a.strip().lower() == b.strip().lower() or a.replace(" ", "") == b.replace(" ", "")):
        return True
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return any(math.isclose(r, x, rel_tol=CLOSE) for r in ((y / 100, y, y * 100) if percentage else (y,)))
    if a == "":
        return False
    a, b = in_brackets(str(a).strip()), str(b).strip()
    ends = a[:1] + a[-1:]
    outer = ends == "[]" and b[:1] != "(" or ends == "()" and b[:1] != "["
    bare = [re.sub(r"[{}()]", "", t.strip("[]()") if outer else t) for t in (a, b)]
    if bare[0] == bare[1]:
        return True

    def each(p: str, q: str) -> bool | None:
        """Element by element; None if the numbers of elements differ."""
        left, right = ([t.strip() for t in z.split(",")] for z in (p, q))
        return all(same_math(u, v) for u, v in zip(left, right)) if len(left) == len(right) else None

    if a[:1] and a[0] in "([" and a[-1] in ")]" and (a[0], a[-1]) == (b[:1], b[-1:]) and each(a[1:-1], b[1:-1]):
        return True
    if "," in a and "," in b and (found := each(a, b)) is not None:
        return found
    if a.startswith("Point") and b[:1] == "(" and b[-1:] == ")" and each(a[a.find("(") + 1 : -1], b[1:-1]):
        return True
    x, y = worked_out(a), worked_out(b)
    return x is not None and y is not None and math.isclose(x, y, rel_tol=CLOSE)


def judged(output: str | None, truth: str | None) -> tuple[bool, bool, str | None]:
    """Whether a response is right, whether it is in the form asked for (a second step and a box; a right one always is),
    and the answer read from it. A NULL is read as the text None; with pi in it an answer may have either value of pi."""
    said, true = str(output), str(truth)
    answer = found_answer(said)[1]
    if grade(answer, true):
        return True, True, answer
    try:
        right = any(same_math(answer, true, pi) for pi in (PI if r"\pi" in answer or r"\pi" in true else PI[:1]))
    except (ValueError, OverflowError, IndexError, RecursionError):
        right = False
    return right, "Step 2:" in said and "\\box" in said, answer


def score(given: str | None, truth: str | None) -> float:
    """1 for a right or a close enough answer, else 0; what is boxed is the answer."""
    answer = unboxed(last_boxed(given)) if given and last_boxed(given) else given
    return 1.0 if grade(answer, truth) or close_numbers(answer, truth) else 0.0


def _scores(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([score(a, b) for a, b in zip(given, truth)], dtype="float64")


def _judged(output: pd.Series, truth: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([judged(a, b) for a, b in zip(output, truth)], columns=["right", "formed", "answer"])


def graded(df: DataFrame, given: str, truth: str, out: str = "score") -> DataFrame:
    """``out``: 1.0 or 0.0 for each row; NULL answers score 0."""
    ship(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(_scores, T.DoubleType())(F.col(given), F.col(truth)))


def graded_responses(df: DataFrame, output: str, truth: str, out: str = "verdict") -> DataFrame:
    """``out``: ``right, formed, answer`` of each row, as ``judged`` has it."""
    ship(df.sparkSession)
    return df.withColumn(out, F.pandas_udf(_judged, "right boolean, formed boolean, answer string")(F.col(output), F.col(truth)))
