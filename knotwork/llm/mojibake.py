"""Texts garbled by decoding with the wrong character encoding: finding them and giving back the original.

The characters of a text are mapped back to the bytes that a legacy code page would have read them from. A byte automaton
(one regular expression over the bytes, that is, one deterministic pass) finds the maximal spans of well-formed multibyte
sequences, and only those spans are decoded, until none is left (text is at times garbled two or three times over).
UTF-8 and GB 18030 are multibyte. Text of a single-byte code page read as another one has no byte structure; there, words
that no orthography allows (a capital, a sign or a letter of another script inside a word of small Latin letters; words
of accented letters only) are held against pairs of code pages, and a pair that makes the words of a text regular is
taken. U+FFFD marks bytes that were lost in decoding: found, not restorable.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.answers import WORDS_OF, tokens
from knotwork.llm.common import spread

# Code pages that UTF-8 is misread as, and (wrong, right) pairs of single-byte code pages.
READ_AS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1250", "iso8859_2", "cp1251")
LATIN_PAIRS = (
    ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("mac_roman", "cp1250"),
    ("cp437", "cp1250"), ("cp850", "cp1250"), ("cp1251", "cp1250"),
)
CYRILLIC_PAIRS = (("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"))
# Letters beyond ASCII that are words by themselves, by language; and quotation marks that don't stand between
# spaces.
ONE_LETTER_WORDS = {"fr": "àÀ", "es": "óáéÓ", "pt": "éàóÉÀ", "it": "èàòÈÀ", "sv": "åöÅ", "lt": "į", "ru": "яЯиИвВоОуУсСкКаА"}
QUOTES = "“”‘’‚„"


@lru_cache(None)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte for the upper half of a code page; control characters stand for bytes it leaves open."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    if codec in ("cp1252", "cp1250", "cp1251"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


_UTF8 = regex.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: A run of GB 18030: common Chinese characters and marks, at least two, with other two- and four-byte ones between.
_GB_ONE = rb"(?:[\xa1-\xa3\xb0-\xf7][\xa1-\xfe]|[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9])"
_GB = regex.compile(_GB_ONE + rb"{2,}")
#: Beside such a run, single ones count too: common characters and letters with accents.
_GB_BESIDE = regex.compile(_GB_ONE + rb"{2,}|[\xb0-\xd7][\xa1-\xfe]|\xa8[\xa1-\xbf]|[\x81-\xfe][0-9][\x81-\xfe][0-9]")
_HIGH = regex.compile(r"[^\x00-\x7f]+")
_SIGNS = r"\p{L}\p{M}\p{So}\p{Sm}\p{Sk}\p{Sc}\p{No}\x80-\x9f‚„†‡‰•·∙¸¶§¡¿–—…“”«»‹›ªº\xad"
_WORD = regex.compile(rf"[{_SIGNS}]*[{_SIGNS}--[\x00-\x7f]][{_SIGNS}]*", regex.VERSION1)

_PART = regex.compile(r"[^ \t\r\n\xa0]+")


@lru_cache(None)
def _pair(codec: str) -> re.Pattern:
    """A lead byte's character before a continuation byte's in a code page: text without one is sound as far as UTF-8 read
    through it goes."""
    back = _bytes_of(codec)
    lead = "".join(re.escape(c) for c, b in back.items() if 0xC2 <= b <= 0xF4)
    more = "".join(re.escape(c) for c, b in back.items() if b <= 0xBF)
    return re.compile(f"[{lead}][{more}]")


@lru_cache(1)
def _lead_and_more() -> re.Pattern:
    """The like in any of the code pages, and perhaps more: a lead's character of one before a continuation's of another."""
    sides = ["".join(sorted({c for codec in READ_AS for c, b in _bytes_of(codec).items() if low <= b <= high})) for low, high in ((0xC2, 0xF4), (0x80, 0xBF))]
    return re.compile("".join(f"[{re.escape(x)}]" for x in sides))


_BOX = regex.compile("[\u2500-\u259f]+")


@lru_cache(4096)
def _expected(c: str) -> bool:
    """Whether a decoded character is one that ordinary text has."""
    o = ord(c)
    if 0xA0 <= o <= 0x17F or 0x2010 <= o <= 0x2044 or 0x400 <= o <= 0x45F or o in (0x20AC, 0x2116, 0x2122, 0x192, 0xFEFF, 0xFE0F):
        return True
    if 0x80 <= o < 0xA0 or 0x2C6 <= o <= 0x2DC:  # left by an inner round
        return True
    if 0x2190 <= o <= 0x2BFF or 0x1E00 <= o <= 0x1EFF or o >= 0x1F300:
        return True
    return 0x386 <= o <= 0x3CE or 0x5D0 <= o <= 0x6D3 or 0x900 <= o <= 0x97F or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3 or 0xFF01 <= o <= 0xFF5E


def _fit(before: str, decoded: str, after: str) -> int:
    """Plus for letters whose case suits their neighbours, minus for those that don't."""
    score = 0
    text = before + decoded + after
    for k in range(len(before), len(before) + len(decoded)):
        c, left, right = text[k], text[k - 1] if k else " ", text[k + 1] if k + 1 < len(text) else " "
        if c.isalpha():
            if left.islower() and c.isupper():
                score -= 2
            else:
                score += 1
        elif c in "“”‘’–—…•£°¿¡":
            score += 1
        elif 0x80 <= ord(c) < 0xA0 or (left.isalpha() and right.isalpha()):
            score -= 1
    return score


def _utf8_round(text: str) -> tuple[str, str, int] | None:
    best = None
    if not _lead_and_more().search(text):
        return None
    for codec in READ_AS:
        if not _pair(codec).search(text):
            continue
        back = _bytes_of(codec)
        parts, last, covered, fit, spans = [], 0, 0, 0, []
        for run in _HIGH.finditer(text):
            raw = bytes(back.get(c, 0x20) for c in run.group())
            for span in _UTF8.finditer(raw):
                decoded = span.group().decode("utf-8", "ignore")
                drawn = _BOX.fullmatch(run.group()[span.start() : span.end()]) and _BOX.match(run.group()[span.start() - 1 : span.start()] if span.start() else "")
                if not drawn and all(map(_expected, decoded)):
                    spans.append((run.start() + span.start(), run.start() + span.end(), decoded))
        if codec == "cp1251" and not any(len(d) > 1 or 0xC0 <= ord(d) <= 0x17F for _, _, d in spans):
            continue  # one Cyrillic letter and a mark after it may well stand in sound text
        for start, end, decoded in spans:
            parts += [text[last:start], decoded]
            last = end
            covered += end - start
            fit += _fit(text[max(0, start - 1) : start], decoded, text[end : end + 1])
        if covered and (best is None or (covered, fit) > best[0]) and fit > -covered:
            best = ((covered, fit), "".join(parts) + text[last:], codec)
    return (best[1], best[2], best[0][0]) if best else None


@lru_cache(1)
def _gb_hint() -> regex.Pattern:
    """Three characters in a row that may be bytes of Chinese."""
    return regex.compile("[" + "".join(map(regex.escape, _bytes_of("cp1252"))) + "]{3}")


class _Bytes(dict):
    """For ``str.translate``: each character as the one of its byte's number, what has none as a space."""

    def __missing__(self, code: int) -> int:
        found = code if code < 0x80 else _bytes_of("cp1252").get(chr(code), 0x20)
        self[code] = found
        return found


@lru_cache(1)
def _gb_table() -> _Bytes:
    return _Bytes()


def _gb_round(text: str) -> tuple[str, int] | None:
    if not _gb_hint().search(text):
        return None
    raw = text.translate(_gb_table()).encode("latin-1", "replace")
    if not any(_chinese(span.group()) for span in _GB.finditer(raw)):
        return None
    parts, last, covered = [], 0, 0
    for span in _GB_BESIDE.finditer(raw):
        decoded = _chinese(span.group()) if len(span.group()) > 2 and not span.group()[1:2].isdigit() else span.group().decode("gb18030", "ignore")
        if not decoded or not all(0x80 > ord(c) or _expected(c) for c in decoded):
            continue
        parts += [text[last : span.start()], decoded]
        last = span.end()
        covered += len(decoded)
    return ("".join(parts) + text[last:], covered) if covered else None


def _chinese(raw: bytes) -> str | None:
    """What a run of bytes says in GB 18030, if it is mostly common characters and Chinese marks."""
    try:
        decoded = raw.decode("gb18030")
    except UnicodeDecodeError:
        return None
    common = sum("\u4e00" <= c <= "\u9fff" and 0xB0 <= c.encode("gb18030")[0] <= 0xD7 for c in decoded)
    marks = sum(c in "，。；：、！？（）《》" for c in decoded)
    if common < 1 or 3 * (common + marks) < 2 * len(decoded) or 4 * sum(x < 0x80 for x in raw) > len(decoded):
        return None
    return decoded


@lru_cache(8192)
def _irregular(word: str) -> bool:
    """Whether no orthography allows the word: a sign between letters, a capital that isn't ASCII after a small letter, or
    letters of two scripts."""
    scripts = set()
    for k, c in enumerate(word):
        if c.isascii():
            if c.isalpha():
                scripts.add("L")
            continue
        if 0x80 <= ord(c) < 0xA0:
            return True
        left, right = word[k - 1] if k else " ", word[k + 1] if k + 1 < len(word) else " "
        if c.isalpha() and c not in "ªºˆ˜ˇµ":
            if not unicodedata.combining(c):
                name = unicodedata.name(c, "")
                scripts.add("L" if name.startswith("LATIN") else name[:5])
            if c.isupper() and left.islower():
                return True
            if c == "ﬂ":
                return True
        elif not unicodedata.combining(c) and left.isalpha() and c not in "’‘“”…–—­·»«®™©¹²°":
            if right.isalpha() or c in "≤≥∙⌡⌠τ▀▄°¸˙˘˝˛‚„‰†‡÷×":
                return True
        elif not unicodedata.combining(c) and left.isalpha() and right.isalpha() and right.islower() and left.islower() and c in "²°¹“”‘»«®©­·™":
            return True
    return len(scripts) > 1 and "L" in scripts and not scripts & {"CJK U", "HIRAG", "KATAK", "HANGU"}


def _regular_latin(word: str) -> bool:
    return all(c.isascii() or 0xC0 <= ord(c) <= 0x17F and c not in "×÷" or c in "¿¡“”‘’–—…£°•«»" for c in word) and not _irregular(word)


def _swap(text: str, wrong: str, right: str) -> str:
    back = _bytes_of(wrong)
    out = []
    for c in text:
        b = back.get(c) if ord(c) >= 0x80 else None
        out.append(c if b is None else bytes([b]).decode(right, "replace"))
    return "".join(out)


_ALL_HIGH = regex.compile(r"(?<![\p{L}\p{M}])[^\x00-\x7f\s“”‘’«»…–—]{3,}(?![\p{L}\p{M}])")
_SMALL_CYRILLIC = regex.compile(r"[а-яё]+|[А-ЯЁ][а-яё]+")
_PHRASE = regex.compile(r"[^\x00-\x7f]+(?:[\s\d,.\-]+[^\x00-\x7f]+)*")


def _common(words: list[str]) -> float:
    """Share of the ten commonest letters of Russian."""
    letters = "".join(words).lower()
    return sum(c in "оеаинтсрвл" for c in letters) / max(1, len(letters))


def _cyrillic_round(text: str) -> tuple[str, str, int] | None:
    words = [w for w in _ALL_HIGH.findall(text) if not _SMALL_CYRILLIC.fullmatch(w) and not any(ord(c) >= 0x2E80 for c in w)]
    if not words:
        return None
    best = None
    for wrong, right in CYRILLIC_PAIRS:
        hits = {w: x for w in words if _SMALL_CYRILLIC.fullmatch(x := _swap(w, wrong, right))}
        score = _common(list(hits.values()))
        if sum(map(len, hits)) >= 4 and score > 0.4 and score > _common(list(hits)) + 0.05 and (best is None or (len(hits), score) > best[0]):
            best = ((len(hits), score), wrong, right, set(hits))
    if best is None:
        return None
    _, wrong, right, known = best
    fixed = _PHRASE.sub(lambda m: _swap(m.group(), wrong, right) if any(w in known for w in _ALL_HIGH.findall(m.group())) else m.group(), text)
    return fixed, f"{right} as {wrong}", sum(map(len, known))


def _latin_round(text: str) -> tuple[str, str, int] | None:
    words = [w for part in _PART.findall(text) if not part.isascii() for w in _WORD.findall(part)]
    odd = [w for w in words if any(c.isascii() and c.isalpha() for c in w) and _irregular(w)]
    if not odd:
        return None
    best = None
    for wrong, right in LATIN_PAIRS:
        hits = [w for w in odd if _regular_latin(_swap(w, wrong, right))]
        if hits and (best is None or len(hits) > best[0]):
            best = (len(hits), wrong, right)
    if best is None:
        return None
    _, wrong, right = best
    back = _bytes_of(wrong)
    # Where most words that the pair would change are odd, the whole text was read through it.
    changing = sum(_swap(w, wrong, right) != w for w in words)
    throughout = wrong != "cp1251" and (len(odd) > 2 or 2 * best[0] >= changing)

    def one(m: regex.Match) -> str:
        word = m.group()
        swapped = _swap(word, wrong, right)
        return swapped if all(ord(c) < 0x80 or c in back for c in word) and _regular_latin(swapped) and (_irregular(word) or throughout) else word

    fixed = _WORD.sub(one, text)
    return (fixed, f"{right} as {wrong}", best[0]) if fixed != text else None


_TOKEN = regex.compile(r"(?<!\S)[\"'“‘«(\[]*([^\x00-\x7f]+?)[\"'”’»)\].,;:]*(?!\S)")
_SENTENCE = regex.compile(r"[^\n.!?。]*(?:[.!?。](?!\s)[^\n.!?。]*)*[.!?。]?")
#: The character that stands in for what is quoted while the rest is restored: a private one, which no code page has.
_STAND_IN = 0xF0000
_STAND_INS = regex.compile(chr(_STAND_IN))


@lru_cache(4096)
def _meant(token: str) -> str:
    """What a token says once it is decoded to the end."""
    while step := _utf8_round(token):
        token = step[0]
    return token


def _quoted(sentence: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of a sentence's spans that quote garbled characters as such: each is a token that stands for one character,
    which is no word there (a letter of a language that the sentence isn't in, or a quotation mark between spaces), in a
    sentence that has no other garbled word."""
    rest = list(sentence)
    for start, end in spans:
        rest[start:end] = " " * (end - start)
    if _utf8_round("".join(rest)):
        return []
    words = tokens("".join(rest))

    def stray(c: str) -> bool:
        """Whether a character is no word: in no language, or in none that more of the sentence's words speak for than for
        English."""
        having = [WORDS_OF.get(lang, frozenset()) for lang, own in ONE_LETTER_WORDS.items() if c in own]
        hits = max((sum(w in small for w in words) for small in having), default=-1)
        return c in QUOTES or c.isalpha() and hits < sum(w in WORDS_OF["en"] for w in words)

    return [(a, b) for a, b in spans if stray(_meant(sentence[a:b]))]


def _set_aside(text: str) -> tuple[str, list[str]]:
    """The text with a stand-in for each quotation, and the quotations. A text that has such characters of its own has
    none set aside."""
    lone = [m.span(1) for m in _TOKEN.finditer(text) if len(m.group(1)) > 1 and _lead_and_more().match(m.group(1)) and len(_meant(m.group(1))) == 1]
    if not lone or _STAND_INS.search(text):
        return text, []
    parts, kept, last = [], [], 0
    for m in _SENTENCE.finditer(text):
        start, end = m.span()
        if inside := [(a - start, b - start) for a, b in lone if start <= a and b <= end]:
            for a, b in _quoted(m.group(), inside):
                parts += [text[last : start + a], chr(_STAND_IN)]
                kept.append(text[start + a : start + b])
                last = start + b
    return "".join(parts) + text[last:], kept


def repair(text: str | None) -> tuple[str, str] | None:
    """``(restored, how)`` of a garbled text, None of any other. ``how`` lists the steps; 'lost' is one where characters
    can't be restored. Decoding goes on until nothing is left to decode; what a text quotes stays as it is."""
    if not text or text.isascii():
        return None
    steps = []
    current, quoted = _set_aside(text)
    if "�" in current:
        steps.append("lost")
    if step := _cyrillic_round(current):
        current = step[0]
        steps.append(step[1])
    while True:  # each round makes the text shorter
        done = _gb_round(current) or None
        if done and (alike := _utf8_round(current)) and alike[2] >= done[1]:
            done = None
        if done:
            current = done[0]
            steps.append("gb18030 as cp1252")
            continue
        if step := _utf8_round(current):
            current = step[0]
            steps.append(f"utf-8 as {step[1]}")
            continue
        break
    if step := _latin_round(current):
        current = step[0]
        steps.append(step[1])
    if not steps:
        return None
    if quoted:
        back = iter(quoted)
        current = _STAND_INS.sub(lambda _: next(back), current)
    return current, ", ".join(steps)


def is_garbled(text: str | None) -> bool:
    return repair(text) is not None


def _repairs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(text)
        found = [(k, r) for k, r in enumerate(map(repair, batch.column(at).to_pylist())) if r]
        kept = batch.take(pa.array([k for k, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array([r[0] for _, r in found], pa.string()), pa.array([r[1] for _, r in found], pa.string())],
            names=[*batch.schema.names, "restored", "how"],
        )


def garbled_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is garbled in whole or in part, with ``restored`` (the text with its garbled spans
    decoded, all else as it is) and ``how`` (the steps; 'lost' where characters are gone for good).

    NULL, empty, blank and pure ASCII texts are never garbled and are dropped within the scan. A text that quotes such
    characters in a sentence about characters isn't a case. Equal rows are judged alike; whole texts are read, however
    long. Columns named ``restored`` or ``how`` are replaced. No shuffle but that of ``spread``.
    """
    keep = [c for c in df.columns if c not in ("restored", "how")]
    rows = df.select(*(F.col(f"`{c}`") for c in keep)).filter(F.col(text).rlike(r"[^\x00-\x7F]"))
    schema = T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType()), T.StructField("how", T.StringType())])
    return spread(rows).mapInArrow(lambda b: _repairs(b, text), schema)
