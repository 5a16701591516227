"""Text functions: names, answers and transcripts as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space that a name loses at its ends.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: The 32 ASCII punctuation marks.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# Fixed value: one assistant turn of a transcript.
ASSISTANT = r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WHITE))


def canonical_name(x: Column) -> Column:
    """Upper case; outer double quotes, then outer single quotes, then outer white space removed; double quotes put on."""
    return F.concat(F.lit('"'), strip(F.btrim(F.btrim(F.upper(x), F.lit('"')), F.lit("'"))), F.lit('"'))


def words(x: Column) -> Column:
    """Words between white space; none of an empty text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def answer_tokens(x: Column) -> Column:
    """Lower case without punctuation and without the articles a, an and the, as words."""
    return F.filter(words(F.regexp_replace(F.lower(x), PUNCTUATION, "")), lambda w: ~w.isin("a", "an", "the"))


def normalize_answer(x: Column) -> Column:
    """``answer_tokens`` with one space between."""
    return F.array_join(answer_tokens(x), " ")


def round_tokens(x: Column) -> Column:
    """Words of the round evaluation: lower case, every other character than a-z, 0-9 and white space a space; articles
    stay."""
    return words(F.regexp_replace(F.lower(x), r"[^a-z0-9\s]", " "))


def normalize_round(x: Column) -> Column:
    return F.array_join(round_tokens(x), " ")


def exact(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(0.0)


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda s, t: s + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))),
    )


def f1(common: Column, n_a: Column, n_b: Column) -> Column:
    """Harmonic mean of the shares of both sides, 0 if nothing is in common."""
    return F.when(common > 0, 2.0 * common / (n_a + n_b)).otherwise(0.0)


def f1_multiset(gold: Column, said: Column) -> Column:
    """F1 of two answers over their tokens as multisets."""
    g, p = answer_tokens(gold), answer_tokens(said)
    return f1(shared_count(g, p), F.size(g), F.size(p))


def f1_set(gold: Column, said: Column) -> Column:
    """F1 over the sets of round tokens; 0 if either is empty."""
    g, p = F.array_distinct(round_tokens(gold)), F.array_distinct(round_tokens(said))
    return f1(F.size(F.array_intersect(g, p)), F.size(g), F.size(p))


def f1_raw(gold: Column, said: Column) -> Column:
    """F1 over the sets of lower-case words between white space, of the answer body if there is one."""
    body = F.coalesce(first_answer(said), said)
    g, p = F.array_distinct(words(F.lower(gold))), F.array_distinct(words(F.lower(body)))
    return f1(F.size(F.array_intersect(g, p)), F.size(g), F.size(p))


def contains_answer(gold: Column, said: Column) -> Column:
    """Whether the normalised gold answer occurs in the normalised prediction."""
    return F.contains(normalize_answer(said), normalize_answer(gold))


def best_of(golds: Column, score) -> Column:  # noqa: ANN001
    """The best score over an array of gold answers; 0 if there is none."""
    return F.coalesce(F.array_max(F.transform(golds, score)), F.lit(0.0))


def assistant_blocks(x: Column) -> Column:
    """Bodies of the assistant turns of a transcript."""
    return F.regexp_extract_all(x, F.lit(ASSISTANT), F.lit(1))


def bodies(x: Column, tag: str) -> Column:
    return F.regexp_extract_all(x, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))


def first_answer(x: Column) -> Column:
    """The first answer body without outer white space, NULL if there is none."""
    return strip(F.try_element_at(bodies(x, "answer"), F.lit(1)))


def last_answer(x: Column) -> Column:
    """What stands before the last closing answer tag and after the opening tag before it, without outer white space and
    then with its lines made one; NULL if no answer is closed."""
    parts = F.split(x, "</answer>", -1)
    body = F.try_element_at(parts, F.lit(-2))
    return F.replace(strip(F.element_at(F.split(body, "<answer>", -1), -1)), F.lit("\n"), F.lit(" "))


def last_turn_answer(x: Column) -> Column:
    """The first answer body of the last assistant turn, NULL if there is no turn or no answer in it."""
    return first_answer(F.try_element_at(assistant_blocks(x), F.lit(-1)))


def knowledge_text(x: Column) -> Column:
    """Texts between knowledge tags, one a line."""
    return F.array_join(F.transform(bodies(x, "knowledge"), strip), "\n")


def tool_query(x: Column) -> Column:
    """The query of the first tool call as a string; NULL if there is no call or its body is no JSON object with it."""
    body = F.try_element_at(bodies(x, "query"), F.lit(1))
    # The parser stops at the end of the object; what follows it makes the body invalid all the same.
    once = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})
    return F.when((F.size(once) == 1) & F.get_json_object(body, "$").isNotNull(), F.get_json_object(body, "$.query"))


def first_call(x: Column) -> Column:
    """A turn up to and with its first closing query tag; all of it if there is none."""
    return F.when(F.contains(x, F.lit("</query>")), F.concat(F.substring_index(x, "</query>", 1), F.lit("</query>"))).otherwise(x)


def truncate_description(x: Column, tokens: int = 200) -> Column:
    """At most ``tokens`` tokens of four characters."""
    return F.substring(x, 1, 4 * tokens)


def last_number(x: Column) -> Column:
    """The last number of a text as it is written, NULL if there is none."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(r"(-?\d+\.?\d*)"), F.lit(1)), F.lit(-1))


def ends_in(x: Column, truth: Column) -> Column:
    """Whether the last number of a text is written as the truth is: a comparison of texts, so that 5 isn't 5.0."""
    return F.coalesce(last_number(x) == truth, F.lit(False))


def hashed_vector(x: Column, places: int = 64) -> Column:
    """Counts of a text's normalised words by the first hex digits of their MD5: a vector that needs no model, all zeros of
    an empty text. ``places`` is at most 256 and divides it."""
    digits = "0123456789abcdef"
    value = lambda w, k: F.instr(F.lit(digits), F.substring(F.md5(w), k, 1)) - 1
    at = F.transform(answer_tokens(x), lambda w: F.floor((value(w, 1) * 16 + value(w, 2)) / (256 // places)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
