"""Defective prompt and response pairs: empty, broken off, refused, copied and wrong-language answers.

The answer of a transcript is its last answer block. Prompt and answer are aligned as token sequences: an answer whose
shingles nearly all lie in the prompt and whose longest common subsequence with it covers most of the prompt is a copy; an
answer that holds a refusal template as a subsequence of its tokens, and little besides, is a refusal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from knotwork.llm.common import spread

TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[’'][\p{L}]+)?|[一-鿿]")
#: The share of a template that must be there, the words after it that may bring an answer all the same, and the words
#: within which the parts of a refusal lie.
REFUSAL_SHARE, REFUSAL_MORE, REFUSAL_SPAN = 0.85, 12, 9
COPY_CONTAINED, COPY_COVERED = 0.8, 0.6

# Ways to decline, word by word.
REFUSALS = [
    "i cannot answer", "i can not answer this", "i can't answer", "i can't help with", "i cannot help with", "i am unable to", "i'm unable to",
    "i am not able to answer", "i'm not able to answer", "i must decline", "i have to decline", "i decline to answer", "i would rather not", "i'd rather not",
    "i won't speculate", "i will not speculate", "i won't answer", "i will not answer", "i do not have enough information", "i don't have enough information",
    "i don't have enough", "i do not have sufficient", "it is not possible for me to", "it isn't possible for me to", "it is impossible for me to",
    "there is nothing i can", "is outside of what i can", "is beyond what i can", "knowledge is not sufficient to answer", "is insufficient to answer",
    "are not sufficient to answer", "information is not sufficient", "i don't know", "i do not know", "cannot be answered", "can't be answered",
    "cannot be determined from", "no answer can be given", "unable to provide an answer", "i have no information", "as an ai",
    "no puedo responder", "no puedo contestar", "no dispongo de datos", "no dispongo de información", "no tengo información", "no lo sé", "no sé la respuesta", "no es posible responder",
    "je ne peux pas répondre", "je ne sais pas", "ne permettent pas de répondre", "ne permet pas de répondre", "je ne suis pas en mesure", "je ne dispose pas", "impossible de répondre",
    "ich weiß es nicht", "ich weiß nicht", "kann ich diese frage nicht", "ich kann diese frage nicht", "liegen mir keine", "kann ich nicht beantworten", "ich kann das nicht", "lässt sich nicht beantworten", "habe ich keine",
    "não posso responder", "não sei", "não consigo responder", "não disponho de", "não tenho informações",
    "nie mogę odpowiedzieć", "nie wiem", "nie mam wystarczających", "nie jestem w stanie", "nemohu odpovědět", "nevím", "nemám dostatek",
    "не могу ответить", "я не знаю", "не знаю ответа", "недостаточно данных", "недостаточно информации", "non posso rispondere", "non lo so",
]
# The parts that an English refusal is made of: who speaks or what is spoken of, before or after; that it can't
# or won't be done; and then what can't be done or is missing. Some say it all.
WHO = frozenset("i i'm i've i'd me my we we're we've us our knowledge passage passages source sources material documents context evidence information data question answer".split())
UNKNOWN = [tokens_.split() for tokens_ in ("don't know", "do not know", "no idea", "can't tell", "cannot tell")]
NOT_ABLE = [
    tokens_.split() for tokens_ in ("cannot", "can't", "can not", "couldn't", "could not", "unable", "not able", "lack", "lacks", "don't have", "do not have", "have no", "haven't", "decline", "refuse", "won't", "will not", "outside", "beyond",
    "insufficient", "not sufficient", "not enough", "rather not", "impossible", "not possible", "isn't possible", "not permitted", "not allowed", "not in a position", "don't know", "do not know", "not sure", "unsure", "no idea", "not aware", "not certain", "no answer", "nothing", "not contained", "not answerable")
]
WHAT = frozenset(
    "answer answers respond reply say tell help assist provide speculate determine confirm comment disclose share offer give evidence information knowledge data context sources remit scope ability abilities competence expertise question questions request this that conclude conclusion given address find found known available answered determined established answerable".split()
)
CHINESE_REFUSALS = ("无法回答", "不能回答", "我不知道", "无法确定", "没有足够", "抱歉")
#: After one of these an answer may follow all the same.
YET = {"but", "hence", "however", "yet", "though", "nevertheless", "aber", "jedoch", "mais", "pero", "mas", "ale", "но"}

# Frequent small words by language.
SMALL_WORDS = {
    "en": "the of is was by in to and it has have its since from who which what where when did does that with for whom his her their this be been an at as on or are were not one older kept bought sold founded ended taught written recorded stored established stepped so i you we cannot could can not no nobody else able find second hence but answer sources say directly agree sorry earlier first account mill archive there about between after before",
    "de": "der die das des dem den von und ist war wurde im in zu ein eine einer es hat sich mit für auf nach bei seit wer wie wo welche welcher als nicht ich liegt wird befindet gekauft gegründet verkauft älter endete verkaufte wem lautet antwort um",
    "fr": "le la les de des du et est a été par en à qui que un une il elle dans sur au aux avec pour se fut ne pas quel quelle où depuis sont trouvent vendu acheté fondé créé plus que voici prit fin réponse l d",
    "es": "el la los las de del y es fue por en a quién qué un una se que con para su al desde está no dónde guarda vendió fundó fundado respuesta más antiguo que son lo",
    "pt": "o a os as de do da dos das e é foi por em no na um uma se que com para seu ao está guardado não vendeu fundado ano resposta mais esta desde quem",
    "it": "il lo la i gli le di del della e è fu da in un una che con per si non nel stato dal sono",
    "pl": "w na z i jest był była było się o do od przez nie to roku gdy który która kto za po ze został założył spisał sprzedał brzmi",
    "cs": "v na z i je byl byla bylo se o do od roku nebyl který která kdo za po ze že a byly podle odpověď zní",
    "nl": "het een en van de is was door werd in met op niet",
    "sv": "och är av den det som på var en ett med för till inte i om vid hos från har hade blev blir kan att när där detta denna eller men finns ligger sedan efter under år",
    "da": "og er af den det som på var en et med for til ikke i om ved hos fra har havde blev bliver kan at når der dette denne eller men findes ligger siden efter under år",
    "hu": "a az és egy nem hogy is volt van ez azt meg már csak mint után alatt szerint",
    "ro": "și este a al ale lui în din pe cu de la un o nu se care prin pentru fost sunt după",
    "tr": "ve bir bu da de ile için olarak olan oldu gibi daha çok sonra değil",
    "fi": "ja on oli ei se että joka hän ovat myös kun mutta tai vuonna sekä",
    "lt": "ir yra buvo metais kas iš į",
}
WORDS_OF = {k: frozenset(v.split()) for k, v in SMALL_WORDS.items()}
#: Small words that names and titles are joined by: no sentence comes of them.
IN_NAMES = frozenset("of and the de von der des den dem in la le les du di da do dos das el los las y e et und for at on van zu im am s d l st o'".split())
#: Words with which no whole sentence ends.
DANGLING = frozenset("of the a an and or in to by from with for at on as because which who that whose was is has had were after before since when while into see cf his her its their von der die das und im in zu wurde hat de la le les et du des par a qui que el los las y en por que fue do da o os as e em no na foi i w z na do od się был была в на и".split())
SENTENCE_ENGLISH = frozenset("is was has have had were are been be it which because who that since by recorded sold bought kept stored ended taught written founded established older closed printed after before when while did does its".split())


def tokens(text: str) -> list[str]:
    return [t.replace("’", "'") for t in TOKEN.findall(text.lower())]


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number, so that long sequences
    take a machine word's worth of cells at a time."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every  # a zero where the length grows
    for x in a:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & every
    return len(b) - row.bit_count()


def contained(a: Sequence[str], b: Sequence[str], width: int = 2) -> float:
    """Share of the distinct shingles of ``a`` that ``b`` has too."""
    width = max(1, min(width, len(a), len(b)))
    one = {tuple(a[i : i + width]) for i in range(len(a) - width + 1)}
    other = {tuple(b[i : i + width]) for i in range(len(b) - width + 1)}
    return len(one & other) / max(1, len(one))


def is_copy(question: str, answer: str) -> bool:
    """Whether the answer only gives the question back, be it in another case, with other marks, or twice over."""
    q, a = tokens(question), tokens(regex.sub(r"^\W*(?:you asked|q|question|the question (?:is|was)|frage|pregunta)\s*:", "", answer.strip(), flags=regex.IGNORECASE))
    if len(a) > len(q) > 0 and len(a) % len(q) == 0 and a == q * (len(a) // len(q)):
        return True
    if not q or len(a) < 3:
        return False
    if contained(a, q) < COPY_CONTAINED:
        return False
    covered = common_subsequence(q, a)
    more = len(a) - covered
    twice = len(a) >= 2 * covered - 1 and common_subsequence(q, a[len(a) // 2 :]) >= COPY_COVERED * len(q)
    if covered / len(q) < COPY_COVERED or (more > 0.1 * len(q) and not twice):
        return False
    rest = [t for t in a if t not in set(q)]
    return len(rest) <= max(1, len(a) // 12) and not _answers_after(question, answer)


def _answers_after(question: str, answer: str) -> bool:
    """Whether something follows the question mark of a repeated question that isn't the question again."""
    _, mark, after = answer.partition("?")
    rest = tokens(after)
    return bool(mark and rest) and common_subsequence(rest, tokens(question)) < COPY_COVERED * len(tokens(question))


@lru_cache(1)
def _templates() -> list[list[str]]:
    return [tokens(r) for r in REFUSALS]


SENTENCE = regex.compile(r"[^.!?。！？\n]+(?:[.!?。！？]+(?!\s|$)[^.!?。！？\n]*)*")


def _template_at(a: Sequence[str]) -> int | None:
    """Where a refusal template that the words are aligned with ends, None if there is none. A template's words must lie
    together: in a window hardly longer than the template itself."""
    have = set(a)
    for t in _templates():
        if len(have.intersection(t)) >= REFUSAL_SHARE * len(set(t)):
            for start in (i for i, x in enumerate(a) if x == t[0]):
                if common_subsequence(t, a[start : start + len(t) + 1]) >= len(t) * REFUSAL_SHARE:
                    return start + len(t)
    return None


def _parts_at(sentence: str, a: Sequence[str]) -> int | None:
    """Where the parts of a refusal (who, not able, what) that lie together in a sentence end, None if they aren't there. A
    title or a name, whose words are written with capitals, is no refusal."""
    if not WHO.intersection(a):
        return None
    words = regex.findall(r"\p{L}[\p{L}'’]*", sentence)
    if 2 * sum(w[0].islower() for w in words) < len(words):
        return None
    for part in [*UNKNOWN, *NOT_ABLE]:
        for at in (i for i in range(len(a) - len(part) + 1) if list(a[i : i + len(part)]) == part):
            around = range(max(0, at - REFUSAL_SPAN), min(len(a), at + len(part) + REFUSAL_SPAN))
            what = next((i for i in around if i >= at + len(part) and a[i] in WHAT), None)
            if part in UNKNOWN and any(a[i] in WHO for i in around):
                return at + len(part)
            if what is not None and any(a[i] in WHO for i in around if i != what):
                return what + 1
    return None


def is_refusal(answer: str) -> bool:
    """Whether the answer declines or says that it can't tell, in its first or its last sentence, however long it is. What
    brings an answer all the same, after a but, is none."""
    if any(r in answer for r in CHINESE_REFUSALS):
        return True
    sentences = [x for x in SENTENCE.findall(answer) if TOKEN.search(x)]
    for k in sorted({0, len(sentences) - 1}) if sentences else ():
        a = tokens(sentences[k])
        end = _template_at(a)
        end = _parts_at(sentences[k], a) if end is None else end
        if end is not None:
            after = a[end:] + [w for x in sentences[k + 1 :][:REFUSAL_MORE] for w in tokens(x)]
            return not (YET & set(after[:REFUSAL_MORE]) and len(after) > 2)
    return False


#: Scripts that no language of ``SMALL_WORDS`` is written in.
SCRIPTS = ("Greek", "Arabic", "Hebrew", "Hangul", "Hiragana", "Katakana", "Devanagari", "Thai", "Armenian", "Georgian")


def language(text: str) -> tuple[str | None, int]:
    """Language of a text by its small words and letters, and how many tell; None if nothing does."""
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return None, 0
    han = sum("一" <= c <= "鿿" for c in letters)
    if han >= 4:
        return "zh", han
    if not letters[0].isascii() or not letters[-1].isascii():
        for script in SCRIPTS:
            found = len(regex.findall(rf"\p{{{script}}}", text))
            if 2 * found > len(letters):
                return script.lower(), len(regex.findall(rf"\p{{{script}}}+", text))
    small = regex.findall(r"(?<![\p{L}])\p{Ll}[\p{Ll}\p{M}’']*(?![\p{L}])", text)
    cyrillic = [w for w in small if regex.match(r"\p{Cyrillic}", w)]
    if cyrillic:
        return "ru", len(cyrillic) + sum("Ѐ" <= c <= "ӿ" for c in letters) // 6
    words = [w for w in tokens(text) if w not in ("of", "and", "the")]  # names are joined by them in any language
    lower = set(small)
    best, most = None, 0.0
    marks = {"de": "ßäöü", "fr": "çœèùêâ", "es": "ñ¿¡íó", "pt": "ãõç", "pl": "łżźćńśęą", "cs": "řůěčž"}
    for lang, own in WORDS_OF.items():
        hits = sum(1 for w in words if w in own and (w in lower or words[:1] == [w]))
        hits += 0.6 * sum(any(c in w for c in marks.get(lang, "")) for w in small)
        if hits > most:
            best, most = lang, hits
    return best, int(most + 0.5)


def _sentence(answer: str, title: bool) -> bool:
    """Whether an answer has more than a name or a title."""
    words = regex.findall(r"[\p{L}\p{M}’'\-]+", answer)
    lower = [w for w in words if w[0].islower()]
    if any(w in SENTENCE_ENGLISH for w in map(str.lower, lower)):
        return True
    if title or len(lower) == len(words):
        return False
    return any(w.lower() not in IN_NAMES for w in lower)


def is_cut(question: str, answer: str, golden: Sequence[str | None] | None, said: str = "") -> bool:
    """Whether an answer that is closed breaks off before it is complete."""
    a = answer.strip()
    if not a or not regex.search(r"[\p{L}\p{N}]", a):
        return False
    known = {" ".join(tokens(g)) for g in golden or () if g}
    if " ".join(tokens(a)) in known:
        return False
    if "?" in a:  # the question, and then the answer
        a = a.rpartition("?")[2].strip(" \t\n\"”’»")
        if not regex.search(r"[\p{L}\p{N}]", a) or " ".join(tokens(a)) in known:
            return False
    if regex.search(r"(?:\.\.\.|…)[\"”’)]*$", a):
        return True
    if regex.search(r"[.!?。！？][\"”’»')\]]*$", a):
        return False
    if a.count("(") > a.count(")") or a[-1] in ",;:–—-(":
        return True
    last = regex.findall(r"[\p{L}\p{M}\p{N}’'\-]+", a)[-1]
    title = bool(regex.search(r"\b(?:title|titre|Titel|título)\b", question or ""))
    if len(tokens(a)) > 1 and last.lower() in DANGLING and last[0].islower():
        return True
    for g in golden or ():
        if g and len(g) > len(a) and g.lower().startswith(a.lower()) and g[len(a)].isalnum() and a[-1].isalnum():
            return True
    if _sentence(a, title):
        return True
    words = a.split()
    if len(words) > 1 and said and a[-1].isalpha():
        two = " ".join(words[-2:])
        if regex.search(regex.escape(two) + r"(?!\p{L})", said) is None and regex.search(regex.escape(two) + r"\p{Ll}", said):
            return True
    return False


def defect(question: str | None, prediction: str | None, golden: Sequence[str | None] | None = None) -> str | None:
    """The defect of a transcript's answer, None if it has none."""
    if prediction is None or not prediction.strip():
        return "empty"
    head, opened, body = prediction.rpartition("<answer>")
    if not opened:
        return "empty" if prediction.rstrip().endswith(("<|im_end|>", "</query>", "</think>", "</answer>")) else "truncated"
    answer, closed, _ = body.partition("</answer>")
    if not closed:
        answer, ended, _ = body.partition("<|im_end|>")
        if not ended:
            return "truncated"
    if not regex.search(r"[\p{L}\p{N}]", answer):
        return "empty"
    question = question or ""
    if is_copy(question, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    if is_cut(question, answer, golden, head):
        return "truncated"
    asked, _ = language(question)
    said, sure = language(answer)
    if said and asked and said != asked and sure >= 2 and _is_statement(answer, said):
        _, own = language(answer) if said == asked else (None, _hits(answer, asked))
        if sure > own and not any(g and " ".join(tokens(g)) == " ".join(tokens(answer)) for g in golden or ()):
            return "language"
    return None


def _hits(text: str, lang: str) -> int:
    return sum(w in WORDS_OF.get(lang, ()) and w not in IN_NAMES for w in tokens(text))


def _is_statement(answer: str, lang: str) -> bool:
    """Whether an answer in ``lang`` is a sentence, not a name or a title."""
    if lang in ("zh", "ru") or lang not in WORDS_OF:
        return True
    return bool(regex.search(r"[.!?][\"”’»)]*\s*$", answer.strip())) or any(w in WORDS_OF[lang] and w not in IN_NAMES for w in regex.findall(r"(?<!\p{L})\p{Ll}+(?!\p{L})", answer))


def _defects(batches: Iterator[pa.RecordBatch], columns: tuple[str, str, str], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, p, g = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)
        found = [(k, d) for k, d in enumerate(map(defect, q, p, g)) if d]
        rows = batch.take(pa.array([k for k, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in keep), pa.array([d for _, d in found], pa.string())], names=[*keep, "defect"])


def defective_answers(df: DataFrame, keep: list[str], question: str = "question", prediction: str = "prediction", golden: str = "golden_answers") -> DataFrame:
    """Columns ``keep`` and ``defect`` of each row whose answer is defective: 'empty', 'truncated', 'refusal', 'copy' or
    'language', the first that holds.

    A NULL or blank prediction is 'empty', whatever the other columns hold. A NULL or empty question can be no copy and
    has no language; NULL golden answers are as none. Equal rows are judged alike. Rows are judged one by one, in one pass
    without a shuffle; an answer of any length is read whole.
    """
    columns = (question, prediction, golden)
    rows = df.select(*dict.fromkeys([*keep, *columns]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields), "defect string"])
    return spread(rows).mapInArrow(lambda b: _defects(b, columns, keep), schema)
