"""The operators for training data: brute force, round trips and edge cases on small frames."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm import answers, bpe, common, mixing, mojibake, name_forms, names, near_duplicates, queries, splitting, survivors

SF = "/root/testdata/sf0.001"


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


# 1: survivors

ENTITY = "client_id string, round_number int, ord long, entity_name string, entity_type string, description string, weight double, source_chunk_hash string, extracted_at timestamp"


def fused(spark, rows, hashes=("h1", "h2"), clients=(("a", 10, 5), ("b", 10, 2)), ranked=True):
    import datetime

    data = [(c, 0, o, n, "PERSON", d, w, h, datetime.datetime(2025, 1, day) if day else None) for o, (c, n, d, w, h, day) in enumerate(rows, 1)]
    entities = spark.createDataFrame(data, ENTITY)
    documents = spark.createDataFrame([(h,) for h in hashes], "chunk_hash string")
    tables = (entities, documents, spark.createDataFrame(list(clients), "client_id string, num_samples long, trust int"))
    return survivors.best_values(*tables)._replace(survivors=survivors.ranked_survivors(*tables)) if ranked else survivors.best_values(*tables)


GOOD = "An organisation founded in 1900, with 732 members."


def test_trust_then_time_then_order(spark):
    got = fused(spark, [("b", "x", GOOD, 5.0, "h1", 9), ("a", "X", GOOD + " Its school was rebuilt in 1905.", 7.0, "h9", 1), ("a", '"x"', "To be added.", 8.0, "h2", 2), ("a", "x", None, 9.0, "h2", 2), ("zz", "alone", GOOD, 1.0, "h1", 1)])
    rows = {(r.canonical_name, r.field): r.ord for r in got.survivors.collect()}
    assert rows == {('"X"', "description"): 2, ('"X"', "weight"): 3, ('"X"', "source_chunk_hash"): 3}
    assert all(0 <= r.posterior <= 1 for r in got.facts.collect()) and {q[1] for q in got.quality} == {"a", "b"}


def test_unusable_values_and_blank_names(spark):
    nan = float("nan")
    got = fused(spark, [("a", None, GOOD, 1.0, "h1", 1), ("a", ' "" ', GOOD, 1.0, "h1", 1), ("a", '""', GOOD, 1.0, "h1", 1), ("a", "''", GOOD, 1.0, "h1", 1), ("a", "y", "   ", nan, None, None), ("zz", "y", "Unfinished statement about the", float("inf"), "", 1), ("b", "y", None, 100.5, "UNKNOWN", 1), (None, "y", "x" * 100_000, 0.0, "h", 1)])
    assert {r.canonical_name for r in got.survivors.collect()} <= {'""'} or got.survivors.filter("canonical_name = '\"Y\"'").count() == 0
    got = fused(spark, [("zz", "y", GOOD, None, None, None), ("zz", "y", GOOD, None, None, None)])
    assert [(r.field, r.ord) for r in got.survivors.collect()] == [("description", 1)]


def test_empty_tables(spark):
    got = fused(spark, [], (), ())
    assert got.survivors.count() == 0 and got.facts.count() == 0 and got.quality == []
    assert fused(spark, [], (), (), False).survivors.count() == 0


@pytest.mark.parametrize("text, good", [(GOOD, True), ("A settlement of 9 people…", False), ("A settlement of 9 people...", False), ("A settlement of 9 peop [...]", False), ("No description available.", False), ("Entity description goes here.", False), ("####", False), ("A café beside the mill bears the name.", True), ("A cafÃ© beside the mill bears the name.", False), ('{"entity_name": "a b c d."}', False), (None, False), ("", False), ("Mount Gakefetral", False)])
def test_statements(spark, text, good):
    common.ship(spark)
    df = spark.createDataFrame([(text,)], "d string")
    assert df.select(survivors.is_statement(F.col("d"))).first()[0] is good


def test_quality_tells_good_sources_from_bad(spark):
    random.seed(1)
    rows = []
    for e in range(60):
        for c in "abcd":
            rows.append((c, f"entity {e}", None, float(e % 90 + 1), None, 1))
        rows.append(("bad", f"entity {e}", None, random.uniform(1, 99), None, 1))
    got = fused(spark, rows, clients=[(c, 1, 3) for c in ("a", "b", "c", "d", "bad")])
    quality = {q[1]: q for q in got.quality if q[0] == "weight"}
    assert quality["bad"][2] < quality["a"][2] and quality["bad"][3] < quality["a"][3]


def test_two_truths_are_retained_and_records_are_built(spark):
    """Each entity has two true weights, of which every good source knows one or both, and what two bad sources make up."""
    random.seed(21)
    rows, truth = [], {}
    for e in range(80):
        true = [float(1 + e % 40), float(50 + e % 40)]
        truth[f'"E{e}"'] = set(true)
        for c in "abcde":
            rows += [(c, f"e{e}", None, v, None, 2) for v in (true if random.random() < 0.6 else [random.choice(true)])]
        rows += [(c, f"e{e}", None, round(random.uniform(41, 49), 3), None, 9) for c in ("bad", "worse")]
    got = fused(spark, rows, clients=[(c, 1, 3) for c in "abcde"] + [("bad", 1, 3), ("worse", 1, 3)], ranked=False)
    assert 1 < got.iterations < survivors.ITERATIONS
    weight = {o: r[3] for o, r in enumerate(rows, 1)}
    kept = {}
    for r in got.facts.filter("posterior >= 0.5").collect():
        kept.setdefault(r.canonical_name, set()).add(weight[r.ord])
    right = sum(len(kept.get(n, set()) & t) for n, t in truth.items())
    assert right >= 0.95 * 160 and sum(map(len, kept.values())) <= right / 0.95
    picked = {r.canonical_name: weight[r.ord] for r in got.survivors.collect()}
    assert sum(picked[n] in t for n, t in truth.items()) == 80 and set(picked) == set(truth)
    assert got.survivors.agg(F.sum("retained")).first()[0] == sum(map(len, kept.values()))
    entities = spark.createDataFrame([(c, 0, o, n, "PERSON", d, w, h, None) for o, (c, n, d, w, h, _) in enumerate(rows, 1)], ENTITY)
    built = {r.canonical_name: (r.description, r.weight, r.source_chunk_hash) for r in survivors.merged_records(entities, got.survivors).collect()}
    assert built == {n: (None, w, None) for n, w in picked.items()}


# 2: names

def clusters(spark, rows):
    df = spark.createDataFrame(rows, "entity_name string, entity_type string")
    pairs = [(r.name_a, r.name_b) for r in names.spelling_pairs(names.link_names(df)).collect()]
    assert all(a < b for a, b in pairs) and len(set(pairs)) == len(pairs)
    return {frozenset(n.strip('"') for n in p) for p in pairs}


def test_variants_are_linked_and_others_are_not(spark):
    same = ["SEBASTIAN KLOTREVIN", "KLOTREVIN, SEBASTIAN", "DR. SEBASTIAN KLOTREVIN", "S. KLOTREVIN", "SEB KLOTREVIN", "SEBASTIAN KLOTERVIN", "SEBASTIAN Q. KLOTREVIN"]
    others = ["SEBASTIAN KLOTREVIN II", "WANDA KLOTREVIN", "SEBASTIAN KLOTREVIN LIBRARY", "UPPER KLOTREVIN", "SIEGE OF KLOTREVIN (1701)", "SIEGE OF KLOTREVIN (1702)"]
    found = clusters(spark, [(n, "PERSON") for n in same] + [(n, None) for n in others])
    assert found == {frozenset(p) for p in itertools.combinations(same, 2)}


def test_bodies_places_events(spark):
    groups = [["VUMPREL INSTITUTE OF BOTANY", "THE VUMPREL INST. OF BOTANY", "INSTITUTE OF BOTANY, VUMPREL", "VUMPREL INSTITUTE OF BOTANY GMBH"], ["VUMPREL INSTITUTE OF OPTICS"], ["LAKE DOSTREBIN", "DOSTREBIN, LAKE", "DOSTREBIN, L."], ["TREATY OF GANZOFIR (1650)", "GANZOFIR TREATY OF 1650", "1650 TREATY OF GANZOFIR"], ["TREATY OF GANZOFIR (1651)"]]
    found = clusters(spark, [(n, "GEO" if "DOSTREBIN" in n else "ORGANIZATION") for g in groups for n in g])
    assert found == {frozenset(p) for g in groups for p in itertools.combinations(g, 2)}


def test_ambiguous_initials_link_nothing(spark):
    assert clusters(spark, [("JOHANNES KLOTREVIN", "PERSON"), ("JOSEFINA KLOTREVIN", "PERSON"), ("J. KLOTREVIN", "PERSON")]) == set()


def test_names_edge_cases(spark):
    assert clusters(spark, []) == set()
    assert clusters(spark, [(None, "PERSON"), ("", None), ('""', "X"), ("x" * 20_000, None), ("x" * 20_000, None), ("...", None), ("12", "GEO")]) == set()


def test_hot_words_lose_no_link(spark, monkeypatch):
    random.seed(11)
    given = ["".join(random.choice("BDGKLMNRT") + random.choice("AEIOU") for _ in range(3)) + "X" for _ in range(70)]
    crowd = [f"{g} KLOTREVIN" for g in given] + [f"JOHN {g}SKY" for g in given] + [f"ROBERT {g}SEN" for g in given]
    twins = [("J. VUMPREL", "JAMES VUMPREL"), ("Q. KLOTREVIN", "QUENTIN KLOTREVIN"), ("BOB KLOTREVIN", "ROBERT KLOTREVIN"), ("JOHN KLOTREVIN", "JOHN KLOTERVIN"), ("JOHN KLOTREVIN", "JOHNN KLOTREVIN"), ("KLOTREVIN INSTITUTE OF BOTANY", "KLOTREVIN INST. OF BOTANY"), ("KLOTREVIN UIB", "UNIVERSITY INSTITUTE OF BOTANY, KLOTREVIN"), ("JOHN ZED.", "JOHN Z.")]
    rows = [(n, "PERSON") for n in crowd] + [(n, None) for t in twins for n in t]
    listed = names.distinct_names(spark.createDataFrame(rows, "entity_name string, entity_type string"))
    found = {most: {tuple(r) for r in names.graded_links(listed.filter("kind is null or kind = 'PERSON'")).collect()} for most in (2, 64, 10**9) if not monkeypatch.setattr(names, "COMMON", most)}
    assert found[64] == found[10**9] == found[2]
    linked = {frozenset((a.strip('"'), b.strip('"'))) for a, b, _ in found[64]}
    assert {frozenset(t) for t in twins if "ZED." not in t[0]} <= linked


def test_words_of_a_kind_are_learned(spark):
    random.seed(14)
    cores = ["".join(random.choice("BDGKLMNRT") + random.choice("AEIOU") for _ in range(4)) for _ in range(60)]
    rows = [(f"{c} BREWERY", "ORGANIZATION") for c in cores[:30]] + [(f"ORDER OF {c}", "EVENT") for c in cores[20:40]] + [(f"JOHN {c}", "PERSON") for c in cores] + [(f"{cores[0]} {x}", "GEO") for x in ("LAKE", "ISLAND", "VALLEY", "HEATH", "MARSH", "BRIDGE", "CASTLE", "FOREST", "HARBOUR")]
    rows += [(f"{c} BREWERY", "ORGANIZATION") for c in ("VUMPREL", "VUMPRL")] + [("VUMPREL BREWRY", None)]
    listed = names.distinct_names(spark.createDataFrame(rows, "entity_name string, entity_type string"))
    assert names.learned_kinds(listed) == {"BREWERY", "ORDER"}
    assert names.learned_kinds(listed.limit(0)) == frozenset()
    linked = {frozenset((r.name_a.strip('"'), r.name_b.strip('"'))) for r in names.graded_links(listed).collect()}
    assert {frozenset(("VUMPREL BREWERY", "VUMPRL BREWERY")), frozenset(("VUMPREL BREWERY", "VUMPREL BREWRY"))} <= linked
    assert not any("BREWERY" in a and "BREWERY" in b and "VUMPR" not in a for a, b in map(sorted, linked))


def test_near_words_are_exact(spark):
    random.seed(3)
    words = {"".join(random.choice("ABCDE") for _ in range(random.randint(3, 9))) for _ in range(150)}
    words |= {w[:2] + w[3:] for w in list(words)[:40]} | {w[:1] + w[2:3] + w[1:2] + w[3:] for w in list(words)[:40]} | {"ÀÉÎÕÜ", "ÀÉÎÕ", "ЖДАНОВ", "ЖДАНОФ"}
    common.ship(spark)
    got = {tuple(r) for r in names.near_words(spark.createDataFrame([(w,) for w in words], "key string")).collect()}
    brute = {(a, b) for a in words for b in words if a < b and min(len(a), len(b)) >= 4 and name_forms.distance(a, b) <= (1 if min(len(a), len(b)) < 7 else 2)}
    assert got == brute


def test_distance_is_a_metric():
    random.seed(5)
    w = ["".join(random.choice("ab") for _ in range(random.randint(0, 6))) for _ in range(25)]
    for a, b, c in itertools.product(w[:12], repeat=3):
        assert name_forms.distance(a, c) <= name_forms.distance(a, b) + name_forms.distance(b, c)
    assert name_forms.distance("ca", "abc") == 2 and name_forms.distance("", "ab") == 2


@pytest.mark.parametrize("rows", [1, 10, 1000])
def test_a_slip_stays_one_on_larger_tables(rows):
    def grade(a, b, n, m):
        return name_forms.match(name_forms.read(a), name_forms.read(b), {a.split()[0]: n * rows, "VUMPREL": 2 * rows}, {b.split()[0]: m * rows, "VUMPREL": 2 * rows})

    assert grade("KATHARNIA VUMPREL", "KATHARINA VUMPREL", 4, 120) == name_forms.STRONG
    assert grade("EDDA VUMPREL", "HEDDA VUMPREL", 34, 16) == grade("BASTIAN VUMPREL", "BASTIEN VUMPREL", 13, 356) == grade("LIZ VUMPREL", "LIV VUMPREL", 8, 299) == 0


# 3: answers

def said(answer, end="<|im_end|>"):
    return f"<|im_start|>assistant\n<think>t</think>\n<answer>{answer}</answer>{end}"


Q = "Who founded Vumprel Observatory?"


@pytest.mark.parametrize("prediction, kind", [
    (None, "empty"), ("  ", "empty"), (said(""), "empty"), (said("…"), "empty"), ("<|im_start|>assistant\n<|im_end|>", "empty"),
    ("<|im_start|>assistant\n<think>I need to", "truncated"), ("<|im_start|>assistant\n<answer>Vumprel Obs", "truncated"), (said("Vumprel Observatory was founded by Seb"), "truncated"), (said("Seb Klotrevin founded it in 1900 (see"), "truncated"),
    (said("I cannot answer this question."), "refusal"), (said("Unfortunately, I don't know at this time."), "refusal"), (said("Je ne peux pas répondre à cette question."), "refusal"),
    (said(Q), "copy"), (said(Q.upper()), "copy"), (said("You asked: " + Q[:-1] + "."), "copy"), (said(Q + " " + Q), "copy"),
    (said("Das Archiv von Vumprel befindet sich in Lake Dostrebin."), "language"), (said("Архив Vumprel хранится в Dostrebin."), "language"),
    (said("Sebastian Klotrevin"), None), (said("sebastian klotrevin"), None), (said(Q + " Sebastian Klotrevin"), None), (said("It was Sebastian Klotrevin who established Vumprel Observatory.", ""), None),
    (said("The sources do not say so directly, but it was Sebastian Klotrevin."), None), (said("I cannot find a second candidate, hence Sebastian Klotrevin."), None), (said("1900"), None),
])
def test_defects(prediction, kind):
    assert answers.defect(Q, prediction, ["Sebastian Klotrevin"]) == kind


LONG = " ".join(f"reason{i} is given here." for i in range(200))


@pytest.mark.parametrize("answer, kind", [
    ("I cannot answer this question. " + LONG, "refusal"), (LONG + " Hence I am unable to answer.", "refusal"), ("I know of " + "one thing and " * 150 + "yet I don't have the information", "refusal"), (LONG, None),
    ("I'm afraid this falls outside my remit.", "refusal"), ("We lack the evidence needed to respond.", "refusal"), ("Our sources are insufficient to confirm this.", "refusal"), ("I Can't Help Falling in Love", None),
    ("Beyond my notes I cannot say more, but it was Sebastian Klotrevin.", None), ("Arkivet i Vumprel ligger i Lake Dostrebin.", "language"), ("Το αρχείο βρίσκεται στη Λίμνη.", "language"), ("Λίμνη Dostrebin", None),
    (" ".join([Q] * 60), "copy"), (" ".join([Q[:-1] + ", " + Q] * 40), "copy"),
])
def test_defects_at_any_length(answer, kind):
    assert answers.defect(Q, said(answer), []) == kind


def test_common_subsequence():
    random.seed(6)
    for _ in range(200):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert answers.common_subsequence(a, b) == row[-1]


def test_defects_of_a_frame(spark):
    rows = [(1, Q, None, None, "x"), (1, None, said("I must decline to answer."), [None], "x"), (2, "", said("fine"), [], "x"), (3, Q, said("word " * 50_000 + "."), None, "x")]
    df = spark.createDataFrame(rows, "result_id long, question string, prediction string, golden_answers array<string>, defect string")
    assert sorted((r.result_id, r.defect) for r in answers.defective_answers(df, ["result_id"]).collect()) == [(1, "empty"), (1, "refusal")]
    assert answers.defective_answers(df.limit(0), ["result_id"]).count() == 0


# 4: near duplicates

def brute_pairs(rows, width, threshold):
    def grams(passages):
        out = set()
        for p in passages or ():
            w = near_words_of(p) if p else []
            out |= {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        return out

    import re

    def near_words_of(p):
        return re.findall(r"[^\W_]+", p.lower())

    sets = [(i, grams(p)) for i, p in rows]
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(sets, key=lambda s: s[0]), 2) if x and y and len(x & y) / len(x | y) >= threshold}


def test_similar_pairs_are_exact(spark):
    random.seed(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Çédille", "ΔΩ", "x2"]
    rows = []
    for i in range(60):
        base = [random.choice(vocabulary) for _ in range(random.choice([4, 12, 40, 80]))]
        rows.append((len(rows), [" ".join(base)]))
        for _ in range(random.randint(0, 3)):
            other = list(base)
            for _ in range(random.randint(0, 3)):
                other[random.randrange(len(other))] = random.choice(vocabulary)
            rows.append((len(rows), [" ".join(other[: len(other) // 2]), None, ", ".join(other[len(other) // 2 :])]))
    rows += [(len(rows), None), (len(rows) + 1, []), (len(rows) + 2, [""]), (len(rows) + 3, ["one two"]), (len(rows) + 4, ["a b c d " * 20_000])]
    df = spark.createDataFrame(rows, "result_id long, context array<string>").withColumn("key", F.lit("clash")).withColumn("id", F.lit(0))
    for width, threshold in ((3, 0.7), (5, 0.8), (2, 0.5)):
        got = {tuple(r) for r in near_duplicates.similar_pairs(df, "result_id", "context", width, threshold).collect()}
        assert got == brute_pairs(rows, width, threshold)
    assert near_duplicates.similar_pairs(df.limit(0), "result_id", "context").count() == 0


def test_copies_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(i, [text]) for i in range(40)] + [(99, [text + " more"])], "result_id long, context array<string>")
    members, pairs = near_duplicates.similar_classes(df, "result_id", "context", 3, 0.7)
    assert members.count() == 41 and members.select("key").distinct().count() == 2 and pairs.count() == 1


@pytest.mark.parametrize("size", [40, 100, 300, 1000, 3000])
def test_tables_discard_unrelated_pairs_and_no_near_one(size):
    draw = np.random.Generator(np.random.PCG64(size))
    blocks = near_duplicates.blocks_of(size)
    sets = draw.integers(0, 1 << 64, (80, size), np.uint64)
    near = sets.copy()
    change = int(0.17 * size)  # the similarity stays above 0.7
    near[:, :change] = draw.integers(0, 1 << 64, (80, change), np.uint64)
    far, other = (np.stack([near_duplicates.coordinates(near_duplicates.sketch(x, blocks)) for x in y]) for y in (sets, near))
    radius = np.full(80, 0.3 / 1.7 * 2 * size)
    assert near_duplicates.within_tables(far, other, radius).all()
    discarded = 1 - near_duplicates.within_tables(far, np.roll(far, 1, axis=0), radius).mean()
    assert discarded > 0.9


def test_hot_shingles_are_joined_in_parts(spark, monkeypatch):
    random.seed(12)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, [common + " " + " ".join(random.choice("abcdef") + str(random.randint(0, 9)) for _ in range(random.choice([3, 6, 12])))]) for i in range(60)]
    df = spark.createDataFrame(rows, "result_id long, context array<string>")
    monkeypatch.setattr(near_duplicates, "HOT", 7)
    assert {tuple(r) for r in near_duplicates.similar_pairs(df, "result_id", "context", 3, 0.7).collect()} == brute_pairs(rows, 3, 0.7)


# 5: splitting

def test_pieces_give_the_text_back(spark):
    texts = ["a" * 5000, "ab " * 3000, "word\n\n" * 900, "😀" * 3333, "Dr. Smith met no. 7. " * 300, "é̂" * 1500, "one. " * 400 + "x" * 4000, "中文句子。" * 600, " " * 2000, None, "", "x" * 1600]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "id int, t string, piece_no int")
    rows = splitting.split_text(df, "t").collect()
    assert {r.id for r in rows} == set(range(9))
    for i in range(9):
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.piece_no)
        assert "".join(r.piece[r.overlap :] for r in own) == texts[i]
        assert all(len(r.piece) <= 1600 and r.overlap <= 160 and r.end_pos - r.start_pos == len(r.piece) - r.overlap for r in own)
        assert all(a.end_pos == b.start_pos and a.piece.endswith(b.piece[: b.overlap]) for a, b in zip(own, own[1:]))
    dr = [r.piece for r in rows if r.id == 4]
    assert not any(p.endswith(("Dr. ", "no. ")) for p in dr)
    assert splitting.split_text(df, "t", 100, 0).filter("overlap <> 0").count() == 0
    with pytest.raises(ValueError):
        splitting.split_text(df, "t", 10, 10)


def test_split_passages_edges(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, "short", "y " * 900])], "result_id long, context array<string>")
    assert {(r.result_id, r.passage_pos) for r in splitting.split_passages(df).collect()} == {(3, 2)}


# 6: encoding

def test_ids_equal_the_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(f"{common.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("other", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    texts = ["".join(random.choice("ab cdeéł\n\t  <|endoftext|>0123'sllŐ中😀") for _ in range(random.randint(0, 80))) for _ in range(200)]
    texts += ["<|endoftext|>", "", None, "a" * 100_000, " " * 5000, "don't we'LL"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id int, text string, ids int, other string")
    out = bpe.encode_texts(df)
    assert sorted(out.columns) == ["doc_id", "ids", "other"]
    got = {r.doc_id: list(r.ids) for r in out.collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in bpe.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode_texts(df.limit(0)).count() == 0


# 7: mixing

def test_mix_holds_shares_and_caps(spark):
    random.seed(4)
    rows = [(i, ["big"] if i % 10 else ["small"], random.randint(1, 60)) for i in range(3000)] + [(9000, None, 5), (9001, ["big"], 0), (9002, ["other"], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, tokens long")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.4, 3), ("m", "none", 0.1, 2), ("n", "none", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs, targets)
    got = {(r.mix_name, r.source): r for r in shares.collect()}
    assert got[("m", "big")].actual_share == pytest.approx(0.5 / 0.9, abs=0.005) and got[("m", "none")].actual_share == 0 and got[("n", "none")].documents == 0
    assert selection.filter("source = 'small'").agg(F.max("uses"), F.min("uses")).first() == (3, 3)
    assert selection.filter("source = 'big'").agg(F.max("uses")).first()[0] == 1
    again, _ = mixing.mix(docs.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))
    empty, none = mixing.mix(docs.limit(0), targets)
    assert empty.count() == 0 and none.count() == 4


def test_overlapping_sources_go_where_they_are_needed(spark):
    routes = mixing.solve({("a",): (100, 10), ("a", "b"): (100, 10)}, {"a": (0.5, 1), "b": (0.5, 1)})
    assert routes == {(("a",), "a"): 100, (("a", "b"), "b"): 100}
    assert mixing.solve({}, {"a": (1.0, 1)}) == {} and mixing.solve({("a",): (5, 1)}, {"a": (0.0, 1)}) == {}
    assert sum(mixing.solve({("a",): (10, 10), ("b",): (30, 30)}, {"a": (0.5, 3), "b": (0.5, 1)}).values()) == 60
    random.seed(8)
    rows = [(i, s, 10) for i in range(3000) for s in [[["a"], ["a", "b"], ["b", "c", "x"]][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.4, 1), ("m", "b", 0.3, 1), ("m", "c", 0.3, 1), ("n", "x", 0.5, 2), ("n", "a", 0.5, 1)], "mix_name string, source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs, targets)
    assert all(abs(r.deviation) < 0.01 for r in shares.collect())
    where, used = {r[0]: set(r[1]) for r in rows}, {}
    for r in selection.collect():
        assert r.source in where[r.doc_id]
        used[(r.mix_name, r.doc_id)] = used.get((r.mix_name, r.doc_id), 0) + r.uses
    assert max(n for (m, _), n in used.items() if m == "m") == 1 and max(used.values()) <= 2
    assert sum(1 for m, _ in used if m == "m") > 2500


def test_a_scarce_source_does_not_shrink_the_mix(spark):
    rows = [(i, ["a"], 100) for i in range(100)] + [(1000 + i, ["b"], 100) for i in range(100)] + [(5000, ["c"], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.4, 1), ("m", "b", 0.4, 1), ("m", "c", 0.2, 2)], "mix_name string, source string, target_share double, max_repeats int")
    _, shares = mixing.mix(docs, targets)
    got = {r.source: r for r in shares.collect()}
    assert [got[s].tokens for s in "abc"] == [10_000, 10_000, 14]
    assert got["a"].total_deviation == pytest.approx(sum(abs(r.actual_share - r.target_share) for r in got.values())) and got["a"].deviation == pytest.approx(got["a"].actual_share - 0.4)
    _, shares = mixing.mix(docs, targets, total=1000)
    assert [r.tokens for r in shares.orderBy("source").collect()] == [400, 400, 14]


def test_many_mixes_and_many_sources(spark):
    targets = spark.range(100_000).select((F.col("id") % 20_000).cast("string").alias("mix_name"), F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("source"), F.lit(0.2).alias("target_share"), F.lit(1).alias("max_repeats"))
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.array(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("sources"), F.lit(10).alias("tokens"))
    _, shares = mixing.mix(docs, targets)
    assert shares.count() == targets.select("mix_name", "source").distinct().count() and shares.filter("documents = 0").count() == 0
    one = mixing.solve({(f"s{i}",): (100, 10) for i in range(30_000)}, {f"s{i}": (1 / 30_000, 1) for i in range(30_000)})
    assert len(one) == 30_000 and set(one.values()) == {100}


def test_targets_with_holes(spark):
    docs = spark.createDataFrame([(1, ["a", None, "a"], 10), (None, ["a"], 10), (2, [], 10), (3, ["a"], None)], "doc_id long, sources array<string>, tokens long").withColumn("source", F.lit("clash"))
    nan = float("nan")
    targets = spark.createDataFrame([("m", "a", 1.0, 3), ("m", "a", 0.5, 1), ("m", "b", nan, 2), ("m", "c", None, None), (None, "a", 1.0, 1), ("n", None, 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    selection, shares = mixing.mix(docs, targets)
    assert [tuple(r) for r in selection.collect()] == [("m", "a", 1, 3)] and sorted(r.source for r in shares.collect()) == ["a", "b", "c"]
    assert mixing.mix(docs, targets.limit(0))[1].count() == 0


# 8: garbled text

@pytest.mark.parametrize("wrong, right, text", [
    ("cp1252", "utf-8", "La mère était née à l’été de 1900."), ("mac_roman", "utf-8", "La mère était née."), ("cp437", "utf-8", "für die größte Brücke"), ("cp850", "utf-8", "für die Brücke"),
    ("cp1251", "cp1252", "La mère était née"), ("mac_roman", "cp1252", "possédait des forêts"), ("cp437", "cp1252", "größte Brücke für"), ("cp1252", "cp1250", "zatrudniało własną część"), ("cp1252", "cp1251", "По словам жителей построил мост"),
    ("koi8_r", "cp1251", "Первое издание вышло в 1830 году и было посвящено"), ("cp1252", "gb18030", "当地居民认为修建了这座桥。"),
])
def test_garbled_text_is_restored(wrong, right, text):
    garbled = "".join(bytes([b]).decode(wrong) if b in _defined(wrong) else chr(b) for b in text.encode(right))
    assert mojibake.repair(garbled)[0] == text and mojibake.repair(text) is None


def _defined(codec):
    out = set(range(0x80))
    for b in range(0x80, 0x100):
        try:
            bytes([b]).decode(codec)
            out.add(b)
        except UnicodeDecodeError:
            pass
    return out


def test_twice_garbled_and_partly_garbled():
    twice = "née à".encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(f"Plain text. {twice} – “sound” part é.")[0] == "Plain text. née à – “sound” part é."
    assert mojibake.repair("La m�re")[1] == "lost"


@pytest.mark.parametrize("times", [1, 3, 6, 9])
def test_text_garbled_any_number_of_times(times):
    text = garbled = "La mère était née."
    for _ in range(times):
        garbled = garbled.encode().decode("latin-1")
    assert mojibake.repair(garbled)[0] == text


def test_quotations_are_kept_where_the_rest_is_restored():
    sound, quoting = "La mère était née à Dostrebin.", "The old ledger showed Ã¼ and “â€œ” there."
    garbled = "".join(bytes([b]).decode("cp1252") if b in _defined("cp1252") else chr(b) for b in sound.encode())
    assert mojibake.repair(quoting) is None
    assert mojibake.repair(f"{quoting} {garbled} Plain.\n{quoting}")[0] == f"{quoting} {sound} Plain.\n{quoting}"
    assert mojibake.repair("Il va Ã\xa0 Dostrebin.")[0] == "Il va à Dostrebin." and mojibake.repair("Der Pfad â€“ so heiÃŸt er.")[0] == "Der Pfad – so heißt er."
    own = chr(0xF0000)
    assert mojibake.repair(f"{own} {garbled}")[0] == f"{own} {sound}"


@pytest.mark.parametrize("text", [
    "In the margin stood Ã© and nothing else.", "Somebody typed Ã± twice.",
    "The clerk's manual explains that the sign pair Ã© appears when bytes are read in the wrong code page.", "As an example of a reading fault the handbook prints â€œ beside the correct letter.",
    "Łódź, Æbelø, Þórshöfn, Ærø, Öland.", "┌────┬────┐ table ruled by hand └────┴────┘", "Marks seen on the plate: © ® ¶ § † ‡ ¬ ± × ÷.", "The inscription reads «ÀÂÇÈÉÊËÎÏÔÙÛÜŸ».", "Tấm biển ghi: ÂU CƠ, ĐÊ ĐIỀU.",
    "NÃO ENTRAR, SÃO SETE DEGRAUS", "Pricelist: ¢5, ¥7, €9, ½ crown, 30°.", "नमस्ते مرحبا 안녕", "По словам жителей, СССР построил мост.", "ПЕРВОЕ ИЗДАНИЕ", "", None, "plain", "été", "x²", "10 µm", "naïve “Anna” – £20 … d’été",
])
def test_sound_text_is_left(text):
    assert mojibake.repair(text) is None


def test_garbled_frame(spark):
    df = spark.createDataFrame([(1, "fÃ¼r", "x"), (1, "fÃ¼r", "x"), (2, None, "x"), (3, "", "x"), (4, "é" * 100_000 + " Ã©", "x")], "doc_id long, text string, how string")
    rows = mojibake.garbled_texts(df).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 4] and rows[0].restored == "für"
    assert mojibake.garbled_texts(df.limit(0)).count() == 0


# all

def test_columns_of_the_queries(spark):
    want = {"p1_found": ["canonical_name", "field", "ord"], "p2_found": ["name_a", "name_b"], "p3_found": ["result_id", "defect"], "p4_found": ["result_id_a", "result_id_b"], "p5_found": ["result_id", "passage_pos"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    have = queries.queries()
    for name, columns in want.items():
        df = have[name](spark, SF)
        assert df.columns == columns, name
        df.collect()
    assert isinstance(have["p6_ids"](spark, SF).schema["ids"].dataType.elementType, T.IntegerType)
