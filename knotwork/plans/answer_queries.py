"""Queries of text functions, answers and rewards over ``results_step``."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import rewards, text
from knotwork.operators import evaluate
from knotwork.plans.base import query
from knotwork.sources.tables import table

SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
PUNCT = r"[!-/:-@\[-`{-~]"
WORDS = f"list_filter(regexp_split_to_array(%s, '{SPACES}'), lambda w: w <> '')"


def tok(x: str) -> str:
    return "list_filter(" + WORDS % f"regexp_replace(lower({x}), '{PUNCT}', '', 'g')" + ", lambda w: w NOT IN ('a', 'an', 'the'))"


def rtok(x: str) -> str:
    return WORDS % rf"regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g')"


#: Python's strip() in SQL.
STRIP = r"regexp_replace(regexp_replace(%s, '^" + SPACES + r"', ''), '" + SPACES + r"$', '')"
LAST = "CASE WHEN len(string_split(prediction, '</answer>')) >= 2 THEN replace(" + STRIP % "list_last(string_split(list_extract(string_split(prediction, '</answer>'), -2), '<answer>'))" + ", chr(10), ' ') END"
ANSWERED = f"a AS (SELECT *, {LAST} AS answer FROM results_step)"
SCORED = f"""{ANSWERED}, t AS (SELECT result_id, step, data_source, {tok("coalesce(answer, '')")} AS p, list_transform(coalesce(golden_answers, []), lambda g: {tok('g')}) AS gs FROM a),
 sc AS (SELECT result_id, step, data_source, coalesce(list_max(list_transform(gs, lambda g: CASE WHEN array_to_string(g, ' ') = array_to_string(p, ' ') THEN 1.0 ELSE 0.0 END)), 0.0) AS em,
  coalesce(list_max(list_transform(gs, lambda g: CASE WHEN coalesce(list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))), 0) > 0
   THEN 2.0 * list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))) / (len(g) + len(p)) ELSE 0.0 END)), 0.0) AS f1 FROM t)"""


def _answered(spark, d):  # noqa: ANN001, ANN202
    return table(spark, d, "results_step").withColumn("answer", text.last_answer(F.col("prediction")))


@query(f"WITH {ANSWERED} SELECT result_id, array_to_string({tok('answer')}, ' ') AS normalized FROM a")
def normalize_eval(spark, d):  # noqa: ANN001, ANN201
    return _answered(spark, d).select("result_id", text.normalize_answer(F.col("answer")).alias("normalized"))


@query(f"WITH {ANSWERED} SELECT result_id, array_to_string({rtok('answer')}, ' ') AS normalized FROM a")
def normalize_round(spark, d):  # noqa: ANN001, ANN201
    return _answered(spark, d).select("result_id", text.normalize_round(F.col("answer")).alias("normalized"))


@query(f"WITH {SCORED} SELECT result_id, em, round(f1, 6) AS f1 FROM sc")
def em_f1_multigold(spark, d):  # noqa: ANN001, ANN201
    return evaluate.answer_scores(_answered(spark, d)).select("result_id", "em", F.round("f1", 6).alias("f1"))


@query(f"WITH {SCORED} SELECT data_source, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, count(*) AS n FROM sc GROUP BY 1")
def corpus_scores(spark, d):  # noqa: ANN001, ANN201
    scored = evaluate.answer_scores(_answered(spark, d))
    return scored.groupBy("data_source").agg(F.round(F.avg("em"), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


@query(f"""WITH {ANSWERED}, t AS (SELECT result_id, list_distinct({rtok("coalesce(answer, '')")}) AS p, list_transform(coalesce(golden_answers, []), lambda g: list_distinct({rtok('g')})) AS gs FROM a)
 SELECT result_id, round(coalesce(list_max(list_transform(gs, lambda g: CASE WHEN len(list_intersect(g, p)) > 0 THEN 2.0 * len(list_intersect(g, p)) / (len(g) + len(p)) ELSE 0.0 END)), 0.0), 6) AS f1 FROM t""")
def f1_set(spark, d):  # noqa: ANN001, ANN201
    said = F.coalesce("answer", F.lit(""))
    return _answered(spark, d).select("result_id", F.round(text.best_of(F.col("golden_answers"), lambda g: text.f1_set(g, said)), 6).alias("f1"))


@query(f"""WITH t AS (SELECT result_id, {rtok("coalesce(array_to_string(list_filter(context, lambda c: c IS NOT NULL), ' '), '')")} AS c, list_transform(coalesce(golden_answers, []), lambda g: {rtok('g')}) AS gs FROM results_step)
 SELECT result_id, len(list_filter(gs, lambda g: contains(array_to_string(c, ' '), array_to_string(g, ' ')) OR len(list_intersect(g, c)) > 0)) > 0 AS hit FROM t""")
def recall_at_k(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "results_step")
    found = evaluate.recall_hit(F.coalesce("golden_answers", F.array().cast("array<string>")), F.coalesce(F.array_join("context", " "), F.lit("")))
    return r.select("result_id", found.alias("hit"))


#: Context against gold answers, of the rows that have a question and a gold answer that isn't empty; recall is by all rows.
RECALL = f"""t AS (SELECT result_id, question, {rtok("coalesce(array_to_string(list_filter(context, lambda c: c IS NOT NULL), ' '), '')")} AS c, list_transform(list_filter(coalesce(golden_answers, []), lambda g: g IS NOT NULL AND g <> ''), lambda g: {rtok('g')}) AS gs FROM results_step),
 h AS (SELECT len(list_filter(gs, lambda g: contains(array_to_string(c, ' '), array_to_string(g, ' ')) OR len(list_intersect(g, c)) > 0)) > 0 AS hit,
  list_max(list_transform(gs, lambda g: CASE WHEN array_to_string(g, ' ') = array_to_string(c, ' ') THEN 1.0 ELSE 0.0 END)) AS em,
  list_max(list_transform(gs, lambda g: CASE WHEN len(list_intersect(g, c)) > 0 THEN 2.0 * len(list_intersect(g, c)) / (len(list_distinct(g)) + len(list_distinct(c))) ELSE 0.0 END)) AS f1 FROM t WHERE question <> '' AND len(gs) > 0)"""


@query(f"""WITH {RECALL} SELECT round(count(*) FILTER (WHERE hit) / CAST((SELECT count(*) FROM results_step) AS DOUBLE), 6) AS recall, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, (SELECT count(*) FROM results_step) AS num_samples FROM h""")
def recall_summary(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "results_step").withColumn("text", F.coalesce(F.array_join("context", " "), F.lit("")))
    out = evaluate.recall_summary(r, "question", "golden_answers", "text")
    return out.select(*(F.round(c, 6).alias(c) for c in ("recall", "em", "f1")), "num_samples")


@query(r"""SELECT result_id, trim(list_extract(regexp_extract_all(prediction, '(?s)<answer>(.*?)</answer>', 1), 1), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS answer FROM results_step""")
def answer_extract(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", text.first_answer(F.col("prediction")).alias("answer"))


@query(f"WITH {ANSWERED} SELECT result_id, answer FROM a")
def last_answer_extract(spark, d):  # noqa: ANN001, ANN201
    return _answered(spark, d).select("result_id", "answer")


@query(r"""WITH q AS (SELECT result_id, list_extract(regexp_extract_all(prediction, '(?s)<query>(.*?)</query>', 1), 1) AS q FROM results_step) SELECT result_id, CASE WHEN json_valid(q) THEN json_extract_string(q, '$.query') END AS tool_query FROM q""")
def tool_call_extract(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", text.tool_query(F.col("prediction")).alias("tool_query"))


@query(r"""SELECT result_id, CASE WHEN contains(prediction, '</query>') THEN split_part(prediction, '</query>', 1) || '</query>' ELSE prediction END AS turn, len(regexp_extract_all(prediction, '(?s)<query>(.*?)</query>', 1)) AS calls FROM results_step""")
def first_call_truncation(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", text.first_call(F.col("prediction")).alias("turn"), F.size(text.bodies(F.col("prediction"), "query")).alias("calls"))


@query(r"""SELECT result_id, array_to_string(list_transform(regexp_extract_all(prediction, '(?s)<knowledge>(.*?)</knowledge>', 1), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), chr(10)) AS knowledge FROM results_step""")
def knowledge_extract(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", text.knowledge_text(F.col("prediction")).alias("knowledge"))


def _one(*tags: str) -> str:
    return " AND ".join(f"(length(b) - length(replace(b, '{t}', ''))) = {len(t)}" for t in tags)


#: Turns of a transcript, and those before the last that are a thought and a query with each tag once.
TURNS = r"""f AS (SELECT *, regexp_extract_all(prediction, '(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>', 1) AS bs, regexp_extract_all(prediction, '(?s)<\|im_start\|>user\n(.*?)<\|im_end\|>', 1) AS us FROM %s),
 g AS (SELECT *, list_filter(range(1, len(bs)), lambda i: length(bs[i]) - length(replace(bs[i], '<think>', '')) = 7 AND length(bs[i]) - length(replace(bs[i], '</think>', '')) = 8 AND length(bs[i]) - length(replace(bs[i], '<query>', '')) = 7
   AND length(bs[i]) - length(replace(bs[i], '</query>', '')) = 8 AND regexp_matches(bs[i], '(?s)^<think>(.*?)</think>\n<query>(.*?)</query>\n?$')) AS steps,
  CASE WHEN len(bs) > 0 AND regexp_matches(bs[len(bs)], '(?s)^<think>(.*?)</think>\n<answer>(.*?)</answer>\n?$') THEN 0.5 ELSE 0.0 END AS finish FROM f)"""
FORMAT = TURNS % "results_step" + """, fm AS (SELECT *, CASE WHEN prediction IS NULL OR len(bs) = 0 THEN 0.0 ELSE 0.5 * len(steps) + finish END AS fmt FROM g)"""
#: Scores of the first answer of the last turn.
LAST_TURN = f"""lt AS (SELECT *, list_extract(regexp_extract_all(bs[len(bs)], '(?s)<answer>(.*?)</answer>', 1), 1) AS answer FROM fm),
 lk AS (SELECT *, {tok("coalesce(answer, '')")} AS p, list_transform(coalesce(golden_answers, []), lambda g: {tok('g')}) AS gs FROM lt),
 ls AS (SELECT *, CASE WHEN answer IS NULL THEN 0.0 ELSE coalesce(list_max(list_transform(gs, lambda g: CASE WHEN array_to_string(g, ' ') = array_to_string(p, ' ') THEN 1.0 ELSE 0.0 END)), 0.0) END AS em,
  CASE WHEN answer IS NULL THEN 0.0 ELSE coalesce(list_max(list_transform(gs, lambda g: CASE WHEN coalesce(list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))), 0) > 0
   THEN 2.0 * list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))) / (len(g) + len(p)) ELSE 0.0 END)), 0.0) END AS f1 FROM lk)"""


#: Transcripts with tags set in and taken out, so that turns of every shape occur.
BENT = r"""(SELECT * REPLACE (CASE result_id % 7 WHEN 1 THEN replace(prediction, '<answer>', '<think></think><answer>') WHEN 2 THEN replace(prediction, '<answer>', '<answer><think>') WHEN 3 THEN replace(prediction, '</answer>', '</answer>' || chr(10))
 WHEN 4 THEN replace(prediction, '<knowledge>', '<knowledge>error ') WHEN 5 THEN replace(prediction, '<query>', '<query><query>') WHEN 6 THEN replace(prediction, '<|im_start|>user', '<|im_start|>tool') ELSE prediction END AS prediction) FROM results_step) AS bent"""


def _bent(spark, d):  # noqa: ANN001, ANN202
    changes = {1: ("<answer>", "<think></think><answer>"), 2: ("<answer>", "<answer><think>"), 3: ("</answer>", "</answer>\n"), 4: ("<knowledge>", "<knowledge>error "), 5: ("<query>", "<query><query>"), 6: ("<|im_start|>user", "<|im_start|>tool")}
    kind, out = F.pmod("result_id", F.lit(7)), F.col("prediction")
    for k, (a, b) in changes.items():
        out = F.when(kind == k, F.replace("prediction", F.lit(a), F.lit(b))).otherwise(out)
    return table(spark, d, "results_step").withColumn("prediction", out)


@query(f"WITH {FORMAT.replace('results_step', BENT)} SELECT result_id, fmt AS format_reward FROM fm")
def format_reward(spark, d):  # noqa: ANN001, ANN201
    return _bent(spark, d).select("result_id", rewards.format_score(F.col("prediction")).alias("format_reward"))


@query(f"WITH {FORMAT}, {LAST_TURN} SELECT result_id, em, round(f1, 6) AS f1 FROM ls")
def last_turn_scores(spark, d):  # noqa: ANN001, ANN201
    r = table(spark, d, "results_step").withColumn("answer", text.last_turn_answer(F.col("prediction")))
    return evaluate.answer_scores(r, missing=0.0).select("result_id", "em", F.round("f1", 6).alias("f1"))


@query(f"""WITH {FORMAT}, {LAST_TURN} SELECT result_id, CASE WHEN prediction IS NULL OR golden_answers IS NULL THEN 0.0 ELSE round(CASE WHEN least(fmt, 1.0) = 1.0 THEN f1 ELSE least(fmt, 1.0) - 1 END, 6) END AS reward FROM ls""")
def composite_reward(spark, d):  # noqa: ANN001, ANN201
    scored = evaluate.answer_scores(table(spark, d, "results_step").withColumn("answer", text.last_turn_answer(F.col("prediction"))), missing=0.0)
    known = F.col("prediction").isNotNull() & F.col("golden_answers").isNotNull()
    return scored.select("result_id", F.round(rewards.composite(rewards.format_score(F.col("prediction")), F.col("f1"), known), 6).alias("reward"))


#: A step counts if the user turn after it brings knowledge without an error; one that has no such turn makes all 0.
TOOL_FORMAT = r""", tf AS (SELECT *, list_extract(golden_answers, 1) AS truth, CASE WHEN prediction IS NULL OR len(bs) = 0 OR len(list_filter(steps, lambda i: i + 1 > len(us))) > 0 THEN 0.0
  ELSE 0.5 * len(list_filter(steps, lambda i: regexp_matches(us[i + 1], '(?s)<knowledge>.*?</knowledge>') AND NOT contains(regexp_extract(us[i + 1], '(?s)<knowledge>(.*?)</knowledge>', 1), 'error'))) + finish END AS fmt FROM g)"""


@query(f"WITH {TURNS % BENT}{TOOL_FORMAT} SELECT result_id, fmt AS format_reward FROM tf")
def tool_format_reward(spark, d):  # noqa: ANN001, ANN201
    return _bent(spark, d).select("result_id", rewards.tool_format_score(F.col("prediction")).alias("format_reward"))


@query(f"""WITH {TURNS % BENT}{TOOL_FORMAT}, num AS (SELECT *, list_last(regexp_extract_all(list_extract(regexp_extract_all(bs[len(bs)], '(?s)<answer>(.*?)</answer>', 1), 1), '(-?[0-9]+\\.?[0-9]*)', 1)) AS said FROM tf)
 SELECT result_id, CASE WHEN prediction IS NULL OR truth IS NULL THEN 0.0 WHEN fmt >= 1.0 THEN CASE WHEN said = truth THEN 1.0 ELSE 0.0 END ELSE fmt - 1 END AS reward FROM num""")
def tool_reward(spark, d):  # noqa: ANN001, ANN201
    return _bent(spark, d).select("result_id", rewards.tool_reward(F.col("prediction"), F.try_element_at("golden_answers", F.lit(1))).alias("reward"))


@query(r"""SELECT doc_id, coalesce(list_last(regexp_extract_all(text, '(-?[0-9]+\.?[0-9]*)', 1)) = CASE WHEN doc_id % 2 = 0 THEN regexp_extract(text, '([0-9]+)[^0-9]*$', 1) ELSE '7.0' END, false) AS right_number FROM documents""")
def last_number_check(spark, d):  # noqa: ANN001, ANN201
    truth = F.when(F.col("doc_id") % 2 == 0, F.regexp_extract("text", r"([0-9]+)[^0-9]*\z", 1)).otherwise("7.0")
    return table(spark, d, "documents").select("doc_id", text.ends_in(F.col("text"), truth).alias("right_number"))


RAW_F1 = f"""r AS (SELECT result_id, prediction, list_distinct({WORDS % "lower(list_extract(golden_answers, 1))"}) AS g, list_distinct({WORDS % "lower(coalesce(list_extract(regexp_extract_all(prediction, '(?s)<answer>(.*?)</answer>', 1), 1), prediction))"}) AS p FROM results_step),
 rf AS (SELECT *, CASE WHEN len(list_intersect(g, p)) > 0 THEN 2.0 * len(list_intersect(g, p)) / (len(g) + len(p)) ELSE 0.0 END AS f1 FROM r)"""


@query(f"WITH {RAW_F1} SELECT result_id, round(f1, 6) AS f1 FROM rf")
def f1_raw(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", F.round(text.f1_raw(F.try_element_at("golden_answers", F.lit(1)), F.col("prediction")), 6).alias("f1"))


@query(f"WITH {RAW_F1} SELECT result_id, round(f1 + CASE WHEN regexp_matches(prediction, '(?s)<think>.*?</think>') AND regexp_matches(prediction, '(?s)<answer>.*?</answer>') THEN 1.0 ELSE 0.0 END, 6) AS reward FROM rf")
def local_reward(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", F.round(rewards.local_reward(F.col("prediction"), F.try_element_at("golden_answers", F.lit(1))), 6).alias("reward"))


@query(f"""WITH {FORMAT}, l AS (SELECT result_id, fmt, len(string_split(question, ' ')) AS n FROM fm) SELECT result_id, array_to_string(list_transform(range(1, coalesce(n, 0) + 3), lambda i: CASE WHEN i = n THEN printf('%.1f', CASE WHEN result_id % 5 = 0 THEN 0.0 ELSE fmt END) ELSE '0.0' END), ',') AS rewards FROM l""")
def managed_rewards(spark, d):  # noqa: ANN001, ANN201
    n = F.size(F.split("question", " "))
    score = F.when(F.col("result_id") % 5 == 0, F.when(F.col("result_id") % 2 == 0, F.lit(float("nan")))).otherwise(rewards.format_score(F.col("prediction")))
    scored = rewards.managed(table(spark, d, "results_step"), score, n, F.coalesce(n, F.lit(0)) + 2)
    return scored.select("result_id", F.array_join(F.transform("rewards", lambda x: F.format_number(x, 1)), ",").alias("rewards"))


@query(r"""SELECT result_id, CASE WHEN regexp_matches(prediction, '(?s)<think>.*?</think>') AND regexp_matches(prediction, '(?s)<answer>.*?</answer>') THEN 1.0 ELSE 0.0 END AS local_format FROM results_step""")
def local_format_reward(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "results_step").select("result_id", rewards.local_format(F.col("prediction")).alias("local_format"))


@query(f"""WITH {ANSWERED}, t AS (SELECT result_id, array_to_string({tok("coalesce(answer, '')")}, ' ') AS p, list_transform(coalesce(golden_answers, []), lambda g: array_to_string({tok('g')}, ' ')) AS gs FROM a) SELECT result_id, len(list_filter(gs, lambda g: contains(p, g))) > 0 AS sub_em FROM t""")
def sub_em(spark, d):  # noqa: ANN001, ANN201
    said = F.coalesce("answer", F.lit(""))
    golds = F.coalesce("golden_answers", F.array().cast("array<string>"))
    return _answered(spark, d).select("result_id", F.coalesce(F.exists(golds, lambda g: text.contains_answer(g, said)), F.lit(False)).alias("sub_em"))


@query(r"""SELECT doc_id, list_last(regexp_extract_all(text, '(-?[0-9]+\.?[0-9]*)', 1)) AS last_number FROM documents""")
def last_number(spark, d):  # noqa: ANN001, ANN201
    return table(spark, d, "documents").select("doc_id", text.last_number(F.col("text")).alias("last_number"))


@query("""WITH m AS (SELECT step, round(avg(CASE WHEN NOT isnan(answer_f1_score) THEN answer_f1_score END), 9) AS mean_score FROM results_step WHERE step IS NOT NULL GROUP BY 1) SELECT step, mean_score FROM m ORDER BY mean_score DESC NULLS LAST, step DESC LIMIT 1""")
def best_step(spark, d):  # noqa: ANN001, ANN201
    return evaluate.best_step(table(spark, d, "results_step"))


@query("""WITH m AS (SELECT step, round(avg(CASE WHEN NOT isnan(answer_f1_score) THEN answer_f1_score END), 9) AS s FROM results_step WHERE step IS NOT NULL GROUP BY 1), b AS (SELECT step FROM m ORDER BY s DESC NULLS LAST, step DESC LIMIT 1)
 SELECT result_id, step FROM results_step WHERE step IN (SELECT step FROM b)""")
def results_of_best_step(spark, d):  # noqa: ANN001, ANN201
    return evaluate.at_best_step(table(spark, d, "results_step")).select("result_id", "step")


def _mean(c: str) -> str:
    return f"round(coalesce(avg(CASE WHEN NOT isnan({c}) THEN {c} END), 'nan'::DOUBLE), 6) AS {c}"


@query(f"SELECT data_source, {_mean('answer_f1_score')}, {_mean('answer_em_score')}, {_mean('format_score')}, {_mean('turns')}, {_mean('step')} FROM results_step GROUP BY 1")
def metrics_by_source(spark, d):  # noqa: ANN001, ANN201
    columns = ["answer_f1_score", "answer_em_score", "format_score", "turns", "step"]
    return evaluate.means_by(table(spark, d, "results_step"), ["data_source"], columns).select("data_source", *(F.round(c, 6).alias(c) for c in columns))


@query(f"SELECT {_mean('answer_f1_score')}, {_mean('answer_em_score')}, {_mean('format_score')} FROM results_step")
def overall_means(spark, d):  # noqa: ANN001, ANN201
    columns = ["answer_f1_score", "answer_em_score", "format_score"]
    return evaluate.means_by(table(spark, d, "results_step"), [], columns).select(*(F.round(c, 6).alias(c) for c in columns))


@query("""WITH b AS (SELECT question, max(CASE WHEN NOT isnan(answer_em_score) THEN answer_em_score END) AS s FROM results_step GROUP BY 1) SELECT round(count(*) FILTER (WHERE s = 1.0) / CAST(count(*) AS DOUBLE), 6) AS pass_at_n FROM b""")
def pass_at_n(spark, d):  # noqa: ANN001, ANN201
    return evaluate.pass_at_n(table(spark, d, "results_step"), ["question"], "answer_em_score").select(F.round("pass_at_n", 6).alias("pass_at_n"))


#: Rubric scores of lines: seven whole numbers from 0 to 10, one of them missing in some lines.
RUBRIC = "CASE WHEN l_linenumber = {k} THEN NULL ELSE (CAST(l_quantity AS INTEGER) * {k} + l_linenumber) % 11 END"


@query("WITH j AS (SELECT l_returnflag, round((" + " + ".join(f"coalesce({RUBRIC.format(k=k)}, 5)" for k in range(1, 8)) + ") / 70.0, 4) AS s FROM lineitem) SELECT l_returnflag, round(avg(s), 6) AS judge_score, count(*) AS n FROM j GROUP BY 1")
def judge_mean(spark, d):  # noqa: ANN001, ANN201
    scores = [F.when(F.col("l_linenumber") != k, F.pmod(F.col("l_quantity").cast("int") * k + F.col("l_linenumber"), F.lit(11))) for k in range(1, 1 + len(evaluate.RUBRICS))]
    judged = table(spark, d, "lineitem").select("l_returnflag", evaluate.judge_score(*scores).alias("s"))
    return judged.groupBy("l_returnflag").agg(F.round(F.avg("s"), 6).alias("judge_score"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT round(avg(CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE c END), 6) AS rsim FROM p""")
def response_similarity(spark, d):  # noqa: ANN001, ANN201
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("gold"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("gold").alias("said")), "vec_id").withColumn("knowledge", F.when(F.col("vec_id") % 3 != 0, "k").otherwise(""))
    return evaluate.similarity_mean(both, "gold", "said", "knowledge").select(F.round("rsim", 6).alias("rsim"))


@query("""WITH x AS (SELECT result_id, list_filter(context, lambda c: c IS NOT NULL) AS c FROM results_step) SELECT result_id, len(c) AS passages, len(list_distinct(c)) AS distinct_passages FROM x""")
def distinct_context(spark, d):  # noqa: ANN001, ANN201
    kept = F.filter("context", lambda c: c.isNotNull())
    return table(spark, d, "results_step").select("result_id", F.when(F.col("context").isNotNull(), F.size(kept)).alias("passages"), F.when(F.col("context").isNotNull(), F.size(evaluate.distinct_context(F.col("context")))).alias("distinct_passages"))
