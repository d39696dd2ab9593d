"""Row scores over responses and over long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks import duck
from checks.harness import Tables, query, spread
from edulake.functions import lexicon as lx
from edulake.functions import text as tx
from edulake.operators import errors, judge, scoring


def responses(t: Tables) -> DataFrame:
    return spread(t.responses)


def documents(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text"))


def pairs(t: Tables) -> DataFrame:
    """Every document with one of the benchmark items, which are all used."""
    items = t.benchmark.select("item_id", F.col("text").alias("gt_answer"))
    return spread(t.documents).join(items, F.col("doc_id") % items.count() == F.col("item_id")).select(
        F.col("doc_id").alias("sample_id"), F.col("text").alias("response"), "gt_answer"
    )


def both() -> tuple[Column, Column]:
    return F.col("response"), F.col("gt_answer")


_FLAGS = f"""SELECT sample_id, contains(response, gt_answer) AS contained, contains(left(response, 50), gt_answer) AS in_prefix,
    list_has_any({duck.words('gt_answer')}[:10], {duck.words('response')}[:20]) AS overlap,
    {duck.any_of('response', lx.STEP_WORDS)} AS steps, {duck.any_of('response', lx.GUIDANCE_WORDS)} AS guidance,
    {duck.any_of('response', lx.GUIDANCE_WORDS_SCIENCE)} AS guidance_science,
    {' + '.join(f"CAST(contains(response, '{w}') AS INTEGER)" for w in lx.STEP_WORDS)} >= 2 AS steps_strict,
    length(response) AS chars FROM """


def _flags(df: DataFrame) -> DataFrame:
    r, g = both()
    return df.select(
        "sample_id",
        scoring.answer_contained(r, g).alias("contained"),
        scoring.answer_in_prefix(r, g).alias("in_prefix"),
        scoring.token_overlap(r, g).alias("overlap"),
        scoring.step_flag(r).alias("steps"),
        tx.contains_any(r, lx.GUIDANCE_WORDS).alias("guidance"),
        tx.contains_any(r, lx.GUIDANCE_WORDS_SCIENCE).alias("guidance_science"),
        scoring.step_flag(r, at_least=2).alias("steps_strict"),
        F.length(r).alias("chars"),
    )


@query("flags_responses", _FLAGS + "@responses", longs=["sample_id", "chars"])
def flags_responses(t: Tables) -> DataFrame:
    return _flags(responses(t))


@query("flags_documents", _FLAGS + "@text_pairs", longs=["sample_id", "chars"])
def flags_documents(t: Tables) -> DataFrame:
    return _flags(pairs(t))


@query("normalize_text_responses", f"SELECT sample_id, {duck.normalize('response')} AS normal FROM @responses", longs=["sample_id"])
def normalize_text_responses(t: Tables) -> DataFrame:
    return responses(t).select("sample_id", tx.normalize_text(F.col("response")).alias("normal"))


@query("normalize_text_documents", f"SELECT doc_id, md5({duck.normalize('text')}) AS normal_md5 FROM @documents", longs=["doc_id"])
def normalize_text_documents(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("normal_md5"))


@query(
    "keywords_responses",
    f"SELECT sample_id, array_to_string(list_sort({duck.keywords('response')}), ',') AS keywords FROM @responses",
    longs=["sample_id"],
)
def keywords_responses(t: Tables) -> DataFrame:
    return responses(t).select("sample_id", F.array_join(F.array_sort(tx.keywords(F.col("response"))), ",").alias("keywords"))


@query(
    "keywords_documents",
    f"SELECT doc_id, len({duck.keywords('text')}) AS n_keywords, len({duck.tokens('text')}) AS n_tokens, len({duck.numbers('text')}) AS n_numbers FROM @documents",
    longs=["doc_id", "n_keywords", "n_tokens", "n_numbers"],
)
def keywords_documents(t: Tables) -> DataFrame:
    text = F.col("text")
    return documents(t).select(
        "doc_id",
        F.size(tx.keywords(text)).alias("n_keywords"),
        F.size(tx.tokens(text)).alias("n_tokens"),
        F.size(tx.numbers(text)).alias("n_numbers"),
    )


@query(
    "tokens_responses",
    f"""SELECT sample_id, array_to_string({duck.tokens('response')}, ' ') AS tokens FROM @responses""",
    longs=["sample_id"],
)
def tokens_responses(t: Tables) -> DataFrame:
    return responses(t).select("sample_id", F.array_join(tx.tokens(F.col("response")), " ").alias("tokens"))


@query(
    "tfidf_documents",
    f"""WITH src AS (SELECT sample_id, {duck.tokens(duck.normalize('gt_answer'))} AS l, {duck.tokens(duck.normalize('response'))} AS r FROM @text_pairs),
        {duck.tfidf_cte('src', 'l', 'r')} SELECT sample_id, coalesce(semantic, 0) AS semantic FROM src LEFT JOIN cosine USING (sample_id)""",
    doubles=["semantic"],
    longs=["sample_id"],
)
def tfidf_documents(t: Tables) -> DataFrame:
    r, g = both()
    return pairs(t).select(
        "sample_id", scoring.tfidf_cosine(tx.normal_tokens(g), tx.normal_tokens(r)).alias("semantic")
    )


_NUMBERS = f"SELECT sample_id, {duck.number_match('r', 'g')} AS number_score FROM (SELECT sample_id, {duck.numbers('response')} AS r, {duck.numbers('gt_answer')} AS g FROM "


@query("number_match_responses", _NUMBERS + "@responses)", doubles=["number_score"], longs=["sample_id"])
def number_match_responses(t: Tables) -> DataFrame:
    return responses(t).select("sample_id", scoring.number_match(*both()).alias("number_score"))


@query(
    "number_match_documents",
    f"SELECT sample_id, {duck.number_match('r', 'g')} AS number_score FROM (SELECT sample_id, {duck.numbers('response')} AS r, "
    f"{duck.numbers('''(gt_answer || ' 10 20.5 0')''')} AS g FROM @text_pairs)",
    doubles=["number_score"],
    longs=["sample_id"],
)
def number_match_documents(t: Tables) -> DataFrame:
    r, g = both()
    return pairs(t).select("sample_id", scoring.number_match(r, F.concat(g, F.lit(" 10 20.5 0"))).alias("number_score"))


def _accuracy(view: str) -> str:
    """CTEs that end in ``acc(sample_id, accuracy)``."""
    return f"""src AS (SELECT sample_id, response, gt_answer, {duck.tokens(duck.normalize('gt_answer'))} AS lt,
          {duck.tokens(duck.normalize('response'))} AS rt, {duck.numbers('response')} AS rn, {duck.numbers('gt_answer')} AS gn FROM @{view}),
        {duck.tfidf_cte('src', 'lt', 'rt')},
        acc AS (SELECT s.sample_id, CASE WHEN gt_answer = '' THEN 0.0 ELSE least(0.4 * {duck.keyword_recall('response', 'gt_answer')}
          + 0.4 * coalesce(semantic, 0) + 0.2 * {duck.number_match('rn', 'gn')}, 1.0) END AS accuracy
          FROM src s LEFT JOIN cosine c USING (sample_id))"""


@query("accuracy_responses", f"WITH {_accuracy('responses')} SELECT * FROM acc", doubles=["accuracy"], longs=["sample_id"])
def accuracy_responses(t: Tables) -> DataFrame:
    return responses(t).select("sample_id", scoring.accuracy_score(*both()).alias("accuracy"))


@query("accuracy_documents", f"WITH {_accuracy('text_pairs')} SELECT * FROM acc", doubles=["accuracy"], longs=["sample_id"])
def accuracy_documents(t: Tables) -> DataFrame:
    return pairs(t).select("sample_id", scoring.accuracy_score(*both()).alias("accuracy"))


def _single(name: str, column: str, duck_expr, spark_expr) -> None:
    @query(
        f"{name}_responses",
        f"SELECT sample_id, {duck_expr('response')} AS {column} FROM @responses",
        doubles=[column],
        longs=["sample_id"],
    )
    def on_responses(t: Tables) -> DataFrame:
        return responses(t).select("sample_id", spark_expr(F.col("response")).alias(column))

    long_expr = duck.fluency_linear if name == "fluency" else duck_expr

    @query(
        f"{name}_documents",
        f"SELECT doc_id, {long_expr('text')} AS {column} FROM @documents",
        doubles=[column],
        longs=["doc_id"],
    )
    def on_documents(t: Tables) -> DataFrame:
        return documents(t).select("doc_id", spark_expr(F.col("text")).alias(column))


_single("completeness", "completeness", duck.completeness, scoring.completeness_score)
_single("fluency", "fluency", duck.fluency, scoring.fluency_score)
_single("scaffolding", "scaffolding", duck.scaffolding, scoring.scaffolding_score)
_single("format", "format", duck.format_score, scoring.format_score)


def _reward(view: str, fluency) -> str:
    r = "response"
    return f"""WITH {_accuracy(view)} SELECT sample_id, accuracy, {duck.completeness(r)} AS completeness, {fluency(r)} AS fluency,
      {duck.scaffolding(r)} AS scaffolding, {duck.format_score(r)} AS format,
      0.30 * accuracy + 0.25 * {duck.completeness(r)} + 0.15 * {fluency(r)} + 0.20 * {duck.scaffolding(r)} + 0.10 * {duck.format_score(r)} AS reward
      FROM src JOIN acc USING (sample_id)"""


_REWARD_COLUMNS = ["accuracy", "completeness", "fluency", "scaffolding", "format", "reward"]


def _rewarded(df: DataFrame) -> DataFrame:
    dims = scoring.rule_dimensions(*both())
    scored = df.select("sample_id", *[c.alias(n) for n, c in dims.items()])
    total = scoring.weighted_sum({n: F.col(n) for n in dims}, lx.RULE_WEIGHTS)
    return scored.withColumn("reward", total)


@query("rule_reward_responses", _reward("responses", duck.fluency), doubles=_REWARD_COLUMNS, longs=["sample_id"])
def rule_reward_responses(t: Tables) -> DataFrame:
    return _rewarded(responses(t))


@query("rule_reward_documents", _reward("text_pairs", duck.fluency_linear), doubles=_REWARD_COLUMNS, longs=["sample_id"])
def rule_reward_documents(t: Tables) -> DataFrame:
    return _rewarded(pairs(t))


_DIMS = ("accuracy", "completeness", "fluency", "scaffolding", "format")
_JSON = r"regexp_extract(judge_output, '\{[^}]+\}')"
_RAW = ", ".join(f"try_cast(json_extract_string(j, '$.{d}') AS DOUBLE) AS {d}" for d in _DIMS)
_CLAMPED = ", ".join(f"CASE WHEN ok THEN greatest(0.0, least(10.0, {d})) END AS {d}" for d in _DIMS)
_OK = " AND ".join(f"{d} IS NOT NULL" for d in _DIMS)
_JUDGED = f"""SELECT sample_id, dataset, ok, {_CLAMPED} FROM (SELECT *, {_OK} AS ok FROM (SELECT sample_id, dataset, {_RAW}
   FROM (SELECT sample_id, dataset, CASE WHEN json_valid({_JSON}) THEN {_JSON} END AS j FROM @judged)))"""
_TOTAL = "coalesce((accuracy * 0.4 + completeness * 0.2 + scaffolding * 0.2 + fluency * 0.1 + format * 0.1) / 10, 0)"


@query("judge_scores", f"SELECT sample_id, {', '.join(_DIMS)} FROM ({_JUDGED})", doubles=list(_DIMS), longs=["sample_id"])
def judge_scores(t: Tables) -> DataFrame:
    scored = t.judged.withColumn("s", judge.judge_scores(F.col("judge_output")))
    return scored.select("sample_id", *[F.col("s")[d].alias(d) for d in _DIMS])


@query("judge_reward", f"SELECT sample_id, {_TOTAL} AS reward FROM ({_JUDGED})", doubles=["reward"], longs=["sample_id"])
def judge_reward(t: Tables) -> DataFrame:
    return judge.score(t.judged.withColumn("response", F.lit("")).withColumn("gt_answer", F.lit("")), judge.create_scorer("judged")).select(
        "sample_id", "reward"
    )


_FORMAT = "(CASE WHEN response = '' THEN 0.0 " + " ".join(
    f"WHEN regexp_matches(response, {duck.rx(p)}) THEN {v}" for p, v in lx.ANSWER_FORMATS
) + " ELSE 0.3 END)"


@query("answer_format", f"SELECT sample_id, {_FORMAT} AS answer_format FROM @responses", doubles=["answer_format"], longs=["sample_id"])
def answer_format(t: Tables) -> DataFrame:
    return t.responses.select("sample_id", judge.answer_format_score(F.col("response")).alias("answer_format"))


@query(
    "hybrid_reward",
    f"""WITH rule AS (SELECT sample_id, reward AS rule FROM ({_reward('responses', duck.fluency)})),
        judge AS (SELECT sample_id, {_TOTAL} AS judge FROM ({_JUDGED}))
        SELECT sample_id, 0.7 * judge + 0.2 * rule + 0.1 * {_FORMAT} AS hybrid, 0.49 * judge + 0.2 * rule + 0.1 * {_FORMAT} AS hybrid_scaled_twice
        FROM rule JOIN judge USING (sample_id) JOIN @responses USING (sample_id)""",
    doubles=["hybrid", "hybrid_scaled_twice"],
    longs=["sample_id"],
)
def hybrid_reward(t: Tables) -> DataFrame:
    """Both forms of the hybrid reward over rule and judge scores that are computed once."""
    r, g = both()
    scored = responses(t).join(t.judged.select("sample_id", "judge_output"), "sample_id").select(
        "sample_id",
        "response",
        scoring.rule_reward(r, g).alias("rule"),
        judge.judge_reward(judge.judge_scores(F.col("judge_output"))).alias("judge"),
    )
    return scored.select(
        "sample_id",
        judge.hybrid_reward(F.col("judge"), F.col("rule"), r).alias("hybrid"),
        judge.hybrid_reward(F.col("judge"), F.col("rule"), r, double_scale=True).alias("hybrid_scaled_twice"),
    )


@query("error_types", f"SELECT sample_id, {duck.error_type('response')} AS error_type FROM @responses", longs=["sample_id"])
def error_types(t: Tables) -> DataFrame:
    return t.responses.select("sample_id", errors.error_type(F.col("response")).alias("error_type"))


_WRONG = f"""SELECT dataset, sample_id, left(question, 200) AS question, left(gt_answer, 100) AS gt_answer,
   left(response, 300) AS model_response, {duck.error_type('response')} AS error_type FROM @responses WHERE NOT coalesce(is_correct, true)"""


@query("wrong_samples", _WRONG, longs=["sample_id"])
def wrong_samples(t: Tables) -> DataFrame:
    return errors.wrong_samples(t.responses)


_DISTRIBUTION = f"""SELECT error_type, count(*) AS count, CAST(printf('%.4f', count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS DOUBLE) AS ratio
   FROM ({_WRONG}) GROUP BY error_type"""


@query("error_distribution", _DISTRIBUTION, doubles=["ratio"], longs=["count"])
def error_distribution(t: Tables) -> DataFrame:
    return errors.error_distribution(errors.wrong_samples(t.responses)).orderBy(F.desc("count"))


@query(
    "error_advice",
    f"SELECT d.*, a.recommendation FROM ({_DISTRIBUTION}) d JOIN (VALUES "
    + ", ".join(f"({duck.lit(k)}, {duck.lit(v)})" for k, v in lx.ERROR_ADVICE)
    + ") a(error_type, recommendation) USING (error_type)",
    doubles=["ratio"],
    longs=["count"],
)
def error_advice(t: Tables) -> DataFrame:
    return errors.recommendations(errors.error_distribution(errors.wrong_samples(t.responses)))


def _last(x: str) -> str:
    return f"try_cast(regexp_extract_all({x}, '-?{duck.NUMBER}')[-1] AS DOUBLE)"


@query(
    "numeric_match",
    f"SELECT sample_id, coalesce(abs({_last('response')} - {_last('gt_answer')}) <= 1e-3, false) AS numeric_match FROM @responses",
    longs=["sample_id"],
)
def numeric_match(t: Tables) -> DataFrame:
    return t.responses.select("sample_id", scoring.numeric_match(*both()).alias("numeric_match"))


def _final(x: str) -> str:
    return f"nullif(regexp_extract({x}, '答案[是为：:]+{duck.SPACE}*([A-D]|{duck.NUMBER})', 1), '')"


@query(
    "final_answer",
    f"""SELECT sample_id, {_final('response')} AS final_answer,
        coalesce({_final('response')} = {_final('gt_answer')}, false) AS final_match FROM @responses""",
    longs=["sample_id"],
)
def final_answer(t: Tables) -> DataFrame:
    r, g = both()
    return t.responses.select(
        "sample_id", scoring.final_answer(r).alias("final_answer"), scoring.final_answer_match(r, g).alias("final_match")
    )


def _length_model():
    """A judge without weights: its scores follow from the length of its prompt."""

    def model(prompts):
        marks = [(len(p) % 11, len(p) % 7, len(p) % 5, len(p) % 10, len(p) % 13) for p in prompts]
        return [
            f'{{"accuracy": {a}, "completeness": {c}, "scaffolding": {s}, "fluency": {f}, "format": {m}}}' if a else "no scores"
            for a, c, s, f, m in marks
        ]

    return model


_MODEL_TOTAL = """CASE WHEN n % 11 = 0 THEN 0 ELSE ((n % 11) * 0.4::DOUBLE + (n % 7) * 0.2::DOUBLE + (n % 5) * 0.2::DOUBLE
   + (n % 10) * 0.1::DOUBLE + least(n % 13, 10) * 0.1::DOUBLE) / 10 END"""
_PROMPTS = f"SELECT sample_id, length({duck.judge_template('question', 'response', 'gt_answer')}) AS n FROM @responses"


@query("model_scores", f"SELECT sample_id, {_MODEL_TOTAL} AS reward FROM ({_PROMPTS})", doubles=["reward"], longs=["sample_id"])
def model_scores(t: Tables) -> DataFrame:
    return judge.score_with_model(t.responses, _length_model).select("sample_id", "reward")


_GROUPS = f"""SELECT sample_id, prompt_id, length({duck.judge_template('q', 'response', 'a')}) AS n FROM (SELECT *,
   first(question) OVER own AS q, first(gt_answer) OVER own AS a FROM @responses WINDOW own AS (PARTITION BY prompt_id ORDER BY sample_id))"""


@query(
    "model_group_scores",
    f"""SELECT prompt_id, array_to_string(list(printf('%.6f', CAST(reward AS DOUBLE)) ORDER BY sample_id), ' ') AS rewards
        FROM (SELECT sample_id, prompt_id, {_MODEL_TOTAL} AS reward FROM ({_GROUPS})) GROUP BY prompt_id""",
    longs=["prompt_id"],
)
def model_group_scores(t: Tables) -> DataFrame:
    """The candidates of every prompt, under the question and answer of the first of them, scored as one row."""
    candidates = F.sort_array(F.collect_list(F.struct("sample_id", "response")))
    groups = t.responses.groupBy("prompt_id").agg(
        F.min_by("question", "sample_id").alias("question"),
        F.min_by("gt_answer", "sample_id").alias("gt_answer"),
        F.transform(candidates, lambda c: c["response"]).alias("responses"),
    )
    scored = judge.score_groups(groups, "prompt_id", _length_model)
    text = F.transform("rewards", lambda r: F.format_string("%.6f", r))
    return scored.select("prompt_id", F.array_join(text, " ").alias("rewards"))
