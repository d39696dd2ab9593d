"""Summaries, intervals, comparisons, checks, weights, rollouts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import duck
from checks.harness import Tables, query, spread
from checks.queries_chat import d1
from edulake.functions import text as tx
from edulake.functions.poisson import BASE, BASE_BITS, MASK, PLACES, quantile_sql
from edulake.operators import bootstrap, chat, checks, compare, report, resample, rollout, runs, scoring, summary
from edulake.plans import evaluate, feedback

METRICS = ["accuracy", "step_completeness", "scaffolding_rate"]
_NEWEST = "(SELECT run_id FROM (SELECT DISTINCT run_id, ts FROM @run_table) ORDER BY ts DESC, run_id DESC LIMIT 1)"
_SECOND = "(SELECT run_id FROM (SELECT DISTINCT run_id, ts FROM @run_table) ORDER BY ts DESC, run_id DESC LIMIT 1 OFFSET 1)"


def latest(t: Tables, recency: int = 1) -> DataFrame:
    return runs.pick(t.run_table, runs.latest_runs(t.run_table, 2), recency)


# -- summaries ---------------------------------------------------------------------------------------------


@query(
    "dataset_summary",
    """SELECT run_id, dataset, count(*) AS total, avg(accuracy) AS accuracy, avg(step_completeness) AS step_completeness,
       avg(scaffolding_rate) AS scaffolding_rate FROM @eval_samples GROUP BY run_id, dataset""",
    doubles=METRICS,
    longs=["total"],
)
def dataset_summary(t: Tables) -> DataFrame:
    return summary.dataset_summary(t.eval_samples, ["run_id", "dataset"])


def _scored(view: str) -> str:
    return f"""SELECT dataset, sample_id, CAST(list_has_any({duck.words('gt_answer')}[:10], {duck.words('response')}[:20]) AS INTEGER) AS accuracy,
      CAST({duck.any_of('response', ('步骤', '首先', '然后', 'Step'))} AS INTEGER) AS step_completeness,
      CAST({duck.any_of('response', ('观察', '思考', '想一想'))} AS INTEGER) AS scaffolding_rate, length(response) AS response_length FROM @{view}"""


@query(
    "evaluate_responses",
    f"""SELECT dataset, count(*) AS total, avg(accuracy) AS accuracy, avg(step_completeness) AS step_completeness,
        avg(scaffolding_rate) AS scaffolding_rate, avg(response_length) AS avg_response_length FROM ({_scored('responses')}) GROUP BY dataset""",
    doubles=[*METRICS, "avg_response_length"],
    longs=["total"],
)
def evaluate_responses(t: Tables) -> DataFrame:
    return summary.dataset_summary(evaluate.score_responses(t.responses), length="response_length")


@query(
    "evaluate_rules",
    f"""SELECT dataset, count(*) AS total, avg(accuracy) AS accuracy, avg(step_completeness) AS step_completeness, avg(scaffolding_rate) AS scaffolding_rate
        FROM (SELECT * REPLACE (CAST(CASE WHEN dataset IN ('ds1', 'ds2') THEN contains(r.response, r.gt_answer) WHEN dataset = 'ds3' THEN contains(left(r.response, 50), r.gt_answer)
            ELSE accuracy = 1 END AS INTEGER) AS accuracy, CASE WHEN dataset IN ('ds1', 'ds2')
            THEN CAST({duck.any_of('r.response', ('观察', '思考', '想一想', '你能发现'))} AS INTEGER) ELSE scaffolding_rate END AS scaffolding_rate)
          FROM ({_scored('responses')}) s JOIN (SELECT dataset, sample_id, response, gt_answer FROM @responses) r USING (dataset, sample_id)) GROUP BY dataset""",
    doubles=METRICS,
    longs=["total"],
)
def evaluate_rules(t: Tables) -> DataFrame:
    """Three kinds of accuracy rules in one run."""
    rules = {"ds1": "contained", "ds2": "contained", "ds3": "prefix"}
    return summary.dataset_summary(evaluate.score_responses(t.responses, rules))


@query(
    "evaluation_errors",
    f"""SELECT error_type, count(*) AS count, CAST(printf('%.4f', count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)) AS DOUBLE) AS ratio
        FROM (SELECT {duck.error_type('response')} AS error_type FROM @responses JOIN ({_scored('responses')}) s USING (dataset, sample_id)
        WHERE s.accuracy <> 1) GROUP BY error_type""",
    doubles=["ratio"],
    longs=["count"],
)
def evaluation_errors(t: Tables) -> DataFrame:
    """Error classes of the responses that the whole evaluation flow finds wrong."""
    return evaluate.evaluate(t.responses).errors


_SLICE = f"""SELECT * FROM (SELECT 'ds' || (conv_id % 7) AS dataset, conv_id,
     coalesce({duck.strip("replace(max_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END), '<image>', '')")}, '') AS question,
     coalesce(max_by(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END), '') AS response
   FROM @conversations GROUP BY conv_id) WHERE length(question) > 0"""


@query(
    "conversation_report",
    f"""SELECT rank, dataset, total, fluency, format, response_length FROM (SELECT *, row_number() OVER (ORDER BY fluency, dataset) AS rank FROM
        (SELECT dataset, count(*) AS total, avg({duck.fluency('response')}) AS fluency, avg({duck.format_score('response')}) AS format,
         avg(length(response)) AS response_length FROM ({_SLICE}) GROUP BY dataset)) WHERE rank <= 5""",
    doubles=["fluency", "format", "response_length"],
    longs=["rank", "total"],
)
def conversation_report(t: Tables) -> DataFrame:
    """The five datasets of least fluent last answers."""
    answers = chat.with_question(chat.question_answer(t.conversations)).withColumnRenamed("gt_answer", "response")
    r = F.col("response")
    scored = answers.select(
        F.concat(F.lit("ds"), F.col("conv_id") % 7).alias("dataset"),
        scoring.fluency_score(r).alias("fluency"),
        scoring.format_score(r).alias("format"),
        F.length(r).alias("response_length"),
    )
    means = scored.groupBy("dataset").agg(
        F.count("*").alias("total"), *[F.avg(c).alias(c) for c in ("fluency", "format", "response_length")]
    )
    ranked = report.weakest_datasets(means.withColumn("accuracy", F.col("fluency"))).select("rank", "dataset")
    return ranked.join(means, "dataset")


_REWARDS = "SELECT dataset, reward FROM @responses"


@query(
    "reward_summary",
    f"""SELECT dataset, count(*) AS count, avg(reward) AS mean_reward, min(reward) AS min_reward, max(reward) AS max_reward,
        avg(CASE WHEN reward > 0.5 THEN 1.0 ELSE 0.0 END) AS share_above FROM ({_REWARDS}) GROUP BY dataset""",
    doubles=["mean_reward", "min_reward", "max_reward", "share_above"],
    longs=["count"],
)
def reward_summary(t: Tables) -> DataFrame:
    return summary.reward_summary(t.responses, ["dataset"])


_DIMENSIONS = f"""SELECT dataset, CAST(sample_id % 11 AS DOUBLE) / 10 AS accuracy, {duck.completeness('response')} AS completeness,
   {duck.fluency('response')} AS fluency, {duck.scaffolding('response')} AS scaffolding, {duck.format_score('response')} AS format FROM @responses"""
_PROFILE = f"""SELECT *, 0.30 * accuracy + 0.25 * completeness + 0.15 * fluency + 0.20 * scaffolding + 0.10 * format AS weighted_total
   FROM (SELECT dataset, avg(accuracy) AS accuracy, avg(completeness) AS completeness, avg(fluency) AS fluency,
   avg(scaffolding) AS scaffolding, avg(format) AS format FROM ({_DIMENSIONS}) GROUP BY dataset)"""
_PROFILE_COLUMNS = ["accuracy", "completeness", "fluency", "scaffolding", "format", "weighted_total"]


def _profile(t: Tables) -> DataFrame:
    r = F.col("response")
    dims = spread(t.responses).select(
        "dataset",
        (F.col("sample_id") % 11 / 10.0).alias("accuracy"),
        scoring.completeness_score(r).alias("completeness"),
        scoring.fluency_score(r).alias("fluency"),
        scoring.scaffolding_score(r).alias("scaffolding"),
        scoring.format_score(r).alias("format"),
    )
    return summary.dimension_profile(dims, ["dataset"])


@query("dimension_profile", _PROFILE, doubles=_PROFILE_COLUMNS)
def dimension_profile(t: Tables) -> DataFrame:
    return _profile(t)


@query(
    "dimension_profile_long",
    " UNION ALL ".join(f"SELECT dataset, '{c}' AS dimension, {c} AS score FROM ({_PROFILE})" for c in _PROFILE_COLUMNS),
    doubles=["score"],
)
def dimension_profile_long(t: Tables) -> DataFrame:
    return summary.long_profile(_profile(t), ["dataset"])


_MACRO = "SELECT run_id, avg(coalesce(accuracy, 0)) AS macro_accuracy FROM @run_table GROUP BY run_id"


@query("macro_mean", _MACRO, doubles=["macro_accuracy"])
def macro_mean(t: Tables) -> DataFrame:
    return summary.macro_mean(t.run_table)


@query(
    "weighted_accuracy",
    "SELECT run_id, sum(accuracy * total) / sum(total) AS weighted_accuracy FROM @run_table GROUP BY run_id",
    doubles=["weighted_accuracy"],
)
def weighted_accuracy(t: Tables) -> DataFrame:
    return summary.weighted_accuracy(t.run_table)


_CATEGORIES = """SELECT lang AS category, source AS dataset, count(*) FILTER (WHERE doc_id % 10 <> 0) AS train_rows,
  count(*) FILTER (WHERE doc_id % 10 = 0) AS eval_rows FROM @documents GROUP BY lang, source"""


@query(
    "category_rollup",
    f"""SELECT CASE WHEN grouping(category) = 1 THEN '合计' ELSE category END AS category, count(dataset) AS datasets,
        sum(train_rows) AS train_rows, sum(eval_rows) AS eval_rows FROM ({_CATEGORIES}) GROUP BY ROLLUP (category)""",
    longs=["datasets", "train_rows", "eval_rows"],
)
def category_rollup(t: Tables) -> DataFrame:
    sizes = t.documents.groupBy(F.col("lang").alias("category"), F.col("source").alias("dataset")).agg(
        F.count_if(F.col("doc_id") % 10 != 0).alias("train_rows"), F.count_if(F.col("doc_id") % 10 == 0).alias("eval_rows")
    )
    return summary.category_rollup(sizes)


@query(
    "accuracy_range",
    """SELECT run_id, count(*) AS datasets, min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy, avg(accuracy) AS mean_accuracy
       FROM @run_table GROUP BY run_id""",
    doubles=["min_accuracy", "max_accuracy", "mean_accuracy"],
    longs=["datasets"],
)
def accuracy_range(t: Tables) -> DataFrame:
    return summary.accuracy_range(t.run_table)


@query(
    "below_half",
    "SELECT run_id, count(*) FILTER (WHERE accuracy < 0.5) AS weak_datasets FROM @run_table GROUP BY run_id",
    longs=["weak_datasets"],
)
def below_half(t: Tables) -> DataFrame:
    return summary.below_half(t.run_table)


# -- bootstrap ---------------------------------------------------------------------------------------------


def _means(scores: str, by: str, replicates: int = 1000) -> str:
    """CTEs that end in ``means(by, n, b, mean)`` for the scores ``(by, value)``."""
    same = " AND ".join(f"m.{c} IS NOT DISTINCT FROM s.{c}" for c in by.split(", "))
    floor = "CAST(floor(value) AS BIGINT)"
    seed = duck.hash52(by, floor, f"CAST(floor((value - {floor}) * 1e9) AS BIGINT)", "place", "j")
    digit = f"CASE WHEN place = {PLACES - 1} THEN cnt >> (place * {BASE_BITS}) ELSE (cnt >> (place * {BASE_BITS})) & {BASE - 1} END"
    return f"""scores AS ({scores}),
      hist AS (SELECT {by}, value, count(*) AS cnt FROM scores GROUP BY ALL),
      sizes AS (SELECT {by}, sum(cnt) AS n FROM hist GROUP BY {by}),
      placed AS (SELECT *, unnest(range({PLACES})) AS place FROM hist),
      pieces AS (SELECT *, unnest(range({digit})) AS j FROM placed),
      seeded AS (SELECT *, 1 << (place * {BASE_BITS}) AS lam, {seed} & {MASK} AS seed FROM pieces),
      mixed AS (SELECT {by}, value, lam, b, ({duck.draw_number('seed', 'b')} + 0.5::DOUBLE) / {MASK + 1}::DOUBLE AS u
        FROM seeded, range({replicates}) AS r(b)),
      drawn AS (SELECT {by}, value, b, {quantile_sql('u', 'lam')} AS k FROM mixed),
      summed AS (SELECT {by}, b, sum(k * value) / nullif(sum(k), 0) AS mean FROM drawn GROUP BY {by}, b),
      means AS (SELECT m.*, s.n FROM summed m JOIN sizes s ON {same})"""


_MARKS = """SELECT dataset, 'first' AS metric, CAST(first_mark AS DOUBLE) AS value FROM @mark_pairs
   UNION ALL SELECT dataset, 'second', CAST(second_mark AS DOUBLE) FROM @mark_pairs"""
_INTERVALS = f"""WITH {_means(_MARKS, 'dataset, metric')}
   SELECT dataset, metric, max(n) AS n, CASE WHEN max(n) >= 5 THEN quantile_cont(mean, 0.025) ELSE 0 END AS lower,
   CASE WHEN max(n) >= 5 THEN quantile_cont(mean, 0.975) ELSE 0 END AS upper,
   CASE WHEN max(n) >= 5 THEN greatest(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), 0.001) ELSE 1 END AS p_value
   FROM means WHERE mean IS NOT NULL GROUP BY dataset, metric"""


def _marks(t: Tables) -> DataFrame:
    marks = t.mark_pairs.withColumnsRenamed({"first_mark": "first", "second_mark": "second"})
    return bootstrap.long_scores(marks, ["dataset"], ["first", "second"])


@query("bootstrap_intervals", _INTERVALS, doubles=["lower", "upper", "p_value"], longs=["n"])
def bootstrap_intervals(t: Tables) -> DataFrame:
    return bootstrap.confidence_intervals(_marks(t))


@query("bootstrap_attached", f"SELECT dataset, metric, n, CAST(printf('%.4f', CAST(lower AS DOUBLE)) AS DOUBLE) AS lower, CAST(printf('%.4f', CAST(upper AS DOUBLE)) AS DOUBLE) AS upper, CAST(printf('%.4f', CAST(p_value AS DOUBLE)) AS DOUBLE) AS p_value FROM ({_INTERVALS}) WHERE n >= 10", doubles=["lower", "upper", "p_value"], longs=["n"])
def bootstrap_attached(t: Tables) -> DataFrame:
    return bootstrap.attached_intervals(bootstrap.confidence_intervals(_marks(t)))


@query(
    "paired_bootstrap",
    f"""WITH {_means("SELECT dataset, CAST(second_mark - first_mark AS DOUBLE) AS value FROM @mark_pairs WHERE dataset <> 'src3'", 'dataset')}
        SELECT dataset, max(n) AS n, avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END) AS p_value FROM means WHERE mean IS NOT NULL GROUP BY dataset
        UNION ALL SELECT dataset, count(*) FILTER (WHERE first_mark = 1), 1.0 FROM @mark_pairs WHERE dataset = 'src3' GROUP BY dataset""",
    doubles=["p_value"],
    longs=["n"],
)
def paired_bootstrap(t: Tables) -> DataFrame:
    first = t.mark_pairs.select("dataset", "sample_id", F.col("first_mark").alias("value"))
    second = t.mark_pairs.select("dataset", "sample_id", F.col("second_mark").alias("value"))
    return bootstrap.paired_p_value(first, second.join(first.where("dataset <> 'src3' or value = 1").select("dataset", "sample_id"), ["dataset", "sample_id"], "left_semi"))


# Continuous values in groups of a few to all rows, and one large group of a hundred steps.
_SIZES = """SELECT o_orderpriority AS dataset, CAST(o_totalprice / 500000 AS DOUBLE) AS value FROM @orders
   UNION ALL SELECT 'c' || CAST(o_custkey % 997 AS VARCHAR), CAST(o_totalprice / 500000 - 0.3 AS DOUBLE) FROM @orders WHERE o_custkey % 997 < 60
   UNION ALL SELECT 'all', CAST(floor(o_totalprice / 5000) / 100 AS DOUBLE) FROM @orders"""


@query(
    "bootstrap_sizes",
    f"""WITH {_means(_SIZES, 'dataset')}
   SELECT dataset, max(n) AS n, CASE WHEN max(n) >= 5 THEN quantile_cont(mean, 0.025) ELSE 0 END AS lower,
   CASE WHEN max(n) >= 5 THEN quantile_cont(mean, 0.975) ELSE 0 END AS upper,
   CASE WHEN max(n) >= 5 THEN greatest(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), 0.001) ELSE 1 END AS p_value
   FROM means WHERE mean IS NOT NULL GROUP BY dataset""",
    doubles=["lower", "upper", "p_value"],
    longs=["n"],
    digits=6,
)
def bootstrap_sizes(t: Tables) -> DataFrame:
    """Intervals of groups of a few rows and of all rows, by the same method."""
    price, customer = F.col("o_totalprice"), F.col("o_custkey") % 997
    continuous = t.orders.select(F.col("o_orderpriority").alias("dataset"), (price / 500000).cast("double").alias("value"))
    small = t.orders.where(customer < 60).select(
        F.concat(F.lit("c"), customer.cast("string")).alias("dataset"), (price / 500000 - F.lit(0.3)).cast("double").alias("value")
    )
    stepped = t.orders.select(F.lit("all").alias("dataset"), (F.floor(price / 5000) / 100).cast("double").alias("value"))
    return bootstrap.confidence_intervals(continuous.unionByName(small).unionByName(stepped), ["dataset"])


# -- comparisons -------------------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT run_id, dataset, '{m}' AS metric, {m} AS value, total FROM @run_table WHERE {m} IS NOT NULL" for m in METRICS)
_VAR = "greatest({v} * (1 - {v}), 0) / greatest({n}, 10)"
_COMPARED = f"""WITH long_runs AS ({_LONG}), a AS (SELECT * FROM long_runs WHERE run_id = {_SECOND}), b AS (SELECT * FROM long_runs WHERE run_id = {_NEWEST}),
   totals AS (SELECT dataset, n1, n2 FROM (SELECT dataset, max(total) AS n1 FROM a GROUP BY dataset) JOIN (SELECT dataset, max(total) AS n2 FROM b GROUP BY dataset) USING (dataset)),
   pairs AS (SELECT dataset, metric, n1, n2, coalesce(a.value, 0) AS v1, coalesce(b.value, 0) AS v2 FROM a FULL JOIN b USING (dataset, metric) JOIN totals USING (dataset)),
   spreads AS (SELECT *, v2 - v1 AS delta, {_VAR.format(v='v1', n='n1')} AS s1, {_VAR.format(v='v2', n='n2')} AS s2 FROM pairs),
   tested AS (SELECT *, abs(delta) / greatest(sqrt(s1 + s2), 1e-6) AS z FROM spreads),
   compared AS (SELECT dataset, metric, n1, n2, v1, v2, delta, v2 - 1.96 * sqrt(s1) AS ci_low, v2 + 1.96 * sqrt(s1) AS ci_high,
     2 * (1 - {duck.normal_cdf('z')}) AS p_value FROM tested),
   trended AS (SELECT *, CASE WHEN abs(delta) < 0.01 THEN 'flat' WHEN p_value < 0.05 AND delta > 0 THEN 'up_significant'
     WHEN p_value < 0.05 AND delta < 0 THEN 'down_significant' WHEN delta > 0 THEN 'up_slight' ELSE 'down_slight' END AS trend FROM compared)"""
_COMPARED_COLUMNS = ["v1", "v2", "delta", "ci_low", "ci_high", "p_value"]


def compared(t: Tables) -> DataFrame:
    return compare.with_trend(compare.compare_runs(runs.to_long(latest(t, 2)), runs.to_long(latest(t, 1))))


@query("compare_runs", _COMPARED + " SELECT * FROM trended", doubles=_COMPARED_COLUMNS, longs=["n1", "n2"])
def compare_runs(t: Tables) -> DataFrame:
    return compared(t)


@query(
    "compare_counts",
    _COMPARED + """ SELECT count(*) FILTER (WHERE trend IN ('up_significant', 'up_slight')) AS improved,
      count(*) FILTER (WHERE trend = 'down_significant') AS regressed FROM trended""",
    longs=["improved", "regressed"],
)
def compare_counts(t: Tables) -> DataFrame:
    return compare.trend_counts(compared(t))


_STAGES = """WITH stage_long AS (SELECT stage, dataset, 'accuracy' AS metric, avg(accuracy) AS value, count(*) AS total FROM @eval_samples GROUP BY stage, dataset
   UNION ALL SELECT stage, dataset, 'step_completeness', avg(step_completeness), count(*) FROM @eval_samples GROUP BY stage, dataset),
   pairs AS (SELECT dataset, metric, a.value AS v1, b.value - CASE WHEN dataset IN ('ds1', 'ds4', 'ds9') THEN 0.12 WHEN dataset = 'ds2' THEN 0.06 ELSE 0 END AS v2,
     a.total AS n1, b.total AS n2 FROM (SELECT * FROM stage_long WHERE stage = 'sft') a JOIN (SELECT * FROM stage_long WHERE stage = 'grpo') b USING (dataset, metric)),
   spreads AS (SELECT *, v2 - v1 AS delta, greatest(v1 * (1 - v1), 0) / greatest(n1, 10) AS s1, greatest(v2 * (1 - v2), 0) / greatest(n2, 10) AS s2 FROM pairs),
   tested AS (SELECT *, abs(delta) / greatest(sqrt(s1 + s2), 1e-6) AS z FROM spreads),""" + f"""
   compared AS (SELECT *, 2 * (1 - {duck.normal_cdf('z')}) AS p_value FROM tested)"""


def stages_compared(t: Tables) -> DataFrame:
    """Two stages over all their runs, with a drop put into some datasets."""
    by_stage = summary.dataset_summary(t.eval_samples, ["stage", "dataset"])
    long_stage = runs.to_long(by_stage.withColumn("run_id", F.col("stage")), ["accuracy", "step_completeness"])
    drop = F.when(F.col("dataset").isin("ds1", "ds4", "ds9"), 0.12).when(F.col("dataset") == "ds2", 0.06).otherwise(0.0)
    tuned = long_stage.where("stage = 'grpo'").withColumn("value", F.col("value") - drop)
    return compare.compare_runs(long_stage.where("stage = 'sft'"), tuned)


@query(
    "weak_metrics",
    _STAGES + " SELECT dataset, metric, delta FROM compared WHERE abs(delta) >= 0.01 AND p_value < 0.05 AND delta < 0",
    doubles=["delta"],
)
def weak_metrics(t: Tables) -> DataFrame:
    return compare.weak_metrics(compare.with_trend(stages_compared(t)))


@query(
    "regression_verdict_tested",
    _STAGES + """ SELECT dataset, -delta AS accuracy_drop, p_value, CASE WHEN -delta > 0.10 AND p_value < 0.01 THEN 'severe'
      WHEN -delta > 0.05 AND p_value < 0.05 THEN 'significant' WHEN -delta > 0.02 THEN 'minor' ELSE 'safe' END AS verdict
      FROM compared WHERE metric = 'accuracy'""",
    doubles=["accuracy_drop", "p_value"],
)
def regression_verdict_tested(t: Tables) -> DataFrame:
    return compare.regression_verdict_tested(stages_compared(t))


def _flat_sql(half: int) -> str:
    return f"""SELECT event_type || '_' || (user_id % 10) AS key, avg(value) AS value FROM @events
       WHERE (day(ts) <= 15) = {'true' if half == 0 else 'false'} AND NOT (user_id % 10 = {half} AND event_type = 'view') GROUP BY 1"""


_FLAT = f"""WITH a AS ({_flat_sql(0)}), b AS ({_flat_sql(1)}),
   flat_pairs AS (SELECT key, coalesce(a.value, 0) AS v1, coalesce(b.value, 0) AS v2 FROM a FULL JOIN b USING (key)),
   flat AS (SELECT *, v2 - v1 AS delta, CASE WHEN abs(v2 - v1) < 0.001 THEN 'flat' WHEN v2 - v1 > 0 THEN 'up' ELSE 'down' END AS trend FROM flat_pairs)"""


def _flat_run(t: Tables, half: int) -> DataFrame:
    rows = t.events.where(
        ((F.day("ts") <= 15) == (half == 0)) & ~((F.col("user_id") % 10 == half) & (F.col("event_type") == "view"))
    )
    key = F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string"))
    return rows.groupBy(key.alias("key")).agg(F.avg("value").alias("value"))


@query("compare_flat", _FLAT + " SELECT * FROM flat", doubles=["v1", "v2", "delta"])
def compare_flat(t: Tables) -> DataFrame:
    return compare.compare_flat(_flat_run(t, 0), _flat_run(t, 1))


@query(
    "flat_verdict",
    _FLAT + """ SELECT improved, regressed, CASE WHEN regressed > improved THEN 'regressed' WHEN improved > regressed THEN 'improved'
      ELSE 'unchanged' END AS verdict FROM (SELECT count(*) FILTER (WHERE trend = 'up') AS improved, count(*) FILTER (WHERE trend = 'down') AS regressed FROM flat)""",
    longs=["improved", "regressed"],
)
def flat_verdict(t: Tables) -> DataFrame:
    return compare.flat_verdict(compare.compare_flat(_flat_run(t, 0), _flat_run(t, 1)))


@query(
    "regression_verdict",
    f"""WITH base AS (SELECT * FROM @run_table WHERE run_id = {_SECOND} AND dataset <> 'ds7'),
        drops AS (SELECT c.dataset, b.accuracy AS base_accuracy, b.accuracy - coalesce(c.accuracy, 0) AS accuracy_drop,
          b.step_completeness - coalesce(c.step_completeness, 0) AS step_drop FROM @run_table c LEFT JOIN base b USING (dataset) WHERE c.run_id = {_NEWEST}),
        verdicts AS (SELECT dataset, accuracy_drop, step_drop, CASE WHEN base_accuracy IS NULL THEN 'no_baseline' WHEN accuracy_drop > 0.10 THEN 'severe'
          WHEN accuracy_drop > 0.05 THEN 'mild' ELSE 'fine' END AS verdict FROM drops)
        SELECT *, verdict <> 'severe' AS safe FROM verdicts""",
    doubles=["accuracy_drop", "step_drop"],
)
def regression_verdict(t: Tables) -> DataFrame:
    return compare.regression_verdict(latest(t, 1), latest(t, 2).where("dataset <> 'ds7'"))


_LADDER = """CASE WHEN grpo_accuracy IS NULL THEN 'no_policy_run' WHEN sft_accuracy IS NULL THEN 'good' WHEN grpo_accuracy < sft_accuracy * 0.95 THEN 'severe'
   WHEN grpo_accuracy < sft_accuracy * 1.02 AND grpo_accuracy < sft_accuracy THEN 'fallback_slight' WHEN grpo_accuracy < sft_accuracy * 1.02 THEN 'fallback'
   WHEN grpo_accuracy < sft_accuracy * 1.05 THEN 'combined' ELSE 'good' END AS verdict, (grpo_accuracy - sft_accuracy) / nullif(sft_accuracy, 0) AS change"""


@query(
    "policy_verdict",
    f"""WITH newest AS (SELECT stage, run_id FROM (SELECT DISTINCT stage, run_id, ts FROM @run_table WHERE stage IN ('sft', 'grpo'))
          QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ts DESC, run_id DESC) = 1),
        means AS (SELECT r.stage, avg(coalesce(accuracy, 0)) AS m FROM @run_table r JOIN newest USING (run_id) GROUP BY r.stage),
        wide AS (SELECT max(CASE WHEN stage = 'grpo' THEN m END) AS grpo_accuracy, max(CASE WHEN stage = 'sft' THEN m END) AS sft_accuracy FROM means)
        SELECT *, {_LADDER} FROM wide""",
    doubles=["grpo_accuracy", "sft_accuracy", "change"],
)
def policy_verdict(t: Tables) -> DataFrame:
    return feedback.policy_verdict(t.run_table)


@query(
    "optimisation_verdict",
    f"""WITH wide AS (SELECT dataset, avg(CASE WHEN stage = 'grpo' THEN accuracy END) AS grpo_accuracy,
          avg(CASE WHEN stage = 'sft' AND dataset <> 'ds0' THEN accuracy END) AS sft_accuracy FROM @eval_samples GROUP BY dataset)
        SELECT *, {_LADDER} FROM wide""",
    doubles=["grpo_accuracy", "sft_accuracy", "change"],
)
def optimisation_verdict(t: Tables) -> DataFrame:
    wide = t.eval_samples.groupBy("dataset").agg(
        F.avg(F.when(F.col("stage") == "grpo", F.col("accuracy"))).alias("grpo_accuracy"),
        F.avg(F.when((F.col("stage") == "sft") & (F.col("dataset") != "ds0"), F.col("accuracy"))).alias("sft_accuracy"),
    )
    return compare.optimisation_verdict(wide)


# -- checks of the evaluation ------------------------------------------------------------------------------


@query(
    "consistency_checks",
    """SELECT run_id, dataset, 'accuracy_low' AS rule, 'issue' AS level, accuracy AS value FROM @run_table WHERE accuracy < 0.05
       UNION ALL SELECT run_id, dataset, 'accuracy_high', 'warning', accuracy FROM @run_table WHERE accuracy > 0.98
       UNION ALL SELECT run_id, dataset, 'steps_low', 'warning', step_completeness FROM @run_table WHERE accuracy > 0.7 AND step_completeness < 0.3
       UNION ALL SELECT run_id, dataset, 'guidance_low', 'warning', scaffolding_rate FROM @run_table WHERE accuracy > 0.7 AND scaffolding_rate < 0.2
       UNION ALL SELECT run_id, NULL, 'spread_wide', 'warning', stddev_pop(accuracy) FROM @run_table GROUP BY run_id
         HAVING count(accuracy) >= 3 AND stddev_pop(accuracy) > 0.3""",
    doubles=["value"],
)
def consistency_checks(t: Tables) -> DataFrame:
    return checks.consistency_checks(t.run_table)


_AGREE = """SELECT dataset, count(*) AS n, avg(first_mark) AS auto_accuracy, avg(second_mark) AS judge_accuracy,
   count(*) FILTER (WHERE first_mark <> second_mark) AS disagreements FROM @mark_pairs GROUP BY dataset"""


@query(
    "judge_agreement",
    f"""SELECT *, CASE WHEN kappa > 0.8 THEN 'almost_perfect' WHEN kappa > 0.6 THEN 'high' ELSE 'fair' END AS agreement FROM
        (SELECT dataset, n, auto_accuracy, judge_accuracy, disagreements, CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa FROM
        (SELECT *, 1 - disagreements / CAST(n AS DOUBLE) AS po, auto_accuracy * judge_accuracy + (1 - auto_accuracy) * (1 - judge_accuracy) AS pe FROM ({_AGREE})))""",
    doubles=["auto_accuracy", "judge_accuracy", "kappa"],
    longs=["n", "disagreements"],
)
def judge_agreement(t: Tables) -> DataFrame:
    return checks.judge_agreement(t.mark_pairs, "first_mark", "second_mark", ["dataset"])


@query("judge_disagreements", "SELECT dataset, sample_id FROM @mark_pairs WHERE first_mark <> second_mark", longs=["sample_id"])
def judge_disagreements(t: Tables) -> DataFrame:
    return checks.disagreements(t.mark_pairs, "first_mark", "second_mark").select("dataset", "sample_id")


_HEADERS = "(SELECT DISTINCT run_id, stage, ts FROM @run_table)"


@query(
    "run_health",
    f"""SELECT stage, count(*) AS runs, count(*) FILTER (WHERE rn <= 20) AS recent_runs
        FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, run_id DESC) AS rn FROM {_HEADERS}) GROUP BY stage""",
    longs=["runs", "recent_runs"],
)
def run_health(t: Tables) -> DataFrame:
    return runs.run_health(t.run_table)


@query(
    "accuracy_stability",
    f"""SELECT dataset, count(accuracy) AS runs, var_pop(accuracy) AS accuracy_variance FROM @run_table
        WHERE run_id IN (SELECT run_id FROM {_HEADERS} ORDER BY ts DESC, run_id DESC LIMIT 20) GROUP BY dataset""",
    doubles=["accuracy_variance"],
    longs=["runs"],
)
def accuracy_stability(t: Tables) -> DataFrame:
    return runs.accuracy_stability(t.run_table)


@query("latest_runs", f"SELECT run_id, stage, ts, row_number() OVER (ORDER BY ts DESC, run_id DESC) AS recency FROM {_HEADERS} ORDER BY ts DESC, run_id DESC LIMIT 2", longs=["recency"])
def latest_runs(t: Tables) -> DataFrame:
    return runs.latest_runs(t.run_table, 2)


@query("latest_stage_run", f"SELECT run_id, stage, ts, 1 AS recency FROM {_HEADERS} WHERE stage = 'sft' ORDER BY ts DESC, run_id DESC LIMIT 1", longs=["recency"])
def latest_stage_run(t: Tables) -> DataFrame:
    return runs.latest_runs(t.run_table, 1, stage="sft")


@query(
    "latest_per_stage",
    f"SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, run_id DESC) AS recency FROM {_HEADERS} QUALIFY recency <= 3",
    longs=["recency"],
)
def latest_per_stage(t: Tables) -> DataFrame:
    return runs.latest_per_stage(t.run_table, 3)


# -- reports -----------------------------------------------------------------------------------------------

_PCT = "coalesce(printf('%.1f%%', {0} * 100), 'N/A')"


@query(
    "dataset_report",
    f"""SELECT dataset, {_PCT.format('accuracy')} AS accuracy, {_PCT.format('step_completeness')} AS step_completeness,
        {_PCT.format('scaffolding_rate')} AS scaffolding_rate, total,
        repeat('█', CAST(floor(coalesce(accuracy, 0) * 20) AS INTEGER)) || repeat('░', 20 - CAST(floor(coalesce(accuracy, 0) * 20) AS INTEGER)) AS bar
        FROM @run_table WHERE run_id = {_NEWEST}""",
    longs=["total"],
)
def dataset_report(t: Tables) -> DataFrame:
    return report.dataset_report(latest(t))


_FIRST = "(SELECT run_id FROM (SELECT DISTINCT run_id, ts FROM @run_table WHERE stage = 'baseline') ORDER BY ts DESC LIMIT 1)"
_TABLE = f"""SELECT dataset, printf('%.1f%%', b * 100) AS base, printf('%.1f%%', f * 100) AS final, f - b AS delta, printf('%+.4f', f - b) AS change,
   CASE WHEN abs(f - b) < 0.01 THEN 'flat' WHEN f - b > 0 THEN 'up' ELSE 'down' END AS trend
   FROM (SELECT dataset, coalesce(accuracy, 0) AS b FROM @run_table WHERE run_id = {_FIRST})
   JOIN (SELECT dataset, coalesce(accuracy, 0) AS f FROM @run_table WHERE run_id = {_NEWEST}) USING (dataset)"""


def _baseline_table(t: Tables) -> DataFrame:
    baseline = runs.pick(t.run_table, runs.latest_runs(t.run_table, 1, stage="baseline"))
    return report.baseline_table(baseline, latest(t))


@query("baseline_table", _TABLE, doubles=["delta"])
def baseline_table(t: Tables) -> DataFrame:
    return _baseline_table(t)


@query("baseline_counts", f"SELECT count(*) FILTER (WHERE trend = 'up') AS improved, count(*) FILTER (WHERE trend = 'down') AS regressed FROM ({_TABLE})", longs=["improved", "regressed"])
def baseline_counts(t: Tables) -> DataFrame:
    return report.baseline_counts(_baseline_table(t))


@query(
    "weakest_datasets",
    f"""SELECT row_number() OVER (ORDER BY accuracy, dataset) AS rank, dataset, accuracy,
        CASE WHEN accuracy < 0.3 THEN 'focus' WHEN accuracy < 0.5 THEN 'more' ELSE 'keep' END AS advice
        FROM @run_table WHERE run_id = {_NEWEST} AND accuracy IS NOT NULL ORDER BY accuracy, dataset LIMIT 5""",
    doubles=["accuracy"],
    longs=["rank"],
)
def weakest_datasets(t: Tables) -> DataFrame:
    return report.weakest_datasets(latest(t))


@query(
    "interval_table",
    """SELECT run_id, dataset, 'accuracy' AS metric, printf('[%.3f, %.3f]', accuracy / 2, accuracy / 2 + 0.5) AS interval FROM @run_table WHERE accuracy IS NOT NULL
       UNION ALL SELECT run_id, dataset, 'scaffolding_rate', printf('[%.3f, %.3f]', 0.0, scaffolding_rate) FROM @run_table WHERE accuracy IS NOT NULL""",
)
def interval_table(t: Tables) -> DataFrame:
    def interval(low, high):
        return F.struct(low.cast("double").alias("lower"), high.cast("double").alias("upper"))

    table = t.run_table.where("accuracy is not null").withColumn(
        "confidence_intervals",
        F.create_map(
            F.lit("accuracy"),
            interval(F.col("accuracy") / 2, F.col("accuracy") / 2 + 0.5),
            F.lit("scaffolding_rate"),
            interval(F.lit(None), F.col("scaffolding_rate")),
        ),
    )
    return report.interval_table(table)


@query(
    "report_names",
    f"""SELECT run_id, stage || '_' || left(ts, 13) || printf('_acc%.4f', macro_accuracy) || '.md' AS report_name
        FROM {_HEADERS} JOIN ({_MACRO}) USING (run_id)""",
)
def report_names(t: Tables) -> DataFrame:
    headers = t.run_table.select("run_id", "stage", "ts").distinct()
    return report.report_name(headers.join(summary.macro_mean(t.run_table), "run_id"))


@query(
    "weakest_advice",
    """SELECT run_id, dataset, '数据集 ' || dataset || ' 表现较弱，建议：(1) 增加训练样本数；(2) 检查数据质量；(3) 调整采样权重' AS recommendation
       FROM @run_table QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY accuracy NULLS LAST, dataset) <= 3""",
)
def weakest_advice(t: Tables) -> DataFrame:
    from edulake.operators.errors import weakest_dataset_advice

    # A run holds one row per dataset, so its list is as short as the registry.
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("accuracy", F.lit(2.0)).alias("a"), "dataset")))
    names = F.transform(F.slice(ordered, 1, 3), lambda e: e["dataset"])
    documents = t.run_table.groupBy("run_id").agg(F.struct(names.alias("weakest_datasets")).alias("aggregate"))
    return weakest_dataset_advice(documents)


# -- weights -----------------------------------------------------------------------------------------------

_SCORED = f"""SELECT dataset, coalesce(accuracy, step_completeness) AS score, total AS n_samples FROM @run_table
   WHERE run_id = {_NEWEST} AND dataset NOT IN ('ds8', 'ds9') AND coalesce(accuracy, step_completeness) IS NOT NULL"""
_SCORES = f"""{_SCORED} UNION ALL SELECT * FROM (VALUES ('ds8', 0.25, 100), ('ds1', 0.1, 100), ('extra', 0.9, 100)) l(dataset, score, n)
   WHERE dataset NOT IN (SELECT dataset FROM ({_SCORED}))"""


def _scores(t: Tables) -> DataFrame:
    legacy = t.spark.createDataFrame(
        [("accuracy_ds8", 0.25), ("kw_match_ds8", 0.8), ("accuracy_ds1", 0.1), ("kw_match_extra", 0.9), ("loss", 3.0)],
        "key string, value double",
    )
    return resample.dataset_scores(latest(t).where("dataset not in ('ds8', 'ds9')"), legacy)


@query("dataset_scores", _SCORES, doubles=["score"], longs=["n_samples"])
def dataset_scores(t: Tables) -> DataFrame:
    return _scores(t)


_V1 = "least(greatest(0.5 / greatest(score, 0.01), {0}), {1})"
_V2 = "least(greatest((sqrt(1 - score) + 0.5) * least(1.0, log10(n_samples + 10) / 3.0), 0.5), 2.5)"


def _weights(formula: str) -> str:
    return f"""SELECT dataset, path, path_exists, score, n_samples, CASE WHEN path_exists THEN w END AS raw_weight,
       CASE WHEN path_exists THEN CAST(printf('%.3f', w) AS DOUBLE) ELSE 0 END AS weight,
       CASE WHEN path_exists THEN CASE WHEN w > 1.8 THEN 'focus' WHEN w > 1.3 THEN 'more' WHEN w < 0.7 THEN 'less' ELSE 'keep' END END AS hint
       FROM (SELECT *, CAST({formula} AS DOUBLE) AS w FROM (SELECT r.dataset, path, path_exists, coalesce(score, 0.5) AS score, coalesce(n_samples, 100) AS n_samples
       FROM @registry r LEFT JOIN ({_SCORES}) s USING (dataset)))"""


def _weight_table(t: Tables, version: str = "v2") -> DataFrame:
    return resample.weight_table(t.registry, _scores(t), version)


_WEIGHT_COLUMNS = ["score", "raw_weight", "weight"]


@query("weight_table", _weights(_V2), doubles=_WEIGHT_COLUMNS, longs=["n_samples"])
def weight_table(t: Tables) -> DataFrame:
    return _weight_table(t)


@query("weight_table_v1", _weights(_V1.format(0.5, 2.5)), doubles=_WEIGHT_COLUMNS, longs=["n_samples"])
def weight_table_v1(t: Tables) -> DataFrame:
    return _weight_table(t, "v1")


@query("weight_totals", f"SELECT sum(raw_weight) AS total_weight, count(*) FILTER (WHERE weight > 0) AS active_datasets FROM ({_weights(_V2)})", doubles=["total_weight"], longs=["active_datasets"])
def weight_totals(t: Tables) -> DataFrame:
    return resample.weight_totals(_weight_table(t))


@query("uniform_weights", "SELECT dataset, path_exists, 1.0 AS weight FROM @registry", doubles=["weight"])
def uniform_weights(t: Tables) -> DataFrame:
    return resample.weight_table(t.registry, _scores(t).where("score < 0")).select("dataset", "path_exists", "weight")


@query(
    "compare_weights",
    f"""SELECT dataset, score, {_V1.format(0.3, 3.0)} AS weight_v1, {_V2} AS weight_v2, {_V2} - {_V1.format(0.3, 3.0)} AS change
        FROM (SELECT * FROM ({_SCORES}) ORDER BY dataset LIMIT 10) WHERE dataset IN (SELECT dataset FROM @registry)""",
    doubles=["score", "weight_v1", "weight_v2", "change"],
)
def compare_weights(t: Tables) -> DataFrame:
    return resample.compare_weights(_scores(t), t.registry)


@query("data_paths", f"SELECT string_agg(path, ',' ORDER BY dataset) AS data_paths FROM ({_weights(_V2)}) WHERE weight > 0")
def data_paths(t: Tables) -> DataFrame:
    return resample.data_paths(_weight_table(t))


@query("top_weights", f"SELECT dataset, weight FROM ({_weights(_V2)}) ORDER BY weight DESC, dataset LIMIT 10", doubles=["weight"])
def top_weights(t: Tables) -> DataFrame:
    return resample.top_weights(_weight_table(t)).select("dataset", "weight")


@query(
    "feedback_weights",
    f"""SELECT dataset, CASE WHEN path_exists THEN CAST(printf('%.3f', CAST({_V2} AS DOUBLE)) AS DOUBLE) ELSE 0 END AS weight FROM (SELECT r.dataset, path_exists, coalesce(score, 0.5) AS score,
        coalesce(n_samples, 100) AS n_samples FROM @registry r LEFT JOIN (SELECT dataset, coalesce(accuracy, step_completeness) AS score, total AS n_samples
        FROM @run_table WHERE run_id = {_NEWEST}) s USING (dataset))""",
    doubles=["weight"],
)
def feedback_weights(t: Tables) -> DataFrame:
    return feedback.resample_from_latest(t.run_table, t.registry).select("dataset", "weight")


# -- rollouts ----------------------------------------------------------------------------------------------

_KEPT = f"SELECT * FROM @rollouts WHERE {duck.strip('response')} <> ''"
_ADVANTAGE = f"""SELECT *, CASE WHEN sd IS NULL OR sd < 1e-8 THEN 0 ELSE (reward - mean) / (sd + 1e-8) END AS advantage FROM
   (SELECT *, avg(reward) OVER (PARTITION BY prompt_id) AS mean, stddev_samp(reward) OVER (PARTITION BY prompt_id) AS sd FROM ({_KEPT}))"""
_TERM = "-least(exp(logp_new - logp_old) * advantage, least(greatest(exp(logp_new - logp_old), 0.8), 1.2) * advantage)"


def _advantages(t: Tables) -> DataFrame:
    return rollout.group_advantage(rollout.drop_blank(t.rollouts))


@query("group_advantage", f"SELECT sample_id, prompt_id, advantage FROM ({_ADVANTAGE})", doubles=["advantage"], longs=["sample_id", "prompt_id"])
def group_advantage(t: Tables) -> DataFrame:
    return _advantages(t).select("sample_id", "prompt_id", "advantage")


@query("surrogate_per_prompt", f"SELECT prompt_id, avg({_TERM}) AS loss FROM ({_ADVANTAGE}) GROUP BY prompt_id", doubles=["loss"], longs=["prompt_id"])
def surrogate_per_prompt(t: Tables) -> DataFrame:
    return rollout.surrogate_loss(_advantages(t))


@query(
    "surrogate_per_batch",
    f"""SELECT batch_id, avg(loss) AS loss, count(*) AS prompts FROM (SELECT batch_id, prompt_id, avg({_TERM}) AS loss FROM ({_ADVANTAGE}) GROUP BY batch_id, prompt_id)
        GROUP BY batch_id""",
    doubles=["loss"],
    longs=["batch_id", "prompts"],
)
def surrogate_per_batch(t: Tables) -> DataFrame:
    return rollout.surrogate_loss(_advantages(t), batch="batch_id")


@query(
    "sequence_logp",
    """SELECT vec_id, coalesce(sum(lp) FILTER (WHERE keep), 0) AS logp_sum, count(*) FILTER (WHERE keep) AS tokens,
       coalesce(sum(lp) FILTER (WHERE keep), 0) / greatest(count(*) FILTER (WHERE keep), 1) AS logp_mean
       FROM (SELECT vec_id, CAST(embedding[i] AS DOUBLE) AS lp, NOT (vec_id % 10 = 0 OR i <= vec_id % 20) AS keep
             FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM @embeddings)) GROUP BY vec_id""",
    doubles=["logp_sum", "logp_mean"],
    longs=["vec_id", "tokens"],
)
def sequence_logp(t: Tables) -> DataFrame:
    masked = (F.col("vec_id") % 10 == 0)
    label = F.transform("embedding", lambda _, i: F.when(masked | (i < F.col("vec_id") % 20), -100).otherwise(1))
    return t.embeddings.select("vec_id", rollout.sequence_logp(F.col("embedding"), label).alias("s")).select("vec_id", "s.*")


@query(
    "rollout_reward_trend",
    "SELECT sample_id // 500 AS interval, count(*) AS rollouts, avg(reward) AS avg_reward FROM @rollouts GROUP BY 1",
    doubles=["avg_reward"],
    longs=["interval", "rollouts"],
)
def rollout_reward_trend(t: Tables) -> DataFrame:
    return rollout.reward_trend(t.rollouts, "sample_id", interval=500)


# -- sets --------------------------------------------------------------------------------------------------


@query("common_datasets", f"SELECT dataset FROM @run_table WHERE run_id = {_NEWEST} INTERSECT SELECT dataset FROM @run_table WHERE run_id = {_SECOND}")
def common_datasets(t: Tables) -> DataFrame:
    return latest(t, 1).select("dataset").intersect(latest(t, 2).select("dataset"))


@query("unscored_datasets", f"SELECT dataset FROM @registry EXCEPT SELECT dataset FROM @run_table WHERE run_id = {_NEWEST}")
def unscored_datasets(t: Tables) -> DataFrame:
    return t.registry.select("dataset").exceptAll(latest(t, 1).select("dataset"))


@query(
    "text_features",
    f"""SELECT sample_id, {duck.lettered("string_split(gt_answer, '，')")} AS lettered, array_to_string(string_split(gt_answer, '，'), '; ') AS joined,
        coalesce(nullif(gt_answer, ''), response) AS fallback, printf('%+.4f', reward - 0.5) AS change,
        json_extract_string(props_text, '$.k') AS k FROM @responses JOIN (SELECT event_id, props AS props_text FROM @events) ON event_id = sample_id""",
    longs=["sample_id"],
)
def text_features(t: Tables) -> DataFrame:
    rows = t.responses.join(t.events.select(F.col("event_id").alias("sample_id"), "props"), "sample_id")
    parts = F.split("gt_answer", "，")
    return rows.select(
        "sample_id",
        tx.lettered(parts).alias("lettered"),
        F.array_join(parts, "; ").alias("joined"),
        tx.first_truthy(F.col("gt_answer"), F.col("response")).alias("fallback"),
        tx.signed(F.col("reward") - 0.5).alias("change"),
        F.from_json("props", T.MapType(T.StringType(), T.StringType()))["k"].alias("k"),
    )
