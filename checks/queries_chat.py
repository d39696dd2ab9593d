"""Chat projections, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.duck import hash52, judge_template, lit, strip, unit
from checks.harness import Tables, query
from edulake.functions.lexicon import EVAL_PROMPTS, TUTOR_PROMPTS
from edulake.operators import chat
from edulake.operators.judge import judge_prompt
from edulake.session import settle
from edulake.sources import metric_log, runs, samples

SYSTEMS = "[" + ", ".join(lit(p) for p in TUTOR_PROMPTS) + "]"


def d1(t: Tables) -> DataFrame:
    """Chat samples as they are stored: JSON turns and a list of images."""
    turns = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(part).alias("content"))
            for role, part in (("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2"))
        ]
    )
    kept = F.filter(turns, lambda turn: turn["content"].isNotNull())
    image = F.concat(F.lit("img"), F.col("sample_id").cast("string")).cast("binary")
    return t.sample_parts.select(
        "sample_id",
        "dataset",
        chat.encode_turns(kept).alias("conversations"),
        F.when(F.col("sample_id") % 7 != 0, F.array(image)).alias("image_bytes"),
    )


def parsed(t: Tables) -> DataFrame:
    return d1(t).withColumn("turns", chat.parse_turns(F.col("conversations")))


@query(
    "image_tag_test",
    """SELECT sample_id, len(turns) AS n_turns, len(list_filter(turns, lambda t: contains(t.content, '<image>'))) > 0 AS has_image,
       CASE WHEN sample_id % 7 <> 0 THEN 'img' || sample_id END AS first_image FROM @samples""",
    longs=["sample_id", "n_turns"],
)
def image_tag_test(t: Tables) -> DataFrame:
    return parsed(t).select(
        "sample_id",
        F.size("turns").alias("n_turns"),
        chat.has_image_tag(F.col("turns")).alias("has_image"),
        chat.first_image(F.col("image_bytes")).cast("string").alias("first_image"),
    )


@query(
    "inject_system_prompt",
    f"""SELECT sample_id, len(turns) + (CASE WHEN added THEN 1 ELSE 0 END) AS n_turns,
        CASE WHEN added THEN 'system' ELSE turns[1].role END AS first_role,
        CASE WHEN added THEN {SYSTEMS}[CAST({hash52("'prompt'", "'42'", "sample_id")} % 5 AS INTEGER) + 1] ELSE turns[1].content END AS first_text
        FROM (SELECT *, {unit("'inject'", "'42'", "sample_id")} < 0.6 AND turns[1].role <> 'system' AS added FROM @samples)""",
    longs=["sample_id", "n_turns"],
)
def inject_system_prompt(t: Tables) -> DataFrame:
    turns = chat.inject_system_prompt(F.col("turns"), F.col("sample_id"), 0.6)
    return parsed(t).withColumn("turns", turns).select(
        "sample_id",
        F.size("turns").alias("n_turns"),
        F.col("turns")[0]["role"].alias("first_role"),
        F.col("turns")[0]["content"].alias("first_text"),
    )


_CLEAN = strip("replace(content, '<image>', '')")


@query(
    "render_messages",
    f"""SELECT sample_id, pos, role, CASE WHEN tagged THEN 'image,text' ELSE 'text' END AS parts,
        CASE WHEN NOT tagged THEN content WHEN {_CLEAN} = '' THEN '请解答这道题' ELSE {_CLEAN} END AS text
        FROM (SELECT sample_id, pos, turns[pos].role AS role, turns[pos].content AS content,
          turns[pos].role = 'user' AND contains(turns[pos].content, '<image>') AS tagged
          FROM (SELECT *, unnest(range(1, len(turns) + 1)) AS pos FROM @samples))""",
    longs=["sample_id", "pos"],
)
def render_messages(t: Tables) -> DataFrame:
    return (
        parsed(t)
        .select("sample_id", F.posexplode(chat.render_messages(F.col("turns"))).alias("pos", "m"))
        .select("sample_id", (F.col("pos") + 1).alias("pos"), "m.role", F.array_join("m.parts", ",").alias("parts"), "m.text")
    )


_SEEDED = f"{SYSTEMS}[CAST({hash52("'prompt'", "'42'", 'k')} % 5 AS INTEGER) + 1]"


@query(
    "prompt_turns",
    f"""SELECT k AS sample_id, pos, role, CASE WHEN role = 'system' THEN {_SEEDED}
          WHEN {_CLEAN} = '' THEN '请解答这道题' ELSE {_CLEAN} END AS content
        FROM (SELECT sample_id AS k, pos, turns[pos].role AS role, turns[pos].content AS content
          FROM (SELECT *, coalesce(list_position(list_transform(turns, lambda t: t.role), 'assistant'), 0) AS first,
                  unnest(range(1, len(turns) + 1)) AS pos FROM @samples)
          WHERE (first = 0 OR pos < first) AND turns[pos].role <> 'assistant')""",
    longs=["sample_id", "pos"],
)
def prompt_turns(t: Tables) -> DataFrame:
    turns = chat.prompt_turns(F.col("turns"), F.col("sample_id"))
    return (
        parsed(t)
        .select("sample_id", F.posexplode(turns).alias("pos", "m"))
        .select("sample_id", (F.col("pos") + 1).alias("pos"), "m.role", "m.content")
    )


_FILTERED = "list_filter(turns, lambda t: t.role = '{}')"


@query(
    "sample_question_answer",
    f"""SELECT * FROM (SELECT sample_id, coalesce({strip(f"replace({_FILTERED.format('user')}[-1].content, '<image>', '')")}, '') AS question,
        coalesce({_FILTERED.format('assistant')}[-1].content, '') AS gt_answer,
        coalesce({_FILTERED.format('assistant')}[1].content, '') AS gt_response FROM @samples) WHERE length(question) > 0""",
    longs=["sample_id"],
)
def sample_question_answer(t: Tables) -> DataFrame:
    turns = F.col("turns")
    return chat.with_question(
        parsed(t).select(
            "sample_id",
            chat.last_question(turns).alias("question"),
            chat.last_answer(turns).alias("gt_answer"),
            chat.first_answer(turns).alias("gt_response"),
        )
    )


@query(
    "turn_question_answer",
    f"""SELECT conv_id, question, gt_answer FROM (SELECT conv_id,
          coalesce({strip("replace(max_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END), '<image>', '')")}, '') AS question,
          coalesce(max_by(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END), '') AS gt_answer
        FROM @conversations GROUP BY conv_id) WHERE length(question) > 0""",
    longs=["conv_id"],
)
def turn_question_answer(t: Tables) -> DataFrame:
    return chat.with_question(chat.question_answer(t.conversations))


@query(
    "turn_first_answer",
    """SELECT c.conv_id, coalesce(min(a.text), '') AS gt_response FROM (SELECT DISTINCT conv_id FROM @conversations) c
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM @conversations
                  WHERE role = 'assistant') a ON a.conv_id = c.conv_id AND a.rn = 1 GROUP BY c.conv_id""",
    longs=["conv_id"],
)
def turn_first_answer(t: Tables) -> DataFrame:
    return chat.first_answer_by_turn(t.conversations)


@query(
    "turn_prompt_part",
    f"""SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN {_SEEDED}
          WHEN {_CLEAN} = '' THEN '请解答这道题' ELSE {_CLEAN} END AS content
        FROM (SELECT c.*, c.conv_id AS k, c.text AS content, f.first FROM @conversations c LEFT JOIN
          (SELECT conv_id, min(turn) AS first FROM @conversations WHERE role = 'assistant' GROUP BY conv_id) f USING (conv_id))
        WHERE (first IS NULL OR turn < first) AND role IN ('system', 'user')""",
    longs=["conv_id", "turn"],
)
def turn_prompt_part(t: Tables) -> DataFrame:
    return chat.prompt_part(t.conversations)


@query(
    "answer_offset",
    r"""SELECT conv_id, turn, CASE WHEN strpos(r, chr(10) || 'assistant' || chr(10)) > 0 THEN strpos(r, chr(10) || 'assistant' || chr(10)) + 10
         WHEN strpos(r, chr(10) || 'assistant:') > 0 THEN strpos(r, chr(10) || 'assistant:') + 10
         WHEN strpos(r, 'assistant' || chr(10)) > 0 THEN strpos(r, 'assistant' || chr(10)) + 9 END AS offset_chars
       FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || chr(10) || role || chr(10) || text
         WHEN 1 THEN role || chr(10) || text ELSE text || chr(10) || role || ': ' || text END AS r FROM @conversations)""",
    longs=["conv_id", "turn", "offset_chars"],
)
def answer_offset(t: Tables) -> DataFrame:
    line = F.lit("\n")
    rendered = (
        F.when(F.col("turn") % 3 == 0, F.concat("text", line, "role", line, "text"))
        .when(F.col("turn") % 3 == 1, F.concat("role", line, "text"))
        .otherwise(F.concat(F.col("text"), line, F.col("role"), F.lit(": "), F.col("text")))
    )
    return t.conversations.select("conv_id", "turn", chat.answer_offset(rendered).alias("offset_chars"))


_TEMPLATE = judge_template("question", "response", "gt_answer")


@query("judge_prompt", f"SELECT sample_id, md5({_TEMPLATE}) AS prompt_md5, length({_TEMPLATE}) AS chars FROM @responses", longs=["chars"])
def judge_prompts(t: Tables) -> DataFrame:
    prompt = judge_prompt(F.col("question"), F.col("response"), F.col("gt_answer"))
    return t.responses.select("sample_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).alias("chars"))


@query(
    "eval_prompt",
    "SELECT conv_id, turn, "
    + ", ".join(f"{lit(text)} || chr(10) || text AS {kind}" for kind, text in EVAL_PROMPTS.items())
    + " FROM @conversations WHERE role = 'user'",
)
def eval_prompt(t: Tables) -> DataFrame:
    prompts = [chat.eval_prompt(F.col("text"), kind).alias(kind) for kind in EVAL_PROMPTS]
    return t.conversations.where("role = 'user'").select("conv_id", "turn", *prompts)


@query(
    "sample_preview",
    """SELECT row_id, array_to_string(list_transform(turns, lambda t: t.role || ': ' || replace(left(t.content, 60), chr(10), ' ')), ' | ') AS preview
       FROM (SELECT sample_id AS row_id, turns FROM @samples ORDER BY sample_id LIMIT 2)""",
    longs=["row_id"],
)
def sample_preview(t: Tables) -> DataFrame:
    return samples.preview(d1(t).withColumnRenamed("sample_id", "row_id"))


@query(
    "samples_write_read",
    """SELECT dataset, count(*) AS rows, count(*) FILTER (WHERE sample_id % 7 <> 0) AS with_image FROM @samples
       GROUP BY dataset""",
    longs=["rows", "with_image"],
)
def samples_write_read(t: Tables) -> DataFrame:
    """Written by dataset, written again without effect, one dataset appended, and read back with a missing path."""
    path = f"{t.scratch}/samples"
    first = d1(t).where("dataset <> 'src3'").drop("sample_id")
    samples.write_samples(first, path)
    samples.write_if_absent(first, path)
    samples.append_missing_datasets(d1(t).drop("sample_id"), path)
    names = {d: f"{path}/dataset={d}" for d in [*(f"src{i}" for i in range(20)), "src_missing"]}
    merged, _skipped = samples.read_datasets(t.spark, names)
    return merged.groupBy("dataset").agg(F.count("*").alias("rows"), F.count("image_bytes").alias("with_image"))


@query(
    "dataset_counts",
    """SELECT dataset, count(*) AS rows FROM (SELECT role AS dataset FROM @conversations
       UNION ALL SELECT source FROM @documents) GROUP BY dataset""",
    longs=["rows"],
)
def dataset_counts(t: Tables) -> DataFrame:
    merged = samples.concat_same_schema(
        [
            t.conversations.select(F.col("role").alias("dataset"), "text"),
            t.documents.select(F.col("source").alias("dataset"), "text"),
        ]
    )
    return samples.dataset_counts(merged)


@query(
    "runs_write_read",
    "SELECT run_id, stage, ts, model_path, dataset, accuracy, total FROM @run_table",
    doubles=["accuracy"],
    longs=["total"],
)
def runs_write_read(t: Tables) -> DataFrame:
    """Runs written as nested JSON documents, one line each, read back and flattened."""
    metrics = ["accuracy", "step_completeness", "scaffolding_rate", "total"]
    documents = t.run_table.groupBy("run_id", "stage", F.col("ts").alias("timestamp"), "model_path").agg(
        F.map_from_entries(F.collect_list(F.struct("dataset", F.struct(*metrics)))).alias("datasets")
    )
    path = f"{t.scratch}/runs"
    runs.write_json(documents, path)
    from edulake.schema import EVAL_RUN

    schema = T.StructType([*EVAL_RUN.fields, T.StructField("run_id", T.StringType())])
    back = t.spark.read.schema(schema).json(path).withColumnRenamed("timestamp", "ts")
    return runs.flatten_runs(back).select("run_id", "stage", "ts", "model_path", "dataset", "accuracy", "total")


@query(
    "run_table_write_read",
    "SELECT run_id, stage, ts, model_path, dataset, accuracy, total FROM @run_table",
    doubles=["accuracy"],
    longs=["total"],
)
def run_table_write_read(t: Tables) -> DataFrame:
    """All runs staged and published twice, as after a lost answer, beside a run that broke off before it was published."""
    path, table = f"{t.scratch}/run-table", t.run_table.select("run_id", "stage", "ts", "model_path", "dataset", "accuracy", "total")
    for attempt in ("a1", "a2"):
        table.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{path}/rows")
        commits = table.select("run_id", F.lit(attempt).alias("attempt")).distinct()
        commits.write.mode("append").parquet(f"{path}/commits")
    runs.stage_run(table.select("dataset", "accuracy", "total"), path, "broken", "sft", "99991231_000000", "model/none")
    return runs.read_run_table(t.spark, path)


@query(
    "json_exports_write_read",
    "SELECT run_id, dataset, accuracy, total FROM @run_table",
    doubles=["accuracy"],
    longs=["total"],
)
def json_exports_write_read(t: Tables) -> DataFrame:
    """Rows exported as JSON lines and read back."""
    path = f"{t.scratch}/export"
    runs.write_json(t.run_table, path, ["run_id", "dataset", "accuracy", "total"])
    return t.spark.read.schema("run_id string, dataset string, accuracy double, total long").json(path)


@query(
    "run_metrics_write_read",
    """WITH weighted AS (SELECT run_id, sum(accuracy * total) / nullif(sum(total), 0) AS w FROM @run_table GROUP BY run_id),
         results AS (SELECT run_id, dataset, total, accuracy IS NULL AS failed, w, scaffolding_rate * 2 - 1 AS mean_reward, accuracy FROM @run_table JOIN weighted USING (run_id))
       SELECT run_id, dataset, total, w AS weighted_accuracy, CASE WHEN failed THEN 'out of memory' END AS error, m.metric, m.value
       FROM results LEFT JOIN (SELECT run_id, dataset, 'accuracy' AS metric, accuracy AS value FROM results WHERE NOT failed
         UNION ALL SELECT run_id, dataset, 'mean_reward', mean_reward FROM results WHERE NOT failed) m USING (run_id, dataset)""",
    doubles=["value", "weighted_accuracy"],
    longs=["total"],
)
def run_metrics_write_read(t: Tables) -> DataFrame:
    """Runs with metrics of any name, failed datasets and their own aggregate, written and read back."""
    failed = F.col("accuracy").isNull()
    result = F.struct(
        "accuracy",
        F.when(~failed, F.col("scaffolding_rate") * 2 - 1).alias("mean_reward"),
        "total",
        F.when(failed, "out of memory").alias("error"),
    )
    weighted = F.try_divide(F.sum(F.col("accuracy") * F.col("total")), F.sum("total")).alias("weighted_accuracy")
    documents = t.run_table.groupBy("run_id", "stage", F.col("ts").alias("timestamp"), "model_path").agg(
        F.map_from_entries(F.collect_list(F.struct("dataset", result))).alias("datasets"),
        F.struct(weighted).alias("aggregate"),
    )
    path = f"{t.scratch}/run-metrics"
    runs.write_json(documents, path)
    results = settle(runs.read_run_results(t.spark, path, one_per_line=True))
    metrics = runs.result_metrics(results).select("run_id", "dataset", "metric", "value")
    total = F.get_json_object("result", "$.total").cast("bigint").alias("total")
    return results.select("run_id", "dataset", total, "weighted_accuracy", "error").join(
        metrics, ["run_id", "dataset"], "left"
    )


@query(
    "metric_log_write_read",
    "SELECT run, metric, step, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text, value FROM @points",
    doubles=["value"],
    longs=["step"],
)
def metric_log_write_read(t: Tables) -> DataFrame:
    """Points written as log lines, a folder per run, and read back in long form."""
    path = f"{t.scratch}/log"
    merged = None
    for run in ("run0", "run1", "run2"):
        metric_log.append_log(t.points.where(F.col("run") == run), f"{path}/{run}")
        part = metric_log.read_log(t.spark, f"{path}/{run}", run)
        merged = part if merged is None else merged.unionByName(part)
    return merged.select("run", "metric", "step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"), "value")
