"""Sources, sinks, normalisation and whole plans on small inputs."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from edulake import session
from edulake.functions.lexicon import TUTOR_PROMPTS
from edulake.operators import chat, judge, normalize, split
from edulake.plans import build, evaluate, feedback
from edulake.session import settle
from edulake.sources import image_files, images, metric_log, registry, runs, samples


def write_json(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_conversation_array_and_images(spark, tmp_path):
    turns = [{"from": "human", "value": "<image>\n问"}, {"from": "gpt", "value": "答"}]
    write_json(
        tmp_path / "geo170k-synthetic.json",
        [
            {"conversations": turns, "image": ["a.png"], "image_file": "geo170k"},
            {"conversations": turns, "image": ["b.png"], "image_file": "geo170k"},
            {"conversations": turns, "image": ["c.png", "d.png"], "image_file": "plain"},
            {"conversations": turns, "image": [], "image_file": "plain"},
        ],
    )
    for name in ("data/local/Open-source-data/geo170k/a.png", "plain/c.png"):
        file = tmp_path / "images" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(name.encode())
    rows = images.read_conversation_array(spark, str(tmp_path / "*.json"))
    files = images.read_images(spark, str(tmp_path / "images"))
    done = normalize.normalize_source_conversations(rows, files, images.folder_table(spark)).collect()
    assert sorted(bytes(r["image_bytes"][0]).decode() for r in done) == [
        "data/local/Open-source-data/geo170k/a.png",
        "plain/c.png",
    ]
    assert {(r["subject"], r["grade_level"], r["question_type"], r["source"]) for r in done} == {
        ("math", "K12", "synthetic", "geo170k")
    }
    assert json.loads(done[0]["conversations"]) == [
        {"role": "user", "content": "<image>\n问"},
        {"role": "assistant", "content": "答"},
    ]


def qa(spark, rows, schema):
    return spark.createDataFrame(rows, "row_id long, " + schema)


def test_normalise_counts_and_cap(spark):
    table = qa(
        spark,
        [(1, "q1", ["x", "y"], 1, "why", b"i"), (2, "q2", [], None, None, b"j"), (3, "q3", None, 0, "", None), (4, "q4", ["z"], 0, None, b"k")],
        "question string, choices array<string>, answer int, lecture string, image binary",
    )
    seen = Observation("load")
    got = sorted(normalize.normalize_qa(table, "scienceqa", observation=seen).collect(), key=lambda r: r["row_id"])
    assert [json.loads(r["conversations"])[1]["content"] for r in got] == [
        "<image>\nq1\nA. x\nB. y", "<image>\nq4\nA. z"]
    assert [json.loads(r["conversations"])[2]["content"] for r in got] == [
        "解析：why\n\n正确答案是 B", "正确答案是 A"]
    # A row without an answer is skipped; a table without the column means the first choice.
    assert (seen.get["kept"], seen.get["skipped"]) == (2, 2)
    bare = normalize.normalize_qa(table.drop("answer"), "scienceqa").collect()
    assert {json.loads(r["conversations"])[2]["content"][-1] for r in bare} == {"A"} and len(bare) == 3
    capped = normalize.normalize_qa(table, "scienceqa", max_samples=2).collect()
    assert sorted(r["row_id"] for r in capped) == [1, 4]


def test_normalise_letters_close_up_and_literal_lists(spark):
    table = qa(spark, [(1, "q", "a", "", None, "d", "C", "e")], "question string, A string, B string, C string, D string, answer string, explanation string")
    got = json.loads(normalize.normalize_qa(table, "ceval").first()["conversations"])
    assert got[1]["content"] == "q\nA. a\nB. d"
    assert got[2]["content"] == "解析：e\n\n答案：C"
    literal = qa(spark, [(1, "q", "['甲', '乙']", "A")], "question string, choices string, answer string")
    assert json.loads(normalize.normalize_qa(literal, "cmmlu").first()["conversations"])[1]["content"] == "q\nA. 甲\nB. 乙"


def test_normalise_empty_answer_list_skips_the_row(spark):
    table = qa(
        spark,
        [(1, "q", "x", ["y"], b"i"), (2, "q", "x", [], b"i"), (3, "q", None, ["y"], b"i"), (4, "q", "x", None, b"i")],
        "question string, answer string, answers array<string>, image binary",
    )
    got = normalize.normalize_qa(table, "ocr_vqa").orderBy("row_id").collect()
    assert [(r["row_id"], json.loads(r["conversations"])[2]["content"]) for r in got] == [
        (1, "答案：x"), (3, "答案：y"), (4, "答案：x")]


def test_normalise_article_and_gold(spark):
    table = qa(spark, [(1, "x" * 250, "q", None, "B")], "article string, question string, options array<string>, answer string")
    text = json.loads(normalize.normalize_qa(table, "race").first()["conversations"])[1]["content"]
    assert text == "<image>\n阅读以下文章，回答问题：\n\n文章：" + "x" * 200 + "...\n\nq"
    gold = qa(spark, [(1, " 问题：q ", ["u", "v"], [1])], "query string, choices array<string>, gold array<int>")
    turns = json.loads(normalize.normalize_qa(gold, "gaokao_mathqa").first()["conversations"])
    assert turns[1]["content"] == "q\nA. u\nB. v" and turns[2]["content"] == "答案：B"
    text_gold = qa(spark, [(1, "q", None, ["x+1"])], "query string, choices array<string>, gold array<string>")
    assert json.loads(normalize.normalize_qa(text_gold, "gaokao_mathqa").first()["conversations"])[2]["content"] == "答案：x+1"


def test_normalise_with_missing_columns_and_odd_lists(spark):
    plain = qa(spark, [(1, "q", b"i")], "question string, image binary")
    assert json.loads(normalize.normalize_qa(plain, "ocr_vqa").first()["conversations"])[2]["content"] == "答案："
    for name in normalize.SOURCES:
        got = normalize.normalize_qa(spark.range(2).withColumnRenamed("id", "row_id"), name)
        dropped = normalize.SOURCES[name].image_rule == "drop"
        assert got.count() == (0 if dropped else 2), name
        for row in got.collect():
            assert all(turn["content"] is not None for turn in json.loads(row["conversations"])), name
    empty = qa(spark, [(1, "q", [], [])], "query string, choices array<string>, gold array<int>")
    assert json.loads(normalize.normalize_qa(empty, "gaokao_mathqa").first()["conversations"])[2]["content"] == "答案：[]"
    numbers = qa(spark, [(1, "q", [1, 2], b"i")], "question string, answer array<int>, image binary")
    assert json.loads(normalize.normalize_qa(numbers, "vizwiz").first()["conversations"])[2]["content"] == "答案：1; 2"


def test_configs_outside_the_list_are_left_out(spark):
    rows = [(1, "q", "college_physics", "A"), (2, "q", "art_studies", "A")]
    table = qa(spark, rows, "question string, config string, answer string")
    assert [r["row_id"] for r in normalize.normalize_qa(table, "ceval").collect()] == [1]


def test_all_sources_are_described():
    assert len(normalize.SOURCES) == 28


def test_registries(spark, tmp_path):
    table = registry.dataset_registry(spark)
    assert table.count() == 17
    assert len(registry.EVAL_PATHS) == 19 and len(registry.TRAIN_PATHS) == 19
    (tmp_path / "dataset").mkdir()
    (tmp_path / "dataset" / "edu_ocr.parquet").write_text("")
    known = registry.path_registry(spark, registry.TRAIN_PATHS, str(tmp_path))
    assert [r["dataset"] for r in known.where("path_exists").collect()] == ["ocr"]
    evaluated, trained = registry.config_registries(spark)
    assert split.config_overlap(evaluated, trained).count() == 5


def test_chat_injection_and_prompts(one):
    turns = [("user", "<image>"), ("assistant", "a")]
    schema = "turns array<struct<role string, content string>>, id long"
    always = one(chat.inject_system_prompt(F.col("turns"), F.col("id")), schema, turns, 7)
    assert len(always) == 3 and always[0]["role"] == "system" and always[0]["content"] in TUTOR_PROMPTS
    assert len(one(chat.inject_system_prompt(F.col("turns"), F.col("id"), 0.0), schema, turns, 7)) == 2
    own = [("system", "s"), *turns]
    assert one(chat.inject_system_prompt(F.col("turns"), F.col("id")), schema, own, 7)[0]["content"] == "s"
    rendered = one(chat.render_messages(F.col("turns")), schema, turns, 7)
    assert rendered[0]["parts"] == ["image", "text"] and rendered[0]["text"] == "请解答这道题"
    prompt = one(chat.prompt_turns(F.col("turns"), F.col("id")), schema, own, 7)
    assert [t["role"] for t in prompt] == ["system", "user"] and prompt[0]["content"] in TUTOR_PROMPTS
    assert one(chat.first_answer(F.col("turns")), schema, [("user", "q")], 7) == ""


@pytest.mark.parametrize(
    ("text", "expected"),
    [("q\nassistant\na", 12), ("q\nassistant: a", 12), ("assistant\na", 10), ("x assistant\n\nassistant:", 23), ("none", None)],
)
def test_answer_offset(one, text, expected):
    assert one(chat.answer_offset(F.col("t")), "t string", text) == expected


def test_run_documents(spark, tmp_path):
    ci = {"accuracy": {"lower": 0.1, "upper": 0.2, "p_value": 0.001}}
    sample = {"question": "q", "gt_answer": "a", "response": "r", "is_correct": False}
    write_json(
        tmp_path / "runs" / "sft_1.json",
        {
            "timestamp": "20260101_101500",
            "stage": "sft",
            "model_path": "m",
            "datasets": {"x": {"accuracy": 0.5, "total": 10, "confidence_intervals": ci, "raw_samples": [sample]}, "y": {"kw_match": 0.25}},
            "aggregate": {"weighted_accuracy": 0.5, "weakest_datasets": ["y"]},
        },
    )
    write_json(tmp_path / "runs" / "latest.json", {"stage": "sft", "file": "sft_1.json"})
    loaded = runs.read_runs(spark, str(tmp_path / "runs"))
    assert [r["run_id"] for r in loaded.collect()] == ["sft_1"]
    flat = {r["dataset"]: r for r in runs.flatten_runs(loaded).collect()}
    assert flat["x"]["accuracy"] == 0.5 and flat["y"]["kw_match"] == 0.25 and flat["y"]["total"] is None
    assert runs.raw_samples(loaded).first()["response"] == "r"
    write_json(tmp_path / "flat" / "old.json", {"accuracy_x": 0.5, "kw_match_y": 1, "timestamp": "t"})
    assert {r["key"]: r["value"] for r in runs.read_flat_runs(spark, str(tmp_path / "flat")).collect()} == {"accuracy_x": 0.5, "kw_match_y": 1.0}


def test_run_table_is_appended(spark, tmp_path):
    path = str(tmp_path / "table")
    summary = spark.createDataFrame([("x", 0.5, 10)], "dataset string, accuracy double, total long")
    runs.append_run(summary, path, "r1", "sft", "20260101_000000")
    runs.append_run(summary, path, "r2", "grpo", "20260102_000000")
    assert {r["stage"] for r in runs.read_run_table(spark, path).collect()} == {"sft", "grpo"}


def test_run_appended_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("x", 0.5), ("y", 0.25)], "dataset string, accuracy double")
    again = spark.createDataFrame([("x", 0.75, 3)], "dataset string, accuracy double, total long")
    runs.append_run(first, path, "20260101", "sft", "1")
    runs.append_run(first, path, "20260101", "sft", "1")
    runs.append_run(first, path, "b", "sft", "2")
    assert runs.read_run_table(spark, path).count() == 4
    # A half-written run, and one that was written and published twice.
    runs.stage_run(first, path, "broken", "sft", "3")
    attempt = runs.stage_run(again, path, "b", "sft", "2")
    assert runs.read_run_table(spark, path).count() == 4
    for _ in range(2):
        runs.commit_run(spark, path, "b", attempt)
    got = sorted((r.run_id, r.dataset, r.accuracy, r.total) for r in runs.read_run_table(spark, path).collect())
    assert got == [("20260101", "x", 0.5, None), ("20260101", "y", 0.25, None), ("b", "x", 0.75, 3)]


def test_metric_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ['{"step": 1, "time": "2026-01-01T00:00:00.5", "loss": 0.5, "lr": 1e-4, "note": "x"}', '{"step": 2, "time": "2026-01-01T00:00:01", "loss": 0.25}']
    (tmp_path / "log" / "a.jsonl").write_text("\n".join(lines))
    points = metric_log.read_log(spark, str(tmp_path / "log"), "a").collect()
    assert sorted((p["metric"], p["step"], p["value"]) for p in points) == [("loss", 1, 0.5), ("loss", 2, 0.25), ("lr", 1, 1e-4)]


def test_write_is_skipped_when_present(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("[]", None, "a")], "conversations string, image_bytes array<binary>, dataset string")
    samples.write_if_absent(rows, path)
    samples.write_if_absent(rows.unionByName(rows), path)
    assert spark.read.parquet(path).count() == 1
    merged, skipped = samples.read_datasets(spark, f"{path}/dataset=a, {path}/dataset=b")
    assert merged.count() == 1 and skipped == [f"{path}/dataset=b"]
    with pytest.raises(ValueError):
        samples.concat_same_schema([rows, rows.drop("dataset")])


def length_judge(folder):
    """A judge that scores by the length of the response in its prompt, and notes every load and call in a folder."""

    def make():
        own = f"{folder}/{os.getpid()}"
        with open(own, "a") as file:
            file.write("load\n")

        def model(prompts):
            with open(own, "a") as file:
                file.write(f"call {len(prompts)}\n")
            sizes = [p.count("§") for p in prompts]
            return [json.dumps(dict.fromkeys(judge.JUDGE_WEIGHTS, n)) if n else "no idea" for n in sizes]

        return model

    return make


def test_model_is_made_once_per_worker_and_batches_are_bounded(spark, tmp_path):
    rows = spark.range(300).repartition(6).select(
        F.col("id"), F.lit("q").alias("question"), F.lit("x").alias("gt_answer"),
        F.repeat(F.lit("§"), (F.col("id") % 4).cast("int")).alias("response"),
    )
    for _ in range(2):
        scored = judge.score_with_model(rows, length_judge(tmp_path), batch_size=16)
        got = {r.id: r.reward for r in scored.collect()}
        assert got == {k: pytest.approx(k % 4 / 10) for k in range(300)}
        logs = [f.read_text().split("\n") for f in tmp_path.iterdir()]
    # Two queries have a model each.
    assert all(1 <= log.count("load") <= 2 for log in logs)
    sizes = [int(line.split()[1]) for log in logs for line in log if line.startswith("call")]
    assert sum(sizes) == 600 and max(sizes) <= 16
    hybrid = judge.score_with_model(rows, length_judge(tmp_path), "hybrid").where("id = 3").first()
    assert hybrid.reward > 0.7 * 0.3


def test_groups_are_scored_in_their_order(spark, tmp_path):
    groups = [(1, "q", ["§§", "", "§", None], "x"), (2, "q", [], "x"), (3, None, ["§§§"], None)]
    table = spark.createDataFrame(groups, "id long, question string, responses array<string>, gt_answer string")
    got = {r.id: r.rewards for r in judge.score_groups(table, "id", length_judge(tmp_path)).collect()}
    assert got == {1: pytest.approx([0.2, 0.0, 0.1, 0.0]), 2: [], 3: pytest.approx([0.3])}


def test_build_plan_splits_by_question(spark):
    table = spark.range(400).select(
        F.col("id").alias("row_id"), F.concat(F.lit("q"), F.col("id") % 150).alias("question"), F.lit("A").alias("answer")
    )
    done = build.build_samples({"cmmlu": table, "other": table}, group_by_question=True)
    assert done.count() == 400 and {r[0] for r in done.select("dataset").distinct().collect()} == {"cmmlu"}
    question = chat.last_question(chat.parse_turns(F.col("conversations")))
    assert split.leaked_prefixes(done.withColumn("question", question)).count() == 0


def test_evaluate_and_feedback_plans(spark):
    words = F.when(F.col("id") % 3 == 0, "首先 观察 答案 A").otherwise("B")
    responses = spark.range(60).select(
        F.concat(F.lit("d"), F.col("id") % 3).alias("dataset"),
        F.col("id").alias("sample_id"),
        F.lit("q").alias("question"),
        F.lit("答案 A").alias("gt_answer"),
        words.alias("response"),
    )
    done = evaluate.evaluate(responses)
    summary = {r["dataset"]: r for r in done.summary.collect()}
    assert (summary["d0"]["accuracy"], summary["d1"]["accuracy"], summary["d0"]["total"]) == (1.0, 0.0, 20)
    assert done.weakest.count() == 3 and done.intervals.count() == 9
    assert done.errors.agg(F.sum("count")).first()[0] == 40
    table = done.summary.select(F.lit("r").alias("run_id"), F.lit("sft").alias("stage"), F.lit("1").alias("ts"), "*")
    known = spark.createDataFrame([("d0", "p0", True), ("d1", "p1", True), ("d9", "p9", False)], "dataset string, path string, path_exists boolean")
    weights = feedback.resample_from_latest(table, known)
    assert {r["dataset"]: r["weight"] for r in weights.collect()} == {"d0": 0.5, "d1": 0.739, "d9": 0.0}
    drawn = feedback.next_training_sample(responses.select("dataset", "sample_id"), weights, "sample_id", draws=500)
    assert drawn.count() == 500


def test_settled_tables_are_kept_until_released(spark, monkeypatch):
    monkeypatch.setattr(session, "_SETTLED", [])
    table = settle(spark.range(5))
    assert table.count() == 5 and len(session._SETTLED) == 1
    folder = session._SETTLED[0]
    assert samples.path_exists(spark, folder)
    with session.settled_within(spark):
        inner = settle(spark.range(3))
        assert inner.count() == 3 and len(session._SETTLED) == 2
    assert session._SETTLED == [folder] and samples.path_exists(spark, folder)
    assert session.release_settled(spark) == 1
    assert not samples.path_exists(spark, folder)


def test_image_bytes_pass_no_exchange(spark, tmp_path, monkeypatch):
    root = f"file:{tmp_path}/images"
    monkeypatch.setattr(image_files, "BATCH_BYTES", 100)
    stored = [(f"a/b c/{k}.png", bytes([k]) * (k * 10)) for k in range(30)] + [("top.png", b""), ("ü%20.png", b"x")]
    assert image_files.write_files(spark.createDataFrame(stored, "path string, content binary").repartition(4), root) == 32
    listed = image_files.list_files(spark, root)
    # Empty files hold no image and are not listed.
    full = [(p, c) for p, c in stored if c]
    assert {(r.path, r.length) for r in listed.collect()} == {(p, len(c)) for p, c in full}
    rows = [(k, p) for k, (p, _) in enumerate(stored)] * 2 + [(90, "missing.png"), (91, None)]
    found = image_files.attach_contents(spark.createDataFrame(rows, "k int, path string"), listed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange" in line]
    assert exchanged and not any("content" in line for line in exchanged)
    got = sorted((r.k, r.path, bytes(r.content)) for r in found.collect())
    assert got == sorted((k, p, c) for k, (p, c) in enumerate(stored) if c for _ in range(2))
    with pytest.raises(ValueError):
        image_files.opened("ftp://host/file")


def test_rows_are_not_dealt_out_by_folder_key(spark):
    """Two keys hold all rows; the few folders go to the rows, and unmapped and null keys stay as they were."""
    rows = spark.range(1000).select(
        F.col("id").alias("row_id"),
        F.array(F.concat(F.lit("i"), F.col("id").cast("string"))).alias("image"),
        F.when(F.col("id") % 3 == 0, "geo170k").when(F.col("id") % 3 == 1, "other").alias("image_file"),
    )
    folder = F.when(F.col("id") % 3 == 0, "data/local/Open-source-data/geo170k/i").otherwise("other/i")
    files = spark.range(1000).select(F.concat(folder, F.col("id").cast("string")).alias("path"), F.lit(b"x").alias("content"))
    found = images.resolve_images(rows, files, images.folder_table(spark))
    assert found.where("image_file IS NOT NULL").count() == found.count() == 667
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(image_file" not in plan and "BroadcastHashJoin [image_file" in plan
