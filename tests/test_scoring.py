"""Scores against brute force and against values worked out by hand."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edulake.functions import lexicon as lx
from edulake.functions import text as tx
from edulake.functions.numeric import normal_cdf, round_exact
from edulake.operators import compare, errors, judge, resample, scoring

ALPHABET = "ab Zé一二十两几个多少加倍减半观察。，.,;:0123\n\t_-@中\U0001f600　\x85ß"


def random_texts(count: int, longest: int = 60, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) for _ in range(count)]


def python_normalize(text: str) -> str:
    for word, digits in lx.NUMBER_WORDS:
        text = text.replace(word, digits)
    text = re.sub(r"\s+", " ", text)
    return re.sub(r"[^\w\s一-鿿]", " ", text).strip()


def python_tokens(text: str) -> list[str]:
    return (
        re.findall(r"[一-鿿]", text) + re.findall(r"[a-zA-Z]+", text.lower()) + re.findall(r"\d+\.?\d*", text)
    )


def python_cosine(left: list[str], right: list[str]) -> float:
    l, r = Counter(left), Counter(right)
    idf = {w: math.log(2 / ((w in l) + (w in r) + 1)) + 1 for w in {*l, *r}}
    dot = sum(l[w] * r[w] * idf[w] ** 2 for w in idf)
    norms = [math.sqrt(sum((c[w] * idf[w]) ** 2 for w in idf)) for c in (l, r)]
    return dot / (norms[0] * norms[1]) if norms[0] and norms[1] else 0.0


def test_normalised_text_and_tokens(spark):
    texts = random_texts(400)
    x = F.col("x")
    rows = (
        spark.createDataFrame([(t,) for t in texts], "x string")
        .select(
            "x",
            tx.normalize_text(x).alias("normal"),
            tx.tokens(x).alias("tokens"),
            tx.tokens(tx.normalize_text(x)).alias("slow"),
            tx.normal_tokens(x).alias("fast"),
            tx.strip(x).alias("strip"),
            tx.words(x).alias("words"),
            tx.keywords(x).alias("keywords"),
        )
        .collect()
    )
    for row in rows:
        assert row["normal"] == python_normalize(row["x"])
        assert row["tokens"] == python_tokens(row["x"])
        assert row["slow"] == row["fast"] == python_tokens(python_normalize(row["x"]))
        assert row["strip"] == row["x"].strip()
        assert row["words"] == row["x"].split()
        wanted = set(re.findall(r"[一-鿿]{2,}", row["x"])) | set(re.findall(r"[a-z]{2,}", row["x"].lower()))
        assert set(row["keywords"]) == wanted and len(row["keywords"]) == len(wanted)


def test_cosine_and_fluency(spark):
    texts = random_texts(300, seed=5)
    pairs = list(zip(texts, random_texts(300, seed=6)))
    x, y = F.col("x"), F.col("y")
    rows = (
        spark.createDataFrame(pairs, "x string, y string")
        .select("x", "y", scoring.tfidf_cosine(tx.tokens(x), tx.tokens(y)).alias("c"), scoring.fluency_score(x).alias("f"))
        .collect()
    )
    for row in rows:
        assert row["c"] == pytest.approx(python_cosine(python_tokens(row["x"]), python_tokens(row["y"])))
        chars = row["x"]
        bigrams = [chars[i : i + 2] for i in range(len(chars) - 1)]
        assert row["f"] == pytest.approx(len(set(bigrams)) / len(bigrams) if bigrams else 0.0)


@pytest.mark.parametrize("vocabulary", [3, 64, 65, 500])
def test_cosine_with_few_and_many_shared_tokens(spark, vocabulary):
    rng = random.Random(vocabulary)
    lists = [[[f"w{rng.randrange(vocabulary)}" for _ in range(700)] for _ in range(2)] for _ in range(5)]
    df = spark.createDataFrame(lists + [[["a"], []], [[], []]], "l array<string>, r array<string>")
    for row in df.select("l", "r", scoring.tfidf_cosine(F.col("l"), F.col("r")).alias("c")).collect():
        assert row["c"] == pytest.approx(python_cosine(row["l"], row["r"]))


def test_idf_of_shared_and_single_tokens():
    assert scoring.IDF_SHARED == pytest.approx(0.594535, abs=1e-6)
    assert math.log(2 / 2) + 1 == 1.0


@pytest.mark.parametrize(
    ("response", "answer", "expected"),
    [
        ("1 2", "2 1", 1.0),
        ("1 2 3", "2 9", 0.7),
        ("no", "also none", 0.5),
        ("7", "8", 0.0),
        ("0 5", "0 6", 1 / 3),
        ("0 100", "0 101", 0.7),
        ("3.50 4", "3.5 4", 0.7),
        ("", "4", 0.0),
    ],
)
def test_number_match(one, response, answer, expected):
    got = one(scoring.number_match(F.col("r"), F.col("a")), "r string, a string", response, answer)
    assert got == pytest.approx(expected)


def test_accuracy_of_empty_answer(one):
    assert one(scoring.accuracy_score(F.col("r"), F.col("a")), "r string, a string", "text", "") == 0.0
    assert one(scoring.accuracy_score(F.col("r"), F.col("a")), "r string, a string", "text", None) == 0.0
    assert one(scoring.accuracy_score(F.col("r"), F.col("a")), "r string, a string", "中文 12", "中文 12") == pytest.approx(1)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("首先看，然后算，接着写，最后答", 1.0), ("首先看，然后算", 0.7), ("第3步", 0.4), ("plain", 0.1), ("步骤二：1) Step 2", 0.7)],
)
def test_completeness(one, text, expected):
    assert one(scoring.completeness_score(F.col("r")), "r string", text) == expected


def test_scaffolding_and_format(one):
    r = F.col("r")
    # Direct answer, nothing else: -0.3 + 0.05 + 0.3; the phrase itself is one keyword of dense text: -0.3 + 0.5 + 0.3.
    assert one(scoring.scaffolding_score(r), "r string", "选 C") == pytest.approx(0.05)
    assert one(scoring.scaffolding_score(r), "r string", "答案是A") == pytest.approx(0.5)
    assert one(scoring.scaffolding_score(r), "r string", "想一想为什么") == pytest.approx(0.8)
    assert one(scoring.scaffolding_score(r), "r string", "") == pytest.approx(0.35)
    assert one(scoring.format_score(r), "r string", "短") == pytest.approx(0.5)
    assert one(scoring.format_score(r), "r string", "") == pytest.approx(0.6)
    assert one(scoring.format_score(r), "r string", "一" * 19 + "。") == pytest.approx(1.0)
    assert one(scoring.format_score(r), "r string", "##@@" + "x" * 30) == pytest.approx(0.6)


GOOD = '{"accuracy": 9, "completeness": 8, "scaffolding": 9, "fluency": 8, "format": 9}'


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (GOOD, 0.87),
        ("评分：\n" + GOOD + " 完", 0.87),
        (GOOD.replace("9", "12"), (10 * 0.4 + 8 * 0.2 + 10 * 0.2 + 8 * 0.1 + 10 * 0.1) / 10),
        (GOOD.replace('"fluency": 8, ', ""), 0.0),
        (GOOD.replace('"', "'"), 0.0),
        ("no json", 0.0),
        ("", 0.0),
        ("{broken} " + GOOD, 0.0),
    ],
)
def test_judge_reward(one, text, expected):
    assert one(judge.judge_reward(judge.judge_scores(F.col("t"))), "t string", text) == pytest.approx(expected)


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        judge.judge_reward(F.lit(None), {"accuracy": 0.5})
    with pytest.raises(ValueError):
        judge.create_scorer("none")


def test_hybrid_scales(one):
    single = judge.hybrid_reward(F.lit(1.0), F.lit(0.5), F.col("r"))
    double = judge.hybrid_reward(F.lit(1.0), F.lit(0.5), F.col("r"), double_scale=True)
    assert one(single, "r string", "答案是 3") == pytest.approx(0.7 + 0.1 + 0.1)
    assert one(double, "r string", "答案是 3") == pytest.approx(0.49 + 0.1 + 0.1)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", "其他错误"),
        (None, "其他错误"),
        ("图片太模糊\n看不清", "图像理解错误"),
        ("逻辑不对", "推理错误"),
        ("未给出任何选项", "答案格式错误"),
        ("除法写错了", "计算错误"),
        ("OCR 结果不准确", "OCR识别错误"),
        ("不知道这个公式", "知识错误"),
        ("太短", "答案格式错误"),
        ("这是一个没有结论词的很长很长很长很长的回答内容", "推理错误"),
        ("这是一个有结论词的很长很长很长很长的回答所以是三", "其他错误"),
    ],
)
def test_error_type(one, text, expected):
    assert one(errors.error_type(F.col("r")), "r string", text) == expected


def test_pattern_dot_stops_at_line_feed_only(one):
    assert one(errors.error_type(F.col("r")), "r string", "图片\n不清晰" + "字" * 30 + "所以") == "其他错误"
    assert one(errors.error_type(F.col("r")), "r string", "图片\r不清晰" + "字" * 30 + "所以") == "图像理解错误"


def test_weights(one):
    v2 = resample.weight_v2(F.col("s"), F.col("n"))
    assert one(v2, "s double, n long", 0.5, 100) == pytest.approx(0.821, abs=1e-3)
    assert one(v2, "s double, n long", 1.0, 10) == 0.5
    assert one(resample.weight_v1(F.col("s")), "s double", 0.0) == 3.0


@pytest.mark.parametrize(
    ("tuned", "base", "expected"),
    [(0.60, 0.60, "fallback"), (0.56, 0.60, "severe"), (0.62, 0.60, "combined"), (0.70, 0.60, "good"),
     (0.59, 0.60, "fallback_slight"), (0.1, None, "good")],
)
def test_optimisation_verdict(spark, tuned, base, expected):
    scores = spark.createDataFrame([(tuned, base)], "grpo_accuracy double, sft_accuracy double")
    assert compare.optimisation_verdict(scores).first()["verdict"] == expected


def test_normal_cdf(one):
    for z in (-3.0, -0.5, 0.0, 1.0, 1.96, 4.0):
        assert one(normal_cdf(F.col("z")), "z double", z) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-7)


def test_exact_rounding(spark):
    rng = random.Random(1)
    values = [rng.randrange(-2000, 2000) / d for d in (8, 16, 32, 40, 64, 100, 2000) for _ in range(200)]
    values += [12.35, 1.005, 1.015, 0.0625, 2.5, -0.00001, 0.0]
    x = F.col("x")
    columns = [round_exact(x, k).alias(f"r{k}") for k in (0, 1, 3, 4)]
    texts = [tx.fixed(x, k).alias(f"t{k}") for k in (0, 1, 3, 4)]
    for row in spark.createDataFrame([(v,) for v in values], "x double").select("x", *columns, *texts).collect():
        for k in (0, 1, 3, 4):
            assert row[f"r{k}"] == round(row["x"], k)
            assert row[f"t{k}"] == f"{row['x']:.{k}f}"
