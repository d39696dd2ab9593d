"""Error analysis of wrong responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edulake.functions import text as tx
from edulake.functions.lexicon import CONCLUSION_PATTERN, ERROR_ADVICE, ERROR_OTHER, ERROR_RULES
from edulake.functions.numeric import round_exact


def error_type(response: Column) -> Column:
    """First matching error class, in rule order, then the fallbacks by shape of the response."""
    label = F.when(F.coalesce(response, F.lit("")) == "", F.lit(ERROR_OTHER))
    for name, patterns in ERROR_RULES:
        label = label.when(tx.matches_any(response, patterns), F.lit(name))
    unclear = response.contains("看不清") | (response.contains("图像") & response.contains("无法"))
    return (
        label.when(unclear, F.lit("图像理解错误"))
        .when(F.length(response) < 20, F.lit("答案格式错误"))
        .when(~tx.matches(response, CONCLUSION_PATTERN), F.lit("推理错误"))
        .otherwise(F.lit(ERROR_OTHER))
    )


def wrong_samples(df: DataFrame) -> DataFrame:
    """Rows marked wrong; a missing mark counts as correct. Texts are cut for the report."""
    return df.where(~F.coalesce(F.col("is_correct"), F.lit(True))).select(
        "dataset",
        "sample_id",
        F.substring("question", 1, 200).alias("question"),
        F.substring("gt_answer", 1, 100).alias("gt_answer"),
        F.substring("response", 1, 300).alias("model_response"),
        error_type(F.col("response")).alias("error_type"),
    )


def error_distribution(wrong: DataFrame) -> DataFrame:
    """Count and share per error class."""
    counts = wrong.groupBy("error_type").agg(F.count("*").alias("count"))
    # At most one row per error class is left here, so one partition is enough for the total.
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("error_type", "count", round_exact(F.col("count") / total, 4).alias("ratio"))


def recommendations(distribution: DataFrame) -> DataFrame:
    """Advice per error class; classes without advice are left out."""
    advice = distribution.sparkSession.createDataFrame(ERROR_ADVICE, "error_type string, recommendation string")
    return distribution.join(F.broadcast(advice), "error_type")


def weakest_dataset_advice(runs: DataFrame) -> DataFrame:
    """One advice row per dataset listed as weakest in a run."""
    return runs.select("run_id", F.explode("aggregate.weakest_datasets").alias("dataset")).withColumn(
        "recommendation",
        F.concat(
            F.lit("数据集 "),
            F.col("dataset"),
            F.lit(" 表现较弱，建议：(1) 增加训练样本数；(2) 检查数据质量；(3) 调整采样权重"),
        ),
    )
