"""Dataset registries: what exists where, how much of it is used, and how it is split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edulake.operators.normalize import CEVAL_EVAL_CONFIGS, CEVAL_TRAIN_CONFIGS
from edulake.sources.samples import path_exists

# ---- Fixed values: dataset name, training path, evaluation path, cap, evaluation share, evaluation cap. ----
DATASETS = (
    ("we_math", "dataset/edu_we_math.parquet", "dataset/eval/eval_we_math.parquet", None, 0.05, 500),
    ("geo170k", "dataset/edu_geo170k.parquet", "dataset/eval/eval_geo170k.parquet", 50000, 0.05, 500),
    ("cmm_math", "dataset/edu_cmm_math.parquet", "dataset/eval/eval_cmm_math.parquet", None, 0.05, 500),
    ("math_real", "dataset/edu_math_real.parquet", "dataset/eval/eval_math_real.parquet", None, 0.10, 200),
    ("scienceqa", "dataset/edu_science.parquet", "dataset/eval/eval_science.parquet", None, 0.05, 500),
    ("windata-math", "dataset/edu_windata_math.parquet", "dataset/eval/eval_windata_math.parquet", 10000, 0.05, 500),
    ("ocr_vqa", "dataset/edu_ocr.parquet", "dataset/eval/eval_ocr.parquet", 20000, 0.05, 500),
    ("chartqa", "dataset/edu_chartqa.parquet", "dataset/eval/eval_chartqa.parquet", 10000, 0.05, 500),
    ("ceval", "dataset/edu_ceval.parquet", "dataset/eval/eval_ceval.parquet", None, 0.05, 200),
    ("cmmlu", "dataset/edu_cmmlu.parquet", "dataset/eval/eval_cmmlu.parquet", None, 0.05, 500),
    ("ape210k", "dataset/edu_ape210k.parquet", "dataset/eval/eval_ape210k.parquet", 20000, 0.05, 500),
    ("openr1_math", "dataset/edu_openr1_math.parquet", "dataset/eval/eval_openr1_math.parquet", 20000, 0.05, 500),
    ("gaokao_mathqa", "dataset/edu_gaokao_mathqa.parquet", "dataset/eval/eval_gaokao_mathqa.parquet", None, 0.10, 100),
    ("gaokao_mathcloze", "dataset/edu_gaokao_mathcloze.parquet", "dataset/eval/eval_gaokao_mathcloze.parquet",
     None, 0.15, 50),
    ("mathverse", "dataset/edu_math_verse.parquet", "dataset/eval/eval_math_verse.parquet", None, 0.05, 200),
    ("mathvista", "dataset/edu_math_vista.parquet", "dataset/eval/eval_math_vista.parquet", None, 0.10, 100),
    ("race", "dataset/edu_race.parquet", "dataset/eval/eval_race.parquet", 10000, 0.05, 500),
)

#: Evaluation sets by name; one is assembled from subject configs and has no file.
EVAL_PATHS = {
    "we_math": "dataset/eval/eval_we_math.parquet",
    "geo170k": "dataset/eval/eval_geo170k.parquet",
    "windata_math": "dataset/eval/eval_windata_math.parquet",
    "cmmu": "dataset/eval/eval_cmmu.parquet",
    "cmmmu": "dataset/eval/eval_cmmmu.parquet",
    "m3exam": "dataset/eval/eval_m3exam.parquet",
    "mmscibench": "dataset/eval/eval_mmscibench.parquet",
    "scienceqa": "dataset/eval/eval_science.parquet",
    "ceval": None,
    "ape210k": "dataset/eval/eval_ape210k.parquet",
    "chartqa": "dataset/eval/eval_chartqa.parquet",
    "cmmlu": "dataset/eval/eval_cmmlu.parquet",
    "math_verse": "dataset/eval/eval_math_verse.parquet",
    "math_vista": "dataset/eval/eval_math_vista.parquet",
    "ocr": "dataset/eval/eval_ocr.parquet",
    "openr1_math": "dataset/eval/eval_openr1_math.parquet",
    "race": "dataset/eval/eval_race.parquet",
    "gaokao_mathqa": "dataset/eval/eval_gaokao_mathqa.parquet",
    "gaokao_mathcloze": "dataset/eval/eval_gaokao_mathcloze.parquet",
}

TRAIN_PATHS = {
    "we_math": "dataset/edu_we_math.parquet",
    "geo170k": "dataset/edu_geo170k.parquet",
    "windata_math": "dataset/edu_windata_math.parquet",
    "cmmu": "dataset/edu_cmmu.parquet",
    "cmmmu": "dataset/edu_cmmmu.parquet",
    "m3exam": "dataset/edu_m3exam.parquet",
    "mmscibench": "dataset/edu_mmscibench.parquet",
    "scienceqa": "dataset/edu_science.parquet",
    "math_verse": "dataset/edu_math_verse.parquet",
    "math_vista": "dataset/edu_math_vista.parquet",
    "ocr": "dataset/edu_ocr.parquet",
    "chartqa": "dataset/edu_chartqa.parquet",
    "ceval": "dataset/edu_ceval.parquet",
    "cmmlu": "dataset/edu_cmmlu.parquet",
    "ape210k": "dataset/edu_ape210k.parquet",
    "openr1_math": "dataset/edu_openr1_math.parquet",
    "gaokao_mathqa": "dataset/edu_gaokao_mathqa.parquet",
    "gaokao_mathcloze": "dataset/edu_gaokao_mathcloze.parquet",
    "race": "dataset/edu_race.parquet",
}

#: Rows per dataset of the curated set for policy training.
CURATED_QUOTAS = (("cmmu", 1500), ("mmscibench", 1000), ("math_verse", 1000), ("math_vista", 500), ("scienceqa", 1000))
# ---- End of fixed values. ----


def dataset_registry(spark: SparkSession) -> DataFrame:
    schema = "dataset string, train_path string, eval_path string, max_samples long, eval_ratio double, eval_cap long"
    return spark.createDataFrame(DATASETS, schema)


def path_registry(spark: SparkSession, paths: dict[str, str | None], root: str = "") -> DataFrame:
    """``dataset``, ``path`` and whether it exists below the root."""
    rows = []
    for name, path in paths.items():
        full = f"{root.rstrip('/')}/{path}" if root and path else path
        rows.append((name, full, bool(full) and path_exists(spark, full)))
    return spark.createDataFrame(rows, "dataset string, path string, path_exists boolean")


def curated_quotas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CURATED_QUOTAS, "dataset string, quota long")


def config_registries(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Subject configs evaluated and trained on, all from the test split."""
    schema = "dataset string, config string"
    tables = [
        spark.createDataFrame([("ceval", c) for c in configs], schema).withColumn("split", F.lit("test"))
        for configs in (CEVAL_EVAL_CONFIGS, CEVAL_TRAIN_CONFIGS)
    ]
    return tables[0], tables[1]
