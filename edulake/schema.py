"""Schemas of the data model: samples, conversations, evaluation runs, judge scores and metric logs."""

from __future__ import annotations

from pyspark.sql import types as T

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
TURNS = T.ArrayType(TURN)

#: One training sample: a JSON list of turns, and the encoded images that belong to it.
SAMPLE = T.StructType(
    [
        T.StructField("conversations", T.StringType()),
        T.StructField("image_bytes", T.ArrayType(T.BinaryType())),
    ]
)

#: Columns a sample may carry besides the two above.
SAMPLE_ATTRIBUTES = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("grade_level", T.StringType()),
        T.StructField("question_type", T.StringType()),
        T.StructField("difficulty", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("split", T.StringType()),
    ]
)

#: A conversation as the JSON-array source holds it.
SOURCE_CONVERSATION = T.StructType(
    [
        T.StructField(
            "conversations",
            T.ArrayType(
                T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
            ),
        ),
        T.StructField("image", T.ArrayType(T.StringType())),
        T.StructField("image_file", T.StringType()),
    ]
)

INTERVAL = T.StructType(
    [
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
    ]
)
RAW_SAMPLE = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("gt_answer", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
    ]
)
DATASET_RESULT = T.StructType(
    [
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("step_completeness", T.DoubleType()),
        T.StructField("scaffolding_rate", T.DoubleType()),
        T.StructField("avg_response_length", T.DoubleType()),
        T.StructField("kw_match", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("total", T.LongType()),
        T.StructField("confidence_intervals", T.MapType(T.StringType(), INTERVAL)),
        T.StructField("raw_samples", T.ArrayType(RAW_SAMPLE)),
    ]
)
#: One evaluation run as a nested JSON document.
EVAL_RUN = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("model_path", T.StringType()),
        T.StructField("datasets", T.MapType(T.StringType(), DATASET_RESULT)),
        T.StructField(
            "aggregate",
            T.StructType(
                [
                    T.StructField("weighted_accuracy", T.DoubleType()),
                    T.StructField("weakest_datasets", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)

METRICS = ("accuracy", "step_completeness", "scaffolding_rate")
DIMENSIONS = ("accuracy", "completeness", "fluency", "scaffolding", "format")
