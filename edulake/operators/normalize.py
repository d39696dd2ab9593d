"""Bringing question-answer tables of many shapes into one chat schema.

A source is described by a ``SourceSpec``: which columns hold question, choices, answer, explanation and image,
and how they are put into words. ``normalize_qa`` turns any table into samples with one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edulake.functions import text as tx
from edulake.operators.chat import IMAGE_TAG, encode_turns
from edulake.operators.ranking import first_by_id
from edulake.operators.summary import load_counts

# ---- Fixed values: texts and column names of the known sources. ----

SYSTEM_DEFAULT = (
    "你是一位耐心的辅导老师，请仔细查看题目图片，"
    "理解题意后给出正确的解答。请包含以下内容：\n"
    "1. 题目分析：简要说明题目考查的知识点\n"
    "2. 解题步骤：分步展示解题过程\n"
    "3. 最终答案：给出明确答案"
)
SYSTEM_TEXT_ONLY = "你是一位耐心的辅导老师，请仔细阅读题目，理解题意后给出正确的解答。请包含：1. 题目分析 2. 解题步骤 3. 最终答案"
SYSTEM_MATH = "你是一位数学辅导老师，请仔细阅读题目，分步解答。请包含：1. 题目分析 2. 解题步骤 3. 最终答案"
SYSTEM_CHART = "你是一位数据解读老师，请根据图表信息回答问题。"
SYSTEM_INFOGRAPHIC = "你是一位信息解读老师，请根据信息图回答问题。"
SYSTEM_SCIENCE = "你是一位科学老师，请观察示意图帮助孩子理解科学概念。"
SYSTEM_SPATIAL = "你是一位数学思维训练老师，请观察图像中的几何/空间关系，解答问题。"
SYSTEM_GEOMETRY = "你是一位几何推理老师，请仔细观察图形，理解问题并给出解答。"
SYSTEM_REAL_SCENE = "你是一位数学老师，请仔细观察图片，理解真实场景中的数学问题并给出解答。"

ANSWER = "答案："
CORRECT = "正确答案是 "
EXPLAINED = "解析："
REASONED = "推理过程："
QUERY_LEAD = "问题："
CHART_LEAD = "请根据图表回答："
INFOGRAPHIC_LEAD = "请根据信息图回答："
ARTICLE_LEAD = "阅读以下文章，回答问题：\n\n文章："

CEVAL_TRAIN_CONFIGS = (
    "high_school_mathematics", "high_school_physics", "high_school_chemistry",
    "high_school_biology", "middle_school_mathematics", "middle_school_physics",
    "middle_school_chemistry", "middle_school_biology",
    "college_physics", "college_chemistry", "college_programming",
    "probability_and_statistics", "discrete_mathematics", "advanced_mathematics",
)
CEVAL_EVAL_CONFIGS = (
    "high_school_mathematics", "high_school_physics", "college_physics",
    "college_programming", "discrete_mathematics",
)

# ---- End of fixed values. ----

Expr = Callable[["Row"], Column]


class Row:
    """The columns of a source table; one that is absent reads as null."""

    def __init__(self, df: DataFrame):
        self._types = {f.name: f.dataType for f in df.schema.fields}

    def has(self, name: str) -> bool:
        return name in self._types

    def type(self, name: str) -> T.DataType | None:
        return self._types.get(name)

    def raw(self, name: str) -> Column:
        return F.col(f"`{name}`") if self.has(name) else F.lit(None)

    def text(self, name: str) -> Column:
        return self.raw(name).cast("string")


def present(*names: str) -> Expr:
    """First of the columns that is not null, else empty text."""
    return lambda r: tx.first_present(*[r.text(n) for n in names], F.lit(""))


def truthy(*names: str) -> Expr:
    """First of the columns that is not null and not empty; the last one only has to be not null."""
    return lambda r: tx.first_present(tx.first_truthy(*[r.text(n) for n in names]), F.lit(""))


def truthy_then_present(first: str, *others: str) -> Expr:
    """The first column unless it is null or empty, then the first of the others that is not null."""
    return lambda r: tx.first_truthy(r.text(first), present(*others)(r))


def _listed(column: str, render: Callable[[Column], Column]) -> Expr:
    """Choice lines of a list column; nothing for a null or empty list."""
    return lambda r: F.when(F.size(r.raw(column)) > 0, F.concat(F.lit("\n"), render(r.raw(column)))) if isinstance(
        r.type(column), T.ArrayType
    ) else F.lit(None).cast("string")


def lettered(column: str) -> Expr:
    return _listed(column, tx.lettered)


def lettered_literal(column: str) -> Expr:
    """A list column, or a list that arrived as text."""

    def build(r: Row) -> Column:
        if isinstance(r.type(column), T.ArrayType):
            return lettered(column)(r)
        parsed = tx.literal_list(r.text(column))
        return F.when(F.size(parsed) > 0, F.concat(F.lit("\n"), tx.lettered(parsed)))

    return build


def lettered_columns(*columns: str) -> Expr:
    """Choices from single columns; empty ones are left out before letters are given."""

    def build(r: Row) -> Column:
        kept = F.filter(F.array(*[r.text(c) for c in columns]), lambda c: tx.truthy(c))
        return F.when(F.size(kept) > 0, F.concat(F.lit("\n"), tx.lettered(kept)))

    return build


def options_or_text(*columns: str) -> Expr:
    """First present column: a list is lettered, even an empty one; non-empty text is appended as it is."""

    def build(r: Row) -> Column:
        parts = []
        for column in columns:
            if isinstance(r.type(column), T.ArrayType):
                parts.append(F.when(r.raw(column).isNotNull(), F.concat(F.lit("\n"), tx.lettered(r.raw(column)))))
            elif r.has(column):
                value = r.text(column)
                parts.append(F.when(tx.truthy(value), F.concat(F.lit("\n"), value)).when(value == "", F.lit("")))
        return F.coalesce(*parts) if parts else F.lit(None).cast("string")

    return build


def joined(separator: str, *columns: str) -> Expr:
    """First present column; a list is joined."""

    def build(r: Row) -> Column:
        values = [
            F.array_join(r.raw(c).cast("array<string>"), separator)
            if isinstance(r.type(c), T.ArrayType)
            else r.text(c)
            for c in columns
        ]
        return F.coalesce(*values, F.lit(""))

    return build


def first_of_list(column: str, fallback: str) -> Expr:
    """The column, else the first entry of the fallback list."""

    def build(r: Row) -> Column:
        listed = F.get(r.raw(fallback), F.lit(0)) if isinstance(r.type(fallback), T.ArrayType) else F.lit(None)
        return tx.first_present(r.text(column), listed.cast("string"), F.lit(""))

    return build


def index_letter(column: str) -> Expr:
    return lambda r: tx.letter(tx.first_present(r.raw(column).cast("int"), F.lit(0)))


def gold_letter(column: str) -> Expr:
    """First of a list: a whole number becomes a letter, anything else stays text; an empty list reads ``[]``."""

    def build(r: Row) -> Column:
        kind = r.type(column)
        value = F.get(r.raw(column), F.lit(0)) if isinstance(kind, T.ArrayType) else r.raw(column)
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        named = tx.letter(value.cast("int")) if isinstance(inner, T.IntegralType) else value.cast("string")
        return F.coalesce(named, F.lit("[]"))

    return build


def cut_query(column: str) -> Expr:
    return lambda r: tx.strip(F.replace(tx.first_present(r.text(column), F.lit("")), F.lit(QUERY_LEAD), F.lit("")))


def led_by(lead: str, inner: Expr) -> Expr:
    return lambda r: F.concat(F.lit(lead), inner(r))


def with_article(article: str, question: str, chars: int = 200) -> Expr:
    return lambda r: F.concat(
        F.lit(ARTICLE_LEAD),
        F.substring(present(article)(r), 1, chars),
        F.lit("...\n\n"),
        present(question)(r),
    )


@dataclass(frozen=True)
class SourceSpec:
    """How one source is read."""

    question: Expr
    answer: Expr
    choices: Expr | None = None
    explanation: Expr | None = None
    explanation_lead: str = EXPLAINED
    answer_lead: str = ANSWER
    #: Lead of the answer when there is no explanation, where it differs.
    plain_lead: str | None = None
    images: tuple[str, ...] = ()
    #: ``drop``: a row without image is left out; ``placeholder``: none is read; ``optional``: kept either way.
    image_rule: str = "drop"
    tag: bool = True
    system: str = SYSTEM_DEFAULT
    required: Expr | None = None
    configs: tuple[str, ...] = ()


_Q = present("question")

SOURCES: dict[str, SourceSpec] = {
    "scienceqa": SourceSpec(
        _Q,
        index_letter("answer"),
        lettered("choices"),
        truthy("lecture"),
        answer_lead=CORRECT,
        images=("image",),
        # Without the column the first choice is right; a row without an answer is left out.
        required=lambda r: r.raw("answer").isNotNull() if r.has("answer") else F.lit(True),
    ),
    "mathverse": SourceSpec(present("question", "problem"), present("answer"), images=("image",)),
    "mathvista": SourceSpec(
        _Q, present("answer"), lettered("choices"), present("query"), images=("decoded_image",)
    ),
    "ocr_vqa": SourceSpec(
        _Q,
        first_of_list("answer", "answers"),
        images=("image",),
        required=lambda r: F.coalesce(F.size(r.raw("answers")) != 0, F.lit(True)) if r.has("answers") else F.lit(True),
    ),
    "ceval": SourceSpec(
        _Q,
        present("answer"),
        lettered_columns("A", "B", "C", "D"),
        present("explanation"),
        image_rule="placeholder",
        tag=False,
        system=SYSTEM_TEXT_ONLY,
        configs=CEVAL_TRAIN_CONFIGS,
    ),
    "cmmlu": SourceSpec(
        _Q,
        present("answer"),
        lettered_literal("choices"),
        image_rule="placeholder",
        tag=False,
        system=SYSTEM_TEXT_ONLY,
    ),
    "tabmwp": SourceSpec(
        _Q, present("answer"), explanation=present("solution"), plain_lead="", images=("image", "table_image")
    ),
    "gaokao": SourceSpec(
        _Q,
        present("answer"),
        explanation=present("solution", "analysis"),
        plain_lead="",
        image_rule="placeholder",
    ),
    "math23k": SourceSpec(
        present("question", "text"), present("answer", "equation"), image_rule="placeholder"
    ),
    "ape210k": SourceSpec(
        truthy("question_chinese", "question", "text"),
        truthy("result", "answer", "equation"),
        explanation=present("chain"),
        image_rule="placeholder",
    ),
    "mmmu": SourceSpec(
        _Q,
        present("answer", "gt"),
        options_or_text("options", "choices"),
        present("explanation", "rationale"),
        images=("image_1", "image", "images"),
        image_rule="optional",
    ),
    "geoqa": SourceSpec(
        truthy_then_present("problem", "question", "text"),
        truthy_then_present("solution", "answer", "gt"),
        images=("image", "img"),
    ),
    "biology": SourceSpec(_Q, present("answer"), images=("image",)),
    "geometry3k": SourceSpec(
        truthy("problem", "question"),
        present("answer"),
        explanation=present("solution", "explanation"),
        images=("images", "image"),
    ),
    "chartqa": SourceSpec(
        led_by(CHART_LEAD, present("question", "query")),
        joined(", ", "answer", "label"),
        images=("image", "img"),
        system=SYSTEM_CHART,
    ),
    "dvqa": SourceSpec(
        led_by(INFOGRAPHIC_LEAD, _Q), present("answer"), images=("image", "png"), system=SYSTEM_INFOGRAPHIC
    ),
    "ai2d": SourceSpec(_Q, present("answer"), images=("image",), system=SYSTEM_SCIENCE),
    "vizwiz": SourceSpec(_Q, joined("; ", "answer"), images=("image",)),
    "tqa": SourceSpec(
        _Q, present("answer"), lettered("choices"), present("explanation", "rationale"), images=("image",)
    ),
    "clevr_math": SourceSpec(
        _Q,
        present("answer"),
        explanation=present("program", "program_text"),
        explanation_lead=REASONED,
        images=("image",),
        system=SYSTEM_SPATIAL,
    ),
    "race": SourceSpec(
        with_article("article", "question"), present("answer"), lettered("options"), image_rule="placeholder"
    ),
    "openr1_math": SourceSpec(
        present("problem"),
        present("answer"),
        explanation=present("solution"),
        image_rule="placeholder",
        tag=False,
        system=SYSTEM_MATH,
    ),
    "gaokao_mathqa": SourceSpec(
        cut_query("query"),
        gold_letter("gold"),
        lettered("choices"),
        image_rule="placeholder",
        tag=False,
        system=SYSTEM_MATH,
    ),
    "gaokao_mathcloze": SourceSpec(
        cut_query("query"), present("answer"), image_rule="placeholder", tag=False, system=SYSTEM_MATH
    ),
    "we_math": SourceSpec(
        present("problem", "question"),
        present("answer", "solution"),
        images=("image", "img"),
        image_rule="optional",
        tag=False,
    ),
    "geo170k": SourceSpec(
        present("question", "problem"),
        present("answer", "solution"),
        images=("image", "img"),
        image_rule="optional",
        system=SYSTEM_GEOMETRY,
    ),
    "cmm_math": SourceSpec(
        present("question", "problem"), present("answer", "solution"), images=("image", "img"), image_rule="optional"
    ),
    "math_real": SourceSpec(
        present("question", "problem"),
        present("answer", "solution"),
        images=("image", "img"),
        image_rule="optional",
        system=SYSTEM_REAL_SCENE,
    ),
}


def _image(r: Row, spec: SourceSpec) -> Column:
    """First image there is; of a list of images the first one."""
    found = []
    for name in spec.images:
        if r.has(name):
            raw = r.raw(name)
            found.append((F.get(raw, F.lit(0)) if isinstance(r.type(name), T.ArrayType) else raw).cast("binary"))
    return F.coalesce(*found) if found else F.lit(None).cast("binary")


def rendered_turns(df: DataFrame, spec: SourceSpec) -> tuple[dict[str, Column], Column, Column]:
    """The three texts, the image, and whether the row is accepted."""
    r = Row(df)
    question = spec.question(r)
    if spec.choices is not None:
        question = F.concat(question, F.coalesce(spec.choices(r), F.lit("")))
    if spec.tag:
        question = F.concat(F.lit(IMAGE_TAG + "\n"), question)
    bare = spec.answer(r)
    lead = spec.answer_lead if spec.plain_lead is None else spec.plain_lead
    answer = F.concat(F.lit(lead), bare)
    if spec.explanation is not None:
        why = spec.explanation(r)
        full = F.concat(F.lit(spec.explanation_lead), why, F.lit("\n\n" + spec.answer_lead), bare)
        answer = F.when(tx.truthy(why), full).otherwise(answer)
    image = _image(r, spec) if spec.image_rule != "placeholder" else F.lit(None).cast("binary")
    accepted = image.isNotNull() if spec.image_rule == "drop" else F.lit(True)
    if spec.required is not None:
        accepted = accepted & spec.required(r)
    if spec.configs and r.has("config"):
        accepted = accepted & F.col("config").isin(*spec.configs)
    return {"system": F.lit(spec.system), "user": question, "assistant": answer}, image, accepted


def normalize_qa(
    df: DataFrame,
    spec: SourceSpec | str,
    row_id: str = "row_id",
    max_samples: int | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Samples of one source: ``row_id``, ``conversations``, ``image_bytes``, ``has_real_image``.

    ``max_samples`` keeps the first accepted rows in input order. ``observation`` receives the kept and skipped
    row counts when the result is computed.
    """
    spec = SOURCES[spec] if isinstance(spec, str) else spec
    texts, image, accepted = rendered_turns(df, spec)
    if observation is not None:
        df = df.observe(observation, F.count_if(accepted).alias("kept"), F.count_if(~accepted).alias("skipped"))
    rows = df.where(accepted)
    if max_samples is not None:
        rows = first_by_id(rows, row_id, max_samples)
    turns = F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in texts.items()])
    return rows.select(
        row_id,
        encode_turns(turns).alias("conversations"),
        F.when(image.isNotNull(), F.array(image)).alias("image_bytes"),
        image.isNotNull().alias("has_real_image"),
    )


def source_counts(df: DataFrame, spec: SourceSpec | str, source: str = "source") -> DataFrame:
    """Kept and skipped rows per value of ``source``."""
    spec = SOURCES[spec] if isinstance(spec, str) else spec
    return load_counts(df, rendered_turns(df, spec)[2], source)


def convert_turns(conversations: Column) -> Column:
    """Turns of ``from``/``value`` pairs: ``human`` is the user, anything else the assistant."""
    return F.transform(
        conversations,
        lambda t: F.struct(
            F.when(t["from"] == "human", "user").otherwise("assistant").alias("role"), t["value"].alias("content")
        ),
    )


def subject_of(file_name: Column) -> Column:
    lowered = F.lower(file_name)
    return F.when(lowered.contains("math") | lowered.contains("geo"), "math").otherwise("general")


def normalize_source_conversations(df: DataFrame, images: DataFrame, folders: DataFrame) -> DataFrame:
    """Samples from from/value conversations whose first image can be found.

    ``folders`` maps the image folder key to a folder (a missing key stands for itself); ``images`` holds
    ``path`` and ``content`` of the files. ``df`` carries the name of its JSON file as ``json_file``.
    """
    from edulake.sources.images import resolve_images

    found = resolve_images(df.where(F.size("image") > 0), images, folders)
    return found.select(
        *[c for c in ("row_id",) if c in df.columns],
        encode_turns(convert_turns(F.col("conversations"))).alias("conversations"),
        F.array("content").alias("image_bytes"),
        subject_of(F.col("json_file")).alias("subject"),
        F.lit("K12").alias("grade_level"),
        F.lit("synthetic").alias("question_type"),
        F.replace("json_file", F.lit("-synthetic.json"), F.lit("")).alias("source"),
    )
