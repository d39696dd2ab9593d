"""Normalisation of every known source shape, over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.duck import lettered, lit, strip
from checks.harness import Tables, query
from edulake.operators import normalize as nz
from edulake.operators.chat import parse_turns
from edulake.plans.build import build_samples

#: Column of the wide table that a source calls by another name.
RENAMED = {
    "scienceqa": {"answer_idx": "answer"},
    "mathvista": {"image": "decoded_image"},
    "ceval": {"a": "A", "b": "B", "c": "C", "d": "D"},
    "cmmlu": {"choices_text": "choices"},
    "chartqa": {"answer_list": "answer"},
    "vizwiz": {"answer_list": "answer"},
    "tabmwp": {"img": "table_image"},
    "dvqa": {"img": "png"},
}


def source(t: Tables, name: str) -> DataFrame:
    """The documents in the shape of one source."""
    renamed = RENAMED.get(name, {})
    wide = t.qa_wide
    if name == "mmmu":
        # Lists on some rows and text on others cannot share a column; the text form is tested on its own.
        wide = wide.withColumn("images", F.when(F.col("img").isNotNull(), F.array("img"))).drop("image", "img")
    if name == "geometry3k":
        wide = wide.withColumn("images", F.when(F.col("img").isNotNull(), F.array("img")))
    for old, new in renamed.items():
        wide = wide.drop(new).withColumnRenamed(old, new) if new != old.upper() else wide.withColumnRenamed(old, new)
    return wide


def texts(samples: DataFrame) -> DataFrame:
    """The three texts of normalised samples, read back from their JSON."""
    turns = parse_turns(F.col("conversations"))
    return samples.select(
        "row_id",
        turns[0]["content"].alias("system_text"),
        turns[1]["content"].alias("user_text"),
        turns[2]["content"].alias("assistant_text"),
        "has_real_image",
    )


_PRESENT = "coalesce({0}, '')"
_Q = "coalesce(question, '')"
_TAG = "'<image>' || chr(10) || "
_LETTERS = "CASE WHEN len({0}) > 0 THEN chr(10) || " + lettered("{0}") + " ELSE '' END"


def _choices(column: str) -> str:
    return "coalesce(" + _LETTERS.format(column) + ", '')"


def _explained(why: str, answer: str, plain: str = "'答案：' || ", lead: str = "解析：", answer_lead: str = "答案：") -> str:
    return (
        f"CASE WHEN {why} IS NOT NULL AND {why} <> '' THEN '{lead}' || {why} || chr(10) || chr(10) || '{answer_lead}' || "
        f"{answer} ELSE {plain}{answer} END"
    )


_LETTER = "chr(65 + coalesce(answer_idx, 0))"
_TRUTHY3 = "coalesce(nullif({0}, ''), nullif({1}, ''), {2}, '')"

#: source -> (user text, assistant text, has image, kept, system text)
EXPECTED = {
    "scienceqa": (
        _TAG + _Q + " || " + _choices("choices"),
        _explained("lecture", _LETTER, "'正确答案是 ' || ", answer_lead="正确答案是 "),
        "image IS NOT NULL", "image IS NOT NULL AND answer_idx IS NOT NULL", nz.SYSTEM_DEFAULT),
    "mathverse": (
        _TAG + "coalesce(question, problem, '')", "'答案：' || coalesce(answer, '')",
        "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_DEFAULT),
    "mathvista": (
        _TAG + _Q + " || " + _choices("choices"), _explained("query", "coalesce(answer, '')"),
        "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_DEFAULT),
    "ocr_vqa": (
        _TAG + _Q, "'答案：' || coalesce(answer, answers[1], '')",
        "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_DEFAULT),
    "ceval": (
        _Q + " || " + _choices("list_filter([a, b, c, d], lambda v: v IS NOT NULL AND v <> '')"),
        _explained("explanation", "coalesce(answer, '')"), "false", "true", nz.SYSTEM_TEXT_ONLY),
    "cmmlu": (
        _Q + " || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source", "'答案：' || coalesce(answer, '')",
        "false", "true", nz.SYSTEM_TEXT_ONLY),
    "tabmwp": (
        _TAG + _Q, _explained("solution", "coalesce(answer, '')", ""),
        "coalesce(image, img) IS NOT NULL", "coalesce(image, img) IS NOT NULL", nz.SYSTEM_DEFAULT),
    "gaokao": (
        _TAG + _Q, _explained("coalesce(solution, analysis)", "coalesce(answer, '')", ""), "false", "true",
        nz.SYSTEM_DEFAULT),
    "math23k": (
        _TAG + "coalesce(question, text)", "'答案：' || coalesce(answer, equation)", "false", "true", nz.SYSTEM_DEFAULT),
    "ape210k": (
        _TAG + _TRUTHY3.format("question_chinese", "question", "text"),
        _explained("chain", _TRUTHY3.format("result", "answer", "equation")), "false", "true", nz.SYSTEM_DEFAULT),
    "mmmu": (
        _TAG + _Q + " || CASE WHEN options IS NOT NULL THEN chr(10) || " + lettered("options") + " ELSE "
        + "coalesce(chr(10) || " + lettered("choices") + ", '') END",
        _explained("coalesce(explanation, rationale)", "coalesce(answer, gt)"),
        "img IS NOT NULL", "true", nz.SYSTEM_DEFAULT),
    "geoqa": (
        _TAG + "coalesce(nullif(problem, ''), question, text)",
        "'答案：' || coalesce(nullif(solution, ''), answer, gt)",
        "coalesce(image, img) IS NOT NULL", "coalesce(image, img) IS NOT NULL", nz.SYSTEM_DEFAULT),
    "biology": (
        _TAG + _Q, "'答案：' || coalesce(answer, '')", "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_DEFAULT),
    "geometry3k": (
        _TAG + "coalesce(nullif(problem, ''), question, '')",
        _explained("coalesce(solution, explanation)", "coalesce(answer, '')"),
        "coalesce(img, image) IS NOT NULL", "coalesce(img, image) IS NOT NULL", nz.SYSTEM_DEFAULT),
    "chartqa": (
        _TAG + "'请根据图表回答：' || coalesce(question, query)",
        "'答案：' || coalesce(array_to_string(answer_list, ', '), label)",
        "coalesce(image, img) IS NOT NULL", "coalesce(image, img) IS NOT NULL", nz.SYSTEM_CHART),
    "dvqa": (
        _TAG + "'请根据信息图回答：' || " + _Q, "'答案：' || coalesce(answer, '')",
        "coalesce(image, img) IS NOT NULL", "coalesce(image, img) IS NOT NULL", nz.SYSTEM_INFOGRAPHIC),
    "ai2d": (
        _TAG + _Q, "'答案：' || coalesce(answer, '')", "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_SCIENCE),
    "vizwiz": (
        _TAG + _Q, "'答案：' || coalesce(array_to_string(answer_list, '; '), '')",
        "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_DEFAULT),
    "tqa": (
        _TAG + _Q + " || " + _choices("choices"),
        _explained("coalesce(explanation, rationale)", "coalesce(answer, '')"),
        "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_DEFAULT),
    "clevr_math": (
        _TAG + _Q, _explained("coalesce(program, program_text)", "coalesce(answer, '')", lead="推理过程："),
        "image IS NOT NULL", "image IS NOT NULL", nz.SYSTEM_SPATIAL),
    "race": (
        _TAG + "'阅读以下文章，回答问题：' || chr(10) || chr(10) || '文章：' || left(text, 200) || '...' || chr(10) || chr(10) || "
        + _Q + " || " + _choices("options"),
        "'答案：' || coalesce(answer, '')", "false", "true", nz.SYSTEM_DEFAULT),
    "openr1_math": (
        "coalesce(problem, '')", _explained("solution", "coalesce(answer, '')"), "false", "true", nz.SYSTEM_MATH),
    "gaokao_mathqa": (
        strip("replace(query, '问题：', '')") + " || " + _choices("choices"),
        "'答案：' || chr(65 + gold[1])", "false", "true", nz.SYSTEM_MATH),
    "gaokao_mathcloze": (
        strip("replace(query, '问题：', '')"), "'答案：' || coalesce(answer, '')", "false", "true", nz.SYSTEM_MATH),
    "we_math": (
        "coalesce(problem, question, '')", "'答案：' || coalesce(answer, solution, '')",
        "coalesce(image, img) IS NOT NULL", "true", nz.SYSTEM_DEFAULT),
    "geo170k": (
        _TAG + "coalesce(question, problem, '')", "'答案：' || coalesce(answer, solution, '')",
        "coalesce(image, img) IS NOT NULL", "true", nz.SYSTEM_GEOMETRY),
    "cmm_math": (
        _TAG + "coalesce(question, problem, '')", "'答案：' || coalesce(answer, solution, '')",
        "coalesce(image, img) IS NOT NULL", "true", nz.SYSTEM_DEFAULT),
    "math_real": (
        _TAG + "coalesce(question, problem, '')", "'答案：' || coalesce(answer, solution, '')",
        "coalesce(image, img) IS NOT NULL", "true", nz.SYSTEM_REAL_SCENE),
}

#: Sources that call the article by another name get it here.
ARTICLE = {"race": "text"}


def _register(name: str) -> None:
    user, assistant, has_image, kept, system = EXPECTED[name]
    sql = f"""SELECT row_id, {lit(system)} AS system_text, {user} AS user_text, {assistant} AS assistant_text,
      {has_image} AS has_real_image FROM @qa_wide WHERE {kept}"""

    @query(f"normalize_{name}", sql, longs=["row_id"])
    def run(t: Tables) -> DataFrame:
        table = source(t, name)
        if name in ARTICLE:
            table = table.withColumnRenamed(ARTICLE[name], "article")
        return texts(nz.normalize_qa(table, name))


for _name in nz.SOURCES:
    _register(_name)


@query(
    "normalize_options_text",
    f"""SELECT row_id, {lit(nz.SYSTEM_DEFAULT)} AS system_text, {_TAG} {_Q} ||
      CASE WHEN options_text IS NULL THEN coalesce(chr(10) || {lettered('choices')}, '')
      WHEN options_text = '' THEN '' ELSE chr(10) || options_text END AS user_text,
      {_explained('coalesce(explanation, rationale)', 'coalesce(answer, gt)')} AS assistant_text,
      coalesce(image, img) IS NOT NULL AS has_real_image FROM @qa_wide""",
    longs=["row_id"],
)
def normalize_options_text(t: Tables) -> DataFrame:
    table = t.qa_wide.drop("options").withColumnRenamed("options_text", "options").withColumn("images", F.array("img"))
    return texts(nz.normalize_qa(table, "mmmu"))


@query(
    "normalize_first_rows",
    f"""SELECT row_id, {_TAG} {_Q} AS user_text FROM @qa_wide WHERE image IS NOT NULL ORDER BY row_id LIMIT 120""",
    longs=["row_id"],
)
def normalize_first_rows(t: Tables) -> DataFrame:
    return texts(nz.normalize_qa(t.qa_wide, "biology", max_samples=120)).select("row_id", "user_text")


@query(
    "normalize_counts",
    """SELECT source, count(*) FILTER (WHERE image IS NOT NULL) AS kept, count(*) FILTER (WHERE image IS NULL) AS skipped
       FROM @qa_wide GROUP BY source""",
    longs=["kept", "skipped"],
)
def normalize_counts(t: Tables) -> DataFrame:
    return nz.source_counts(t.qa_wide, "biology")


_PAIRS = "[{'role': 'user', 'content': '<image>' || chr(10) || question}, {'role': 'assistant', 'content': text}]"


@query(
    "normalize_windata",
    """SELECT row_id, '<image>' || chr(10) || coalesce(question, '') AS user_text, text AS assistant_text,
      CASE WHEN lang = 'en' THEN 'math' ELSE 'general' END AS subject, 'K12' AS grade_level, 'synthetic' AS question_type,
      CASE WHEN lang = 'en' THEN 'geo170k' ELSE 'docs' END AS source,
      CASE WHEN lang = 'en' THEN 'data/local/Open-source-data/geo170k/' ELSE 'other/' END || image AS image_text
      FROM @qa_wide WHERE image IS NOT NULL AND lang <> 'de'""",
    longs=["row_id"],
)
def normalize_windata(t: Tables) -> DataFrame:
    """English rows lie in a mapped folder, others in an unmapped one; the files of German rows are missing."""
    from edulake.sources.images import folder_table

    wide = t.qa_wide
    english = F.col("lang") == "en"
    pair = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    rows = wide.select(
        "row_id",
        F.array(
            pair("human", F.concat(F.lit("<image>\n"), F.coalesce("question", F.lit("")))), pair("gpt", F.col("text"))
        ).alias("conversations"),
        F.when(F.col("image").isNotNull(), F.array("image")).otherwise(F.array()).alias("image"),
        F.when(english, "geo170k").otherwise("other").alias("image_file"),
        F.when(english, "geo170k-synthetic.json").otherwise("docs-synthetic.json").alias("json_file"),
    )
    folder = F.when(english, "data/local/Open-source-data/geo170k").otherwise("other")
    path = F.concat_ws("/", folder, F.col("image"))
    files = wide.where("image is not null and lang <> 'de'").select(
        path.alias("path"), path.cast("binary").alias("content")
    )
    done = nz.normalize_source_conversations(rows, files, folder_table(t.spark))
    turns = parse_turns(F.col("conversations"))
    return done.select(
        "row_id",
        turns[0]["content"].alias("user_text"),
        turns[1]["content"].alias("assistant_text"),
        "subject",
        "grade_level",
        "question_type",
        "source",
        F.col("image_bytes")[0].cast("string").alias("image_text"),
    )


@query(
    "image_files",
    """SELECT page_id, md5(html) AS digest, strlen(html) AS bytes, 'math' AS subject FROM @pages
       WHERE html IS NOT NULL AND page_id % 5 <> 0""",
    longs=["page_id", "bytes"],
)
def image_files(t: Tables) -> DataFrame:
    """Every page as a file; conversations name most of the files, and some that do not exist."""
    from edulake.sources import image_files as files
    from edulake.sources.images import folder_table

    name = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    pages = t.pages.where("html IS NOT NULL")
    folder = "data/local/Open-source-data/geo170k"
    root = f"{t.scratch}/images"
    files.write_files(pages.select(F.concat(F.lit(f"{folder}/"), name).alias("path"), F.col("html").cast("binary").alias("content")), root)
    turn = F.struct(F.lit("human").alias("from"), name.alias("value"))
    rows = pages.where("page_id % 5 <> 0").select("page_id", name.alias("name"), F.array(turn).alias("conversations"))
    missing = rows.where("page_id % 7 = 0").withColumn("name", F.concat(F.lit("no"), "name"))
    rows = rows.unionByName(missing).select(
        F.col("page_id").alias("row_id"),
        "conversations",
        F.array("name").alias("image"),
        F.lit("geo170k").alias("image_file"),
        F.lit("geo170k-synthetic.json").alias("json_file"),
    )
    done = nz.normalize_source_conversations(rows, files.list_files(t.spark, root), folder_table(t.spark))
    content = F.col("image_bytes")[0]
    return done.select(
        F.col("row_id").alias("page_id"), F.md5(content).alias("digest"), F.octet_length(content).alias("bytes"), "subject"
    )


@query(
    "json_array_conversations",
    """SELECT 'img' || conv_id AS image, count(*) AS turns,
      md5(string_agg((CASE WHEN role = 'user' THEN 'human' ELSE role END) || ':' || text, '|' ORDER BY turn, role, text)) AS digest,
      'geo170k' AS image_file FROM @conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id""",
    longs=["turns"],
)
def json_array_conversations(t: Tables) -> DataFrame:
    """All conversations written as files of one JSON array each, and read back by ranges of bytes."""
    from edulake.sources.images import read_conversation_array
    from edulake.sources.json_array import write_arrays

    said = t.conversations.where("text IS NOT NULL AND role IS NOT NULL")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    who = lambda x: F.when(x["role"] == "user", "human").otherwise(x["role"])
    rows = said.groupBy("conv_id").agg(
        F.transform(turns, lambda x: F.struct(who(x).alias("from"), x["text"].alias("value"))).alias("conversations")
    )
    rows = rows.select(
        "conversations", F.array(F.concat(F.lit("img"), "conv_id")).alias("image"), F.lit("geo170k").alias("image_file")
    )
    write_arrays(rows, f"{t.scratch}/arrays")
    lines = F.transform("conversations", lambda x: F.concat(x["from"], F.lit(":"), x["value"]))
    return read_conversation_array(t.spark, f"{t.scratch}/arrays").select(
        F.col("image")[0].alias("image"),
        F.size("conversations").alias("turns"),
        F.md5(F.concat_ws("|", lines)).alias("digest"),
        "image_file",
    )


def _built(name: str) -> str:
    user, assistant, has_image, kept, _ = EXPECTED[name]
    return f"""SELECT '{name}' AS dataset, row_id, {user} AS user_text, {assistant} AS assistant_text, {has_image} AS has_real_image
      FROM @qa_wide WHERE {kept}"""


@query(
    "build_samples",
    f"""WITH merged AS ({_built('biology')} UNION ALL {_built('ceval')} UNION ALL {_built('race')}),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY
           CAST('0x' || substr(md5('42|' || dataset || ':' || row_id), 1, 13) AS BIGINT), dataset || ':' || row_id) AS rn,
         count(*) OVER (PARTITION BY dataset) AS total FROM merged)
       SELECT dataset, row_id, user_text, assistant_text, has_real_image,
         CASE WHEN rn <= least(greatest(least(floor(total * 0.05::DOUBLE), 500), 10), total - 10) THEN 'eval' ELSE 'train' END AS split
       FROM ranked""",
    longs=["row_id"],
)
def build(t: Tables) -> DataFrame:
    """Whole flow from three sources: the rendered texts and the side of the split that they end on."""
    sources = {
        "biology": source(t, "biology"),
        "ceval": source(t, "ceval"),
        "race": t.qa_wide.withColumnRenamed("text", "article"),
        "unknown": t.qa_wide,
    }
    turns = parse_turns(F.col("conversations"))
    return build_samples(sources).select(
        "dataset",
        "row_id",
        turns[1]["content"].alias("user_text"),
        turns[2]["content"].alias("assistant_text"),
        "has_real_image",
        "split",
    )
