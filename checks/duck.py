"""SQL snippets for the comparison engine."""

from __future__ import annotations

from edulake.functions import lexicon as lx
from edulake.functions.text import SPACE_CHARS

SPACE = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f \x{85}\p{Z}]"
NON_WORD = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f \x{85}\p{Z}]"
HAN = r"[\x{4e00}-\x{9fff}]"
NUMBER = r"\p{Nd}+\.?\p{Nd}*"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return lit(pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE))


def strip(x: str) -> str:
    return f"trim({x}, {lit(SPACE_CHARS)})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{NOT_SPACE}+')"


def hash52(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def unit(*parts: str) -> str:
    return f"({hash52(*parts)} / CAST({1 << 52} AS DOUBLE))"


def draw_number(seed: str, j: str) -> str:
    mask = (1 << 31) - 1
    a = f"(({seed} + {j} * {0x1E3779B1}) & {mask})"
    b = f"((xor({a}, {a} >> 15) * {0x2C1B3C6D}) & {mask})"
    c = f"((xor({b}, {b} >> 12) * {0x297A2D39}) & {mask})"
    return f"xor({c}, {c} >> 15)"


def normalize(x: str, numbers=lx.NUMBER_WORDS) -> str:
    for word, digits in numbers:
        x = f"replace({x}, {lit(word)}, {lit(digits)})"
    return strip(f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '{NON_WORD}', ' ', 'g')")


def keywords(x: str) -> str:
    return (
        f"list_distinct(list_concat(regexp_extract_all({x}, '{HAN}{{2,}}'), "
        f"regexp_extract_all(lower({x}), '[a-z]{{2,}}')))"
    )


def tokens(x: str) -> str:
    return (
        f"list_concat(regexp_extract_all({x}, '{HAN}'), list_concat(regexp_extract_all(lower({x}), '[a-z]+'), "
        f"regexp_extract_all({x}, '{NUMBER}')))"
    )


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '{NUMBER}'))"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def any_match(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {rx(p)})" for p in patterns) + ")"


def lettered(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda v, i: chr(CAST(64 + i AS INTEGER)) || '. ' || v), chr(10))"


def completeness(x: str) -> str:
    hits = " + ".join(f"CAST(regexp_matches({x}, {rx(p)}) AS INTEGER)" for p in lx.STEP_PATTERNS)
    return f"(SELECT CASE WHEN h >= 4 THEN 1.0 WHEN h >= 2 THEN 0.7 WHEN h >= 1 THEN 0.4 ELSE 0.1 END FROM (SELECT {hits} AS h))"


def fluency(x: str) -> str:
    pairs = f"list_transform(range(1, length({x})), lambda i: substr({x}, i, 2))"
    return f"(CASE WHEN length({x}) < 2 THEN 0 ELSE len(list_distinct({pairs})) / CAST(length({x}) - 1 AS DOUBLE) END)"


def fluency_linear(x: str) -> str:
    """The same for long texts: the characters are split once."""
    c = f"string_split({x}, '')"
    return (
        f"(CASE WHEN length({x}) < 2 THEN 0 ELSE len(list_distinct(list_transform(list_zip({c}[:-2], {c}[2:]), "
        f"lambda p: p[1] || p[2]))) / CAST(length({x}) - 1 AS DOUBLE) END)"
    )


def occurrences(x: str, needles) -> str:
    return "(" + " + ".join(f"(length({x}) - length(replace({x}, {lit(n)}, ''))) / {len(n)}" for n in needles) + ")"


def scaffolding(x: str) -> str:
    density = f"({occurrences(x, lx.SCAFFOLDING_WORDS)} / (greatest(length({x}), 1) / 50.0::DOUBLE))"
    direct = any_match(strip(x), lx.DIRECT_ANSWER_PATTERNS)
    return (
        f"greatest(least((CASE WHEN {direct} THEN -0.3 ELSE 0.0 END) + (CASE WHEN {density} > 3 THEN 0.5 "
        f"WHEN {density} > 1.5 THEN 0.35 WHEN {density} > 0.5 THEN 0.2 ELSE 0.05 END) + 0.3, 1.0), 0.0)"
    )


def format_score(x: str) -> str:
    noise = f"length(regexp_replace({x}, '[^@#$%^&*_+=\\[\\]{{}}|\\\\`~]', '', 'g'))"
    return (
        f"greatest(1.0 - (CASE WHEN length({x}) < 20 THEN 0.4 ELSE 0 END) - (CASE WHEN length({x}) > 0 AND "
        f"{noise} / CAST(greatest(length({x}), 1) AS DOUBLE) > 0.05 THEN 0.3 ELSE 0 END) - (CASE WHEN {strip(x)} <> '' "
        f"AND NOT contains({lit(lx.SENTENCE_ENDS)}, right({strip(x)}, 1)) THEN 0.1 ELSE 0 END), 0.0)"
    )


def number_match(r: str, g: str) -> str:
    """``r`` and ``g`` are lists of distinct numbers."""
    return (
        f"(CASE WHEN len({g}) = 0 THEN 0.5 WHEN list_sort({r}) = list_sort({g}) THEN 1.0 "
        f"WHEN len(list_intersect({r}, {g})) > 0 AND len(list_filter({g}, lambda a: try_cast(a AS DOUBLE) <> 0 AND "
        f"len(list_filter({r}, lambda b: abs(try_cast(b AS DOUBLE) - try_cast(a AS DOUBLE)) / try_cast(a AS DOUBLE) < 0.05)) > 0)) > 0 "
        f"THEN 0.7 ELSE len(list_intersect({r}, {g})) / CAST(len(list_distinct(list_concat({r}, {g}))) AS DOUBLE) END)"
    )


def tfidf_cte(source: str, left: str, right: str, key: str = "sample_id") -> str:
    """CTEs that end in ``cosine(key, semantic)`` for the token lists of two columns of ``source``."""
    return f"""
      toks AS (SELECT {key}, 0 AS side, unnest({left}) AS token FROM {source}
               UNION ALL SELECT {key}, 1 AS side, unnest({right}) AS token FROM {source}),
      tf AS (SELECT {key}, token, CAST(sum(1 - side) AS DOUBLE) AS l, CAST(sum(side) AS DOUBLE) AS r FROM toks GROUP BY ALL),
      weighed AS (SELECT {key}, l, r, ln(2.0 / ((CASE WHEN l > 0 THEN 1 ELSE 0 END) + (CASE WHEN r > 0 THEN 1 ELSE 0 END) + 1)) + 1 AS w FROM tf),
      cosine AS (SELECT {key}, CASE WHEN sum(l) > 0 AND sum(r) > 0 THEN
                 sum(l * r * w * w) / (sqrt(sum(l * l * w * w)) * sqrt(sum(r * r * w * w))) ELSE 0 END AS semantic
                 FROM weighed GROUP BY {key})"""


def keyword_recall(r: str, g: str) -> str:
    return (
        f"(CASE WHEN len({keywords(g)}) = 0 THEN 0.5 ELSE "
        f"len(list_intersect({keywords(g)}, {keywords(r)})) / CAST(len({keywords(g)}) AS DOUBLE) END)"
    )


def error_type(x: str) -> str:
    rules = " ".join(f"WHEN {any_match(x, patterns)} THEN {lit(name)}" for name, patterns in lx.ERROR_RULES)
    return (
        f"(CASE WHEN coalesce({x}, '') = '' THEN {lit(lx.ERROR_OTHER)} {rules} "
        f"WHEN contains({x}, '看不清') OR (contains({x}, '图像') AND contains({x}, '无法')) THEN '图像理解错误' "
        f"WHEN length({x}) < 20 THEN '答案格式错误' WHEN NOT regexp_matches({x}, {rx(lx.CONCLUSION_PATTERN)}) THEN '推理错误' "
        f"ELSE {lit(lx.ERROR_OTHER)} END)"
    )


def normal_cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0 + 0.3275911::DOUBLE * {x}))"
    poly = "0.0::DOUBLE"
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = f"(({poly} + ({c})::DOUBLE) * {t})"
    erf = f"(1.0::DOUBLE - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} < 0 THEN (1.0 - {erf}) / 2 ELSE (1.0 + {erf}) / 2 END)"


def judge_template(question: str, response: str, answer: str) -> str:
    text = lit(lx.JUDGE_TEMPLATE)
    for name, column in (("question", question), ("gt", answer), ("response", response)):
        text = f"replace({text}, '{{{name}}}', coalesce(nullif({column}, ''), '{lx.JUDGE_EMPTY[name]}'))"
    return text
