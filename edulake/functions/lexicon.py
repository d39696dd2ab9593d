"""Word lists, patterns and lookup tables. The scorers take them as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# ---- Fixed values: results depend on these exact strings and numbers. ----

STEP_WORDS = ("步骤", "首先", "然后", "Step")
GUIDANCE_WORDS = ("观察", "思考", "想一想")
GUIDANCE_WORDS_SCIENCE = ("观察", "思考", "想一想", "你能发现")
ACCURACY_RULES = {"scienceqa": "contained", "ceval": "prefix"}

SCAFFOLDING_WORDS = (
    "观察", "思考", "想一想", "你能发现", "注意到",
    "试试看", "你觉得", "第一步", "第二步", "步骤",
    "为什么", "原因是", "我们来", "接下来", "首先",
    "然后", "最后", "所以", "因此", "答案是",
)

DIRECT_ANSWER_PATTERNS = (
    r"^[A-D][\.\)）]\s*\n",
    r"^答案[是为]：?[A-D]",
    r"^正确[选项答案]",
    r"^选\s*[A-D]",
)

STEP_PATTERNS = (
    r"第[一二三四五六七八九十\d]+步",
    r"步骤[一二三四五六七八九十\d]+",
    r"首先",
    r"然后",
    r"接着",
    r"最后",
    r"([1-9][\.\)、])",
    r"Step\s*\d+",
)

NUMBER_WORDS = (
    ("一", "1"), ("二", "2"), ("三", "3"), ("四", "4"), ("五", "5"),
    ("六", "6"), ("七", "7"), ("八", "8"), ("九", "9"), ("十", "10"),
    ("两", "2"), ("几个", "若干"), ("多少", "未知数"),
    ("加倍", "×2"), ("翻倍", "×2"), ("减半", "÷2"),
)

SYMBOLS = "@#$%^&*_+=[]{}|\\`~"
SENTENCE_ENDS = ".。!！?？…—)）"

ANSWER_FORMATS = (
    (r"答案[是为：:]\s*[A-D\d]", 1.0),
    (r"最终答案[为是：:]?\s*[A-D\d]", 0.9),
    (r"正确[选项答案][为是：:]?\s*[A-D\d]", 0.8),
)

ERROR_RULES = (
    ("图像理解错误", (
        r"图片.*?(看不清|不清晰|无法识别)",
        r"(没有|缺少).*?图像",
        r"图像理解失败",
        r"未识别到",
    )),
    ("推理错误", (
        r"(推理|逻辑|思路).*?(错误|不对|错)",
        r"因果.*?错误",
        r"(假设|前提).*?(错误|不成立)",
    )),
    ("答案格式错误", (
        r"答案.*?格式",
        r"未按要求.*?作答",
        r"(缺少|没有).*?答案",
        r"未给出.*?选项",
    )),
    ("计算错误", (
        r"(加|减|乘|除).*?错",
        r"计算.*?错误",
        r"(算式|算错|算成)",
    )),
    ("OCR识别错误", (
        r"(OCR|识别).*?(失败|错误|不准确)",
        r"文字.*?识别",
        r"(错别字|识别成|误识别)",
    )),
    ("知识错误", (
        r"概念.*?(不清楚|错误|混淆)",
        r"原理.*?(错误|不对)",
        r"不知道.*?(定义|公式|定理)",
    )),
)
ERROR_OTHER = "其他错误"
CONCLUSION_PATTERN = r"答案是|答案:|因此|所以|故"

ERROR_ADVICE = (
    ("图像理解错误", "增加 OCR/视觉理解专项数据（如 OCR-VQA、ChartQA、DocVQA）"),
    ("推理错误", "增加思维链（CoT）数据，强调分步推理"),
    ("答案格式错误", "增加格式规范训练数据（明确\"答案是 X\"模式）"),
    ("计算错误", "增加计算步骤数据，强调中间过程"),
    ("OCR识别错误", "增加中英文 OCR 训练数据，特别是手写体"),
    ("知识错误", "增加学科基础知识数据（如教材原题、概念解释）"),
)

TUTOR_PROMPTS = (
    "你是一位耐心的数学老师，请一步步引导孩子思考，用简单易懂的方式解答题目。",
    "你是一位和蔼的科学老师，先用生活中的例子帮助孩子理解概念，再给出答案和解析。",
    "你是一位小学辅导老师，看到题目后先鼓励孩子，然后分步骤讲解，最后给出正确答案。",
    "你是一位会启发式教学的老师，不要直接告诉答案，而是通过提问引导孩子自己找到解题思路。",
    "你是一位中学理科老师，请给出清晰的解题步骤，每一步都解释为什么这样做。",
)
EMPTY_USER_TEXT = "请解答这道题"

EVAL_PROMPTS = {
    "choice_image": "请解答这道题目，给出正确选项和解析：",
    "choice_text": "请解答这道选择题，给出正确选项和解析：",
    "plain": "请解答这道题目：",
    "solution": "请解答这道题目，给出解析和答案：",
}

ASSISTANT_MARKERS = ("\nassistant\n", "\nassistant:", "assistant\n")

JUDGE_TEMPLATE = """你是一位经验丰富的 K12 教育专家，正在评判 AI 助教的回答质量。

【题目】
{question}

【标准答案】
{gt}

【学生回答】
{response}

请按以下 5 个维度严格评分（每项 0-10 分，整数）：

1. **答案准确性**（与标准答案的一致性）
   - 10: 完全正确，含关键推理过程
   - 7-9: 基本正确，关键点都对
   - 4-6: 部分正确，有明显遗漏
   - 1-3: 部分正确，有明显错误
   - 0: 错误或无关

2. **步骤完整性**（是否给出清晰解题步骤）
   - 10: 完整步骤（"第一步...然后...最后..."）
   - 5: 有步骤但不完整
   - 0: 直接给答案无步骤

3. **启发式引导**（是否用引导式提问/启发而非直接给答案）
   - 10: 强烈启发（"你发现什么？""试试看"等）
   - 7-9: 较多引导
   - 4-6: 有少量引导
   - 1-3: 几乎直接给答案
   - 0: 完全直接给答案（"答案是 A"）

4. **语言流畅度**（中文表达质量）
   - 10: 流畅准确，无错别字
   - 5-9: 基本流畅，偶有小问题
   - 0-4: 不流畅或难懂

5. **格式规范性**（是否符合"答案是 X"或"最终答案为 X"格式）
   - 10: 完美格式
   - 0: 无明确答案

请只输出一个 JSON 对象，不要任何解释：
{"accuracy": X, "completeness": X, "scaffolding": X, "fluency": X, "format": X}
"""
JUDGE_EMPTY = {"question": "（无题目）", "response": "（无回答）", "gt": "（无标准答案）"}

RULE_WEIGHTS = {"accuracy": 0.30, "completeness": 0.25, "fluency": 0.15, "scaffolding": 0.20, "format": 0.10}
JUDGE_WEIGHTS = {"accuracy": 0.40, "completeness": 0.20, "scaffolding": 0.20, "fluency": 0.10, "format": 0.10}

# ---- End of fixed values. ----


@dataclass(frozen=True)
class Lexicon:
    """The word lists one rule-based scorer works with."""

    scaffolding: tuple[str, ...] = SCAFFOLDING_WORDS
    direct_answers: tuple[str, ...] = DIRECT_ANSWER_PATTERNS
    steps: tuple[str, ...] = STEP_PATTERNS
    numbers: tuple[tuple[str, str], ...] = NUMBER_WORDS
    symbols: str = SYMBOLS
    ends: str = SENTENCE_ENDS


DEFAULT_LEXICON = Lexicon()
