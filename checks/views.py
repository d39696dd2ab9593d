"""Views derived from the given tables, in SQL that both engines understand.

``@name`` stands for a table or another view, and ``$list(`` for the list constructor.
"""

VIEWS = {
    # One wide question-answer table: every column a source may have, with nulls and empty texts.
    "qa_wide": """
        SELECT doc_id AS row_id, source, lang, text,
          CASE WHEN doc_id % 17 = 0 THEN NULL ELSE split_part(text, '.', 1) END AS question,
          CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE split_part(text, '.', 2) END AS problem,
          CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN '' ELSE concat('题', split_part(text, ' ', 1)) END
            AS question_chinese,
          concat(CASE WHEN doc_id % 2 = 0 THEN '问题：' ELSE '' END, ' ', split_part(text, '.', 1), ' ') AS query,
          CASE WHEN doc_id % 6 = 0 THEN NULL ELSE $list(split_part(text, ' ', 1), split_part(text, ' ', 2),
            split_part(text, ' ', 3), split_part(text, ' ', 4)) END AS choices,
          CASE WHEN doc_id % 9 = 0 THEN NULL ELSE $list(split_part(text, ' ', 3), split_part(text, ' ', 5)) END AS options,
          CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE split_part(text, ' ', 6) END AS options_text,
          concat('[''', lang, ''', ''', source, ''']') AS choices_text,
          split_part(text, ' ', 5) AS a, CASE WHEN doc_id % 4 = 1 THEN '' ELSE split_part(text, ' ', 6) END AS b,
          CASE WHEN doc_id % 5 = 2 THEN NULL ELSE split_part(text, ' ', 7) END AS c, split_part(text, ' ', 8) AS d,
          CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '' ELSE split_part(text, ' ', 9) END AS answer,
          CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id % 4 AS INT) END AS answer_idx,
          CASE WHEN doc_id % 8 = 0 THEN NULL ELSE $list(split_part(text, ' ', 1), split_part(text, ' ', 2)) END AS answer_list,
          CASE WHEN doc_id % 8 = 1 THEN NULL ELSE $list(split_part(text, ' ', 3), split_part(text, ' ', 4)) END AS answers,
          split_part(text, ' ', 10) AS label, split_part(text, ' ', 11) AS gt,
          CASE WHEN doc_id % 3 = 1 THEN NULL WHEN doc_id % 3 = 2 THEN '' ELSE CAST(n_chars AS STRING) END AS result,
          concat('x=', CAST(n_chars AS STRING)) AS equation,
          CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE split_part(text, '.', 3) END AS chain,
          CASE WHEN doc_id % 2 = 0 THEN NULL ELSE split_part(text, '.', 3) END AS lecture,
          CASE WHEN doc_id % 5 = 1 THEN NULL WHEN doc_id % 5 = 2 THEN '' ELSE split_part(text, '.', 4) END AS solution,
          split_part(text, '.', 5) AS analysis,
          CASE WHEN doc_id % 3 = 2 THEN NULL ELSE split_part(text, '.', 2) END AS explanation,
          split_part(text, '.', 6) AS rationale,
          CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 7 = 4 THEN '' ELSE concat('add(', lang, ')') END AS program,
          concat('text:', lang) AS program_text, $list(CAST(doc_id % 5 AS INT)) AS gold,
          CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('img', CAST(doc_id AS STRING)) END AS image,
          CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('alt', CAST(doc_id AS STRING)) END AS img
        FROM @documents""",
    # Parts of chat samples: tagged and plain questions, with and without system turn and answers.
    "sample_parts": """
        SELECT doc_id AS sample_id, source AS dataset, n_chars,
          CASE WHEN doc_id % 4 = 0 THEN concat('system ', lang) END AS s,
          CASE WHEN doc_id % 10 = 1 THEN concat(' <image>', chr(10)) WHEN doc_id % 3 = 0
            THEN concat('<image>', chr(10), split_part(text, '.', 1)) WHEN doc_id % 23 = 0 THEN ' ' ELSE text END AS u1,
          CASE WHEN doc_id % 9 <> 0 THEN split_part(text, '.', 2) END AS a1,
          CASE WHEN doc_id % 5 = 0 THEN concat(split_part(text, '.', 3), chr(9)) END AS u2,
          CASE WHEN doc_id % 5 = 0 AND doc_id % 9 <> 0 THEN concat(split_part(text, '.', 4), chr(10)) END AS a2
        FROM @documents""",
    # Responses in Chinese to one question per order.
    "responses": """
        SELECT o_orderkey AS sample_id, o_custkey AS prompt_id, concat('ds', CAST(o_custkey % 19 AS STRING)) AS dataset,
          concat('<image>', chr(10), '长方形的面积是 ', amt, ' 平方厘米，求它的两倍。') AS question,
          CASE o_orderkey % 5 WHEN 0 THEN concat('答案是 ', letter) WHEN 1 THEN concat('答案：', amt)
            WHEN 2 THEN concat('解析：先算面积，再求 ', amt, ' 的两倍，取 0') WHEN 3 THEN '' ELSE letter END AS gt_answer,
          CASE o_orderkey % 18
            WHEN 0 THEN concat('首先，观察题目中的信息。第一步：计算 ', amt, ' × 2。然后，试试看，你觉得结果是多少？最后，答案是 ', letter, '。')
            WHEN 1 THEN concat('B.', chr(10), '正确')
            WHEN 2 THEN concat('答案是A', chr(10))
            WHEN 3 THEN concat('正确答案是 ', amt)
            WHEN 4 THEN ''
            WHEN 5 THEN concat('  ', chr(10), ' ')
            WHEN 6 THEN '图片太模糊，看不清题目。'
            WHEN 7 THEN '这里的推理过程不对，因果关系错误。'
            WHEN 8 THEN concat('步骤一：加法算错了，结果应为 ', amt, '.5 元，所以最终答案：', amt)
            WHEN 9 THEN concat('Step 1: compute ', amt, '. Step 2: check ### $$$ *** & so on', chr(10), 'Answer ', letter)
            WHEN 10 THEN '概念混淆，不知道该用哪个公式'
            WHEN 11 THEN '选 C，因为三加二等于五，加倍之后是十，大约是几个苹果？'
            WHEN 12 THEN '文字没有识别出来，OCR 失败了，请重新拍照上传图片后再试一次吧！'
            WHEN 13 THEN concat('这道题目考查的是面积计算，长方形的长是 ', amt, ' 厘米，宽是 3.5 厘米，面积等于长乘以宽')
            WHEN 14 THEN concat('因此我们可以得到 ', letter, ' 选项是对的，故选 ', letter, '，想一想为什么？你能发现规律吗？')
            WHEN 15 THEN concat('答案：', amt)
            WHEN 16 THEN concat('图像里的内容我无法辨认，取 0 和 ', amt, '1')
            ELSE concat('我们来思考：1. 先看面积 2. 再乘以二。首先注意到数字 ', amt, '，接下来乘以 2，所以答案：', letter, '……') END
            AS response,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS is_correct,
          o_totalprice / 500000 AS reward
        FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS amt,
          chr(CAST(65 + o_orderkey % 4 AS INT)) AS letter FROM @orders)""",
    # Free text of a judge, mostly with a JSON object in it.
    "judged": """
        SELECT o_orderkey AS sample_id, concat('ds', CAST(o_custkey % 19 AS STRING)) AS dataset,
          CASE o_orderkey % 8
            WHEN 0 THEN concat(chr(123), core, '"format": 9', chr(125))
            WHEN 1 THEN concat('评分如下：', chr(10), chr(123), core, '"format": 12', chr(125), ' 以上。')
            WHEN 2 THEN concat(chr(123), core, '"style": 3', chr(125))
            WHEN 3 THEN '无法评分'
            WHEN 4 THEN concat(chr(123), core, '"format": -1.5', chr(125))
            WHEN 5 THEN concat(chr(123), core, '"format": "8"', chr(125))
            WHEN 6 THEN concat(chr(123), core, '"format": "good"', chr(125))
            ELSE concat(chr(123), core, '"format": null', chr(125)) END AS judge_output
        FROM (SELECT *, concat('"accuracy": ', CAST(o_orderkey % 11 AS STRING), ', "completeness": ',
          CAST(o_custkey % 11 AS STRING), ', "scaffolding": 7.5, "fluency": ', CAST(o_custkey % 13 AS STRING), ', ') AS core
          FROM @orders)""",
    # Long texts with a reference text each.
    "text_pairs": """
        SELECT doc_id AS sample_id, source AS dataset, d.text AS response, b.text AS gt_answer
        FROM (SELECT *, doc_id % (SELECT count(*) FROM @benchmark) AS item FROM @documents) d
        JOIN @benchmark b ON d.item = b.item_id""",
    # Marks of single samples in monthly evaluation runs; one dataset was not evaluated in two months of the year.
    "eval_samples": """
        SELECT run_no, concat('run_', CAST(run_no AS STRING)) AS run_id,
          CASE run_no % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'sft' WHEN 2 THEN 'grpo' ELSE 'full' END AS stage,
          concat(CAST(yr * 100 + mo AS STRING), '01_093000') AS ts,
          concat('ds', CAST(o_custkey % 19 AS STRING)) AS dataset, o_orderkey AS sample_id,
          CASE WHEN o_totalprice > 60000 + 23000 * (o_custkey % 19) THEN 1 ELSE 0 END AS accuracy,
          CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS step_completeness,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS scaffolding_rate
        FROM (SELECT *, yr * 12 + mo AS run_no FROM (SELECT *, CAST(year(o_orderdate - INTERVAL 1 DAY) AS INT) AS yr,
          CAST(month(o_orderdate - INTERVAL 1 DAY) AS INT) AS mo FROM @orders))
        WHERE NOT (mo IN (3, 8) AND o_custkey % 19 = 3)""",
    # One row per run and dataset; one dataset failed in every third run.
    "run_table": """
        SELECT run_id, stage, ts, concat('model/', stage) AS model_path, dataset,
          CASE WHEN max(run_no) % 3 = 0 AND dataset = 'ds5' THEN NULL ELSE avg(CAST(accuracy AS DOUBLE)) END AS accuracy,
          CASE WHEN dataset = 'ds6' AND max(run_no) % 2 = 0 THEN NULL ELSE avg(CAST(step_completeness AS DOUBLE)) END
            AS step_completeness,
          avg(CAST(scaffolding_rate AS DOUBLE)) AS scaffolding_rate, count(*) AS total
        FROM @eval_samples GROUP BY run_id, stage, ts, dataset""",
    # Marks of two runs on the same documents.
    "mark_pairs": """
        SELECT d.source AS dataset, l.doc_id AS sample_id, l.quality AS first_mark, 1 - l.toxic AS second_mark
        FROM @labels l JOIN @documents d ON l.doc_id = d.doc_id""",
    # Points of a metric log: users are spread over three runs, and the event type is the metric.
    "points": """
        SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, event_type AS metric, event_id AS step, ts, value
        FROM @events""",
    # Datasets with a size, a path and whether it exists.
    "registry": """
        SELECT concat('ds', CAST(c_custkey % 25 AS STRING)) AS dataset,
          concat('dataset/ds', CAST(c_custkey % 25 AS STRING), '.parquet') AS path,
          c_custkey % 25 <> 4 AS path_exists, count(*) AS customers
        FROM @customer GROUP BY c_custkey % 25""",
    # Candidates with logged log-probabilities.
    "rollouts": """
        SELECT sample_id, prompt_id, prompt_id % 50 AS batch_id, response,
          CASE WHEN prompt_id % 10 = 0 THEN 0.5 ELSE reward END AS reward,
          -(sample_id % 97) / CAST(50 AS DOUBLE) AS logp_old, -(sample_id % 89) / CAST(50 AS DOUBLE) AS logp_new
        FROM @responses""",
}

#: Views whose shape differs by engine; the Spark side builds them with the library's own operators.
DUCKDB_VIEWS = {
    "samples": """
        SELECT sample_id, dataset, list_filter([
          {'role': 'system', 'content': s}, {'role': 'user', 'content': u1}, {'role': 'assistant', 'content': a1},
          {'role': 'user', 'content': u2}, {'role': 'assistant', 'content': a2}],
          lambda t: t.content IS NOT NULL) AS turns
        FROM @sample_parts""",
}

#: Views that build or cut texts; a single small input file is spread over the cores first.
SPREAD = {"qa_wide", "sample_parts", "responses", "judged"}

#: Run tables are stored when a run ends, and read many times.
STORED = {"run_table"}
