"""Splits, samples, weights and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.duck import hash52, unit
from checks.harness import Tables, query
from edulake.operators import sampling, split


def _h(key: str, seed: str = "42") -> str:
    return hash52(f"'{seed}'", key)


_SIZE = "least(greatest(least(floor(total * {ratio}::DOUBLE), {cap}), 10), total - 10)"


@query(
    "holdout_split",
    f"""SELECT dataset, o_orderkey, CASE WHEN rn <= {_SIZE.format(ratio=0.05, cap=500)} THEN 'eval' ELSE 'train' END AS split
        FROM (SELECT o_orderpriority AS dataset, o_orderkey,
          row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h('o_orderkey')}, o_orderkey) AS rn,
          count(*) OVER (PARTITION BY o_orderpriority) AS total FROM @orders)""",
    longs=["o_orderkey"],
)
def holdout_split(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("dataset"), "o_orderkey")
    return split.holdout_split(rows, "o_orderkey")


@query(
    "holdout_split_settings",
    f"""SELECT dataset, doc_id, CASE WHEN rn <= {_SIZE.format(ratio='(CASE WHEN lang = \'en\' THEN 0.1 ELSE 0.2 END)', cap="(CASE WHEN lang = 'en' THEN 20 ELSE 1000 END)")}
          THEN 'eval' ELSE 'train' END AS split
        FROM (SELECT lang AS dataset, lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id')}, doc_id) AS rn,
          count(*) OVER (PARTITION BY lang) AS total FROM @documents)""",
    longs=["doc_id"],
)
def holdout_split_settings(t: Tables) -> DataFrame:
    english = F.col("dataset") == "en"
    settings = (
        t.documents.select(F.col("lang").alias("dataset"))
        .distinct()
        .withColumn("eval_ratio", F.when(english, 0.1).otherwise(0.2))
        .withColumn("eval_cap", F.when(english, 20).otherwise(1000))
    )
    return split.holdout_split(t.documents.select(F.col("lang").alias("dataset"), "doc_id"), "doc_id", settings=settings)


_GROUPED = f"""WITH keyed AS (SELECT lang AS dataset, doc_id, left(text, 100) AS question, md5(left(text, 100)) AS k FROM @documents),
   units AS (SELECT DISTINCT dataset, k FROM keyed),
   cut AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_h('k')}, k) AS rn,
     count(*) OVER (PARTITION BY dataset) AS total FROM units),
   marked AS (SELECT y.dataset, y.doc_id, y.question, CASE WHEN rn <= {_SIZE.format(ratio=0.05, cap=500)}
     THEN 'eval' ELSE 'train' END AS split FROM keyed y JOIN cut USING (dataset, k))"""


def _grouped(t: Tables) -> DataFrame:
    question = F.substring("text", 1, 100)
    rows = t.documents.select(
        F.col("lang").alias("dataset"), "doc_id", question.alias("question"), F.md5(question).alias("k")
    )
    return split.holdout_split(rows, "doc_id", group_key="k")


@query("holdout_split_grouped", _GROUPED + " SELECT dataset, doc_id, split FROM marked", longs=["doc_id"])
def holdout_split_grouped(t: Tables) -> DataFrame:
    return _grouped(t).select("dataset", "doc_id", "split")


@query(
    "train_rows",
    f"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id')}, doc_id) AS rn,
          count(*) OVER (PARTITION BY lang) AS total FROM @documents) WHERE rn > {_SIZE.format(ratio=0.05, cap=500)}""",
    longs=["doc_id"],
)
def train_rows(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("dataset"), "doc_id")
    held = split.holdout_split(rows, "doc_id").where("split = 'eval'")
    return split.train_rows(rows, held, "doc_id").select("doc_id")


_SPLIT = f"""WITH marked AS (SELECT doc_id, text AS question, CASE WHEN rn <= {_SIZE.format(ratio=0.05, cap=500)}
     THEN 'eval' ELSE 'train' END AS split
   FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id')}, doc_id) AS rn,
     count(*) OVER (PARTITION BY lang) AS total FROM @documents)),
   leaked AS (SELECT left(question, 100) AS prefix FROM marked GROUP BY 1 HAVING count(DISTINCT split) = 2)"""


def _marked(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("dataset"), "doc_id", F.col("text").alias("question"))
    return split.holdout_split(rows, "doc_id")


@query("leaked_prefixes", _SPLIT + " SELECT prefix FROM leaked")
def leaked_prefixes(t: Tables) -> DataFrame:
    return split.leaked_prefixes(_marked(t))


@query(
    "leaked_rows",
    _SPLIT + " SELECT doc_id, split FROM marked WHERE left(question, 100) IN (SELECT prefix FROM leaked)",
    longs=["doc_id"],
)
def leaked_rows(t: Tables) -> DataFrame:
    return split.leaked_rows(_marked(t)).select("doc_id", "split")


@query("leakage_after_grouped_split", _GROUPED + """, leaked AS (SELECT question FROM marked GROUP BY dataset, question
   HAVING count(DISTINCT split) = 2) SELECT count(*) AS leaked FROM leaked""", longs=["leaked"])
def leakage_after_grouped_split(t: Tables) -> DataFrame:
    rows = _grouped(t).withColumn("question", F.concat_ws("|", "dataset", "question"))
    return split.leaked_prefixes(rows, chars=200).agg(F.count("*").alias("leaked"))


@query(
    "config_overlap",
    """SELECT dataset, config, split FROM (SELECT DISTINCT source AS dataset, lang AS config, 'test' AS split FROM @documents WHERE n_chars > 4000)
       INTERSECT SELECT DISTINCT source, lang, 'test' FROM @documents WHERE n_chars < 1200""",
)
def config_overlap(t: Tables) -> DataFrame:
    configs = lambda condition: t.documents.where(condition).select(
        F.col("source").alias("dataset"), F.col("lang").alias("config"), F.lit("test").alias("split")
    ).distinct()
    return split.config_overlap(configs("n_chars > 4000"), configs("n_chars < 1200"))


@query("first_rows", "SELECT event_id, event_type FROM @events WHERE event_type <> 'view' ORDER BY event_id LIMIT 777", longs=["event_id"])
def first_rows(t: Tables) -> DataFrame:
    return sampling.first_n(t.events.where("event_type <> 'view'"), "event_id", 777).select("event_id", "event_type")


@query(
    "fraction_sample",
    f"""SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY {_h('o_orderkey')}, o_orderkey) AS rn,
        count(*) OVER () AS total FROM @orders) WHERE rn <= least(floor(total * 0.125::DOUBLE), 1500)""",
    longs=["o_orderkey", "o_custkey"],
)
def fraction_sample(t: Tables) -> DataFrame:
    return sampling.fraction_sample(t.orders, "o_orderkey", 0.125, cap=1500).select("o_orderkey", "o_custkey")


@query(
    "random_rows",
    f"SELECT doc_id, lang FROM @documents ORDER BY {_h('doc_id', '7')}, doc_id LIMIT 200",
    longs=["doc_id"],
)
def random_rows(t: Tables) -> DataFrame:
    return sampling.random_n(t.documents, "doc_id", 200, seed="7").select("doc_id", "lang")


@query(
    "curated_sample",
    f"""SELECT dataset, o_orderkey FROM (SELECT o_orderpriority AS dataset, o_orderkey,
          row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_h('o_orderkey')}, o_orderkey) AS rn FROM @orders)
        WHERE rn <= CASE dataset WHEN '1-URGENT' THEN 1500 WHEN '2-HIGH' THEN 1000 WHEN '3-MEDIUM' THEN 1000000 ELSE 0 END""",
    longs=["o_orderkey"],
)
def curated_sample(t: Tables) -> DataFrame:
    quotas = t.spark.createDataFrame(
        [("1-URGENT", 1500), ("2-HIGH", 1000), ("3-MEDIUM", 1000000), ("9-MISSING", 500)], "dataset string, quota long"
    )
    rows = t.orders.select(F.col("o_orderpriority").alias("dataset"), "o_orderkey", "o_totalprice")
    return sampling.curated_sample(rows, quotas, "o_orderkey").select("dataset", "o_orderkey")


def _draws(weight: str) -> str:
    return f"""WITH rows AS (SELECT lang AS dataset, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_h('doc_id')}, doc_id) AS position
       FROM @documents),
     sizes AS (SELECT dataset, count(*) AS size FROM rows GROUP BY dataset),
     masses AS (SELECT *, sqrt(size::DOUBLE) * {weight} AS mass FROM sizes),
     shares AS (SELECT *, (sum(mass) OVER (ORDER BY dataset) - mass) / sum(mass) OVER () AS lo,
       sum(mass) OVER (ORDER BY dataset) / sum(mass) OVER () AS hi FROM masses),
     draws AS (SELECT range AS draw, {unit("'d'", "'42|0'", "range")} AS u, {unit("'r'", "'42|0'", "range")} AS v
       FROM range((SELECT count(*) FROM rows)))
     SELECT draw, s.dataset, doc_id FROM draws JOIN shares s ON u >= lo AND u < hi
     JOIN rows r ON r.dataset = s.dataset AND r.position = floor(v * size) + 1"""


def _draw_rows(t: Tables) -> DataFrame:
    return t.documents.select(F.col("lang").alias("dataset"), "doc_id")


@query("weighted_draws", _draws("1"), longs=["draw", "doc_id"])
def weighted_draws(t: Tables) -> DataFrame:
    return sampling.weighted_draws(_draw_rows(t), "doc_id")


@query("weighted_draws_feedback", _draws("(CASE WHEN dataset = 'de' THEN 2.5 WHEN dataset = 'es' THEN 0 ELSE 1 END)"), longs=["draw", "doc_id"])
def weighted_draws_feedback(t: Tables) -> DataFrame:
    weights = t.spark.createDataFrame([("de", 2.5), ("es", 0.0)], "dataset string, weight double")
    return sampling.weighted_draws(_draw_rows(t), "doc_id", multipliers=weights)


def _permuted(tag: str) -> str:
    """``event_id`` and ``position``: row numbers through the rounds of the permutation, again while beyond the last."""

    def rounds(p: str, source: str) -> str:
        h = [hash52("'permutation'", f"'{tag}'", f"'{turn}'", half) for turn, half in enumerate(("y0", "x1", "y1", "x2"))]
        return f"""SELECT event_id, n, a, b, x2 * b + (y1 + {h[3]}) % b AS p FROM (SELECT *, (x1 + {h[2]}) % a AS x2
          FROM (SELECT *, (y0 + {h[1]}) % b AS y1 FROM (SELECT *, ({p} // b + {h[0]}) % a AS x1
          FROM (SELECT *, {p} % b AS y0 FROM {source}))))"""

    return f"""WITH RECURSIVE numbered AS (SELECT event_id, row_number() OVER (ORDER BY {_h('event_id', 'rows')}, event_id) - 1 AS row_number,
        count(*) OVER () AS n FROM @events),
      sided AS (SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM numbered)),
      walk AS ({rounds('row_number', 'sided')} UNION ALL {rounds('p', '(SELECT * FROM walk WHERE p >= n)')})
      SELECT event_id, p + 1 AS position FROM walk WHERE p < n"""


_ORDER = _permuted("45")


@query("epoch_order", _ORDER, longs=["event_id", "position"])
def epoch_order(t: Tables) -> DataFrame:
    return sampling.epoch_order(t.events, "event_id", epoch=3)


@query(
    "batches_resumed",
    f"SELECT event_id, position, CAST((position - 1) // 32 AS BIGINT) AS batch_id FROM ({_ORDER}) WHERE (position - 1) // 32 >= 7",
    longs=["event_id", "position", "batch_id"],
)
def batches_resumed(t: Tables) -> DataFrame:
    numbered = sampling.number_rows(t.events, "event_id")
    return sampling.assign_batches(sampling.epoch_order(numbered, "event_id", epoch=3), 32, skip_batches=7)


@query(
    "batch_rows",
    f"SELECT event_id, position, CAST((position - 1) // 32 AS BIGINT) AS batch_id FROM ({_ORDER}) WHERE (position - 1) // 32 IN (2, 7, 30)",
    longs=["event_id", "position", "batch_id"],
)
def batch_rows(t: Tables) -> DataFrame:
    return sampling.batch_rows(sampling.number_rows(t.events, "event_id"), "event_id", [2, 7, 30], 32, epoch=3)


@query(
    "shards",
    f"SELECT event_id, (position - 1) % 4 AS worker FROM ({_ORDER})",
    longs=["event_id", "worker"],
)
def shards(t: Tables) -> DataFrame:
    return sampling.shard(sampling.epoch_order(t.events, "event_id", epoch=3), 4).select("event_id", "worker")


@query(
    "audit_sample",
    f"""SELECT dataset, sample_id, printf('%s_%03d', dataset, row_number() OVER (PARTITION BY dataset ORDER BY sample_id) - 1) AS audit_id,
          true AS to_audit
        FROM (SELECT dataset, sample_id, row_number() OVER (PARTITION BY dataset ORDER BY {_h('sample_id')}, sample_id) AS rn FROM @responses)
        WHERE rn <= greatest(1, 50 // (SELECT count(DISTINCT dataset) FROM @responses))""",
    longs=["sample_id"],
)
def audit_sample(t: Tables) -> DataFrame:
    return sampling.audit_sample(t.responses.select("dataset", "sample_id"), "sample_id")


@query(
    "raw_sample_cap",
    """SELECT dataset, sample_id, response FROM @responses
       QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY sample_id) <= 100""",
    longs=["sample_id"],
)
def raw_sample_cap(t: Tables) -> DataFrame:
    return split.raw_sample_cap(t.responses.select("dataset", "sample_id", "response"), "sample_id")
