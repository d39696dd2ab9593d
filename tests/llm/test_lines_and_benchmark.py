from __future__ import annotations

from collections import Counter

import pytest

from edulake.llm import decontaminate, line_dedup
from tests.llm import rules
from tests.llm.conftest import SCHEMA, invented

LINE = "All rights reserved."


def test_lines_match_brute_force(spark, edges):
    more = [(100 + k, f"{LINE}\n{invented(200 + k, 30)}\n \r{LINE} ", "en", "s0", 1) for k in range(8)]
    docs = edges.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, SCHEMA))
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    lines = rules.boilerplate([(h, t) for _, h, t in rows], 0.3, 3)
    assert lines["s0"] == {LINE}
    want = []
    for id, host, text in rows:
        new = rules.without(text, lines.get(host, set()))
        n = 0 if text is None else len(text.split("\n"))
        want.append((id, new, n, 0 if text is None else n - (len(new.split("\n")) if new or n else 0)))
    found = line_dedup.drop_boilerplate(docs, ratio=0.3, min_pages=3).select("row.doc_id", "text", "n_lines", "n_dropped")
    assert Counter(map(tuple, found.collect())) == Counter(want)


def test_copies_do_not_turn_their_own_lines_into_boilerplate(spark):
    text = invented(7, 50)
    docs = spark.createDataFrame([(k, text, "en", "s", 1) for k in range(50)] + [(90, "other\n" + LINE, "en", "s", 1)], SCHEMA)
    assert line_dedup.drop_boilerplate(docs, min_pages=2).where("n_dropped > 0").count() == 0


def test_a_page_of_boilerplate_alone_becomes_empty(spark):
    docs = spark.createDataFrame([(k, f"{LINE}\npage {k}", "en", "s", 1) for k in range(9)] + [(9, LINE, "en", "s", 1)], SCHEMA)
    row = line_dedup.drop_boilerplate(docs).where("row.doc_id = 9").first()
    assert (row.text, row.n_lines, row.n_dropped) == ("", 1, 1)


def test_clashing_columns_and_empty_table(edges, nothing):
    assert line_dedup.drop_boilerplate(edges).count() == edges.count()
    assert line_dedup.drop_boilerplate(nothing).count() == 0


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, invented(500 + k, 12 + 5 * k)) for k in range(6)]
    rows += [(10, "two words"), (11, ""), (12, None), (13, "One"), (None, invented(500, 12)), (14, invented(504, 32))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_contained_items_match_brute_force(spark, edges, items):
    own = {r.item_id: r.text for r in items.collect() if r.item_id is not None}
    more = []
    for k, text in own.items():
        passage = rules.words(text)
        if len(passage) > 4:
            more.append((300 + k, f"{invented(k, 400)} {text} {invented(k + 1, 300)}", "en", "s0", 1))
            changed = passage[: len(passage) // 2] + ["changed"] + passage[len(passage) // 2 + 1 :]
            more.append((400 + k, f"{invented(k, 40)} {' '.join(changed)} {invented(k + 1, 30)}", "en", "s0", 1))
            more.append((500 + k, " ".join(passage[: int(len(passage) * 0.7)]), "en", "s0", 1))
    more += more[:2]
    docs = edges.select("doc_id", "text").unionByName(spark.createDataFrame(more, SCHEMA).select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        held = rules.shingles(r.text)
        for item, text in own.items():
            parts = rules.shingles(text)
            if parts and len(held & parts) >= 0.8 * len(parts):
                want[r.doc_id, item, len(held & parts), len(parts)] += 1
    found = decontaminate.contaminations(docs, items)
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()) == want
    assert len(want) > 10
    clean = decontaminate.remove_contaminated(docs, items)
    bad = {key[0] for key in want}
    ids = Counter(r.doc_id for r in clean.collect())
    whole = Counter(r.doc_id for r in docs.collect())
    assert all(ids[i] == (0 if i in bad else n) for i, n in whole.items() if i is not None)


def test_signature_is_as_long_as_the_share_needs(items):
    for r in decontaminate.item_signatures(items, "item_id", "text").groupBy("item").agg({"n": "max", "probed": "max"}).collect():
        assert r["max(probed)"]
    rows = decontaminate.item_signatures(items.where("item_id IS NOT NULL"), "item_id", "text").collect()
    probed = Counter(r.item for r in rows if r.probed)
    for r in rows:
        assert probed[r.item] >= min(r.n, int(0.2 * r.n + 1e-9) + 1)


def test_empty_tables_contain_nothing(edges, nothing, items):
    assert decontaminate.contaminations(nothing, items).count() == 0
    assert decontaminate.contaminations(edges, items.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(edges, items.limit(0)).count() == edges.count()
