"""The pipeline against a plain version of its stages, and what each stage must leave alone."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from edulake.llm import line_dedup, perplexity, simhash
from edulake.session import settle
from tests.llm import rules
from tests.llm.conftest import FOLDER


@pytest.fixture(scope="module")
def stages(spark, documents):
    found, docs = {"": documents}, documents
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, FOLDER))
        found[name] = docs
    return found


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_stages_keep_the_columns(stages, documents):
    assert list(stages) == ["", "quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name in list(stages)[1:-1]:
        assert stages[name].schema == documents.schema or stages[name].dtypes == documents.dtypes


def test_quality_rules(stages, documents):
    kept = {r.doc_id for r in perplexity.judge(documents, keep=["doc_id"]).where("kept").collect()}
    assert rows(stages["quality_rules"]) == [r for r in rows(documents) if r[0] in kept]
    for id, text, *_ in rows(documents):
        n, _, _, _, repeated = rules.measures(text)
        if n < 50 or 100 * repeated > 50 * n:
            assert id not in kept


def test_line_dedup(stages):
    before = rows(stages["quality_rules"])
    lines = rules.boilerplate([(r[3], r[1]) for r in before], line_dedup.RATIO, line_dedup.MIN_PAGES)
    want = []
    for id, text, lang, source, n in before:
        new = rules.without(text, lines.get(source, set()))
        want.append((id, new, lang, source, n if new == text else len(new)))
    assert rows(stages["line_dedup"]) == want


def test_near_dedup(stages):
    """Against all pairs of wide fingerprints; texts of like shingles go, and no text of unlike ones."""
    before = rows(stages["line_dedup"])
    hashes = [simhash.shingle_hashes((r[1] or "").encode(), simhash.SIMILAR_WORDS) for r in before]
    counts = np.array([len(h) for h in hashes])
    wide = simhash.wide_bits(np.array([x for h in hashes for x in h], dtype=np.uint64), counts)
    most, least = simhash.similar_limits(simhash.SIMILARITY)
    parent = list(range(len(before)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(before)):
        differing = wide[:i] ^ wide[i]
        near = (np.bitwise_count(differing).sum(axis=1) <= most) & ((differing == 0).sum(axis=1) >= least)
        for j in np.flatnonzero(near).tolist():
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    after = rows(stages["near_dedup"])
    assert after == [r for k, r in enumerate(before) if find(k) == k]
    shingles = [rules.shingle_counts(r[1]) for r in after]
    for i in range(len(after)):
        for j in range(i):
            if abs(len(shingles[i]) - len(shingles[j])) < 0.3 * len(shingles[i]):
                assert rules.jaccard(shingles[i], shingles[j]) < 0.82


def test_decontamination(spark, stages):
    items = [rules.shingles(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = []
    for r in rows(stages["near_dedup"]):
        held = rules.shingles(r[1])
        if not any(i and len(held & i) >= 0.8 * len(i) for i in items):
            want.append(r)
    assert rows(stages["decontamination"]) == want
    assert len(want) < stages["near_dedup"].count()


def test_packing(stages):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in stages["packing"].collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = {r[0]: [*own.encode(r[1], add_special_tokens=False).ids, 0] for r in rows(stages["decontamination"])}
    assert {k: [i for _, ids in sorted(v) for i in ids] for k, v in pieces.items()} == want


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns == stages["packing"].columns
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in found.collect()) == Counter(
        (r.doc_id, r.start, bytes(r.ids)) for r in stages["packing"].collect()
    )


def test_stages_take_no_rows(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
        docs = docs if docs.columns != nothing.columns else settle(docs)
