from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
FOLDER = "/root/testdata/sf0.001"


def invented(seed: int, n: int) -> str:
    """Words of random syllables in lines."""
    choose = random.Random(seed)
    parts = "an on er in th es ti le ou re de qu é ß ñ".split()
    own = ["".join(choose.choices(parts, k=choose.randint(1, 3))) for _ in range(n)]
    return " ".join(w + choose.choices([" ", ".\n"], [9, 1])[0].strip(" ") for w in own)


def edge_rows() -> list[tuple]:
    """Null and empty texts, null ids and columns, blanks, repeats, near copies and a very long text."""
    base = invented(1, 300)
    rows = [(k, invented(k, 60 + 7 * k), "en" if k % 2 else "fr", f"s{k % 3}", 1) for k in range(2, 14)]
    rows += [(20, base, "en", "s0", None), (21, base, "en", "s0", 7), (22, base + " one more", None, None, 7)]
    rows += [(23, "", "en", "s1", 0), (24, None, "fr", "s1", None), (25, " \n\t\n ", "en", None, 5)]
    rows += [(26, "One", "de", "s1", 3), (27, "one", "de", "s1", 3), (28, "two words", "de", "s2", 9)]
    rows += [(None, base, "en", "s0", 1), (None, None, None, None, None), (30, invented(3, 81), "en", "s0", 1)]
    rows += [(31, invented(99, 20000), "en", "s2", 1), (31, invented(99, 20000), "en", "s2", 1)]
    rows += [(32, "!! ## $$ %% " * 40, "en", "s2", 1), (33, "same same same " * 50, "en", "s2", 1)]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    """Rows of edge cases, with further columns whose names the operators might use themselves."""
    names = ["row", "host", "d0", "words", "__text", "__id", "key", "n", "label", "score", "kept", "start"]
    rows = [(*r, *["x"] * len(names)) for r in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names)).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 2, int(k % 5 == 0)) for k in range(40)] + [(None, 1, 1), (20, None, None), (20, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
