from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from edulake.sources import json_array


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": None}
    old = {name: spark.conf.get(name) for name in names}

    def use(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield use
    for name, value in old.items():
        spark.conf.set(name, value)


def objects(spark, path):
    return sorted(json.dumps(json.loads(r.json), sort_keys=True) for r in json_array.read_objects(spark, str(path)).collect())


def expected(*arrays):
    return sorted(json.dumps(o, sort_keys=True) for a in arrays for o in a if isinstance(o, dict))


def invented(seed, n):
    """Objects with brackets, braces, quotes and escapes in their strings, nested and of very different size."""
    choose = random.Random(seed)
    parts = ["}", "{", "]", "[", '"', "\\", '\\"', "},{", "é", "中", "😀", "\n", "abc ", ", ", "\\\\", "/", "\t"]

    def text():
        return "".join(choose.choices(parts, k=choose.choice([0, 1, 5, 40, 200])))

    def value(depth):
        kind = choose.randrange(5 if depth else 2)
        if kind == 0:
            return text()
        if kind == 1:
            return choose.choice([None, True, -1.5e3, 7])
        if kind < 4:
            return {text(): value(depth - 1) for _ in range(choose.randrange(4))}
        return [value(depth - 1) for _ in range(choose.randrange(4))]

    return [{"k": k, **{text(): value(3) for _ in range(choose.randrange(4))}} for k in range(n)]


@pytest.mark.parametrize("size", [400, 3000])
@pytest.mark.parametrize(("indent", "ascii_only"), [(None, False), (2, False), (None, True)])
def test_objects_of_any_shape(spark, tmp_path, small_ranges, size, indent, ascii_only):
    """Ranges that cut objects, strings, escapes and code points give what the whole file gives."""
    arrays = [invented(size + k, 12) for k in range(2)]
    for k, array in enumerate(arrays):
        (tmp_path / f"{k}.json").write_text(json.dumps(array, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    small_ranges(size)
    assert objects(spark, tmp_path) == expected(*arrays)


def test_several_tasks_read_one_file(spark, tmp_path, small_ranges):
    array = [{"k": k, "text": "some words " * 20} for k in range(400)]
    (tmp_path / "one.json").write_text(json.dumps(array))
    small_ranges(8000)
    lines = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    assert objects(spark, tmp_path) == expected(array)


def test_empty_arrays_files_and_other_elements(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text(" [\n ] \n")
    (tmp_path / "c.json").write_text("")
    assert objects(spark, tmp_path) == []
    mixed = ["a { b", 1, {"x": "}"}, None, {}, "}", "\\", {"z": {"w": {}}}, "]"]
    (tmp_path / "d.json").write_text(json.dumps(mixed))
    small_ranges(20)
    assert objects(spark, tmp_path) == expected(mixed)


def test_one_object_over_many_ranges(spark, tmp_path, small_ranges):
    array = [{"k": 1}, {"long": ["{}" * 1000, {"deep": "x" * 2000}]}, {"k": 2}]
    (tmp_path / "a.json").write_text(json.dumps(array))
    small_ranges(500)
    assert objects(spark, tmp_path) == expected(array)


def test_written_arrays_come_back(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit('"}\\ {['), F.col("id")).alias("text")).repartition(3)
    json_array.write_arrays(rows, str(tmp_path / "out"))
    for file in (tmp_path / "out").glob("part-*.txt"):
        assert isinstance(json.loads(file.read_text()), list)
    got = json_array.read_objects(spark, str(tmp_path / "out"))
    back = got.select(F.from_json("json", "id bigint, text string").alias("r")).select("r.*")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    json_array.write_arrays(rows.limit(0), str(tmp_path / "none"))
    assert json_array.read_objects(spark, str(tmp_path / "none")).count() == 0
