"""Files that hold one JSON array of objects each, read by as many tasks as their bytes deserve.

Spark's text reader cuts a file into byte ranges, and with the closing brace as the end of a line every range begins
right behind one, whatever stands on the file's lines. Such a piece tells neither how deep it lies nor whether its brace
belongs to a string. So one pass sums up every range: how it changes the depth, for either case, and whether it ends
inside a string if it began outside. Running totals over a file's ranges give the state in which each begins. A second
pass then cuts out the objects; those that lie in several ranges are put together from their parts, which are the only
texts that are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edulake.session import settle

_BRACE = "}"
_INSIDE = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: The rest of a string; an escaped character or a whole string; all before an object.
_REST = re.compile(_INSIDE, re.S)
_WHOLE = re.compile(r"\\.|\"" + _INSIDE, re.S)
_BEFORE = re.compile(r'(?:[^"{]++|"' + _INSIDE + r")*+\{", re.S)


def scan(piece: str, inside: bool) -> tuple[int, bool]:
    """What a piece without closing braces adds to the depth, and whether it ends inside a string.

    Only strings have backslashes, so an escaped quote never begins or ends a string, whatever ``inside`` says.
    """
    if inside:
        rest = _REST.match(piece)
        if rest is None:
            return 0, True
        piece = piece[rest.end() :]
    bare = _WHOLE.sub("", piece)
    quote = bare.find('"')
    if quote >= 0:
        bare = bare[:quote]
    return bare.count("{") + bare.count("[") - bare.count("]"), quote >= 0


def _rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _sum_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range, if it begins outside and if inside a string: change of depth, and the least depth behind a brace."""
    found: list[list] = []
    state: list[list] = []
    for path, start, value in _rows(batches, "path", "start", "value"):
        if not found or found[-1][:2] != [path, start]:
            found.append([path, start])
            # Depth so far, least depth, and whether inside a string.
            state.append([[0, None, False], [0, None, True]])
        for case in state[-1]:
            change, case[2] = scan(value or "", case[2])
            case[0] += change
            if not case[2]:
                case[0] -= 1
                case[1] = case[0] if case[1] is None else min(case[0], case[1])
    rows = [(*f, s[0][2], *s[0][:2], *s[1][:2]) for f, s in zip(found, state, strict=True)]
    names = ["path", "start", "turns", "outside", "outside_low", "inside", "inside_low"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects, and parts of objects that go beyond their range."""
    out: list[tuple] = []
    held: list[str] = []
    now: tuple | None = None
    depth, inside, owner, size = 0, False, None, 0

    def keep(whole: bool, closed: bool) -> None:
        nonlocal size
        out.append((*now, owner, whole, closed, "".join(held)))
        size += len(out[-1][-1])
        held.clear()

    def taken() -> pa.RecordBatch:
        nonlocal size
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        names = ["path", "start", "owner", "whole", "closed", "json"]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        out.clear()
        size = 0
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for path, start, value, first_depth, first_inside, first_owner in _rows(
        batches, "path", "start", "value", "depth", "in_string", "owner"
    ):
        if now != (path, start):
            if held:
                keep(False, False)
            now = (path, start)
            depth, inside, owner = first_depth, first_inside, first_owner
            begun = depth > 1
        piece = value or ""
        if not begun:
            rest = _REST.match(piece) if inside else None
            begin = _BEFORE.match(piece, rest.end() if rest else 0) if rest or not inside else None
            if begin:
                begun, owner = True, start
                held.append(piece[begin.end() - 1 :] + _BRACE)
        else:
            held.append(piece + _BRACE)
        change, inside = scan(piece, inside)
        depth += change
        if not inside:
            depth -= 1
            if begun and depth == 1:
                keep(owner == start, True)
                begun = False
        if size > 1 << 22:
            yield taken()
    if held:
        keep(False, False)
    yield taken()


def read_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``file_name`` and ``json`` for every object of the arrays in the files, whatever their formatting.

    A file is cut into ranges of ``spark.sql.files.maxPartitionBytes``. There is one state of a few dozen bytes for each
    range, that is for each task of the scan; they are broadcast. Texts and numbers between the objects are left out, an
    empty array or file gives no rows, and an object that breaks off with its file is lost.
    """
    lines = spark.read.option("lineSep", _BRACE).text(path)
    pieces = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    sums = settle(
        pieces.mapInArrow(
            _sum_up,
            "path string, start bigint, turns boolean, outside bigint, outside_low bigint, inside bigint, inside_low bigint",
        )
    )
    # Within a file: one row per range.
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("in_string", F.coalesce(F.sum(F.col("turns").cast("int")).over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    low = F.when(F.col("in_string"), F.col("inside_low")).otherwise(F.col("outside_low"))
    known = known.withColumn("low", low).withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    between = (F.col("depth") <= 1) | (F.col("depth") + F.col("low") <= 1)
    owner = F.last(F.when(between, F.col("start")), ignorenulls=True).over(before)
    states = settle(known.select("path", "start", "depth", "in_string", owner.alias("owner")))
    # The ranges stay as they are and in order: the pieces are the streamed side of the join.
    placed = pieces.join(F.broadcast(states), ["path", "start"]).select(
        "path", "start", "value", "depth", "in_string", "owner"
    )
    cut = placed.mapInArrow(
        _cut_out, "path string, start bigint, owner bigint, whole boolean, closed boolean, json string"
    )
    cut = settle(cut)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "json"))), lambda p: p["json"])
    joined = (
        cut.where("NOT whole")
        .groupBy("path", "owner")
        .agg(F.max("closed").alias("closed"), F.concat_ws("", parts).alias("json"))
        .where("closed")
    )
    found = cut.where("whole").select("path", "json").unionByName(joined.select("path", "json"))
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "json")


def _bracketed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = "["
    for batch in batches:
        values = batch.column("value").to_pylist()
        if values:
            lines = [mark + values[0], *["," + v for v in values[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
            mark = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], ["value"])


def write_arrays(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays of objects, one file and array for each partition."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    rows.mapInArrow(_bracketed, "value string").write.text(path)
