"""Records of a delimited file whose quoted cells may have line breaks, read in splits.

A split of a file may begin inside a quoted cell.  A first pass steps each split through its lines from both states, outside and inside
quotes; a scan over the splits (a row each) tells in which one it really begins.  A second pass cuts the lines into records; only what a
border cuts apart is brought together by its split.  A quote opens a cell at its start only, so other quotes in a cell are text.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path

#: The rest of a quoted cell, with its closing quote.
_CLOSED = re.compile(r'(?:[^"]++|"")*+"')


def ends_inside(line: str, delimiter: str, inside: bool) -> bool:
    """Whether a quoted cell is open after a line, if one is before it or not."""
    at = 0
    if inside or line.startswith('"'):
        closed = _CLOSED.match(line, 0 if inside else 1)
        if not closed:
            return True
        at = closed.end()
    opening = delimiter + '"'
    while (at := line.find(opening, at)) >= 0:
        closed = _CLOSED.match(line, at + 2)
        if not closed:
            return True
        at = closed.end()
    return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(split, some of its lines), in order; a partition may have several splits."""
    for batch in batches:
        splits, lines = batch.column(0).to_numpy(), batch.column(1)
        at = 0
        while at < len(lines):
            to = at + int((splits[at:] == splits[at]).argmin() or len(lines) - at)
            yield int(splits[at]), lines.slice(at, to - at)
            at = to


def _quoting(lines: pa.Array) -> list[int]:
    """Lines that have a quote; others leave the state as it is."""
    return pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()


def _is_blank(record: str, delimiter: str) -> bool:
    if record.strip(delimiter + '" \t\r\n\v\f  ﻿'):
        return False
    return not any(c.strip() for row in csv.reader([record], delimiter=delimiter) for c in row)


def read_records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(line, record): records that have a value as they are in the file, line breaks in cells as \\n; `line` is in the order of the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("split"), "value")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[bool]] = {}
        for split, some in _runs(batches):
            state = out.setdefault(split, [False, True, False])  # after the lines so far if it begins outside, if inside; whether a record ended then
            for i in _quoting(some):
                line = some[i].as_py()
                outside, inside = ends_inside(line, delimiter, state[0]), ends_inside(line, delimiter, state[1])
                state[:] = [outside, inside, state[2] or not inside]
        rows = [(k, *v) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))], names=["split", "outside", "inside", "closes"])

    found = lines.mapInArrow(ends, "split long, outside boolean, inside boolean, closes boolean").orderBy("split").collect()  # a row a split
    starts: dict[int, tuple[int, bool, int]] = {}  # split: its number, whether it begins inside a cell, the split whose last record that is
    inside, owner = False, 0
    for n, r in enumerate(found):
        starts[r["split"]] = (n, inside, owner)
        if not inside or r["closes"]:
            owner = n
        inside = r["inside"] if inside else r["outside"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number, inside, owner, nth, open_, ahead = None, 0, False, 0, 0, [], False

        def batch(rows: list[tuple[int, int, bool, str]]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["line", "owner", "whole", "record"])

        def rest() -> list[tuple[int, int, bool, str]]:
            return [(number << 33 | nth, owner if ahead else number, False, "\n".join(open_))] if open_ else []

        for new, some in _runs(batches):
            if new != split:
                yield batch(rest())
                split, (number, inside, owner), nth, open_ = new, starts[new], 0, []
                ahead = inside
            quoting, rows = set(_quoting(some)), []
            for i, line in enumerate(some.to_pylist()):
                if not number and not nth and not open_:
                    line = line.lstrip("﻿")
                if i in quoting:
                    inside = ends_inside(line, delimiter, inside)
                open_.append(line)
                if inside:
                    continue
                record, open_ = "\n".join(open_), []
                if ahead:  # the end of a record that began in a split before
                    rows.append((number << 33, owner, False, record))
                    ahead = False
                elif not _is_blank(record, delimiter):
                    rows.append((number << 33 | nth, number, True, record))
                    nth += 1
            yield batch(rows)
        yield batch(rest())

    where = scratch_path(spark, "records")
    lines.mapInArrow(cut, "line long, owner long, whole boolean, record string").write.parquet(where)
    pieces = spark.read.parquet(where)
    # At most two pieces a split: what is open at its end and what closes at its start.
    parts = F.array_sort(F.collect_list(F.struct(F.shiftright("line", 33).alias("split"), "record")))
    stitched = pieces.filter("NOT whole").groupBy("owner").agg(
        F.max(F.when(F.shiftright("line", 33) == F.col("owner"), F.col("line"))).alias("line"), F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record")
    )
    return pieces.filter("whole").select("line", "record").unionByName(stitched.select("line", "record"))

