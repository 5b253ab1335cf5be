"""CSV records whose cells hold line breaks, from files that are split over many tasks.

Whether a line starts a record depends on all quotes before it. For a line, and so for a run of
lines, that is a map of two states (outside or inside a quoted cell) to two states. Each split gives
its map, a running composition over the splits of a file (a row per batch of lines) gives the state in which
each split starts, and each task then joins its lines to records by itself. Only records that cross
the border of a split, at most one per border, are stitched by a grouping.

Lines end with LF or CR LF. A quote opens a cell only at its start, and a doubled quote stands for
itself; text after a closing quote belongs to the cell up to the next comma.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .table import SMALL_FILES, _stage, small_frame

WHOLE, REST, OPEN = 0, 1, 2  # a record, the end or middle of one begun in an earlier split, its beginning
BATCH_BYTES = 8 << 20        # of records in one output batch, about
_SPLIT = "file string, start bigint"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts outside or inside a quoted cell ends inside one."""
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        inside = False
        quote = line.find('"', at)
        while quote >= 0 and line[quote + 1:quote + 2] == '"':
            quote = line.find('"', quote + 2)
        if quote < 0:
            return True
        at = line.find(",", quote + 1) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    value = F.col("value")
    text = F.when(value.startswith("﻿"), F.substring(value, 2, 2 ** 31 - 1)).otherwise(value)
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), text.alias("value"))


def _runs(batch):
    """(file, start, rows) of each split in a batch; rows of one split lie together."""
    file, start = batch.column("file"), batch.column("start")
    n = batch.num_rows
    if not n:
        return
    moved = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(start.slice(1), start.slice(0, n - 1)))
    edges = [0, *(np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for low, high in zip(edges, edges[1:]):
        yield file[low].as_py(), start[low].as_py(), batch.slice(low, high - low)


def _maps(batches):
    """One row per split and batch: the state after its lines if they start outside, and if inside."""
    for i, batch in enumerate(batches):
        rows = []
        for file, start, run in _runs(batch):
            value, after = run.column("value"), (False, True)
            for line in value.filter(pc.match_substring(value, '"')).to_pylist():  # others change nothing
                after = tuple(ends_inside(line, s) for s in after)
            rows.append((file, start, i, *after))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["file", "start", "part", "outside", "inside"])


def _pieces(batches):
    """Records of each split and the parts that cross its borders, in order; empty lines are no records."""
    split, inside, at, kind, held = None, False, 0, WHOLE, []
    out, size = [], 0

    def close(kind):
        nonlocal at, held, size
        text = "\n".join(held)
        held = []
        if kind != OPEN and text.endswith("\r"):
            text = text[:-1]
        if text or kind == REST:
            out.append({"file": split[0], "start": split[1], "at": at, "kind": kind, "text": text})
            size += len(text)
            at += kind != REST

    for batch in batches:
        for file, start, opened, value in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "open", "value"))):
            if (file, start) != split:
                if held:
                    close(REST if kind == REST else OPEN)
                split, inside, at = (file, start), opened, 0
                kind = REST if opened else WHOLE
            held.append(value)
            if '"' in value:
                inside = ends_inside(value, inside)
            if not inside:
                close(kind)
                kind = WHOLE
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(out, _PIECES)
                out, size = [], 0
    if held:
        close(REST if kind == REST else OPEN)
    if out:
        yield pa.RecordBatch.from_pylist(out, _PIECES)


_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def _with_split_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of each split beside its rows: broadcast if there are at most SMALL_FILES splits. Beyond
    that the rows move by split and keep their order by ``seq``."""
    few = [tuple(r) for r in facts.limit(SMALL_FILES + 1).collect()]
    if len(few) <= SMALL_FILES:
        return rows.join(F.broadcast(small_frame(rows.sparkSession, few, facts.schema.simpleString()[7:-1])), ["file", "start"])
    joined = rows.join(facts, ["file", "start"])
    return joined.sortWithinPartitions("file", "start", "seq") if "seq" in rows.columns else joined


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, open): whether a split starts inside a quoted cell.

    A split's map sets the state, keeps it or turns it: the state is the last one set, turned as
    often as since.
    """
    maps = lines.mapInArrow(_maps, f"{_SPLIT}, part bigint, outside boolean, inside boolean")
    upto = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(upto)
    turned = maps.withColumn("turns", turns)
    fixed = F.when(F.col("outside") == F.col("inside"), (F.col("outside").cast("int") + F.col("turns")) % 2)
    state = (F.coalesce(F.last(fixed, ignorenulls=True).over(upto), F.lit(0)) + F.col("turns")) % 2
    in_order = Window.partitionBy("file").orderBy("start", "part")
    before = F.coalesce(F.lag("after").over(in_order), F.lit(0)) == 1
    return turned.withColumn("after", state).withColumn("open", before).groupBy("file", "start").agg(
        F.min_by("open", "part").alias("open"))


def csv_records(spark: SparkSession, path: str, paths: list) -> DataFrame:
    """(row_id, text): the records of CSV files without their headers, numbered by file and place.

    ``paths`` gets the folder in which the pieces are staged.
    """
    lines = _lines(spark, path)
    opened = _with_split_facts(lines.withColumn("seq", F.monotonically_increasing_id()), split_states(lines))
    pieces, folder = _stage(opened.select("file", "start", "open", "value").mapInArrow(
        _pieces, f"{_SPLIT}, at bigint, kind int, text string"), "records")
    paths.append(folder)

    # Parts of one record follow its beginning: at most two rows per split here.
    crossing = pieces.where(F.col("kind") != WHOLE)
    upto = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(F.col("kind") == OPEN, F.struct("start", "at")), ignorenulls=True).over(upto)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), "text")))
    stitched = crossing.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.array_join(F.transform(ordered, lambda e: e["text"]), "\n").alias("text")).select(
        "file", "begun.start", "begun.at", "text")
    records = pieces.where(F.col("kind") == WHOLE).select("file", "start", "at", "text").unionByName(stitched)

    counts = pieces.groupBy("file", "start").agg(F.count_if(F.col("kind") != REST).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("place", F.coalesce(F.sum("n").over(before), F.lit(0)))
    files = counts.groupBy("file").agg((F.sum("n") - 1).alias("rows"))  # without the header
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    facts = places.join(offsets, "file").select("file", "start", "place", "offset")
    numbered = _with_split_facts(records, facts)
    at = F.col("place") + F.col("at")
    return numbered.where(at > 0).select((F.col("offset") + at - 1).alias("row_id"), "text")
