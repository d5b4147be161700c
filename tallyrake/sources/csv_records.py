"""CSV records from blocks of files: quoted line breaks, doubled quotes, any line ends.

Spark deals files in blocks and cuts them into lines, but a line break inside quotes is no
record end, and whether a block begins inside quotes is only known from all blocks before it.

1. *States*: a task reads its blocks line by line and finds, for both possible states at the
   block's start (outside or inside a quoted field), the state at its end; that is one row per
   block, with the header if it is a file's first block.  A quote opens a field only at the
   field's start, and a doubled quote closes none.
2. The states are put together along each file by window sums over the block rows: a block
   either fixes its end state, keeps or turns it.  A file that ends inside quotes is an error.
3. *Records*: with its state known, every block gives the records that begin in it.  A record
   that runs past its block is put together in a second, small step from the ends of that block
   and the beginnings of the following ones.

Empty and blank lines are skipped; a byte order mark goes; a lone
carriage return ends a record as well; equal
header names get ``.1``, ``.2``; empty files have no records.  Nothing is collected per file or
block: the driver gets the distinct headers' names and one number of blocks.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000           # block states sent to the tasks; beyond that lines are shuffled
BLOCK_SCHEMA = "file string, block long, outside boolean, inside boolean, header array<string>, headed boolean"
RECORD_SCHEMA = "file string, block long, place long, kind string, fields array<string>, body string"
_OPEN = re.compile(r'[,\r\n]"')
_RETURNS = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)?")


def inside_after(line: str, inside: bool) -> bool:
    """Whether the line ends inside quotes; ``line`` starts a record unless ``inside``."""
    at = 0
    if not inside:
        m = _OPEN.search(line) if not line.startswith('"') else None
        if m is None and not line.startswith('"'):
            return False
        at = m.end() if m else 1
    while True:
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('"', at + 1):
            at += 2
            continue
        m = _OPEN.search(line, at + 1)
        if m is None:
            return False
        at = m.end()


def parsed(lines: list[str]) -> list[list[str]]:
    """Fields of whole records; empty lines give none."""
    csv.field_size_limit(sys.maxsize)
    pieces = []
    for x in lines:
        pieces += [p for p in _RETURNS.findall(x) if p] if "\r" in x else [x]
    if any(p[0] in " \t" and p.isspace() for p in pieces):
        pieces = _without_blank(pieces)
    return [r for r in csv.reader(pieces) if r]


def _without_blank(pieces):
    inside, out = False, []
    for p in pieces:
        if inside or p.strip(" \t\r\n"):
            out.append(p)
        inside = inside_after(p, inside) if inside or '"' in p else False
    return out


def lines_of(spark: SparkSession, paths) -> DataFrame:
    """``(file, block, value)``: lines in their order within each block, break included."""
    return (spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").text(paths)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.coalesce("value", F.lit("")).alias("value")))


def _runs(batch):
    """(file, block, lines) of neighbouring rows of one block."""
    files, blocks, lines = batch.column(0), np.asarray(batch.column(1)), batch.column(2).to_pylist()
    codes = np.asarray(files.dictionary_encode().indices)
    cut = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])])) if len(codes) else []
    for i, j in zip(cut, [*cut[1:], len(codes)]):
        yield files[int(i)].as_py(), int(blocks[i]), lines[i:j]


def _block_states(clean: Callable[[str], str]):
    def run(batches):
        now, ends, head, header = None, [False, True], [], None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([ends[0]]), pa.array([ends[1]]),
                 pa.array([header], pa.list_(pa.string())), pa.array([now[1] == 0])], [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])
        for batch in batches:
            for file, block, lines in _runs(batch):
                if (file, block) != now:
                    if now is not None:
                        yield out()
                    now, ends, head, header = (file, block), [False, True], [], None
                for line in lines:
                    if '"' in line:
                        before = ends[0]
                        ends = [inside_after(line, x) for x in ends] if ends[0] != ends[1] else [inside_after(line, before)] * 2
                    if block == 0 and header is None:
                        head.append(line + "\n")
                        if not ends[0]:
                            got = parsed([head[0].lstrip("\ufeff"), *head[1:]])
                            head = []
                            if got:
                                header = _names(got[0], clean)
        if now is not None:
            yield out()
    return run


def _names(fields: list[str], clean: Callable[[str], str]) -> list[str]:
    out, seen = [], {}
    for i, name in enumerate(fields):
        name = name or f"Unnamed: {i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(clean(f"{name}.{k}" if k else name))
    return out


def _records(first_only: bool):
    """Records that begin in each block; 'tail': the record left open at its end; 'head': lines that
    belong to a record begun in an earlier block (with ``first_only`` only these two)."""
    def run(batches):
        now, inside, open_lines, begun, place, header = None, False, [], True, 0, True
        rows, ready = [], []

        def records():
            nonlocal ready, place, header
            for fields in parsed(ready):
                if header:
                    header = False
                    continue
                rows.append((now[0], now[1], place, "record", fields, None))
                place += 1
            ready = []

        def close():
            nonlocal open_lines
            records()
            if open_lines:
                rows.append((now[0], now[1], place, "tail" if begun else "head", None, "".join(open_lines)))
            open_lines = []

        def out():
            kept = [r for r in rows if not first_only or r[3] != "record"]
            rows.clear()
            if kept:
                files, blocks, places, kinds, fields, body = zip(*kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()),
                     pa.array(kinds, pa.string()), pa.array(fields, pa.list_(pa.string())), pa.array(body, pa.string())],
                    [f.split()[0] for f in RECORD_SCHEMA.split(", ")])
        for batch in batches:
            starts = batch.column(3)
            row = 0
            for file, block, lines in _runs(batch):
                if (file, block) != now:
                    if now is not None:
                        close()
                    now, place, header = (file, block), 0, block == 0
                    inside = bool(starts[row].as_py())
                    begun = not inside
                    if block == 0 and lines:
                        lines = [lines[0].lstrip("\ufeff"), *lines[1:]]
                row += len(lines)
                for line in lines:
                    if not inside and '"' not in line:
                        ready.append(line + "\n")
                        continue
                    open_lines.append(line + "\n")
                    inside = inside_after(line, inside)
                    if not inside:
                        if begun:
                            ready += open_lines
                        else:
                            rows.append((file, block, -1, "head", None, "".join(open_lines)))
                            begun = True
                        open_lines = []
                records()
            yield from out()
        if now is not None:
            close()
            yield from out()
    return run


def block_states(lines: DataFrame, clean: Callable[[str], str]) -> DataFrame:
    """``(file, block, start_inside, end_inside, header)`` of every block."""
    got = lines.mapInArrow(_block_states(clean), BLOCK_SCHEMA)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed, turns = F.col("outside") == F.col("inside"), (F.col("outside") & ~F.col("inside")).cast("int")
    marks = (got.withColumn("turns", F.sum(turns).over(here))
             .withColumn("fixed", F.when(fixed, F.struct(F.col("outside").cast("int").alias("state"), "turns"))))

    def state(w, now):
        last = F.last("fixed", ignorenulls=True).over(w)
        return F.pmod(F.coalesce(last["state"], F.lit(0)) + F.coalesce(now, F.lit(0)) - F.coalesce(last["turns"], F.lit(0)), F.lit(2)) == 1
    return marks.select("file", "block", state(before, F.max("turns").over(before)).alias("start_inside"),
                        state(here, F.col("turns")).alias("end_inside"),
                        F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))).alias("from_end"), "header")


def csv_records(spark: SparkSession, paths, clean: Callable[[str], str] = str) -> tuple[DataFrame, DataFrame]:
    """(records ``(file, block, place, fields)``, headers ``(file, header)``) of all files under ``paths``."""
    from tallyrake.session import cut_lineage
    lines = lines_of(spark, paths)
    states = cut_lineage(block_states(lines, clean))
    torn = states.filter("from_end = 1 and end_inside").select("file").limit(5).collect()
    if torn:
        raise ValueError(f"a quoted field is never closed in {[r[0] for r in torn]}")
    headers = states.filter("header is not null").select("file", "header")
    begun = states.filter("start_inside").select("file", "block", F.lit(True).alias("start_inside"))
    some = begun.limit(BROADCAST_ROWS + 1).count()

    def read(frame, first_only):
        if some <= BROADCAST_ROWS:
            told = frame.join(F.broadcast(begun), ["file", "block"], "left")
        else:                             # too many to send: deal lines by block, in their order
            told = (frame.withColumn("at", F.monotonically_increasing_id()).join(begun, ["file", "block"], "left")
                    .repartition("file", "block").sortWithinPartitions("file", "block", "at"))
        return told.select("file", "block", "value", "start_inside").mapInArrow(_records(first_only), RECORD_SCHEMA)
    whole = read(lines, False).filter("kind = 'record'").select("file", "block", "place", "fields")
    if not some:
        return whole, headers
    # only files with a record across blocks are read for its pieces
    over = read(lines.join(begun.select("file").distinct(), "file", "left_semi"), True) if some > BROADCAST_ROWS else read(
        lines.join(F.broadcast(begun.select("file").distinct()), "file", "left_semi"), True)
    owner = F.last(F.when(F.col("kind") == "tail", F.struct("block", "place")), ignorenulls=True).over(
        Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == "tail", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0))
    joined = (over.withColumn("owner", owner).groupBy("file", "owner")
              .agg(F.array_sort(F.collect_list(F.struct("block", "body"))).alias("pieces"))
              .select("file", F.col("owner.block").alias("block"), F.col("owner.place").alias("place"),
                      F.array_join(F.col("pieces.body"), "").alias("body"))
              .mapInArrow(_stitched, "file string, block long, place long, fields array<string>"))
    return whole.unionByName(joined), headers


def _stitched(batches):
    for batch in batches:
        rows = [(f, b, p, r) for f, b, p, body in zip(*(c.to_pylist() for c in batch.columns)) for r in parsed([body])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["file", "block", "place", "fields"])
