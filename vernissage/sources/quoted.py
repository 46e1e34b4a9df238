"""Records of CSV files with quoted line breaks, read by as many tasks as the files have splits.

A split cannot know whether it starts inside a quoted field. So a first pass
tells for each split in which state it ends, for either state it may start in;
folding these along a file fixes where every split starts. A second pass then
cuts each split into its records, and the few records that go on in the next
split are put together from their pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage.session import land

# States of a split go along with its lines by broadcast up to this many splits, and by a join that keeps the order beyond.
BROADCAST_SPLITS = 100_000
# A field is quoted, or does not begin with a quote; quotes further on in it are characters like others.
_FIELD = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
_CLOSED = re.compile(rf"{_FIELD}(?:,{_FIELD})*+", re.DOTALL)
_CLOSING = re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{_FIELD})*+', re.DOTALL)


def open_after(line: str) -> tuple[bool, bool]:
    """Whether a quoted field is open at the end of a line, if it starts outside one and if it starts inside one."""
    return _CLOSED.fullmatch(line) is None, _CLOSING.fullmatch(line) is None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of a batch that belong to one split."""
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (start[1:] != start[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
        if b > a:
            yield file.dictionary[int(code[a])].as_py(), int(start[a]), batch.slice(a, b - a)


def _quoted_lines(lines: pa.Array) -> Iterator[tuple[int, bool, bool]]:
    """(place, open if outside before, open if inside before) of the lines that hold a quote; others change nothing."""
    for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist():
        yield i, *open_after(lines[i].as_py())


def _end_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, outside, inside = None, False, True
    told: list[tuple] = []
    for batch in batches:
        for file, start, lines in _runs(batch):
            if split != (file, start):
                if split:
                    told.append((*split, outside, inside))
                split, outside, inside = (file, start), False, True
            for _, if_outside, if_inside in _quoted_lines(lines.column("value")):
                outside, inside = (if_inside if outside else if_outside), (if_inside if inside else if_outside)
    if split:
        told.append((*split, outside, inside))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        list(zip(*told, strict=True)) or [[]] * 4, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True
    )], names=["file", "start", "outside", "inside"])


def start_states(lines: DataFrame) -> DataFrame:
    """(file, start, open): whether a split starts inside a quoted field.

    One row per split; a file's splits are folded in one row, in the order of their starts.
    """
    ends = lines.mapInArrow(_end_states, "file string, start bigint, outside boolean, inside boolean")
    folded = ends.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "outside", "inside"))).alias("splits"))
    states = F.expr("""aggregate(splits, named_struct('open', false, 'out', cast(array() as array<struct<start:bigint,open:boolean>>)),
        (acc, x) -> named_struct('open', if(acc.open, x.inside, x.outside), 'out', array_append(acc.out, named_struct('start', x.start, 'open', acc.open))),
        acc -> acc.out)""")
    return folded.select("file", F.explode(states).alias("s")).select("file", "s.start", "s.open")


_PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("ends", pa.bool_()), ("begins", pa.bool_()), ("value", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split; `begins` and `ends` are false where a record starts before or goes on after its split.

    The first record of a file is its header and left out.
    """
    split, open_, first = None, False, False
    held: list[str] = []
    begins = True

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PIECES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    for batch in batches:
        for file, start, run in _runs(batch):
            if split != (file, start):
                if held:
                    yield pieces([(*split, False, begins, "\n".join(held))])
                split, held, open_ = (file, start), [], bool(run.column("open")[0].as_py())
                begins, first = not open_, start == 0
            lines = run.column("value")
            after = np.zeros(len(lines), dtype=bool)
            done = 0
            for i, if_outside, if_inside in _quoted_lines(lines):
                after[done:i] = open_
                open_ = if_inside if open_ else if_outside
                after[i], done = open_, i + 1
            after[done:] = open_
            ends = np.flatnonzero(~after) + 1
            if not len(ends):
                held += lines.to_pylist()
                continue
            # The first record may have lines from the batch before; the others are joined at once.
            head = "\n".join(held + lines.slice(0, int(ends[0])).to_pylist())
            if not first:
                yield pieces([(*split, True, begins, head)])
            held, begins, first = lines.slice(int(ends[-1])).to_pylist(), True, False
            if len(ends) > 1:
                own = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lines)
                value, n = pc.binary_join(own, "\n"), len(ends) - 1
                whole = pa.array(np.ones(n, dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), whole, whole, value], schema=_PIECES)
    if held:
        yield pieces([(*split, False, begins, "\n".join(held))])


def read_quoted(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(`value`): every record of CSV files as text, without headers; line breaks inside quoted fields are kept.

    A record belongs to the split it begins in. Files may have any number of
    splits, a quoted field may go on over several; an open quote at the end of
    a file ends its last record there. Blank lines are not records.
    """
    text = spark.read.text(path, lineSep="\n")
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    states = land(start_states(lines), "csv-splits")
    n_splits, n_open = states.agg(F.count(F.lit(1)), F.count_if("open")).first()
    if n_splits <= BROADCAST_SPLITS:
        told = lines.join(F.broadcast(states), ["file", "start"])
    else:
        placed = lines.withColumn("place", F.monotonically_increasing_id())
        told = placed.join(states, ["file", "start"]).sortWithinPartitions("file", "start", "place")
    form = "file string, start bigint, ends boolean, begins boolean, value string"
    cut = told.select("file", "start", "value", "open").mapInArrow(_cut, form)
    if n_open:
        cut = land(cut, "csv-records")
        whole, parts = cut.filter("begins and ends").select("value"), cut.filter("not (begins and ends)")
        # One row per split and side. In the order of starts, what goes on before what begins, a piece
        # that does not begin a record belongs to the last one that does.
        order = F.struct("start", "begins", "ends", "value")
        listed = parts.groupBy("file").agg(F.sort_array(F.collect_list(order)).alias("parts"))
        joined = F.expr("""aggregate(parts, cast(array() as array<array<string>>), (acc, x) -> if(x.begins or size(acc) = 0,
            array_append(acc, array(x.value)), concat(slice(acc, 1, size(acc) - 1), array(array_append(acc[size(acc) - 1], x.value)))))""")
        spanning = listed.select(F.explode(joined).alias("lines")).select(F.array_join("lines", "\n").alias("value"))
        rows = whole.unionByName(spanning)
    else:
        rows = cut.select("value")
    return rows.select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value <> ''")
