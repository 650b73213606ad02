"""CSV records with quoted line breaks, read in parallel inside each file.

A file is read as lines, in the ranges that Spark deals to tasks. A range begins at a line, but that line may lie
inside a quoted field, which only the ranges before it can tell. So each range of a divided file is first scanned
from both states (between records, inside quotes); the outcomes, one row for each range, are composed along the
file; and then every range is parsed from its true state at once. What a border cuts, two pieces or more of one
record, is put together and parsed by itself. Files that fit one range need neither scan.

A quote opens a field only where a field begins; doubled quotes stand for one. Records of more fields than the header
are bad and dropped, as are those that are no CSV; missing fields are null, and so is an empty one.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Records of an output batch.
BATCH = 10_000
_LIMIT = (1 << 31) - 1


def after_line(line: str, inside: bool) -> bool:
    """Whether a line that begins inside quotes or between fields ends inside quotes."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside and line[at : at + 1] == '"':
            inside, at = True, at + 1
        while inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
            else:
                inside, at = False, at + 1
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1
        if at >= n:
            return False


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[str]]]:
    """The ranges of a task, one after the other: their first row's other columns, and their lines (to be used up
    before the next range)."""
    rest: list = [None]  # what the last range has not taken: a batch and its first free row

    def pieces() -> Iterator[tuple[pa.RecordBatch, int, int]]:
        """Stretches of rows of one range."""
        for batch in batches:
            if not batch.num_rows:
                continue
            path, at = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((path[1:] != path[:-1]) | (at[1:] != at[:-1])) + 1
            ends = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(ends, ends[1:], strict=False):
                yield batch, lo, hi

    stretches = pieces()
    rest[0] = next(stretches, None)
    while rest[0] is not None:
        batch, lo, _ = rest[0]
        head = {name: batch.column(i)[lo].as_py() for i, name in enumerate(batch.schema.names) if name != "value"}
        key = (head["path"], head["at"])

        def lines(key: tuple = key) -> Iterator[str]:
            while rest[0] is not None:
                batch, lo, hi = rest[0]
                if (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py()) != key:
                    return
                values = batch.column(2).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                rest[0] = next(stretches, None)
                for v in values:
                    yield v.decode("utf-8", "replace") + "\n"

        taken = lines()
        yield head, taken
        for _ in taken:  # a range that was not read to its end
            pass


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: is it inside quotes at its end, if it begins between records, and if it begins inside?"""
    rows = []
    for head, lines in _ranges(batches):
        between, inside = False, True
        for line in lines:
            between = after_line(line, between)
            inside = after_line(line, inside)
        rows.append((head["path"], head["at"], between, inside))
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.bool_())], names=["path", "at", "between", "inside"])


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: the text up to the end of the record that was begun before it, and the text of the record that
    is not at its end when the range is."""
    out = []
    for head, lines in _ranges(batches):
        inside = head["inside"]
        first, last, done = [], [], not inside
        for line in lines:
            inside = after_line(line, inside)
            if not done:
                first.append(line)
                done = not inside
                continue
            last.append(line)
            if not inside:
                last = []
        if first:
            out.append((head["path"], head["at"], "".join(first), False))
        if last:
            out.append((head["path"], head["at"], "".join(last), True))
    cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], names=["path", "at", "text", "begins"])


def _parse(wanted: list[str]):
    """Records of each range as the wanted columns, with the file and whether they are bad."""
    keys = [w.lower() for w in wanted]

    def batch_of(rows: list[list], paths: list[str], bad: list[bool]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(wanted)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(paths, pa.string()), pa.array(bad, pa.bool_())], names=[*(f"c{i}" for i in range(len(wanted))), "path", "bad"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(_LIMIT)
        rows, paths, bad = [], [], []
        for head, lines in _ranges(batches):
            if head["inside"]:
                for line in lines:
                    if not after_line(line, True):
                        break
            names = head["names"]
            state = [False]

            def whole(lines: Iterator[str] = lines, state: list = state) -> Iterator[str]:
                """The lines; state tells whether the last one handed on leaves a field open."""
                for line in lines:
                    state[0] = after_line(line, state[0])
                    yield line

            reader = csv.reader(whole())
            while True:
                try:
                    fields = next(reader, None)
                except csv.Error:
                    rows.append([None] * len(wanted))
                    paths.append(head["path"])
                    bad.append(True)
                    continue
                if fields is None or (state[0] and head["cut"]):
                    break  # what the range's end cuts is parsed elsewhere
                if not fields:
                    continue
                if names is None:
                    names = fields
                    continue
                if len(fields) > len(names):
                    rows.append([None] * len(wanted))
                    bad.append(True)
                else:
                    place = _places(names, keys)
                    rows.append([(fields[i] or None) if i is not None and i < len(fields) else None for i in place])
                    bad.append(False)
                paths.append(head["path"])
                if len(rows) >= BATCH:
                    yield batch_of(rows, paths, bad)
                    rows, paths, bad = [], [], []
        yield batch_of(rows, paths, bad)

    return run


_known: dict[tuple, list[int | None]] = {}


def _places(names: list[str], keys: list[str]) -> list[int | None]:
    """Where each wanted column stands in a header: the first column of its name, whatever case or white space."""
    key = (tuple(names), tuple(keys))
    if key not in _known:
        if len(_known) > 1000:
            _known.clear()
        clean = [n.lstrip("\ufeff").strip().lower() for n in names]
        _known[key] = [clean.index(k) if k in clean else None for k in keys]
    return _known[key]


def _header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record of each file, from its first range."""
    paths, names = [], []
    for head, lines in _ranges(batches):
        fields = next((f for f in csv.reader(lines) if f), None)
        if fields:
            paths.append(head["path"])
            names.append(fields)
    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.list_(pa.string()))], names=["path", "names"])


def _may_be_divided(spark: SparkSession, paths: list[str]) -> bool:
    """Whether any file is larger than what Spark never divides; lists the files, reads none."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    least = min(as_bytes(spark.conf.get(f"spark.sql.files.{c}")) for c in ("openCostInBytes", "maxPartitionBytes"))
    largest = spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0]
    return (largest or 0) > least


def records(spark: SparkSession, paths: list[str], wanted: list[str]) -> DataFrame:
    """(c0.. in the order of `wanted`, path, bad), all strings, of every record of CSV files with headers.

    Ranges of divided files meet a broadcast row each: the file's path, its header and a state, some hundred bytes
    for a range of spark.sql.files.maxPartitionBytes."""
    meta = "_metadata"
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(F.col(f"{meta}.file_path").alias("path"), F.col(f"{meta}.file_block_start").alias("at"), "value", (F.col(f"{meta}.file_block_length") < F.col(f"{meta}.file_size")).alias("cut"))
    parsed = ", ".join([*(f"c{i} string" for i in range(len(wanted))), "path string", "bad boolean"])
    divided = lines.filter("cut")
    scanned = divided.select("path", "at", "value").mapInArrow(_scan, "path string, at long, between boolean, inside boolean")
    along = Window.partitionBy("path").orderBy("at")
    # a range that ends alike from both states settles all before it; the others keep the state or turn it
    ends = scanned.select("path", "at", "between", F.when(F.col("between") == F.col("inside"), F.col("between")).alias("settled"), (F.col("between") & ~F.col("inside")).cast("int").alias("turns"))
    ends = ends.withColumn("since", F.count("settled").over(along))
    within = Window.partitionBy("path", "since").orderBy("at")
    base = F.coalesce(F.first("settled").over(within), F.lit(False)).cast("int")
    turns = F.sum(F.when(F.col("settled").isNull(), F.col("turns")).otherwise(0)).over(within)
    ends = ends.withColumn("end_inside", (base + turns) % 2 == 1)
    states = ends.select("path", "at", F.coalesce(F.lag("end_inside").over(along), F.lit(False)).alias("inside"))
    heads = divided.filter("at = 0").select("path", "at", "value").mapInArrow(_header, "path string, names array<string>")
    states = cut(states.join(heads, "path", "left")) if _may_be_divided(spark, paths) else None
    if states is None or states.isEmpty():
        whole = lines.select("path", "at", "value", F.lit(False).alias("inside"), F.lit(None).cast("array<string>").alias("names"), F.lit(False).alias("cut"))
        return whole.mapInArrow(_parse(wanted), parsed)

    states = F.broadcast(states)
    known = lines.join(states, ["path", "at"], "left").select("path", "at", "value", F.coalesce("inside", F.lit(False)).alias("inside"), F.when(F.col("at") > 0, F.col("names")).alias("names"), "cut")
    out = known.mapInArrow(_parse(wanted), parsed)

    pieces = known.filter("cut").select("path", "at", "value", "inside").mapInArrow(_cut_pieces, "path string, at long, text string, begins boolean")
    order = Window.partitionBy("path").orderBy("at", "begins")
    pieces = pieces.withColumn("record", F.sum(F.col("begins").cast("int")).over(order))
    joined = pieces.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"), F.max("begins").alias("begun")).filter("begun")
    text = F.array_join(F.transform("p", lambda p: p.text), "")
    # each is a range of its own, of one line that holds its breaks
    mended = joined.select("path", F.col("record").cast("long").alias("at"), F.rtrim(text, F.lit("\n")).alias("value"), F.lit(False).alias("inside"), F.lit(False).alias("cut"))
    mended = mended.join(heads, "path").select("path", "at", "value", "inside", "names", "cut")
    return out.unionByName(mended.mapInArrow(_parse(wanted), parsed))
