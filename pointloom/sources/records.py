"""Large single files in parallel: readers that plan byte ranges, and writers that put every record at its own offset.

Workers reach files through pyarrow's file systems (local and mounted paths, and the stores that it knows by URI).
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pointloom.operators import scan

#: Bytes of a file that a task reads, and bytes that it holds at once.
RANGE_BYTES, HELD_BYTES = 64 << 20, 8 << 20
_SQL = {"i1": "tinyint", "u1": "smallint", "i2": "smallint", "u2": "int", "i4": "int", "u4": "bigint", "i8": "bigint", "f4": "float", "f8": "double"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def beginning(path: str, size: int) -> bytes:
    system, at = located(path)
    with system.open_input_file(at) as f:
        return f.read(size)


def length(path: str) -> int:
    system, at = located(path)
    return system.get_file_info(at).size


def in_reach(path: str) -> bool:
    """Whether path is one file (or several without a pattern in the name) that pyarrow can open."""
    if any(c in path for c in "*?[{"):
        return False
    try:
        system, at = located(path)
        return system.get_file_info(at).type == fs.FileType.File
    except (OSError, pa.ArrowInvalid, ImportError):
        return False


class _Range(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        super().__init__((first, count))
        self.first, self.count = first, count


class FixedRecords(DataSource):
    """Records of one length behind a header: (row, columns...). Options: path, offset, count, dtype (numpy's, as JSON), and columns,
    those of them that are wanted, so that the others are never unpacked."""

    @classmethod
    def name(cls) -> str:
        return "pointloom_records"

    def dtype(self) -> np.dtype:
        return np.dtype([(n, k) for n, k in json.loads(self.options["dtype"])])

    def wanted(self) -> list[str]:
        return json.loads(self.options["columns"]) if "columns" in self.options else list(self.dtype().names)

    def schema(self) -> str:
        return "row bigint" + "".join(f", `{c}` {_SQL[self.dtype()[c].str[1:]]}" for c in self.wanted())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FixedReader(self.options["path"], int(self.options["offset"]), int(self.options["count"]), self.dtype(), self.wanted(), int(self.options.get("rangeBytes", RANGE_BYTES)))


class _FixedReader(DataSourceReader):
    def __init__(self, path: str, offset: int, count: int, dtype: np.dtype, wanted: list[str], size: int) -> None:
        self.path, self.offset, self.count, self.dtype, self.wanted, self.size = path, offset, count, dtype, wanted, size

    def partitions(self) -> list[InputPartition]:
        rows = max(1, self.size // self.dtype.itemsize)
        return [_Range(a, min(rows, self.count - a)) for a in range(0, self.count, rows)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        held = max(1, HELD_BYTES // self.dtype.itemsize)
        system, at = located(self.path)
        with system.open_input_file(at) as f:
            for a in range(partition.first, partition.first + partition.count, held):
                n = min(held, partition.first + partition.count - a)
                data = f.read_at(n * self.dtype.itemsize, self.offset + a * self.dtype.itemsize)
                if len(data) < n * self.dtype.itemsize:
                    raise EOFError(f"{self.path} ends before record {a + n}")
                block = np.frombuffer(data, self.dtype)
                wide = {"u1": np.int16, "u2": np.int32, "u4": np.int64}
                columns = [np.ascontiguousarray(block[c]).astype(wide.get(self.dtype[c].str[1:], block[c].dtype)) for c in self.wanted]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), *map(pa.array, columns)], ["row", *self.wanted])


def read_fixed(spark: SparkSession, path: str, offset: int, count: int, dtype: list[tuple[str, str]], columns: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(FixedRecords)
    reader = spark.read.format("pointloom_records").option("path", path).option("offset", offset).option("count", count).option("dtype", json.dumps(dtype)).option("rangeBytes", range_bytes)
    return (reader.option("columns", json.dumps(columns)) if columns is not None else reader).load()


def read_indexed(spark: SparkSession, path: str, start: int, count: int, size_at: Callable, parse: Callable[[bytes], tuple], schema: str, range_bytes: int = RANGE_BYTES, number: str | None = None) -> DataFrame:
    """Records of various lengths. size_at(view, at): the length of the record at `at` of the view, or -1 if the view ends before it does.

    One task walks over the records' lengths and keeps where every range begins, holding HELD_BYTES of the file or one record;
    the ranges are then parsed side by side. `number` names a column for the records' places.
    """
    schema = f"{number} bigint, {schema}" if number else schema

    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    names, kinds = fields.names, fields.types

    def index(batches) -> Iterator[pa.RecordBatch]:
        system, where = located(path)
        for _ in batches:
            with system.open_input_file(where) as f:
                at, begun, hold, marks, firsts = start, start, HELD_BYTES, [start], [0]
                data, base, left = b"", start, count
                while left:
                    n = size_at(data, at - base)
                    if n < 0:
                        hold = HELD_BYTES if at > base or not data else hold * 2
                        data, base = f.read_at(hold, at), at
                        if size_at(data, 0) < 0 and len(data) < hold:
                            raise EOFError(f"{path} ends within a record")
                        continue
                    at, left = at + n, left - 1
                    if at - begun >= range_bytes:
                        marks.append(at)
                        firsts.append(count - left)
                        begun = at
                ends = [*marks[1:], at]
            yield pa.RecordBatch.from_pydict({"begin": pa.array(marks, pa.int64()), "end": pa.array(ends, pa.int64()), "first": pa.array(firsts, pa.int64())})

    def rows(batches) -> Iterator[pa.RecordBatch]:
        system, where = located(path)
        for b in batches:
            for begin, end, n_th in zip(*[b.column(c).to_pylist() for c in ("begin", "end", "first")], strict=True):
                with system.open_input_file(where) as f:
                    at, hold = begin, HELD_BYTES
                    while at < end:
                        data, inside, out = f.read_at(min(hold, end - at), at), 0, []
                        while (n := size_at(data, inside) if inside < len(data) else -1) >= 0:
                            row = parse(data[inside : inside + n])
                            out.append((n_th, *row) if number else row)
                            n_th += 1
                            inside += n
                        hold = HELD_BYTES if inside else hold * 2
                        at += inside
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ranges = spark.range(1, numPartitions=1).mapInArrow(index, "begin long, end long, first long")
    spread = ranges.repartition(max(1, min(4096, -(-length(path) // range_bytes))), F.xxhash64("begin"))
    return spread.mapInArrow(rows, schema)


def paired_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(head, tail) of a text of pairs of lines: comments are left out, as are empty lines where a head is expected; a tail may be empty.

    Whether a line is a head depends on all before it, so each range says for both cases where it leaves off, and those are chained;
    then the ranges are read side by side. A range has the lines that begin in it.
    """
    size = length(path)
    begins = list(range(0, max(size, 1), range_bytes))
    table = spark.createDataFrame([(b,) for b in begins], "begin long").repartition(min(len(begins), 4096), "begin")

    def lines(f, begin: int) -> Iterator[bytes]:
        """The lines that begin in the range, each with what ends it."""
        at, held, place = begin, b"", 0  # held[place:] are the bytes from `at` on
        if begin:  # a line that goes on from before isn't ours
            at, skip = begin - 1, True
        else:
            skip = False
        while at < begin + range_bytes and at < size:
            cut = held.find(b"\n", place)
            if cut < 0:
                more = f.read_at(HELD_BYTES, at + len(held) - place)
                held, place = held[place:] + more, 0
                if more:
                    continue
                cut = len(held) - 1
            if not skip:
                yield held[place : cut + 1]
            at, place, skip = at + cut + 1 - place, cut + 1, False

    def step(expects: int, line: bytes) -> int:
        """0: a head is next, 1: a tail."""
        return expects if line.startswith(b"#") or not expects and not line.strip() else 1 - expects

    def ends(batches) -> Iterator[pa.RecordBatch]:
        system, where = located(path)
        for b in batches:
            with system.open_input_file(where) as f:
                for begin in b.column(0).to_pylist():
                    states = [0, 1]
                    for line in lines(f, begin):
                        states = [step(s, line) for s in states]
                    yield pa.RecordBatch.from_pydict({"begin": [begin], "zero": pa.array([states[0]], pa.int32()), "one": pa.array([states[1]], pa.int32())})

    chained, now = [], 0
    for r in sorted(table.mapInArrow(ends, "begin long, zero int, one int").collect(), key=lambda r: r["begin"]):  # two bits a range
        chained.append((r["begin"], now))
        now = r["one"] if now else r["zero"]

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        system, where = located(path)
        for b in batches:
            with system.open_input_file(where) as f:
                for begin, expects in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    heads, tails, kept = [], [], 0
                    for line in lines(f, begin):
                        before, expects = expects, step(expects, line)
                        if line.startswith(b"#") or before == expects:
                            continue
                        if not before:
                            heads.append(line)
                            kept += len(line)
                        elif heads and len(tails) < len(heads):
                            tails.append(line)
                            kept += len(line)
                            if kept >= HELD_BYTES:
                                yield _batch(heads, tails)
                                heads, tails, kept = [], [], 0
                    if len(tails) < len(heads):  # the tail stands at the next ranges' beginning, or nowhere
                        tails.append(_next_tail(f, begin + range_bytes, range_bytes, size, lines))
                    yield _batch(heads, tails)

    return spark.createDataFrame(chained, "begin long, expects int").repartition(min(len(chained), 4096), "begin").mapInArrow(pairs, "head string, tail string")


def _next_tail(f, begin: int, range_bytes: int, size: int, lines: Callable) -> bytes:
    while begin < size:
        for line in lines(f, begin):
            if not line.startswith(b"#"):
                return line
        begin += range_bytes
    return b""


def _batch(heads: list[bytes], tails: list[bytes]) -> pa.RecordBatch:
    text = lambda xs: pa.array([x.decode().rstrip("\r\n") for x in xs], pa.string())
    return pa.RecordBatch.from_pydict({"head": text(heads), "tail": text(tails)})


def write_records(df: DataFrame, path: str, head: bytes, record: str | Column, order: list[str]) -> None:
    """One file: head, and then every row's record (binary), in the order of `order`, each written by a task at its own offset.

    Rows are put in ranges and their lengths summed up to each, so no task and no driver holds the file. Writing again what was
    written changes nothing, so a task may be repeated. Where a store has no writes at an offset, path becomes a folder with a file per
    range, which in the order of their names are the file.
    """
    rows = df.select(*order, (F.col(record) if isinstance(record, str) else record).alias("_record"))
    parts = scan.ranges(rows, [], order)
    placed = scan.running_sums(parts, [], order, {"_end": F.octet_length("_record").cast("long")})
    total = len(head) + (parts.agg(F.sum(F.octet_length("_record").cast("long"))).first()[0] or 0)
    system, where = located(path)
    single = isinstance(system, fs.LocalFileSystem)
    if single:
        with open(where, "wb") as f:
            f.write(head)
            f.truncate(total)
    else:
        system.create_dir(where)
        with system.open_output_stream(f"{where}/00000-head") as f:
            f.write(head)
    begin = len(head)

    def written(batches) -> Iterator[pa.RecordBatch]:
        if single:
            with open(where, "r+b") as f:
                for b in batches:
                    at, out, next_ = None, io.BytesIO(), None
                    for end, data in zip(b.column("_end").to_pylist(), b.column("_record").to_pylist(), strict=True):
                        first = begin + end - len(data)
                        if first != next_:
                            if at is not None:
                                f.seek(at)
                                f.write(out.getvalue())
                            at, out = first, io.BytesIO()
                        out.write(data)
                        next_ = first + len(data)
                    if at is not None:
                        f.seek(at)
                        f.write(out.getvalue())
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(b)], pa.int64())})
            return
        held, n = {}, 0
        try:
            for b in batches:
                for part, data in zip(b.column(scan.PART).to_pylist(), b.column("_record").to_pylist(), strict=True):
                    if part not in held:
                        held[part] = system.open_output_stream(f"{where}/{part + 1:05d}")
                    held[part].write(data)
                    n += 1
        finally:
            for f in held.values():
                f.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    placed.select(scan.PART, "_end", "_record").sortWithinPartitions(scan.PART, "_end").mapInArrow(written, "n long").agg(F.sum("n")).collect()


def write_rows(df: DataFrame, path: str, head: bytes, encode: Callable, key: str) -> None:
    """write_records of encode(row), a row being a dict of the columns, by key."""

    def records(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({key: b.column(key), "record": pa.array([encode(r) for r in b.to_pylist()], pa.binary())})

    kind = dict(df.dtypes)[key]
    write_records(df.mapInArrow(records, f"`{key}` {kind}, record binary"), path, head, "record", [key])
