"""Delimited and line files as records ``path, row, start, end, bytes``.

A file is cut into blocks. A first pass finds each block's outcome for every state
the scanner may start in; composing these (a few numbers per block) gives each block
its state and first row, so a second pass emits all records of all blocks side by
side, whatever quotes do. A record belongs to the block in which it starts.

Files are opened by workers: paths must be visible to all of them (a shared mount).
A fingerprint taken at planning is compared in every read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowatlas.sources.formats import Fingerprint, check_path, infer_format, verify
from rowatlas.sources.scanner import CSV, LINES, QUOTED, RECORD, TSV, Dialect, Scanner, outcome, plain_block

BLOCK_BYTES = 32 << 20
_RECORDS = pa.schema([("path", pa.string()), ("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary())])
RECORDS = "path string, row long, start long, end long, bytes binary"
_BATCH_BYTES = 8 << 20


def dialect_of(path: str) -> Dialect:
    kind = infer_format(path)
    if kind == "xlsx":
        raise ValueError("a workbook has no records of bytes")
    return {"csv": CSV, "tsv": TSV, "lines": LINES}[kind]


def _outcomes(dialect: Dialect):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                verify(r["path"], Fingerprint(r["size"], r["identity"], r["revision"]))
                with open(r["path"], "rb") as f:
                    f.seek(r["at"])
                    o = outcome(f.read(r["length"]), dialect)
                rows.append({"path": r["path"], "at": r["at"], "states": list(o.states), "starts": list(o.starts)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("at", pa.int64()), ("states", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64()))]))

    return run


def block_records(path: str, at: int, length: int, state: int, row: int, dialect: Dialect) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, start, end, bytes) of the records that start in a block; the last may reach into later ones."""
    scanner = Scanner(dialect)
    with open(path, "rb") as f:
        f.seek(at)
        data, base = f.read(length), at
        opened: list[int] = []
        ends: list[int] = []
        if plain := plain_block(data, state, dialect):
            opened, closed, state = (plain[0] + base).tolist(), plain[1], plain[2]
            ends = (closed[closed >= plain[0][0]] + base).tolist() if opened else []
        else:
            state, _ = scanner.scan(data, state, lambda k: opened.append(base + k), lambda k: ends.append(base + k) if opened else None)
        for k, (s, e) in enumerate(zip(opened, ends, strict=False)):
            yield row + k, s, e, data[s - base : e - base]
        if len(opened) > len(ends):
            s, parts = opened[-1], [data[opened[-1] - base :]]
            found: list[int] = []

            def stop(k: int) -> bool:
                found.append(k)
                return False

            while not found and (more := f.read(1 << 20)):
                state, _ = scanner.scan(more, state, lambda k: None, stop)
                parts.append(more[: found[0]] if found else more)
            raw = b"".join(parts)
            yield row + len(opened) - 1, s, s + len(raw), raw


def file_records(path: str, size: int, dialect: Dialect, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, start, end, bytes) of all records of a file, block by block."""
    state, row = RECORD, 0
    for at in range(0, size, block_bytes):
        yield from block_records(path, at, min(block_bytes, size - at), state, row, dialect)
        with open(path, "rb") as f:
            f.seek(at)
            state, starts = _after(f.read(block_bytes), state, dialect)
        row += starts


def _after(data: bytes, state: int, dialect: Dialect) -> tuple[int, int]:
    """State after a block, and the records that start in it."""
    if plain := plain_block(data, state, dialect):
        return plain[2], len(plain[0])
    seen = [0]

    def start(_: int) -> None:
        seen[0] += 1

    return Scanner(dialect).scan(data, state, start, lambda _: None)[0], seen[0]


def first_records(path: str, count: int, dialect: Dialect | None = None) -> list[tuple[int, int, int, bytes]]:
    """The first records of a file, before the rest of it is read: for the first window of a document."""
    check_path(path)
    return list(islice(file_records(path, Fingerprint.of(path).size, dialect or dialect_of(path), 1 << 20), count))


def _emit(rows: Iterator[tuple[int, int, int, bytes]], path: str) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[3]) + 64
        if size > _BATCH_BYTES:
            yield _batch(held, path)
            held, size = [], 0
    if held:
        yield _batch(held, path)


def _batch(rows: list[tuple[int, int, int, bytes]], path: str) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c, t) for c, t in zip(columns, _RECORDS.types[1:], strict=True))], schema=_RECORDS)


def _reading(dialect: Dialect):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                before = Fingerprint(r["size"], r["identity"], r["revision"])
                verify(r["path"], before)
                yield from _emit(block_records(r["path"], r["at"], r["length"], r["state"], r["row"], dialect), r["path"])
                verify(r["path"], before)

    return run


def plan_blocks(spark: SparkSession, path: str, dialect: Dialect, block_bytes: int = BLOCK_BYTES) -> tuple[list[dict], int, tuple[str, int, int] | None]:
    """Blocks with their state and first row, the number of rows, and what is wrong at the end."""
    check_path(path)
    before = Fingerprint.of(path)
    blocks = [{"path": path, "at": at, "length": min(block_bytes, before.size - at), **asdict(before)} for at in range(0, before.size, block_bytes)]
    if not blocks:
        return [], 0, None
    schema = "path string, at long, length long, size long, identity string, revision string"
    cut = spark.createDataFrame(blocks, schema).repartition(len(blocks))
    seen = {r["at"]: r for r in cut.mapInArrow(_outcomes(dialect), "path string, at long, states array<int>, starts array<long>").collect()}  # one small row per block
    state, row = RECORD, 0
    for b in blocks:
        b["state"], b["row"] = state, row
        r = seen[b["at"]]
        state, row = r["states"][state], row + r["starts"][state]
    diagnostic = None
    if state == QUOTED:
        last = max((b for b in blocks if seen[b["at"]]["starts"][b["state"]]), key=lambda b: b["at"])
        start = max(s for _, s, _, _ in block_records(path, last["at"], last["length"], last["state"], last["row"], dialect))
        diagnostic = ("unterminated_quoted_field", before.size, start)
    return blocks, row, diagnostic


def read_records(spark: SparkSession, path: str, dialect: Dialect | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Records of one file, scanned in blocks."""
    dialect = dialect or dialect_of(path)
    blocks, _, _ = plan_blocks(spark, path, dialect, block_bytes)
    if not blocks:
        return spark.createDataFrame([], RECORDS)
    schema = "path string, at long, length long, size long, identity string, revision string, state int, row long"
    return spark.createDataFrame(blocks, schema).repartition(len(blocks)).mapInArrow(_reading(dialect), RECORDS)


def diagnostic(spark: SparkSession, path: str, dialect: Dialect | None = None) -> tuple[str, int, int] | None:
    """(kind, offset of the end, start of the record) if a quoted field is never closed."""
    return plan_blocks(spark, path, dialect or dialect_of(path))[2]


class _FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.dialect = None
        if "delimiter" in options or "quote" in options:
            self.dialect = Dialect(ord(options.get("delimiter", ",")), ord(options.get("quote", '"')))
        elif "dialect" in options:
            self.dialect = {"csv": CSV, "tsv": TSV, "lines": LINES}[options["dialect"]]
        for p in self.paths:
            check_path(p)
        self.known = {p: Fingerprint.of(p) for p in self.paths}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = partition.value
        verify(path, self.known[path])
        yield from _emit(file_records(path, self.known[path].size, self.dialect or dialect_of(path)), path)
        verify(path, self.known[path])


class RowDocument(DataSource):
    """``spark.read.format("rowdocument").load(path)``: a task for each file, which reads it in blocks. Options: ``dialect`` (csv, tsv, lines), or ``delimiter`` and ``quote``; else by suffix."""

    @classmethod
    def name(cls) -> str:
        return "rowdocument"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RowDocument)
