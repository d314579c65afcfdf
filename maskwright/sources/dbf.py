"""dBASE/FoxPro tables as a Spark data source: `spark.read.format("dbf").load(folder)` and `df.write.format("dbf")`.

Records have a fixed length, so a table is read in parallel by record ranges. Deleted records are rows with
`_deleted` set; `_physical_index` is a record's place. Paths are of a file system that is mounted on the driver and all executors. Long fields are read from the companion .fpt file. Tables are
written by one task each, since record order is their identity; the rows must be in the order to be written.
"""

from __future__ import annotations

import datetime
import os
import struct
from collections.abc import Iterator
from dataclasses import asdict
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..plans.schema import DELETED, INDEX, FieldFact, spark_type

#: Code page marks of the file header and their codecs.
CODE_PAGES = {0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x64: "cp852", 0x65: "cp866", 0x69: "cp620", 0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253"}
HEADER, FIELD = struct.Struct("<BBBBIHH16xBB2x"), struct.Struct("<11sc4xBBB13x")
JULIAN_OF_DAY_0 = 1_721_425
ROWS = 50_000
MEMO_BLOCK = 64


def codec_of(mark: int) -> str:
    name = CODE_PAGES.get(mark, "cp1252")
    try:
        "".encode(name)
    except LookupError:
        return "cp1252"
    return name


def read_header(path: str) -> dict:
    """Version, record count, lengths, codec and field facts. Anything malformed is refused."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            raise ValueError("DBF_HEADER_TRUNCATED")
        version, _, _, _, records, header_length, record_length, flags, mark = HEADER.unpack(head)
        if version not in (0x03, 0x30, 0x31, 0x32, 0x83, 0x8B, 0xF5):
            raise ValueError("DBF_VERSION_UNSUPPORTED")
        if header_length > size or header_length < 33:
            raise ValueError("DBF_HEADER_LENGTH")
        f.seek(32)
        described = f.read(header_length - 32)
    facts, codec, at = [], codec_of(mark), 0
    while at + 32 <= len(described) and described[at] != 0x0D:
        name, kind, width, decimals, bits = FIELD.unpack(described[at : at + 32])
        kind = kind.decode("latin-1")
        system = bool(bits & 1)
        facts.append(FieldFact(name.split(b"\0")[0].decode("ascii"), kind, width, decimals, codec if kind in "CVM" else "none", bool(bits & 2), bool(bits & 4) and kind in "GP", system, False))
        at += 32
    if 1 + sum(f.width for f in facts) != record_length or header_length + records * record_length > size:
        raise ValueError("DBF_RECORD_LENGTH")
    return {"version": version, "records": records, "start": header_length, "length": record_length, "facts": facts, "codec": codec, "flags": flags}


def memo_path(path: str) -> str | None:
    base = os.path.splitext(path)[0]
    return next((base + s for s in (".fpt", ".FPT") if os.path.exists(base + s)), None)


def read_memo(file, block_size: int, number: int, codec: str) -> tuple[str, bytes] | None:
    """(kind, payload) of a block; block 0 is none."""
    if not number:
        return None
    file.seek(number * block_size)
    kind, size = struct.unpack(">II", file.read(8))
    return ("TEXT" if kind == 1 else "BINARY", file.read(size))


def read_value(raw: bytes, fact: FieldFact):
    kind = fact.dbf_type
    if kind == "C":
        return raw.decode(fact.encoding).rstrip(" \0")
    if kind in "NF":
        text = raw.strip(b" \0").decode("ascii")
        if not text or text.strip("*") == "":
            return None
        return Decimal(text) if kind == "N" and not fact.decimals else float(text)
    if kind == "I":
        return struct.unpack("<i", raw)[0]
    if kind == "B":
        return struct.unpack("<d", raw)[0]
    if kind == "Y":
        return Decimal(struct.unpack("<q", raw)[0]).scaleb(-4)
    if kind == "L":
        return {b"T": True, b"t": True, b"Y": True, b"y": True, b"F": False, b"f": False, b"N": False, b"n": False}.get(raw)
    if kind == "D":
        text = raw.decode("ascii").strip()
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:])) if text and text != "00000000" else None
    if kind == "T":
        day, millis = struct.unpack("<ii", raw)
        return datetime.datetime.fromordinal(day - JULIAN_OF_DAY_0 + 1) + datetime.timedelta(milliseconds=millis) if day else None
    raise ValueError(f"DBF_TYPE_{kind}")


def write_value(value, fact: FieldFact) -> bytes:
    kind, width = fact.dbf_type, fact.width
    if kind == "C":
        raw = (value or "").encode(fact.encoding)
        if len(raw) > width:
            raise ValueError("DBF_VALUE_TOO_WIDE")
        return raw.ljust(width)
    if kind in "NF":
        text = "" if value is None else f"{value:.{fact.decimals}f}"
        if len(text) > width:
            raise ValueError("DBF_VALUE_TOO_WIDE")
        return text.encode().rjust(width)
    if kind == "I":
        return struct.pack("<i", value or 0)
    if kind == "B":
        return struct.pack("<d", value or 0.0)
    if kind == "Y":
        return struct.pack("<q", int(Decimal(value or 0).scaleb(4)))
    if kind == "L":
        return b"?" if value is None else b"T" if value else b"F"
    if kind == "D":
        return b" " * 8 if value is None else value.strftime("%Y%m%d").encode().rjust(8, b"0")
    if kind == "T":
        if value is None:
            return bytes(8)
        rest = value - datetime.datetime.combine(value.date(), datetime.time())
        return struct.pack("<ii", value.toordinal() + JULIAN_OF_DAY_0 - 1, rest.days * 86_400_000 + rest.seconds * 1000 + rest.microseconds // 1000)
    raise ValueError(f"DBF_TYPE_{kind}")


def schema_of(facts: list[FieldFact]) -> StructType:
    own = [StructField(f.name, spark_type(f), True, {"fact": asdict(f)}) for f in facts if not f.system]
    return StructType([*own, StructField(INDEX, LongType(), False), StructField(DELETED, BooleanType(), False)])


class Records(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class DbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.head = path, read_header(path)
        if any(f.dbf_type in "MGP" for f in self.head["facts"]) and not memo_path(path):
            raise ValueError("MEMO_COMPANION_MISSING")

    def partitions(self) -> list[Records]:
        n = self.head["records"]
        return [Records(k, min(ROWS, n - k)) for k in range(0, n, ROWS)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        head, memo = self.head, memo_path(self.path)
        length, memos, block = head["length"], None, MEMO_BLOCK
        if memo and any(f.dbf_type in "MGP" for f in head["facts"]):
            memos = open(memo, "rb")  # noqa: SIM115
            block = struct.unpack(">4xxxH", memos.read(8))[0] or 512
        with open(self.path, "rb") as f:
            f.seek(head["start"] + partition.first * length)
            for k in range(partition.count):
                raw, at, row = f.read(length), 1, []
                for fact in head["facts"]:
                    cell = raw[at : at + fact.width]
                    at += fact.width
                    if fact.system:
                        continue
                    if fact.dbf_type in "MGP":
                        number = struct.unpack("<i", cell)[0] if fact.width == 4 else int(cell.strip() or 0)
                        found = read_memo(memos, block, number, fact.encoding)
                        if found and fact.dbf_type == "M" and found[0] != "TEXT":
                            raise ValueError("MEMO_PAYLOAD_BINARY")  # of a text field; never decoded as if it were text
                        row.append(None if found is None else found[1].decode(fact.encoding) if fact.dbf_type == "M" else found[1])
                    else:
                        row.append(read_value(cell, fact))
                yield (*row, partition.first + k, raw[:1] == b"*")
        if memos:
            memos.close()


class DbfWriter(DataSourceWriter):
    """One partition, in order; the file appears under its name only when it is whole."""

    def __init__(self, path: str, schema: StructType):
        if os.path.exists(path):
            raise FileExistsError(path)
        self.path, self.names = path, [f.name for f in schema]
        self.facts = [FieldFact(**f.metadata["fact"]) for f in schema if f.name not in (INDEX, DELETED)]

    def write(self, rows: Iterator[tuple]) -> WriterCommitMessage:
        base = os.path.splitext(self.path)[0]
        long = any(f.dbf_type in "MGP" for f in self.facts)
        widths = [4 if f.dbf_type in "MGP" else f.width for f in self.facts]
        head_length, record_length, count = 32 + 32 * len(self.facts) + 1 + 263, 1 + sum(widths), 0
        mark = next((m for f in self.facts if f.dbf_type in "CM" for m, c in CODE_PAGES.items() if c == f.encoding), 0x03)
        place = {n: i for i, n in enumerate(self.names)}
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(f"{self.path}.part", "wb") as out, open(f"{base}.fpt.part" if long else os.devnull, "wb") as memos:
            out.write(bytes(head_length))
            block = 512 // MEMO_BLOCK
            memos.write(struct.pack(">I2xH", 0, MEMO_BLOCK).ljust(512, b"\0"))
            for row in rows:
                cells = [b"*" if DELETED in place and row[place[DELETED]] else b" "]
                for fact in self.facts:
                    value = row[place[fact.name]]
                    if fact.dbf_type not in "MGP":
                        cells.append(write_value(value, fact))
                    elif value is None:
                        cells.append(bytes(4))
                    else:
                        payload = value.encode(fact.encoding) if isinstance(value, str) else bytes(value)
                        data = struct.pack(">II", 1 if isinstance(value, str) else 0, len(payload)) + payload
                        memos.write(data.ljust(-(-len(data) // MEMO_BLOCK) * MEMO_BLOCK, b"\0"))
                        cells.append(struct.pack("<i", block))
                        block += -(-len(data) // MEMO_BLOCK)
                out.write(b"".join(cells))
                count += 1
            out.write(b"\x1a")
            out.seek(0)
            out.write(HEADER.pack(0x30, 126, 1, 1, count, head_length, record_length, 2 if long else 0, mark))
            for fact, width in zip(self.facts, widths, strict=True):
                out.write(FIELD.pack(fact.name.encode("ascii")[:10].ljust(11, b"\0"), fact.dbf_type.encode(), width, fact.decimals, (2 if fact.nullable else 0) | (4 if fact.dbf_type in "GP" else 0)))
            out.write(b"\r")
            if long:
                memos.seek(0)
                memos.write(struct.pack(">I2xH", block, MEMO_BLOCK))
        os.rename(f"{self.path}.part", self.path)
        if long:
            os.rename(f"{base}.fpt.part", f"{base}.fpt")
        return WriterCommitMessage()


class DbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://")

    def schema(self) -> StructType:
        return schema_of(read_header(self._path())["facts"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return DbfReader(self._path())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("an existing table is never overwritten")
        return DbfWriter(self._path(), schema)


def register(spark) -> None:
    spark.dataSource.register(DbfSource)


def write_dbf(df, facts: tuple[FieldFact, ...], path: str) -> None:
    """df as one table, in record order."""
    from ..plans.schema import with_facts

    register(df.sparkSession)
    with_facts(df, facts).coalesce(1).sortWithinPartitions(INDEX).write.format("dbf").mode("append").save(path)
