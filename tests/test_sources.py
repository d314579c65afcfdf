"""DBF tables written and read back, malformed ones refused, and the command line."""

import datetime
import json
from decimal import Decimal

import pytest

from maskwright import cli
from maskwright.plans.schema import DELETED, INDEX, FieldFact
from maskwright.sources.dbf import read_header, register, write_dbf

FACTS = (
    FieldFact("CODE", "C", 10, encoding="cp1250"), FieldFact("CNT", "I", 4), FieldFact("QTY", "N", 8), FieldFact("AMOUNT", "N", 10, 2), FieldFact("RATIO", "F", 12, 4), FieldFact("PRICE", "Y", 8),
    FieldFact("MEASURE", "B", 8), FieldFact("FLAG", "L", 1), FieldFact("DAY", "D", 8), FieldFact("MOMENT", "T", 8), FieldFact("NOTE", "M", 4, encoding="cp1250"), FieldFact("PIC", "P", 4),
)
SCHEMA = f"CODE string, CNT int, QTY decimal(8,0), AMOUNT double, RATIO double, PRICE decimal(19,4), MEASURE double, FLAG boolean, DAY date, MOMENT timestamp_ntz, NOTE string, PIC binary, {INDEX} bigint, {DELETED} boolean"
ROWS = [
    ("zażółć", -5, Decimal(42), 123.45, 2.5, Decimal("1234.5678"), 3.14159, True, datetime.date(2028, 2, 29), datetime.datetime(2028, 2, 29, 23, 59, 58), "note " * 50, b"\x00\x01", 0, False),
    ("", 7, None, None, None, Decimal("-1.0000"), 0.0, None, None, None, None, None, 1, True),
]


def test_dbf_roundtrip(spark, tmp_path):
    path = str(tmp_path / "t.dbf")
    write_dbf(spark.createDataFrame(ROWS[::-1], SCHEMA), FACTS, path)
    register(spark)
    back = spark.read.format("dbf").load(path)
    assert [tuple(r) for r in back.orderBy(INDEX).collect()] == [tuple(bytearray(v) if isinstance(v, bytes) else v for v in r) for r in ROWS]
    head = read_header(path)
    assert [(f.name, f.dbf_type, f.width, f.decimals, f.encoding) for f in head["facts"]] == [(f.name, f.dbf_type, f.width, f.decimals, f.encoding if f.dbf_type in "CVM" else "none") for f in FACTS]
    with pytest.raises(Exception):
        write_dbf(spark.createDataFrame(ROWS, SCHEMA), FACTS, path)


def test_malformed_tables_are_refused(spark, tmp_path):
    path = str(tmp_path / "t.dbf")
    write_dbf(spark.createDataFrame(ROWS, SCHEMA), FACTS, path)
    raw = bytearray(open(path, "rb").read())
    for change, why in ((lambda b: b[:-60], "RECORD_LENGTH"), (lambda b: b"\x99" + b[1:], "VERSION"), (lambda b: b[:8] + b"\xe8\xfd" + b[10:], "HEADER_LENGTH"), (lambda b: b[:10], "TRUNCATED")):
        open(path, "wb").write(change(bytes(raw)))
        with pytest.raises(ValueError, match=why):
            read_header(path)
    open(path, "wb").write(raw)
    (tmp_path / "t.fpt").unlink()
    with pytest.raises(Exception, match="MEMO_COMPANION_MISSING"):
        spark.read.format("dbf").load(path).collect()


def test_command_line(spark, capsys, tmp_path):
    assert cli.main(["capabilities", "--json", "--recovery-policy", "disabled"]) == 0
    assert json.loads(capsys.readouterr().out)["recovery"] is False
    assert cli.main(["self-test", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"status": "PASS"}
    assert cli.main(["plan", "--json", f"file://{tmp_path}/none", f"file://{tmp_path}/out", f"file://{tmp_path}/vault"], spark) == 2
    assert json.loads(capsys.readouterr().out)["error"]["code"] == "PATH_NOT_FOUND"
