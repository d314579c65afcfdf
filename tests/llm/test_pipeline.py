"""The pipeline against a plain version: each stage's decisions on what the stage before kept."""

import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from maskwright.llm.quality import OP9_SQL
from maskwright.llm.token_counts import tokenizer_path

from .test_near_copies import plain_groups
from .test_operators import plain_spans

SF = "/root/testdata/sf0.001"


def plain_redaction(text):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in plain_spans(text).split(",") if s)
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]


def test_pipeline_equals_the_plain_one(spark):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {d for d, ok in con.sql(f"SELECT doc_id, kept FROM ({OP9_SQL})").fetchall() if ok}
    best = {}
    for d in kept:
        best[documents[d]] = max(d, best.get(documents[d], d))
    left = sorted(best.values())
    gone = plain_groups([documents[d] for d in left])
    texts = {d: plain_redaction(documents[d]) for k, d in enumerate(left) if k not in gone}
    own = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {d: np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    found = corpus_pipeline.run(spark, SF).collect()
    pieces = {}
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert set(pieces) == set(texts)
    for d, cut in pieces.items():
        assert [s for s, _ in sorted(cut)] == [sum(n for _, n in sorted(cut)[:k]) for k in range(len(cut))] and sum(n for _, n in cut) == len(ids[d])


def test_stages_take_empty_tables_and_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns
            stage(spark, docs, SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_stages_take_long_texts_and_further_columns(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(k, t, "en", "s", 0, 7, 8) for k, t in enumerate([long, long, long + " end", "the of and to in a is that for it was on are"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, secrets int, `a.b` int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-2:] == ["secrets", "a.b"]
        if name == "exact_dedup":
            assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == [1, 2, 3]
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == [1, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).agg({"length": "sum"}).first()[0] > 60_000


pytestmark = pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no test tables here")
