"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into units that no pre-token crosses, units unknown so far into pre-tokens, and the pre-tokens of
a batch are merged together as ragged arrays; a text's count is the sum over its units.

Defined cases: a null text counts as empty and has no tokens; the strings of added tokens inside a text count as
one token each, as the tokenizers library has it by default; texts of any length are counted whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .array_bpe import Bounded, Merges
from .common import column, table

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than space and line feed; texts that hold any are cut by PATTERN as a whole.
ODD = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -     　]")
UNIT = re.compile("[ \n]*[^ \n]+|[ \n]+")
CACHE = 250_000
OUT = "doc_id long, n_bytes long, n_tokens long"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.merges = Merges(
            [vocabulary[a] for a, _ in pairs], [vocabulary[b] for _, b in pairs], range(len(pairs)), [vocabulary[a + b] for a, b in pairs]
        )
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte] = vocabulary[letter]
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pattern = regex.compile(PATTERN)
        self.known = Bounded(CACHE)  # unit -> tokens

    def count_pretokens(self, pretokens: list[str]) -> np.ndarray:
        raw = [p.encode() for p in pretokens]
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        return self.merges.apply(symbols, np.fromiter(map(len, raw), np.int64, len(raw)))[1]

    def learn(self, units: list[str]) -> None:
        cut = [self.pattern.findall(u) for u in units]
        every = list(dict.fromkeys(chain.from_iterable(cut)))
        count = dict(zip(every, self.count_pretokens(every).tolist(), strict=True)) if every else {}
        for unit, pretokens in zip(units, cut, strict=True):
            self.known[unit] = sum(map(count.__getitem__, pretokens))

    def count(self, texts: list[str]) -> list[int]:
        self.known.make_room()
        cut, extra = [], []
        for text in texts:
            n, parts = 0, [text]
            if self.added and self.added.search(text):
                parts = self.added.split(text)
                n = len(parts) - 1
            extra.append(n)
            cut.append([u for p in parts for u in ((p,) if ODD.search(p) else UNIT.findall(p))] if n or ODD.search(text) else UNIT.findall(text))
        unseen = self.known.missing(chain.from_iterable(cut))
        if unseen:
            self.learn(list(unseen))
        known = self.known.__getitem__
        totals = [n + sum(map(known, units)) for n, units in zip(extra, cut, strict=True)]
        for unit in unseen:
            if len(unit) > 64:  # whole odd texts and the like don't come again
                del self.known[unit]
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def slices(texts: list[str], size: int = 4_000_000) -> Iterator[list[str]]:
    """texts in lists of about `size` characters, so that a batch of long texts needs no more memory."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [n for part in slices(texts) for n in own.count(part)]
            sizes = [len(t.encode()) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    rows = docs.select(column(id_col), column(text_col))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *T.StructType.fromDDL("n_bytes long, n_tokens long").fields]))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (counted.n_tokens > LIMIT).alias("over_limit"))
