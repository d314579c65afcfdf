"""Packing token sequences by first-fit decreasing over a tournament tree, in randomised groups of documents.

First each document is turned into ids and cut: whole sequences of ``length`` ids, and a rest. Where the cuts
fall doesn't depend on the packing, so pieces and their checksums are made in one pass over the texts, numbered and
written to the shared folder. Whole pieces are sequences of their own; the rests are dealt by a hash of their
number into groups of about ``GROUP`` rests and packed there, longest first, each into the first bin with room,
which a tournament tree over the bins' free space finds in logarithmic time.

A sequence is padded to ``length``, unless its length is a power of two: then it stays as it is
(``padded_length``).

Defined cases: a null or empty text is the end id alone; documents of equal length are packed in order of their
number; repeated rows and null ids are packed as documents of their own; an empty table gives no pieces; other columns
are passed through whatever their names, and the new one is ``piece`` with underscores before it if that is taken.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .array_bpe import Bounded
from .common import column, free_name, materialize, packed, table
from .token_counts import slices, tokenizer_path

VOCABULARY, END_ID, LENGTH, GROUP = "word_bpe_49k.json", 2, 4096, 8192
CACHE = 350_000
LETTER, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
WORD = re.compile(f"[{LETTER}]+")
#: Chunks where split() would cut at more than white space; no token goes across white space.
CHUNK = re.compile("[^ \t\n\r\x0b\x0c]+")
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Chunks given to the tokenizer at once; what it returns for each is large.
LEARN = 20_000
#: Words given to it as one line.
LINE = 100
#: Fixed value: the mark of a token that ends a word.
WORD_END = "</w>"
PROBE = "a bcd naïve straßenbahn çà ÿ éèê internationalisierung"


class ChunkEncoder:
    """Ids of a vocabulary that drops white space: chunks between blanks are encoded once and remembered.

    Holds only where no token crosses a blank, which is checked on a probe text when the vocabulary is loaded.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a word in lower case needs no normaliser, and is one pre-token
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known = Bounded(CACHE)  # chunk -> ids as little-endian unsigned 32-bit integers
        self.closing = {m: self.raw(self.tokenizer.encode(m, add_special_tokens=False).ids) if m else b"" for m in ("", *MARKS)}
        probe = f"{PROBE} {PROBE.upper()} Don't  PANIC:\té́ x1 42,\n\n<|endoftext|> ´s  '"
        for text in (PROBE, PROBE.upper(), probe):
            if self.encode([text]) != [self.raw(self.tokenizer.encode(text, add_special_tokens=False).ids)]:
                raise ValueError("this vocabulary has tokens that cross blanks")

    @staticmethod
    def raw(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    @staticmethod
    def cut(text: str) -> list[str]:
        if "<|" not in text:  # strings of special tokens are in lower case as they stand
            try:
                text.encode("latin-1")
                text = text.lower()  # as the vocabulary does later; these characters need no normalisation before
            except UnicodeEncodeError:
                pass
        return CHUNK.findall(text) if any(c in text for c in SEPARATORS) else text.split()

    def learn(self, chunks: Iterable[str]) -> None:
        """Words are encoded once, whatever their case and whether a mark closes them; other chunks as they are."""
        words, derived, others = {}, [], []
        for chunk in chunks:
            mark = chunk[-1] if chunk[-1] in MARKS else ""
            word = chunk[:-1] if mark else chunk
            if WORD.fullmatch(word):
                word = word.lower()
                words[word] = None
                if word != chunk:
                    derived.append((chunk, word, mark))
            else:
                others.append(chunk)
        listed = [w for w in words if w not in self.known]
        for at in range(0, len(listed), LEARN):
            part = listed[at : at + LEARN]
            self.known.update(zip(part, self.words(part), strict=True))
        for chunk, word, mark in derived:
            self.known[chunk] = self.known[word] + self.closing[mark]
        for at in range(0, len(others), LEARN):
            part = others[at : at + LEARN]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, (self.raw(f.ids) for f in found), strict=True))

    def words(self, listed: list[str]) -> list[bytes]:
        """The ids of words in lower case, a line of them at a time: each word ends in a token that ends a word."""
        lines = [" ".join(listed[at : at + LINE]) for at in range(0, len(listed), LINE)]
        ids = np.array(list(chain.from_iterable(e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False))), "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def join(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, chunks))

    def encode(self, texts: list[str]) -> list[bytes]:
        self.known.make_room()
        cut = [self.cut(t) for t in texts]
        unseen = self.known.missing(chain.from_iterable(cut))
        if unseen:
            self.learn(unseen)
        out = [self.join(c) for c in cut]
        for chunk in unseen:
            if len(chunk) > 64:
                self.known.pop(chunk, None)
                self.known.pop(chunk.rstrip(MARKS).lower(), None)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def cut_documents(docs: DataFrame, path: str, text_col: str, end_id: int, length: int) -> DataFrame:
    """A row per piece: `row` with the other columns of docs, start, length, ids_crc32, and doc_tokens of the document."""
    rows = docs.select(packed([c for c in docs.columns if c != text_col]).alias("row"), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            for part in slices(texts):
                raw = [r + end for r in own.encode(part)]
                totals = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
                pieces = -(-totals // length)
                owner = np.repeat(np.arange(len(raw)), pieces)
                starts = length * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                sizes = np.minimum(totals[owner] - starts, length)
                sums = [zlib.crc32(raw[k][4 * s : 4 * (s + n)]) for k, s, n in zip(owner.tolist(), starts.tolist(), sizes.tolist(), strict=True)]
                found = [batch.column(0).take(pa.array(owner + at)), pa.array(starts), pa.array(sizes), pa.array(sums, pa.int64()), pa.array(totals[owner])]
                yield pa.record_batch(found, ["row", "start", "length", "ids_crc32", "doc_tokens"])
                at += len(raw)

    schema = T.StructType([rows.schema["row"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    return rows.mapInArrow(run, schema)


class Tournament:
    """Free space of bins; the winner of each match is the larger space."""

    def __init__(self, bins: int, space: int):
        self.size = 1 << max(bins - 1, 0).bit_length()
        self.tree = [space] * (2 * self.size)

    def place(self, need: int) -> int:
        """Take `need` from the first bin that has it; its number."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < need:
                at += 1
        found = at - self.size
        tree[at] -= need
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
        return found


def first_fit_decreasing(lengths: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; longest first, equal ones in their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, filled = Tournament(len(lengths), space), [0] * max(len(lengths), 1)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        b = tree.place(need)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += need
    return bins, offsets


def pack(
    docs: DataFrame, path: str, text_col: str = "text", end_id: int = END_ID, length: int = LENGTH, group: int = GROUP
) -> DataFrame:
    """A row per piece: the columns of docs without its text, and the struct ``piece``."""
    # a piece's number is written with it, so it is the same whenever a task reads it again
    each = materialize(cut_documents(docs, path, text_col, end_id, length).withColumn("n", F.monotonically_increasing_id()), "pieces")
    rests = each.filter(F.col("length") < length)
    groups = max(1, round(rests.count() / group))
    rests = rests.withColumn("group", F.pmod(F.xxhash64("n"), F.lit(groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n", ignore_index=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), length)
        used = np.bincount(bins, weights=part["length"].to_numpy()).astype(np.int64)
        return pd.DataFrame({"n": part["n"], "bin": bins, "offset": offsets, "used": used[bins]})

    placed = rests.select("group", "n", "length").groupBy("group").applyInPandas(run, "n bigint, bin bigint, offset bigint, used bigint")
    # sequence ids: a group's bins under the group's number, whole pieces below zero
    rest = rests.join(placed, "n").withColumn("sequence_id", F.shiftleft("group", 32) + F.col("bin"))
    alone = each.filter(F.col("length") == length).withColumn("offset", F.lit(0).cast("long")).withColumn("used", F.lit(length).cast("long"))
    alone = alone.withColumn("sequence_id", -1 - F.col("n"))
    columns = ["row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "used"]
    both = rest.select(columns).unionByName(alone.select(columns))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    piece = F.struct("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.when(power, F.col("used")).otherwise(length).cast("long").alias("padded_length"))
    return both.select("row.*", piece.alias(free_name(docs, "piece")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(VOCABULARY)).select("doc_id", "piece.*")
