"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut into units that no merge crosses (a run of word marks and what follows it; line feeds, where no
piece holds one); units unknown so far are merged together, as flat symbol arrays, and remembered.

Defined cases: a null text counts as empty and has no ids; characters without a piece become byte pieces; the
model must be a BPE model with byte fallback, an identity normaliser and a leading word mark, which is checked
on a probe text when it is loaded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .array_bpe import Bounded, Merges
from .common import column, table
from .token_counts import slices, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LONE = 1 << 20  # symbols from here on are characters without a piece
CACHE = 150_000
PROBE = "A probe\ttext,\n  with ▁ marks \U0001f9ea and  spaces "


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        plain = {model.id_to_piece(i): i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.single = {p: i for p, i in plain.items() if len(p) == 1}
        symbol = lambda p: plain[p] if p in plain else LONE + ord(p)
        scores = sorted({model.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: n for n, s in enumerate(scores)}
        left, right, ranks, merged = [], [], [], []
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                a, b = piece[:k], piece[k:]
                if (a in plain or len(a) == 1) and (b in plain or len(b) == 1):
                    left.append(symbol(a))
                    right.append(symbol(b))
                    ranks.append(rank[model.get_score(i)])
                    merged.append(i)
        self.merges = Merges(left, right, ranks, merged)
        joined = [p for p in plain if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in joined):
            raise ValueError("pieces with a word mark after another character are not supported")
        breaks = "" if any("\n" in p for p in joined) else "\n"
        self.unit = re.compile(f"{MARK}+[^{MARK}{breaks}]*|[^{MARK}{breaks}]+" + (f"|{breaks}" if breaks else ""))
        self.bytes_of = [b""] * len(size)
        for piece, i in plain.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])
        self.known = Bounded(CACHE)  # unit -> number of ids, ids as text, bytes
        if self.ids(PROBE) != model.encode(PROBE):
            raise ValueError("this model's normaliser or kind is not supported")

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units, flat, and how many each has."""
        text = "".join(units)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        seen, back = np.unique(points, return_inverse=True)
        symbols = np.array([self.single.get(chr(c), LONE + c) for c in seen.tolist()], np.int64)[back]
        flat, lengths = self.merges.apply(symbols, np.fromiter(map(len, units), np.int64, len(units)))
        if not (flat >= LONE).any():
            return flat, lengths
        word = np.repeat(np.arange(len(units)), lengths)
        raw = [chr(s - LONE).encode() if s >= LONE else b"?" for s in flat.tolist()]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        lone = np.repeat(flat >= LONE, sizes)
        out = np.repeat(flat, sizes)
        out[lone] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)[lone]]
        return out, np.bincount(np.repeat(word, sizes), minlength=len(units))

    def cut(self, text: str) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def ids(self, text: str) -> list[int]:
        units = self.cut(text)
        return self.merge(units)[0].tolist() if units else []

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def learn(self, units: list[str]) -> None:
        flat, lengths = self.merge(units)
        names, at = [str(i).encode() for i in flat.tolist()], 0
        pieces = [self.bytes_of[i] for i in flat.tolist()]
        for unit, n in zip(units, lengths.tolist(), strict=True):
            self.known[unit] = (n, b",".join(names[at : at + n]), b"".join(pieces[at : at + n]))
            at += n

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, and the SHA-256 of the ids and of the decoded text."""
        self.known.make_room()
        cut = [self.cut(t) for t in texts]
        unseen = self.known.missing(chain.from_iterable(cut))
        if unseen:
            self.learn(list(unseen))
        out, known = [], self.known.__getitem__
        for units in cut:
            found = list(map(known, units))
            ids = hashlib.sha256(b",".join([f[1] for f in found])).hexdigest()
            # byte pieces come from whole characters, so the joined bytes are valid UTF-8
            text = hashlib.sha256(b"".join([f[2] for f in found]).removeprefix(b" ")).hexdigest()
            out.append((sum([f[0] for f in found]), ids, text))
        for unit in unseen:
            if len(unit) > 64:
                del self.known[unit]
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and decoded of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.ids(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())], [id_col, "ids", "decoded"])

    rows = docs.select(column(id_col), column(text_col))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *T.StructType.fromDDL("ids array<int>, decoded string").fields]))


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row, without shipping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [x for part in slices(texts, 2_000_000) for x in own.digests(part)]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(column(id_col), column(text_col))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields]))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path(MODEL))
