"""Language identification, words first, with backoff to character n-grams.

A model is fitted on labelled documents: per language the log frequency of its words and of the character
n-grams of its words. A known word scores by its log frequencies; an unseen word backs off to its n-grams, the
longest known ones first: at each position the longest known n-gram counts, with a penalty for each step
down. A document's score is the posterior of the best language under the mean log likelihood of its words.

Bounds: the fit counts about ``FIT_ROWS`` labelled documents per language, picked by a hash of the text, and keeps the
``WORDS`` most frequent words and ``GRAMS`` most frequent n-grams of each language, ``ENTRIES`` of a kind in all, so the model is
broadcast; every one of these is a parameter. Every language of the labels is learned, and words and runs of letters of any length are
cut whole, when learned as when scored. Only (entry, language) pairs that occur are stored.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0, as is every text where nothing could
be learned; of equal scores the language first in order wins; of equally frequent entries the first in order is kept; rows with a null
language or text are not learned from; a null id is held out; repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .array_bpe import Bounded
from .common import column, materialize, table

FIT_ROWS, WORDS, GRAMS, ENTRIES = 20_000, 20_000, 20_000, 2_000_000
LONGEST = 4
#: Log penalty of an unseen word, and of each n-gram length below the longest.
UNSEEN, STEP = math.log(0.1), math.log(0.4)
UNKNOWN = "und"
LETTERS, PLAIN = regex.compile(r"\p{L}+"), re.compile("[a-z]+")
CACHE = 300_000
SALTS = 16
#: Up to this many languages a worker unpacks the model into a row of numbers per entry.
DENSE = 16


def held_out(id_col: Column) -> Column:
    """Every fifth document by the checksum of its id; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class Logs:
    """Log frequencies of entries by language: what an entry adds to the floor, for the languages that have it."""

    index: dict[str, int]
    starts: np.ndarray
    langs: np.ndarray
    above: np.ndarray
    floor: np.ndarray

    @staticmethod
    def of(rows: list[tuple[str, int, int]], langs: int) -> Logs:
        """rows: entry, place of language, count."""
        rows = sorted(rows)
        index = {e: i for i, e in enumerate(dict.fromkeys(r[0] for r in rows))}
        place, counts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], float)
        sizes = np.bincount(np.array([index[r[0]] for r in rows], np.int64), minlength=len(index)) if rows else np.zeros(0, np.int64)
        totals = np.bincount(place, weights=counts, minlength=langs) + 0.5 * max(len(index), 1)
        return Logs(index, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), place, np.log((counts + 0.5) / 0.5), np.log(0.5 / totals))

    def dense(self) -> np.ndarray:
        out = np.tile(self.floor, (len(self.index), 1))
        entry = np.repeat(np.arange(len(self.index)), np.diff(self.starts))
        out[entry, self.langs] += self.above
        return out

    def sum(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sum over entries of times x log frequency, by language."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.floor * times.sum() + np.bincount(self.langs[at], weights=self.above[at] * np.repeat(times, sizes), minlength=len(self.floor))


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, words: int = WORDS, grams: int = GRAMS, entries: int = ENTRIES
) -> dict:
    """{"langs": [...], "words": Logs, "grams": Logs}, of bounded size."""
    labelled = docs.select(column(lang_col).cast("string").alias("lang"), column(text_col).alias("text")).dropna()
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("docs"))
    sizes = materialize(sizes, "languages")
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not langs:
        return {"langs": [], "words": Logs.of([], 0), "grams": Logs.of([], 0)}
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(rows) / F.col("docs")).alias("share"))
    unit = F.xxhash64("text") / F.lit(float(2**64)) + 0.5
    part = labelled.join(F.broadcast(share), "lang").filter(unit <= F.col("share"))
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    counted = materialize(part.select("lang", F.explode(found).alias("entry")).groupBy("lang", "entry").agg(F.count("*").alias("n")), "words")
    # runs of letters are cut whole: in windows of 64 starts, each with the letters that its last n-grams reach into
    windows = F.regexp_extract_all(F.concat(F.lit(" "), "entry", F.lit(" ")), F.lit(f"(?=(.{{1,{63 + LONGEST}}})).{{1,64}}"), F.lit(1))
    spread = counted.select("lang", "n", F.explode(windows).alias("window"))
    starts = F.sequence(F.lit(1), F.least(F.length("window"), F.lit(64)))
    # lambdas of one argument: a second one would be given the index
    grams_of = lambda k: F.transform(F.filter(starts, lambda i: i <= F.length("window") - (k - 1)), lambda i: F.substring("window", i, F.lit(k)))
    cut = F.flatten(F.array(*(grams_of(k) for k in range(1, LONGEST + 1))))
    parts = spread.select("lang", "n", F.explode(cut).alias("entry")).filter("entry != ' '").groupBy("lang", "entry").agg(F.sum("n").alias("n"))
    return {"langs": langs, "words": log_frequencies(counted, langs, words, entries), "grams": log_frequencies(parts, langs, grams, entries)}


def log_frequencies(counted: DataFrame, langs: list[str], most: int, entries: int) -> Logs:
    """Of the most frequent entries of each language. Each salt of a language is limited first, so no task gets all entries of one."""
    most = max(1, min(most, entries // len(langs)))
    order = (F.desc("n"), "entry")
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("entry"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= most)
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= most)
    at = {lang: i for i, lang in enumerate(langs)}
    return Logs.of([(r["entry"], at[r["lang"]], r["n"]) for r in kept.select("lang", "entry", "n").collect()], len(langs))


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.unseen = Bounded(CACHE)
        self.word_logs = self.gram_logs = None

    def unpack(self) -> None:
        """On a worker, so that the broadcast is of what occurs only."""
        if self.word_logs is None and len(self.langs) <= DENSE:
            self.word_logs, self.gram_logs = self.words.dense(), self.grams.dense()

    def back_off(self, word: str) -> np.ndarray:
        padded, rows, penalty, index = f" {word} ", [], 0.0, self.grams.index
        for i in range(len(padded)):
            for k in range(min(LONGEST, len(padded) - i), 0, -1):
                row = index.get(padded[i : i + k])
                if row is not None:
                    rows.append(row)
                    penalty += STEP * (LONGEST - k)
                    break
        if not rows:
            return np.full(len(self.langs), UNSEEN)
        total = self.gram_logs[rows].sum(axis=0) if self.gram_logs is not None else self.grams.sum(np.array(rows), np.ones(len(rows)))
        return UNSEEN + (total + penalty) / len(rows)

    def score(self, text: str | None) -> tuple[str, float]:
        low = text.lower() if text else ""
        counts = Counter((PLAIN if low.isascii() else LETTERS).findall(low))
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        self.unpack()
        total, known, times, index = np.zeros(len(self.langs)), [], [], self.words.index
        unseen = [w for w in counts if w not in index]
        for word in self.unseen.missing(unseen):
            self.unseen[word] = self.back_off(word)
        for word in unseen:
            total += counts[word] * self.unseen[word]
            if len(word) > 32:
                del self.unseen[word]
        for word, row in zip(counts, map(index.get, counts), strict=True):
            if row is not None:
                known.append(row)
                times.append(counts[word])
        if known:
            times = np.array(times, float)
            total += times @ self.word_logs[known] if self.word_logs is not None else self.words.sum(np.array(known), times)
        total /= counts.total()
        shifted = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(shifted[best] / shifted.sum())


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each row; only the text is read for it."""
    sent = docs.sparkSession.sparkContext.broadcast(Scorer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            own.unseen.make_room()
            found = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [id_col, "lang_pred", "score"],
            )

    rows = docs.select(column(id_col), column(text_col))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *T.StructType.fromDDL("lang_pred string, score double").fields]))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
