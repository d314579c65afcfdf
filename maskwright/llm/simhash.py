"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints that differ in at most 3 of 64 bits share at least 5 of their 8 bytes, position by position. Single
positional bytes make postings that grow with the corpus, so the index entries are positional byte quadruples:
the 14 blocks of the Steiner system S(3,4,8), of which every 5 positions contain one (a pair that shares 5, 6, 7 or 8 bytes meets in
1, 3, 7 or 14 postings, one that shares fewer in 1 at most). In each posting the positional bytes that are still open are indexed
again, the lists that hold both of a pair are counted, pairs with 5 shared bytes or more in all are verified on their bits, and only
links of a spanning forest leave the posting. Equal fingerprints are one entry.

A posting longer than ``POSTING`` is refined: of its free bits, split into four parts, a pair within 3 bits shares one
part whole, so each fingerprint goes on under four longer keys; after three refinements at most 14 bits are free,
which bounds any posting. No link is lost, and no group is collected without a bound.

Defined cases: a null or blank text has fingerprint zero, linked like any other; component ids are the smallest id
reached; rows without an id take part in links but name no component; repeated rows are one group; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, column, materialize, table
from .components import components

SHINGLE, SEED, BITS, SHARED = 3, 42, 3, 5
POSTING, PAIRS = 2048, 1 << 21
#: The blocks of S(3,4,8) on positions 0 to 7, each with its complement.
BLOCKS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 2, 4, 6), (0, 2, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6))
BLOCKS += tuple(tuple(i for i in range(8) if i not in b) for b in BLOCKS)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z, and only the six ASCII blanks
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the unsigned 64-bit hashes have."""
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and fp of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.int64())], ["id", "fp"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.dtypes[0][1]}, fp bigint")


def byte_mask(positions: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def refinements(mask: int) -> list[int]:
    """mask with one of four parts of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [round(len(free) * k / 4) for k in range(5)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def tallied(group: np.ndarray, least: int = SHARED, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of a posting that share `least` positional bytes or more.

    The posting has an inverted index of its own: at each position where bytes differ, fingerprints by byte. A pair's tally is the
    number of lists that hold both, and of positions where all agree. Tallies are counted for so many rows at a time that
    about `pairs` list entries are held.
    """
    n, parts = len(group), np.ascontiguousarray(group).view(np.uint8).reshape(-1, 8)
    open_at = np.flatnonzero((parts != parts[0]).any(axis=0))
    need = least - (8 - len(open_at))
    if need <= 0:
        # whatever the lists say, every pair of this posting has enough; refinement bounds how many such there are
        rows = max(1, pairs // n)
        for at in range(0, n, rows):
            i, j = np.nonzero(np.arange(at, min(at + rows, n))[:, None] < np.arange(n)[None, :])
            yield i + at, j
        return
    lists = []
    for p in open_at.tolist():
        order = np.argsort(parts[:, p], kind="stable")
        value = parts[order, p]
        slot = np.empty(n, np.int64)
        slot[order] = np.arange(n)
        ends = np.searchsorted(value, value, side="right")
        lists.append((order, slot, (ends[slot] - slot - 1)))
    heads = np.cumsum(sum(after for _, _, after in lists))
    at = 0
    while at < n:
        before = heads[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(heads, before + pairs, side="right")))
        keys = []
        for order, slot, after in lists:
            count = after[at:end]
            i = np.repeat(np.arange(at, end), count)
            place = np.repeat(slot[at:end] + 1 - np.cumsum(count) + count, count) + np.arange(count.sum())
            keys.append(i * n + order[place])
        key, tally = np.unique(np.concatenate(keys), return_counts=True)
        key = key[tally >= need]
        yield key // n, key % n
        at = end


def forest(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over the fingerprints of a posting: (node, least node of its part)."""
    group = np.unique(group)
    label, links = np.arange(len(group)), []
    for i, j in tallied(group):
        near = np.bitwise_count((group[i] ^ group[j]).view(np.uint64)) <= BITS
        links.append(np.stack([i[near], j[near]]))
    i, j = np.concatenate(links, axis=1)
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(group))
    return group[moved], group[label[moved]]


def links_within(postings: DataFrame) -> DataFrame:
    """postings (fps) -> links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                found = forest(np.asarray(fps.values.to_numpy(zero_copy_only=False), np.int64))
                a.append(found[0])
                b.append(found[1])
            join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.record_batch([join(a), join(b)], ["a", "b"])

    return postings.select("fps").mapInArrow(run, "a bigint, b bigint")


def near_links(distinct: DataFrame, posting: int = POSTING) -> DataFrame:
    """fp -> links (a, b) that connect exactly the fingerprints within reach of each other."""
    masks = [byte_mask(b) for b in BLOCKS]
    level = distinct.select("fp", F.explode(F.array(*(F.lit(signed(m)) for m in masks))).alias("mask"))
    links = None
    while True:
        level = level.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(level.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "postings")
        last = all(64 - m.bit_count() <= 14 for m in masks)
        fit = sizes if last else sizes.filter(F.col("n") <= posting)
        gathered = level.join(fit.select("mask", "key"), ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found = links_within(gathered)
        links = found if links is None else links.unionByName(found)
        large = sizes.filter(F.col("n") > posting).select("mask", "key")
        if last or large.isEmpty():
            return links
        finer = {m: refinements(m) for m in masks}
        table_of = F.create_map(*(x for m, subs in finer.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(s)) for s in subs)))))
        deeper = level.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(F.element_at(table_of, F.col("mask"))).alias("mask"))
        level = materialize(deeper.distinct(), "refined")
        masks = sorted({s for subs in finer.values() for s in subs})


def near_pairs(marked: DataFrame, posting: int = POSTING) -> DataFrame:
    """marked (id, fp) -> pairs (a, b) of ids that connect the rows whose fingerprints are within reach, for an exact check to follow."""
    least = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    links = materialize(near_links(least.select("fp"), posting), "links").distinct()
    ends = least.select("fp", "least")
    between = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select("x", "y")
    alike = marked.join(least.filter("n > 1"), "fp").select(F.col("least").alias("x"), F.col("id").alias("y"))
    return between.unionByName(alike).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING) -> DataFrame:
    """id, fp and component_id of each row."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    found = components(near_links(least.select("fp"), posting))
    roots = found.select(F.col("root").alias("fp"), F.col("root")).distinct().unionByName(found.select(F.col("node").alias("fp"), "root"))
    linked = least.select("fp", "least").join(roots, "fp")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = linked.join(ids, "root").select("fp", "component_id")
    copies = least.filter("n > 1").join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    # fingerprints of one row without links need no label
    labels = materialize(labels.unionByName(copies).withColumn("grouped", F.lit(True)), "labels")
    own = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id"))
    return attach(marked, labels, "fp", "id").select("id", "fp", own.alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that stay: one of each group, that with the smallest id. Rows without an id all stay."""
    goes = near_groups(docs, id_col, text_col).filter("id != component_id").select(F.col("id").alias(id_col))
    goes = materialize(goes.distinct(), "near-copies")
    return docs.join(F.broadcast(goes) if goes.count() <= broadcast_rows else goes, id_col, "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
