"""Near copies: fingerprints in a byte-position inverted index with count filtering, then an exact check and an exact join for what lies beyond 3 bits.

Two texts are near copies if at least four fifths of their distinct five-word shingles are shared. The method is that of the fingerprint operator and runs
first, through its own functions: fingerprints of the five-word shingles, index entries of positional bytes, tallies, bits. What it links is checked on the shingles.
Most near copies differ in 4 to 11 bits, which no number of shared bytes guarantees, so the rest is found by a set similarity join with prefix, position and
sketch filters, all lossless: under any one order of all shingles such a pair shares one within the first fifth of each, so only those prefixes are
indexed, as 64-bit hashes. The order is by hash with shingles of many postings last; it decides the cost, never the result.
Each member meets one hub, the document of its postings whose prefix is shared most, which is the text that the others were copied from where there is one;
then only members that are still in different groups are paired, so a large group of copies is not paired with itself.

A document is one row with the hashes of its prefix and some to spare; entries are (hash, row, place), and only those whose hash others
have too ever meet a size or a sketch.

Defined cases: texts are split and lowered as for fingerprints; one of fewer than five words is one shingle, a null or blank text
the empty one; groups are connected components and ids are the smallest reached; rows without an id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column, discard, free_name, materialize
from .components import components
from .simhash import majority, near_pairs

SHINGLE = 5
#: Shingles with more postings go last in the order, which is revised so many times at most.
COMMON, REVISIONS = 32, 2
#: A list has a part of its prefix, one in so many and so many more, to spare.
SPARE = 8
NEEDED = "size - (4 * size + 4) div 5 + 1"
#: The factors that make hashes of shingles out of those of words.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: So many partners of one document are verified together.
LOT = 64
#: Words of the sketch: bit k is the parity of the hashes that end in k, so two sketches differ in no more bits than sets in shingles.
SKETCH = [f"s{k}" for k in range(4)]


def shingles(text: str | None) -> set[bytes]:
    words = text.encode().lower().split() if text else []
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE, 0) + 1)}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    """Jaccard of 4/5 or more, in whole numbers."""
    shared = len(a & b)
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def hashed(text: str | None) -> np.ndarray:
    """A hash for each shingle of text, repeats included, made of the hashes of its words."""
    words = text.encode().lower().split() if text else []
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    made = np.full(max(len(words) - SHINGLE, 0) + 1, size, np.uint64)
    for k in range(size):
        made = made * FACTOR + each[k : k + len(made)]
    for shift in (33, 29, 32):
        made = (made ^ (made >> np.uint64(shift))) * MIX
    return made ^ (made >> np.uint64(32))


def needed(size: int) -> int:
    """So many shingles, the first in one order, of which near copies share one."""
    return size - (4 * size + 4) // 5 + 1


def listing(text: str | None, common: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Fingerprint, number of different shingles, sketch, and the first hashes in order, those in common last: what is needed and some to spare."""
    each = hashed(text)
    found = np.unique(each.view(np.int64))
    odd = np.bincount(found & (64 * len(SKETCH) - 1), minlength=64 * len(SKETCH)) & 1
    most = needed(len(found)) + needed(len(found)) // SPARE + SPARE
    last = np.isin(found, common) if len(common) else np.zeros(len(found), bool)
    ordered = np.concatenate([found[~last], found[last]])[:most]
    return majority(each), len(found), np.packbits(odd.astype(np.uint8)).view(np.int64), ordered


def listed(docs: DataFrame, common: np.ndarray, turn: int) -> DataFrame:
    """docs (id, text) -> a row for each: its number u, the turn, id, fp, size, sketch and first hashes, written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [listing(t, sent.value) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *(len(h) for _, _, _, h in made)])
                hs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([h for _, _, _, h in made])))
                sketches = np.stack([s for _, _, s, _ in made]).T.copy()
                columns = [part.column(0), pa.array([f for f, _, _, _ in made], pa.int64()), pa.array([n for _, n, _, _ in made], pa.int32()), *map(pa.array, sketches), hs]
                yield pa.record_batch(columns, ["id", "fp", "size", *SKETCH, "hs"])

    made = docs.mapInArrow(run, f"id {docs.dtypes[0][1]}, fp bigint, size int, {', '.join(f'{c} bigint' for c in SKETCH)}, hs array<bigint>")
    # a row is known by its number, which is written with it
    return materialize(made.withColumn("u", F.monotonically_increasing_id() + F.lit(turn << 56)).withColumn("turn", F.lit(turn)), "listed")


def repeated(entries: DataFrame) -> DataFrame:
    """entries (h, u, place) -> those whose h others have too: one shuffle of small rows, in which equal ones come to lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, met = None, False  # the last row so far, and whether the one before it is like it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            h = rows.column(0).to_numpy()
            alike = h[1:] == h[:-1]
            keep = np.concatenate([[met], alike]) | np.concatenate([alike, [False]])
            yield rows.slice(0, len(h) - 1).filter(pa.array(keep[:-1]))
            held, met = rows.slice(len(h) - 1), bool(keep[-1])
        if held is not None and met:
            yield held

    return entries.repartition("h").sortWithinPartitions("h").mapInArrow(run, entries.schema)


def bounded(side: DataFrame) -> DataFrame:
    """The side of a join, broadcast only if its rows are few."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def semi(left: DataFrame, right: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    return left.join(bounded(right), on, how)


def index(docs: DataFrame, lists: DataFrame, common_postings: int, revisions: int = REVISIONS) -> DataFrame:
    """The prefix entries that occur in more than one document, under one order of all shingles, and the share of its prefix that each document has here.

    lists are deleted."""
    spark, common, last = docs.sparkSession, np.zeros(0, np.int64), 0
    entry = lambda: lists.select("u", F.posexplode("hs").alias("place", "h")).select("h", "u", "place")
    known = lambda: bounded(spark.createDataFrame(pa.table({"h": pa.array(common), "common": pa.array(np.ones(len(common), np.int32))}).to_pandas(), "h bigint, common int"))
    facts, shared = lists.select("u", "turn", "id", "size", *SKETCH), materialize(repeated(entry()), "shared")
    for turn in range(1, revisions + 1):
        room = BROADCAST_ROWS - len(common)  # the rest keeps its place in the order
        counts = shared.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > common_postings)
        if len(common):
            counts = counts.join(known(), "h", "left_anti")
        fresh = [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(room).select("h").collect()]
        if not fresh:
            break
        common, last = np.union1d(common, np.array(fresh, np.int64)), turn
        # these need more than they have to spare, and are listed again
        gone = shared.join(known(), "h", "left_semi").groupBy("u").agg(F.count("*").alias("gone"))
        short = gone.join(lists.select("u", "id", "size", F.size("hs").alias("has")), "u").filter(f"has - gone < {NEEDED}")
        short = materialize(short.select("id").distinct(), "short")
        if short.isEmpty():
            break
        old, former = shared, lists
        fixed = listed(semi(docs, short, "id").select("id", "text"), common, turn)
        lists = materialize(semi(lists, short, "id", "left_anti").unionByName(fixed), "listed")
        facts, shared = lists.select("u", "turn", "id", "size", *SKETCH), materialize(repeated(entry()), "shared")
        discard(old, former, fixed, short)
    found = shared
    if len(common):
        found = found.join(known(), "h", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    else:
        found = found.withColumn("common", F.lit(0))
    of = Window.partitionBy("u")
    # of those that were not listed under the last order, the common ones go to the end, beyond what is needed
    before = F.when(F.col("turn") < last, F.sum("common").over(of.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))).otherwise(0)
    found = found.join(facts.hint("merge"), "u").withColumn("place", (F.col("place") - before).cast("int"))
    found = found.filter(f"place < {NEEDED} and (turn = {last} or common = 0)")
    # the share of a prefix that others have too: the text that a group was copied from has most of it, an edited copy loses some
    found = materialize(found.withColumn("shared", F.count("*").over(of) / F.expr(NEEDED)).select("id", "size", "place", "h", *SKETCH, "shared"), "entries")
    discard(shared, lists)
    return found


def reachable(a: str, b: str):
    """May the documents share enough, if this is the first shingle they share?"""
    most = F.least(F.expr(f"{a}.size - {a}.place"), F.expr(f"{b}.size - {b}.place"))
    both = F.expr(f"{a}.size + {b}.size")
    differ = F.expr(" + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in SKETCH))
    return (9 * most >= 4 * both) & (9 * differ <= both)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies. The texts of a come first in their lot and are not repeated; one of many partners has several lots."""
    kind = docs.dtypes[0][1]
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > LOT)
    lots = F.coalesce(F.ceil(F.col("n") / LOT), F.lit(1))
    pairs = pairs.join(bounded(many), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), lots).cast("int").alias("lot"))
    firsts, seconds = pairs.select(F.col("a").alias("id"), "lot").distinct(), pairs.select(F.col("b").alias("id"), "a", "lot")
    own = docs.join(bounded(firsts), "id").select(F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "lot", "text")
    other = docs.join(bounded(seconds), "id").select("a", F.col("id").alias("b"), "lot", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, set()
        for batch in batches:
            keep = []
            for k, (a, b, _, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if b is None:
                    at, mine = a, shingles(text)
                elif a == at and similar(mine, shingles(text)):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    dealt = own.unionByName(other).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def hubs(entries: DataFrame) -> DataFrame:
    """entries -> (a, b): for each document b the most central document a that it shares a posting with and may be a near copy of."""
    rank = F.struct(-F.col("shared"), F.xxhash64("id"), "id").alias("rank")
    y = entries.withColumn("rank", rank)
    best = F.min(F.struct("rank", "id", "size", "place", *SKETCH)).over(Window.partitionBy("h")).alias("x")
    met = y.select(best, F.struct("id", "size", "place", *SKETCH).alias("y")).filter(F.expr("x.id != y.id") & reachable("x", "y"))
    return met.groupBy(F.col("y.id").alias("b")).agg(F.min(F.col("x.rank")).alias("r")).select(F.col("r.id").alias("a"), "b")


def candidates(pairs: DataFrame, *used: DataFrame) -> DataFrame:
    """The pairs, written; the tables they were made from, and their shuffle files, go before texts are moved."""
    found = materialize(pairs, "candidates")
    del pairs  # what is referred to keeps its shuffle files
    discard(*used)
    return found


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are near copies, written; those given are deleted."""
    found = materialize(verified(pairs, docs), "verified")
    discard(pairs)
    return found


def across(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """entries, roots (id, root) -> (a, b): all pairs of a posting that may be near copies and are not in one group yet.

    The members of the largest group of a posting are met by the others only, never by each other."""
    placed = entries.join(bounded(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # most postings are those of one group
    several = F.min("root").over(Window.partitionBy("h")) != F.max("root").over(Window.partitionBy("h"))
    placed = materialize(placed.withColumn("several", several).filter("several").drop("several"), "several")
    shares = placed.groupBy("h", "root").agg(F.count("*").alias("n"))
    main = shares.groupBy("h").agg(F.min_by("root", F.struct(-F.col("n"), "root")).alias("main"), F.count("*").alias("roots"))
    placed = materialize(placed.join(bounded(main.filter("roots > 1").drop("roots")), "h"), "placed")
    one = F.expr("x.h = y.h and x.root != y.root and (y.root = y.main or x.id < y.id)")
    met = placed.filter("root != main").alias("x").join(placed.alias("y"), one & reachable("x", "y"))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common_postings: int = COMMON) -> DataFrame:
    """id and component_id of each row that is in a group and not its least."""
    docs = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).filter("id is not null")
    lists = listed(docs, np.zeros(0, np.int64), 0)
    near = materialize(near_pairs(lists.select("id", "fp")), "near")
    entries = index(docs, lists, common_postings)
    met = hubs(entries).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = confirmed(candidates(near.unionByName(met).distinct(), near), docs)
    roots = materialize(components(first).select(F.col("node").alias("id"), "root"), "roots")
    links = confirmed(candidates(across(entries, roots), entries), docs)
    if not links.isEmpty():
        # links of groups instead of members: the components are the same, and a large group has few
        of = bounded(roots)
        for c in ("a", "b"):
            links = links.join(of.select(F.col("id").alias(c), F.col("root").alias("of")), c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
        links = links.distinct().unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        roots = materialize(components(links).select(F.col("node").alias("id"), "root"), "roots")
    return roots.withColumnRenamed("root", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each group, that with the smallest id. Rows without an id all stay."""
    goes = near_copy_groups(docs, id_col, text_col).select(F.col("id").alias(free_name(docs, "goes")))
    same = column(id_col) == column(goes.columns[0])
    return docs.join(F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes, same, "left_anti")
