r"""Removal of repeated substrings, exactly, with suffix arrays over what may repeat.

A string of ``LENGTH`` bytes, a window, has one anchor: of its ``GRAM``-byte strings the first whose hash is the least. Equal windows have
equal anchors at equal places, so an anchor's group is all that a window must be compared to. Hashes only choose what
is compared; that a window starts elsewhere too is read off a suffix array, from neighbours that share all its symbols:

* Anchors of all documents are counted by hash; those that occur once go. The bytes that the windows of one anchor cover are
  its surroundings; occurrences with equal surroundings are one kind, which folds copies before bytes are moved.
* A kind that occurs twice enters an array twice, all that its windows share, which is all of it, as one symbol.
* The other kinds of a group are compared to each other and to one of each kind that occurs twice. Windows are dealt by how
  far they start left of the anchor, in halves down to ``STARTS`` starts; the bytes that all windows of a half share are its key and become one
  symbol, so the strings of the array are short (left rest, symbol, right rest), and arrays are independent of each other.
* A group of more than ``GROUP`` kinds is halved the same way by DataFrame operations, its rows dealt by the new keys, until
  its groups are small or a single start is left, where all that share a key are one kind. No group meets in one task without a bound.

Anchors are compared by 64 bits and surroundings by 64 more; keys and the strings of arrays by their bytes.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; a row that is repeated in full
repeats every string of it; rows may share ids or have none, they are told apart by a hash of their text, and rows that agree in
both lose the same bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, column, discard, materialize, table
from .suffix_array import suffix_array

LENGTH, GRAM, GROUP = 200, 100, 1000
#: Starts that a suffix array tells apart, at most; symbols of one array, at most.
STARTS, SYMBOLS = 26, 200_000
FAR = 1 << 40
BASE = 0x9E3779B97F4A7C15
ITEM = "h bigint, c bigint, lo int, hi int, id {id}, th bigint, a bigint, lead int, bytes binary, need boolean"


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least over each window of x, by doubling."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a document's anchors, and their hashes. What a window selects depends on its bytes alone."""
    n, width = len(raw), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(1 << max(16, (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    mixed = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    least = sliding(mixed, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), width, np.maximum) == mixed)
    return at, mixed[at]


def nearest(at: np.ndarray, value: np.ndarray, reach: int, right: bool) -> np.ndarray:
    """For each of the ordered places the next one within reach on a side whose value is less (right) or not more (left); far away if none."""
    n = len(at)
    out, live, step = np.full(n, FAR if right else -FAR, np.int64), np.arange(n), 0
    while len(live):
        step += 1 if right else -1
        other = live + step
        ok = (other >= 0) & (other < n)
        live, other = live[ok], other[ok]
        ok = np.abs(at[other] - at[live]) <= reach
        live, other = live[ok], other[ok]
        hit = value[other] < value[live] if right else value[other] <= value[live]
        out[live[hit]] = at[other[hit]]
        live = live[~hit]
    return out


def owned(at: np.ndarray, value: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance before each anchor at which a window starts that is this anchor's; ends: last start of a window."""
    reach = length - gram
    first = np.maximum(at - reach, nearest(at, value, reach, False) + 1)
    last = np.minimum(np.minimum(at, ends), nearest(at, value, reach, True) - reach - 1)
    return at - last, at - first


def hash_of(raw: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed) - (1 << 63)


def part_of(raw: bytes, lead: int, lo: int, hi: int, length: int) -> tuple[bytes, int]:
    """Of bytes around an anchor, `lead` of them before it: those that windows starting lo to hi before it cover, and how many lie before the shared bytes."""
    return raw[max(0, lead - hi) : lead - lo + length], min(lead, hi) - lo


def key_of(raw: bytes, lead: int, lo: int, hi: int, length: int) -> bytes | None:
    """The bytes that all those windows share; None where they leave the document, so that none of the windows is inside."""
    return raw[lead - lo : lead - hi + length] if lead >= lo and lead - hi + length <= len(raw) else None


class Leaves:
    """Gathers short strings and tells which of their windows occur twice, from the neighbours in their suffix array."""

    def __init__(self, length: int):
        self.length = length
        self.clear()

    def clear(self) -> None:
        self.text: list[str] = []
        self.size, self.leaf, self.starts = 0, 0, []  # starts: place in text, window starts, symbols of a window, largest distance, least distance, tags

    def put(self, text: str, times: int, windows: int, symbols: int, most: int, least: int, tags: list[tuple]) -> None:
        for _ in range(times):
            self.starts.append((self.size, windows, symbols, most, least, tags))
            self.text.append(text)
            self.size += len(text)
            tags = []

    def whole(self, kinds: Iterable[tuple[int, int, int, list[tuple]]]) -> None:
        """(least and largest distance, times, tags) of strings that are equal in all their windows: one symbol says all."""
        symbol = chr(0x10000 + self.leaf) + "Ā"
        self.leaf += 1
        for least, most, times, tags in kinds:
            self.put(symbol, min(times, 2), 1, 1, most, least, tags)

    def add(self, lo: int, hi: int, strings: Iterable[tuple[bytes, int, int, list[tuple]]]) -> None:
        """(bytes, how many lie before the shared ones, times, tags) of different strings that share the bytes of a key."""
        shared = self.length - (hi - lo)
        symbol = chr(0x10000 + self.leaf)  # one for each leaf, so that strings of two leaves have no window in common
        self.leaf += 1
        for part, left, times, tags in strings:
            text = part[:left].decode("latin-1") + symbol + part[left + shared :].decode("latin-1") + "Ā"
            windows = min(left + 1, len(text) - 1 - (hi - lo))
            if windows > 0:
                self.put(text, min(times, 2), windows, hi - lo + 1, left + lo, left + lo - windows + 1, tags)

    def repeated(self) -> Iterator[tuple[tuple, int, int]]:
        """(tag, least and largest distance before the anchor) of each run of windows that start elsewhere too."""
        text = "".join(self.text)
        codes = {c: i for i, c in enumerate(sorted(set(text)))}
        order = suffix_array([codes[c] for c in text])
        owner = np.full(len(text), -1, np.int64)
        for k, (at, windows, *_) in enumerate(self.starts):
            owner[at : at + windows] = k
        twice = np.zeros(len(text), bool)
        own = owner.tolist()
        for p, q in zip(order, order[1:], strict=False):
            if own[p] >= 0 and own[q] >= 0:
                size = self.starts[own[p]][2]
                if size == self.starts[own[q]][2] and text[p : p + size] == text[q : q + size]:
                    twice[p] = twice[q] = True
        at = np.flatnonzero(twice)
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0)) + 1
        firsts, lasts = at[np.concatenate([[0], breaks])].tolist() if len(at) else [], at[np.concatenate([breaks - 1, [len(at) - 1]])].tolist() if len(at) else []
        for first, last in zip(firsts, lasts, strict=True):
            start, windows, _, most, least, tags = self.starts[own[first]]
            # a symbol that says all stands for windows from least to most
            one = windows == 1
            for tag in tags:
                yield tag, least if one else most - (last - start), most if one else most - (first - start)
        self.clear()


def settle(group: list[tuple[bytes, int, tuple | None]], lo: int, hi: int, length: int, leaves: Leaves) -> None:
    """Members of a group that share a key (bytes, how many before the anchor, tag; none: only a partner) go to leaves, all that some window of theirs may equal."""
    todo = [(lo, hi, group)]
    while todo:
        lo, hi, group = todo.pop()
        kinds: dict[tuple[bytes, int], list] = defaultdict(list)
        for member in group:
            part, left = part_of(member[0], member[1], lo, hi, length)
            if len(part) >= length:
                kinds[part, left].append(member)
        tags = {k: [m[2] for m in members if m[2] is not None] for k, members in kinds.items()}
        if not any(tags.values()):
            continue
        if len(kinds) == 1:
            (part, left), members = next(iter(kinds.items()))
            if len(members) > 1:
                most, least = left + lo, max(lo, left + lo + length - len(part))
                leaves.whole([(least, most, len(members), tags[part, left])])
            continue
        if hi - lo < STARTS:
            leaves.add(lo, hi, [(part, left, len(members), tags[part, left]) for (part, left), members in kinds.items()])
            continue
        middle = (lo + hi) // 2
        for low, high in ((lo, middle), (middle + 1, hi)):
            halves: dict[bytes, list] = defaultdict(list)
            for member in group:
                key = key_of(member[0], member[1], low, high, length)
                if key is not None:
                    halves[key].append(member)
            todo += [(low, high, members) for members in halves.values() if len(members) > 1]


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each anchor of each document that has a window: hashes of it and of its surroundings, where it is, and its windows' distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, 256):
                raws = [batch.column(2)[k].as_buffer().to_pybytes() for k in range(start, min(start + 256, batch.num_rows))]
                found = [anchors(raw, length, gram) for raw in raws]
                row = np.repeat(np.arange(len(raws)), [len(at) for at, _ in found])
                sizes = np.fromiter(map(len, raws), np.int64, len(raws))
                # documents one after another, out of each other's reach
                base = np.cumsum(sizes + length) - sizes - length
                at, h = np.concatenate([at for at, _ in found]), np.concatenate([h for _, h in found])
                lo, hi = owned(at + base[row], h, (sizes - length + base)[row], length, gram)
                hi = np.minimum(hi, at)
                some = lo <= hi
                h, at, row, lo, hi = h[some], at[some], row[some], lo[some], hi[some]
                c = [hash_of(raws[k][a - m : a - n + length], m) for k, a, n, m in zip(row.tolist(), at.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                here = pa.array(row + start)
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(c, pa.int64()), ids.take(here), hashes.take(here), pa.array(at), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                    ["h", "c", "id", "th", "a", "lo", "hi"],
                )

    return docs.mapInArrow(run, f"h bigint, c bigint, id {docs.dtypes[0][1]}, th bigint, a bigint, lo int, hi int")


def classify(rows: DataFrame, tag: str) -> DataFrame:
    """rows (h, c, id, th, a, ...) that share their h: with full (c occurs twice) and open (h has other c), and need.

    Of a kind that occurs twice in an h with others, one row stays open, as the others' partner. Rows alone go.
    """
    kinds = rows.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("id", "th", "a")).alias("one"))
    kinds = materialize(kinds, tag)
    heads = kinds.groupBy("h").agg(F.sum("m").alias("all"), F.count("*").alias("kinds"), F.min("m").alias("least")).filter("all > 1")
    live = kinds.join(heads, "h").filter((F.col("m") > 1) | (F.col("kinds") > 1))
    mixed = (F.col("kinds") > 1) & (F.col("least") == 1)
    # the hot kinds are on the left, which Spark splits; each (h, c) is on the right once
    live = live.select("h", "c", (F.col("m") > 1).alias("full"), mixed.alias("mixed"), "one", F.col("kinds"))
    joined = rows.join(live, ["h", "c"])
    me = F.struct("id", "th", "a").eqNullSafe(F.col("one"))
    opened = F.col("mixed") & (~F.col("full") | me)
    return joined.withColumn("open", opened).withColumn("need", ~F.col("full")).filter(F.col("full") | F.col("open")).drop("mixed", "one")


def deal(docs: DataFrame, found: DataFrame, columns: list[Column], how: str = "left") -> DataFrame:
    """docs with found's different rows of the same document gathered in `found`, a list (null: none). A document has at most as many as bytes."""
    lists = materialize(found.groupBy("id", "th").agg(F.collect_set(F.struct(*columns)).alias("found")), "lists")
    rows, total = lists.agg(F.count("*"), F.sum(F.size("found"))).first()
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))
    lists = lists.select(F.col("id").alias("id_"), F.col("th").alias("th_"), "found")
    if (total or 0) <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    elif how == "inner" and rows <= BROADCAST_ROWS:
        # texts without a list needn't move
        docs = docs.join(F.broadcast(lists.select("id_", "th_")), same, "left_semi")
    return docs.join(lists, same, how).drop("id_", "th_")


def fetch(docs: DataFrame, opened: DataFrame, length: int, gram: int) -> DataFrame:
    """The surroundings of one anchor of each open kind."""
    kind = docs.dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, items in enumerate(batch.column(3).to_pylist()):
                raw = batch.column(2)[k].as_buffer().to_pybytes() if items else b""
                for x in items or ():
                    a, lead = x["a"], x["hi"]
                    out.append((x["h"], x["c"], k, a, lead, raw[a - lead : a - x["lo"] + length], x["need"]))
            if out:
                h, c, k, a, lead, raw, need = zip(*out, strict=True)
                k = pa.array(k)
                yield pa.record_batch(
                    [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array([0] * len(h), pa.int32()), pa.array([length - gram] * len(h), pa.int32()),
                     batch.column(0).take(k), batch.column(1).take(k), pa.array(a, pa.int64()), pa.array(lead, pa.int32()), pa.array(raw, pa.binary()), pa.array(need)],
                    ["h", "c", "lo", "hi", "id", "th", "a", "lead", "bytes", "need"],
                )

    rows = deal(docs, opened, [F.col(c) for c in ("h", "c", "a", "lo", "hi", "need")], "inner").select("id", "th", "raw", "found")
    return rows.mapInArrow(run, ITEM.format(id=kind))


def halve(items: DataFrame, length: int) -> DataFrame:
    """Each item under the keys of its two halves."""
    names = ["h", "c", "lo", "hi", "id", "th", "a", "lead", "bytes", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("h", "c", "lo", "hi", "k")}
            for k, (lo, hi, lead, raw) in enumerate(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("lo", "hi", "lead", "bytes")), strict=True)):
                middle = (lo + hi) // 2
                for low, high in ((lo, middle), (middle + 1, hi)):
                    key = key_of(raw, lead, low, high, length)
                    part, left = part_of(raw, lead, low, high, length)
                    if key is not None and len(part) >= length:
                        for n, v in zip(out, (hash_of(key, 1000 * low + high), hash_of(part, left), low, high, k), strict=True):
                            out[n].append(v)
            kept = batch.take(pa.array(out["k"], pa.int64()))
            made = {"h": pa.int64(), "c": pa.int64(), "lo": pa.int32(), "hi": pa.int32()}
            yield pa.record_batch([pa.array(out[n], made[n]) if n in made else kept.column(kept.schema.get_field_index(n)) for n in names], names)

    return items.select(names).mapInArrow(run, ITEM.format(id=dict(items.dtypes)["id"]))


def settle_whole(kinds: DataFrame, length: int) -> DataFrame:
    """kinds (lo, hi, m and others) that occur m times -> the others and s, e, from the anchor on, of repeated bytes."""
    others = [f for f in kinds.schema if f.name not in ("lo", "hi", "m")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = Leaves(length)
        for batch in batches:
            lo, hi, m = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("lo", "hi", "m"))
            for at in range(0, batch.num_rows, SYMBOLS // 4):
                for k in range(at, min(at + SYMBOLS // 4, batch.num_rows)):
                    leaves.whole([(lo[k], hi[k], m[k], [(k,)])])
                found = list(leaves.repeated()) if leaves.size else []
                rows = pa.array([t[0] for t, _, _ in found], pa.int64())
                made = [pa.array([-most for _, _, most in found], pa.int64()), pa.array([length - least for _, least, _ in found], pa.int64())]
                yield pa.record_batch([*(batch.column(batch.schema.get_field_index(f.name)).take(rows) for f in others), *made], [*(f.name for f in others), "s", "e"])

    return kinds.mapInArrow(run, T.StructType([*others, T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def settle_groups(items: DataFrame, length: int) -> DataFrame:
    """Groups of bounded size -> (id, th, s, e) of repeated bytes. A task reads its groups one after another."""
    kind = dict(items.dtypes)["id"]
    names = ("h", "lo", "hi", "id", "th", "a", "lead", "bytes", "need")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, group, last = Leaves(length), [], None

        def emit() -> pa.RecordBatch:
            # tags: (id, th, a)
            rows = [(t[0], t[1], t[2] - most, t[2] - least + length) for t, least, most in leaves.repeated()] if leaves.size else []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            return pa.record_batch([pa.array(columns[0], kinds), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", "th", "s", "e"])

        kinds = None
        for batch in batches:
            kinds = batch.schema.field("id").type
            for h, lo, hi, i, th, a, lead, raw, need in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if (h, lo, hi) != last:
                    if len(group) > 1:
                        settle(group, last[1], last[2], length, leaves)
                        if leaves.size > SYMBOLS:
                            yield emit()
                    group, last = [], (h, lo, hi)
                group.append((raw, lead, (i, th, a) if need else None))
        if kinds is not None:
            if len(group) > 1:
                settle(group, last[1], last[2], length, leaves)
            yield emit()

    dealt = items.repartition("h").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(run, f"id {kind}, th bigint, s bigint, e bigint")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, list[DataFrame]]:
    """docs (id, th, raw) -> (id, th, s, e): byte ranges that cover exactly the repeated bytes; and the tables that hold them."""
    every = materialize(find_anchors(docs, length, gram), "anchors")
    # most anchors are alone: they go before surroundings are compared
    twice = materialize(every.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "twice")
    found = materialize(every.join(twice, "h", "left_semi"), "found")
    discard(every, twice)
    kinds = materialize(found.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("id", "th", "a", "lo", "hi")).alias("one")), "kinds")
    heads = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("m").alias("least"))
    # the hot kinds are on the left, which Spark splits; each (h, c) is on the right once
    whole = materialize(settle_whole(kinds.filter("m > 1").select("h", "c", "m", "one.lo", "one.hi"), length), "whole")
    at = lambda c: (F.col("a") + F.col(c)).alias(c)
    ranges = found.select("h", "c", "id", "th", "a").join(whole, ["h", "c"]).select("id", "th", at("s"), at("e"))
    # groups of which every kind occurs twice have nothing to compare
    mixed = heads.filter("kinds > 1 and least = 1").select("h", "kinds")
    opened = materialize(kinds.join(mixed, "h").select("h", "c", "one.*", (F.col("m") == 1).alias("need"), "kinds"), "open")
    discard(kinds)
    made = [found, whole, opened]
    items = fetch(docs, opened, length, gram)
    sizes = opened.select("h", F.col("kinds").alias("n")).distinct()
    while True:
        items = materialize(items, "items")
        large = materialize(sizes.filter(F.col("n") > group).select("h"), "large")
        none = large.isEmpty()
        small = items if none else items.join(large, "h", "left_anti")
        made.append(materialize(settle_groups(small, length), "settled"))
        ranges = ranges.unionByName(made[-1])
        if none:
            discard(items, large)
            return ranges, made
        halves = materialize(halve(items.join(large, "h", "left_semi"), length), "halves")
        discard(items, large)
        classes = materialize(classify(halves.withColumnRenamed("need", "was"), "kinds"), "classes")
        # distances of the windows that lie within the bytes
        least = F.greatest(F.col("lo"), F.col("lead") + length - F.octet_length("bytes"))
        again = classes.filter(F.col("full") & F.col("was")).select("id", "th", "a", least.alias("lo"), F.least("hi", "lead").alias("hi"), F.lit(2).alias("m"))
        made += [materialize(settle_whole(again, length), "again"), classes]
        ranges = ranges.unionByName(made[-2].select("id", "th", at("s"), at("e")))
        discard(halves)
        items = classes.filter("open").withColumn("need", F.col("need") & F.col("was")).select("h", "c", "lo", "hi", "id", "th", "a", "lead", "bytes", "need")
        sizes = items.groupBy("h").agg(F.count("*").alias("n"))


def cut_ranges(docs: DataFrame, ranges: DataFrame, made: list[DataFrame], keep_text: bool = False) -> DataFrame:
    """docs (id, th, raw) and ranges, which the tables of made hold and go with -> id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, found in enumerate(batch.column(2).to_pylist()):
                raw = batch.column(1)[k].as_buffer().to_pybytes()
                parts, at, spans, end = [], 0, 0, -1
                for s, e in sorted((x["s"], min(x["e"], len(raw))) for x in found or ()):
                    if s > end:
                        spans += 1
                        parts.append(raw[at:s])
                    at = end = max(end, e)
                kept = b"".join([*parts, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            n = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            yield pa.record_batch([batch.column(0), *n, pa.array([x[3] for x in out], pa.string()), pa.array([x[4] for x in out], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = deal(docs, ranges, [F.col("s"), F.col("e")]).select("id", "raw", "found")
    discard(*made)
    return rows.mapInArrow(run, f"id {docs.dtypes[0][1]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def byte_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(column(text_col), F.lit(""))
    return docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("th"), F.encode(text, "UTF-8").alias("raw"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, group: int = GROUP, keep_text: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of each row."""
    rows = byte_rows(docs, id_col, text_col)
    return cut_ranges(rows, *repeated_ranges(rows, length, gram or length // 2, group), keep_text)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
