"""One-to-one pseudonyms: text tokens under widths, integers of a shared range, one calendar offset.

Tokens are random from the operating system's generator only. Whatever was drawn is written before it is used: a
lineage that drew again on a retry would give one original two pseudonyms.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import ALPHABET, LONGEST_NATIVE, MAX_COUNT, is_safe, token_of
from ..plans.errors import EngineError
from ..sources.shared import materialize
from .observe import stacked
from .ranks import dense_index

#: Text domains whose tokens up to the tight width number at most this many are solved on the driver.
TIGHT = 200_000


@dataclass(frozen=True)
class WidthFacts:
    """Per width or length, from three grouped counts: originals, persisted tokens, originals that are tokens themselves."""

    originals: dict[int, int]
    occupied: dict[int, int]
    reserved: dict[int, int]
    base: int

    def total(self, length: int) -> int:
        return min(self.base**length, MAX_COUNT) - self.occupied.get(length, 0)

    def free(self, length: int) -> int:
        return self.total(length) - self.reserved.get(length, 0)

    def up_to(self, counts: Callable[[int], int], width: int) -> int:
        return min(sum(counts(k) for k in range(1, width + 1)), MAX_COUNT)

    def fungible(self) -> bool:
        """Each original finds a token that is nobody's own."""
        need = 0
        for width in sorted(self.originals):
            need += self.originals[width]
            if need > self.up_to(self.free, width):
                return False
        return True

    def feasible(self, own: list[tuple[int, int]]) -> bool:
        """own: (length, width) of originals that are free tokens which they could get themselves. Exact, by Hall's condition."""
        need, upto = 0, {}
        for width in range(0, max(self.originals, default=0) + 1):
            need += self.originals.get(width, 0)
            upto[width] = need
            if need > self.up_to(self.total, width):
                return False
        return all(upto.get(length - 1, need) + 1 <= self.up_to(self.total, width) - 1 for length, width in own)


def width_facts(observed: DataFrame, occupied: DataFrame, alphabet: str = ALPHABET) -> WidthFacts:
    """observed: value, min_width; occupied: token. Widths are at most 254, so what is collected is small."""
    count = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).agg(F.count("*")).collect()}
    safe = observed.filter(is_safe(F.col("value"), alphabet)).join(occupied.select(F.col("token").alias("value")), "value", "left_anti")
    return WidthFacts(count(observed, F.col("min_width")), count(occupied, F.length("token")), count(safe, F.length("value")), len(alphabet))


def length_classes(facts: WidthFacts, needed: int) -> list[tuple[int, int, int]]:
    """(length, first position, end): originals by (width, bytes) fill the shortest tokens first."""
    out, at, longest = [], 0, max(facts.originals, default=0)
    for length in range(1, longest + 1):
        if at >= needed:
            break
        take = min(facts.free(length), needed - at)
        if take > 0:
            out.append((length, at, at + take))
            at += take
    return out


def random_keys(df: DataFrame) -> DataFrame:
    """df with a random 64-bit column r, from the operating system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.frombuffer(secrets.token_bytes(8 * batch.num_rows), np.int64)
            yield pa.record_batch([*batch.columns, pa.array(drawn)], [*batch.schema.names, "r"])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("r", T.LongType())]))


def draw_tokens(count: int, length: int, alphabet: str, spark: SparkSession) -> DataFrame:
    """count random tokens of one length, not yet distinct."""
    base = len(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, parts = batch.num_rows * length, []
            while need > 0:
                # bytes beyond the last whole multiple of the base would make some characters more likely
                raw = np.frombuffer(secrets.token_bytes(need + need // 4 + 16), np.uint8)
                parts.append(raw[raw < 256 // base * base][:need] % base)
                need -= len(parts[-1])
            letters = np.array(list(alphabet))[np.concatenate(parts)] if parts else np.zeros(0, "U1")
            yield pa.record_batch([pa.array(letters.view(f"U{length}").tolist(), pa.string())], ["token"])

    return spark.range(count).mapInArrow(run, "token string")


def fresh_tokens(count: int, length: int, blocked: DataFrame, alphabet: str, spark: SparkSession) -> DataFrame:
    """count distinct random tokens of one length outside blocked (token), as j, token with j from 0.

    Where half the free tokens or more are wanted, all free ones are shuffled; else tokens are drawn, and what
    collides is drawn again.
    """
    own = blocked.filter(F.length("token") == length).select("token")
    space = len(alphabet) ** length
    if length <= LONGEST_NATIVE and (space <= 50_000 or 2 * count >= space - own.count()):
        every = spark.range(space).select(token_of(F.col("id"), length, alphabet).alias("token"))
        pool = materialize(random_keys(every.join(own, "token", "left_anti")), "pool")
        return dense_index(pool, "r", "token", name="j").filter(F.col("j") < count).select("j", "token")
    have, parts = 0, []
    while have < count:
        drawn = materialize(draw_tokens(count - have, length, alphabet, spark), "drawn").distinct().join(own, "token", "left_anti")
        for part in parts:
            drawn = drawn.join(part, "token", "left_anti")
        parts.append(materialize(drawn, "fresh"))
        have = sum(p.count() for p in parts)
    every = stacked(parts, spark, "token string")
    return dense_index(materialize(random_keys(every), "pool"), "r", "token", name="j").select("j", "token")


def tight_assignment(originals: list[tuple[str, int]], occupied: set[str], alphabet: str) -> dict[str, str]:
    """Exact, for few tokens: originals by width against tokens by length, then a swap for each that met itself."""
    from ..functions.tokens import token_at, token_space

    width = max(w for _, w in originals)
    random = secrets.SystemRandom()
    tokens = []
    total = token_space(width, len(alphabet))
    for length in range(1, width + 1):
        first = token_space(length - 1, len(alphabet))
        part = [t for t in (token_at(i, width, alphabet) for i in range(first, min(total, first + len(alphabet) ** length))) if t not in occupied]
        random.shuffle(part)
        tokens += part
        if len(tokens) >= len(originals) + 2 and length >= max((len(o) for o, _ in originals if len(o) <= width), default=0):
            break
    order = sorted(originals, key=lambda x: x[1])
    if len(tokens) < len(order):
        raise EngineError("MAPPING_CAPACITY_EXHAUSTED")
    given = tokens[: len(order)]
    spare = tokens[len(order) :]
    for k, (value, w) in enumerate(order):
        if len(given[k]) > w:
            raise EngineError("MAPPING_CAPACITY_EXHAUSTED")
    for k, (value, w) in enumerate(order):
        if given[k] != value:
            continue
        swap = next((s for s, t in enumerate(spare) if len(t) <= w), None)
        if swap is not None:
            given[k], spare[swap] = spare[swap], given[k]
            continue
        # the other gets this token, so it must have room for it, and its own must fit here
        other = next((j for j, (v, room) in enumerate(order) if j != k and room >= len(value) and len(given[j]) <= w and v != value), None)
        if other is None:
            raise EngineError("MAPPING_CONSTRAINT_INFEASIBLE")
        given[k], given[other] = given[other], given[k]
    return {v: t for (v, _), t in zip(order, given, strict=True)}


def allocate_text(observed: DataFrame, mapped: DataFrame, alphabet: str = ALPHABET) -> DataFrame:
    """observed (value, min_width), mapped (value, token: persisted) -> value, token for all observed.

    Persisted pairs are reused first, and must still fit. The rest is solved exactly: by length classes where
    there is room beside everybody's own value, else on the driver for a token space of bounded size.
    """
    spark = observed.sparkSession
    mapped = mapped.select("value", "token")
    reused = observed.join(mapped, "value")
    if not reused.filter(F.length("token") > F.col("min_width")).isEmpty():
        raise EngineError("MAPPING_CONSTRAINT_INFEASIBLE", "PERSISTED_TOKEN_TOO_LONG")
    rest = materialize(observed.join(mapped, "value", "left_anti"), "residual")
    facts = width_facts(rest, mapped, alphabet)
    needed = sum(facts.originals.values())
    done = reused.select("value", "token")
    if not needed:
        return done
    if not alphabet:
        raise EngineError("MAPPING_CAPACITY_EXHAUSTED", "NO_COMMON_ALPHABET")
    if not facts.fungible():
        return done.unionByName(tight_text(rest, mapped, facts, alphabet))
    # only tokens that some original is, or that are persisted, are blocked: self-assignment can't happen
    blocked = materialize(mapped.select("token").unionByName(rest.filter(is_safe(F.col("value"), alphabet)).select(F.col("value").alias("token"))).distinct(), "blocked")
    ranked = dense_index(rest, "min_width", F.encode("value", "UTF-8"))
    parts = []
    for length, first, end in length_classes(facts, needed):
        tokens = fresh_tokens(end - first, length, blocked, alphabet, spark).withColumn("k", F.col("j") + first)
        parts.append(ranked.filter(F.col("k").between(first, end - 1)).join(tokens.select("k", "token").hint("merge"), "k").select("value", "token"))
    return done.unionByName(stacked(parts, spark, "value string, token string"))


def tight_text(rest: DataFrame, mapped: DataFrame, facts: WidthFacts, alphabet: str) -> DataFrame:
    own = [
        (r[0], r[1])
        for r in rest.filter(is_safe(F.col("value"), alphabet) & (F.length("value") <= F.col("min_width")))
        .join(mapped.select(F.col("token").alias("value")), "value", "left_anti").select(F.length("value"), "min_width").distinct().collect()
    ]
    if not facts.feasible(own):
        need, short = 0, False
        for width in sorted(facts.originals):
            need += facts.originals[width]
            short |= need > facts.up_to(facts.total, width)
        raise EngineError("MAPPING_CAPACITY_EXHAUSTED" if short else "MAPPING_CONSTRAINT_INFEASIBLE")
    need, tight = 0, 0
    for width in sorted(facts.originals):
        need += facts.originals[width]
        if need > facts.up_to(facts.free, width):
            tight = width
    # originals up to the tight width share a token space that is at most twice as large as they are; wider ones follow
    inner = rest.filter(F.col("min_width") <= tight)
    taken = mapped.filter(F.length("token") <= tight).select("token")
    if inner.count() <= TIGHT and taken.count() <= TIGHT:
        found = tight_assignment([(r["value"], r["min_width"]) for r in inner.collect()], {r["token"] for r in taken.collect()}, alphabet)
        first = rest.sparkSession.createDataFrame(list(found.items()), "value string, token string")
    else:
        first = tight_by_classes(inner, taken, facts, tight, alphabet)
    outer = rest.filter(F.col("min_width") > tight)
    if outer.isEmpty():
        return first
    return first.unionByName(allocate_text(outer, mapped.unionByName(first), alphabet))


def tight_by_classes(inner: DataFrame, taken: DataFrame, facts: WidthFacts, tight: int, alphabet: str) -> DataFrame:
    """The same for a domain of any size: tokens by length class, everybody's own among them, then a swap for each that met itself.

    A random order has about one such for each class, whatever their sizes, and a swap partner is any pair whose tokens fit both ways.
    """
    spark = inner.sparkSession
    own = WidthFacts({w: n for w, n in facts.originals.items() if w <= tight}, facts.occupied, {}, facts.base)
    ranked, parts = dense_index(inner, "min_width", F.encode("value", "UTF-8")), []
    for length, first, end in length_classes(own, sum(own.originals.values())):
        tokens = fresh_tokens(end - first, length, taken, alphabet, spark).withColumn("k", F.col("j") + first)
        parts.append(ranked.filter(F.col("k").between(first, end - 1)).join(tokens.select("k", "token").hint("merge"), "k").select("value", "min_width", "token"))
    pairs = materialize(stacked(parts, spark, "value string, min_width int, token string"), "tight")
    fixed, now = pairs.filter("value = token").collect(), {}  # now: width and present token of each pair that was changed
    for r in fixed:
        value, width = r["value"], r["min_width"]
        if value in now and now[value][1] != value:
            continue
        fits = (F.length("token") <= width) & (F.col("min_width") >= len(value)) & (F.col("value") != value)
        # each swap so far changed two pairs, so one that was not is among these if there is any; a changed one counts with its present token
        others = pairs.filter(fits).orderBy(F.col("value") != F.col("token")).limit(2 * len(fixed) + 1).collect()
        found = [(o["value"], o["min_width"], o["token"]) for o in others if o["value"] not in now]
        found += [(o, w, t) for o, (w, t) in now.items() if o != value and len(t) <= width and w >= len(value)]
        if found:
            other, room, token = found[0]
            now[other] = (room, value)
        else:
            token = spare_token(pairs, now, taken, width, alphabet)
        now[value] = (width, token)
    swapped = {v: t for v, (_, t) in now.items()}
    pairs = pairs.select("value", "token")
    if not swapped:
        return pairs
    new = spark.createDataFrame(list(swapped.items()), "value string, token string")
    return pairs.join(F.broadcast(new.select("value")), "value", "left_anti").unionByName(new)


def spare_token(pairs: DataFrame, now: dict[str, tuple[int, str]], taken: DataFrame, width: int, alphabet: str) -> str:
    """A random token of at most that length which nobody has: neither taken, nor in pairs as changed by now."""
    spark = pairs.sparkSession
    changed = spark.createDataFrame([(v, t) for v, (_, t) in now.items()], "value string, token string")
    held = pairs.select("value", "token").join(F.broadcast(changed.select("value")), "value", "left_anti").select("token")
    held = materialize(held.unionByName(changed.select("token")).unionByName(taken.select("token")), "held")
    count = {r[0]: r[1] for r in held.groupBy(F.length("token")).agg(F.count("*")).collect()}
    for length in range(1, width + 1):
        if count.get(length, 0) < len(alphabet) ** length:
            return fresh_tokens(1, length, held, alphabet, spark).first()["token"]
    raise EngineError("MAPPING_CONSTRAINT_INFEASIBLE")


def numeric_feasible(low: int, high: int, originals: int, occupied: int, own_free: int) -> bool:
    """Free numbers for all, and a second one where an original could only get itself."""
    free = high - low + 1 - occupied
    return originals <= free and (not own_free or free >= 2)


def allocate_numeric(observed: DataFrame, mapped: DataFrame, low: int, high: int) -> DataFrame:
    """observed (value: canonical text), mapped (value, token: persisted) -> value, token for all observed."""
    spark = observed.sparkSession
    number = lambda c: F.col(c).cast("decimal(38,0)")
    mapped = mapped.select("value", "token")
    done = observed.join(mapped, "value")
    rest = materialize(observed.join(mapped, "value", "left_anti"), "residual")
    needed, occupied = rest.count(), mapped.count()
    if not needed:
        return done.select("value", "token")
    outside = ~number("value").between(F.lit(str(low)).cast("decimal(38,0)"), F.lit(str(high)).cast("decimal(38,0)"))
    if not rest.filter(outside).isEmpty():
        raise EngineError("MAPPING_CONSTRAINT_INFEASIBLE", "NUMERIC_KEY_OUT_OF_RANGE")
    own = rest.join(mapped.select(F.col("token").alias("value")), "value", "left_anti").count()
    if not numeric_feasible(low, high, needed, occupied, own):
        raise EngineError("MAPPING_CAPACITY_EXHAUSTED" if needed > high - low + 1 - occupied else "MAPPING_CONSTRAINT_INFEASIBLE")
    room = high - low + 1 - occupied - own
    taken = mapped.select("token")
    if room >= needed:
        # enough numbers that are nobody's own
        taken = taken.unionByName(rest.select(F.col("value").alias("token"))).distinct()
    taken = materialize(taken, "blocked")
    ranked = dense_index(rest, "value").select("k", "value")
    free = fresh_numbers(needed, low, high, taken, spark)
    pairs = materialize(ranked.join(free.withColumnRenamed("j", "k").hint("merge"), "k").select("value", "token"), "pairs")
    return done.select("value", "token").unionByName(pairs if room >= needed else without_fixed_points(pairs, taken, low, high))


def fresh_numbers(count: int, low: int, high: int, blocked: DataFrame, spark: SparkSession) -> DataFrame:
    """count distinct random integers of a range outside blocked (token, canonical text), as j, token."""
    space = high - low + 1
    if 2 * count >= space - blocked.count() or space <= 50_000:
        every = spark.range(low, high + 1).select(F.col("id").cast("string").alias("token"))
        pool = materialize(random_keys(every.join(blocked, "token", "left_anti")), "pool")
        return dense_index(pool, "r", "token", name="j").filter(F.col("j") < count).select("j", "token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([str(low + secrets.randbelow(space)) for _ in range(batch.num_rows)], pa.string())], ["token"])

    have, parts = 0, []
    while have < count:
        drawn = materialize(spark.range(count - have).mapInArrow(run, "token string"), "drawn").distinct().join(blocked, "token", "left_anti")
        for part in parts:
            drawn = drawn.join(part, "token", "left_anti")
        parts.append(materialize(drawn, "fresh"))
        have = sum(p.count() for p in parts)
    return dense_index(materialize(random_keys(stacked(parts, spark, "token string")), "pool"), "r", "token", name="j").select("j", "token")


def without_fixed_points(pairs: DataFrame, blocked: DataFrame, low: int, high: int) -> DataFrame:
    """Originals that got themselves pass their tokens on in a circle, however many they are; a single one swaps with any other pair, or takes a free number."""
    spark = pairs.sparkSession
    fixed = materialize(pairs.filter("value = token").select("value"), "fixed")
    count = fixed.count()
    if not count:
        return pairs
    if count > 1:
        placed = dense_index(fixed, "value").select("k", "value")
        new = placed.join(placed.select(F.pmod(F.col("k") - 1, F.lit(count)).alias("k"), F.col("value").alias("token")), "k").select("value", "token")
    else:
        value, partner = fixed.first()["value"], pairs.filter("value != token").first()
        if partner:
            changed = [(value, partner["token"]), (partner["value"], value)]
        else:
            taken = blocked.select("token").unionByName(fixed.select(F.col("value").alias("token"))).distinct()
            if high - low + 1 <= taken.count():
                raise EngineError("MAPPING_CONSTRAINT_INFEASIBLE")
            changed = [(value, fresh_numbers(1, low, high, taken, spark).first()["token"])]
        new = spark.createDataFrame(changed, "value string, token string")
    return pairs.join(new.select("value"), "value", "left_anti").unionByName(new)


def choose_offset(least: int | None, most: int | None, persisted: int | None = None) -> int | None:
    """Days to move all dates by: the persisted offset if it fits, else a uniform one that isn't 0; None without dates."""
    from ..functions.values import shift_interval

    interval = shift_interval(least, most)
    if interval is None:
        return persisted
    low, high = interval
    if persisted is not None:
        if not low <= persisted <= high:
            raise EngineError("MAPPING_CONSTRAINT_INFEASIBLE", "PERSISTED_OFFSET")
        return persisted
    count = high - low + 1 - (low <= 0 <= high)
    if count < 1:
        raise EngineError("MAPPING_CAPACITY_EXHAUSTED", "TEMPORAL")
    drawn = low + secrets.randbelow(count)
    return drawn + 1 if low <= 0 <= high and drawn >= 0 else drawn


def check_bijection(mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per domain: pairs, distinct originals, distinct tokens, and whether all are equal. Exact counts."""
    counts = [F.count("*").alias("pairs"), F.countDistinct("value").alias("originals"), F.countDistinct("token").alias("tokens")]
    out = mapping.groupBy(*by).agg(*counts) if by else mapping.agg(*counts)
    return out.withColumn("bijective", (F.col("pairs") == F.col("originals")) & (F.col("pairs") == F.col("tokens")))
