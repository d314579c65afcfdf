r"""Quality rules: base counts, and how far a document lies from its language, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared to those of its language by
Jensen-Shannon distance (base 2, 0 to 1). A language is the documents of one ``lang``; its references are the sums over all of
them, and its common words its ``COMMON`` most frequent ones of ``SHORT`` letters at most, counted over all documents in lower case and without
the marks around them. A document without ``lang``, or of one with fewer than ``MIN_DOCS`` documents, is compared to all documents.

Limits: character classes may lie ``MAX_CLASS_DISTANCE`` apart, from ``MIN_WORDS`` words on; common words less than ``MAX_WORD_SHARE`` of how far a text
without any common word lies from the same reference, from so many words on that ``MIN_COMMON`` common ones are to be expected. Shorter histograms are noise.
So a language written without blanks, whose "words" hardly repeat, is not judged by them.

Defined cases: null or blank texts have no words and fail the base rules; an empty table gives an empty report; of words
equally frequent the first in order is the more common; a distance at a limit of classes passes, at that of words fails; repeated
rows are judged alike; other columns are passed through as they are, whatever their names.
Windows of five words are compared by 64-bit hash and, where hashes agree, word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, attach, column, discard, materialize, packed, table

MIN_WORDS, MIN_DOCS, MIN_COMMON, COMMON = 50, 20, 20, 16
#: A distance above the first rejects a document, as does one of the second part of the way to a text without common words, or more.
MAX_CLASS_DISTANCE, MAX_WORD_SHARE = 0.3, 0.8
BASE_WORDS, REPEAT_PERCENT = 10, 20
#: Character classes: decimal digits, capitals, small letters, blanks, others.
CLASSES = 5
#: Words of more characters aren't counted one by one: common words are short in every language.
SHORT, LONG = 6, "-"
#: Languages are broadcast up to this many; each has COMMON words and numbers.
LANGUAGES_BROADCAST = 10_000
#: Capitals of ASCII and Latin-1 and their small letters: the same in every engine.
CAPITALS = "".join(chr(c) for c in (*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)))
SMALL = "".join(chr(ord(c) + 32) for c in CAPITALS)
#: What lies between words, for their histogram: all ASCII but letters.
BETWEEN = "".join(chr(c) for c in range(1, 128) if not chr(c).isalpha())


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """The words for their histogram, some of them empty."""
    return F.split(F.translate(text, CAPITALS + BETWEEN, SMALL + " " * len(BETWEEN)), " ")


def base_counts(docs: DataFrame, text: str) -> DataFrame:
    """docs with the struct columns that the rules need. One pass, no shuffle."""
    out = docs.withColumn("words", words_of(F.col(text))).withColumn("n_words", F.size("words"))
    out = out.withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.sequence(F.lit(0), F.greatest(F.col("n_words") - 5, F.lit(0)))
    hashed = F.transform(windows, lambda i: F.xxhash64(*(F.get("word_hashes", i + k) for k in range(5))))
    out = out.withColumn("hashes", F.when(F.col("n_words") >= 5, hashed).otherwise(F.array().cast("array<bigint>")))
    # most documents repeat no window: only the others are sorted
    out = out.withColumn("twice", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    pairs = F.sort_array(F.zip_with("hashes", F.sequence(F.lit(1), F.size("hashes")), lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("i"))))
    out = out.withColumn("sorted", F.when(F.col("twice"), pairs))
    same = lambda i, j: (
        (F.element_at("sorted", i)["h"] == F.element_at("sorted", j)["h"])
        & (F.slice("words", F.element_at("sorted", i)["i"], 5) == F.slice("words", F.element_at("sorted", j)["i"], 5))
    )
    last = F.size("sorted")
    hit = lambda i: F.when(i > 1, same(i, F.greatest(i - 1, F.lit(1)))).otherwise(False) | F.when(i < last, same(i, F.least(i + 1, last))).otherwise(False)
    found = F.filter(F.sequence(F.lit(1), last), hit)
    out = out.withColumn("starts", F.when(F.col("twice"), F.array_sort(F.transform(found, lambda i: F.element_at("sorted", i)["i"]))))
    # windows overlap: each start covers up to the next one, five words at most
    gaps = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    repeat = F.when(F.col("twice") & (F.size("starts") > 0), F.aggregate(gaps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("n_repeat_words", repeat).withColumn("lines", lines)
    return out.withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).withColumn("word_chars", F.length(F.array_join("words", "")))


def class_counts(df: DataFrame, text: str) -> DataFrame:
    """df with counts of characters by class; the mask of a text has a letter for each class but blanks."""
    masked = df.withColumn("masked", F.mask(F.col(text), F.lit("A"), F.lit("a"), F.lit("0"), F.lit(".")))
    times = lambda m: F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(m), F.lit("")))
    out = masked.withColumn("some", F.array(times("0"), times("A"), times(".")))
    small = F.length("masked") - F.col("some")[0] - F.col("some")[1] - F.col("some")[2]
    blanks = F.length(text) - F.col("word_chars")
    others = F.col("word_chars") - F.col("some")[0] - F.col("some")[1] - small
    return out.withColumn("classes", F.array(F.col("some")[0], F.col("some")[1], small, blanks, others))


def common_words(rows: DataFrame, min_docs: int, common: int) -> tuple[DataFrame, tuple[list[str], list[float]]]:
    """lang, own_words and own_common (how often each occurs, and all others) of each language; and both for all documents."""
    langs = rows.groupBy("lang").agg(F.count("*").alias("docs")).filter((F.col("docs") >= min_docs) & F.col("lang").isNotNull()).select("lang")
    words = rows.select("lang", F.explode(plain_words(F.col("text"))).alias("word")).filter("word != ''")
    counts = materialize(words.withColumn("word", F.when(F.length("word") <= SHORT, F.col("word")).otherwise(LONG)).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    short = counts.filter(F.col("word") != LONG)
    # limited within each partition before anything is shuffled by language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = short.filter("lang is not null").withColumn("k", place).filter(F.col("k") <= common)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "n"))).alias("top"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    sums = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)
    own = top.join(totals, "lang").join(langs, "lang")
    own = own.select("lang", F.col("top.word").alias("own_words"), F.concat("top.n", F.array(F.col("total") - sums(F.col("top.n")))).cast("array<double>").alias("own_common"))
    own = materialize(own, "references")
    every = short.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(common).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    pooled = [r["word"] for r in every], [*(float(r["n"]) for r in every), float(total - sum(r["n"] for r in every))]
    discard(counts)
    return own, pooled


def entropy_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; 0 where either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ta, tb = total(a), total(b)
    share = F.zip_with(F.transform(a, lambda v: v / ta), F.transform(b, lambda v: v / tb), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    term = lambda s, x: s + (entropy_term(x["p"], (x["p"] + x["q"]) / 2) + entropy_term(x["q"], (x["p"] + x["q"]) / 2)) / 2
    return F.when((ta > 0) & (tb > 0), F.sqrt(F.greatest(F.aggregate(share, F.lit(0.0), term), F.lit(0.0)))).otherwise(0.0)


def sums(prefix: str, size: int) -> list[Column]:
    return [F.sum(F.col(prefix)[i]).cast("double") for i in range(size)]


def assess(
    docs: DataFrame,
    id_cols: list[str],
    text_col: str = "text",
    lang_col: str = "lang",
    max_class: float = MAX_CLASS_DISTANCE,
    max_word: float = MAX_WORD_SHARE,
    min_words: int = MIN_WORDS,
    min_docs: int = MIN_DOCS,
    min_common: int = MIN_COMMON,
    common: int = COMMON,
) -> DataFrame:
    """A struct ``id`` of id_cols, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance and kept."""
    rows = docs.select(packed(id_cols).alias("id"), column(lang_col).alias("lang"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    own, (words, sums_of_all) = common_words(rows.select("lang", "text"), min_docs, common)
    fixed = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    found = attach(rows.withColumn("spread", F.xxhash64("id", F.length("text"))), own, "lang", "spread", LANGUAGES_BROADCAST).drop("spread")
    found = found.withColumn("own_words", F.coalesce("own_words", fixed(words, "string"))).withColumn("own_common", F.coalesce("own_common", fixed(sums_of_all, "double")))
    counted = class_counts(base_counts(found, "text"), "text").withColumn("n_symbols", F.regexp_count("text", F.lit("[#*$%&|<>]")))
    marks = "".join(chr(0x41 + i) for i in range(common + 1))
    # a document as a short string, a mark for each word: A for all but the common ones
    mark = lambda w: F.when(w == "", "").when(F.length(w) > SHORT, marks[0]).otherwise(F.lit(marks).substr(F.array_position("own_words", w).cast("int") + 1, F.lit(1)))
    marked = F.array_join(F.transform(plain_words(F.col("text")), mark), "")
    counted = counted.withColumn("marked", marked).withColumn("n_plain", F.length("marked"))
    times = lambda m: F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(m), F.lit("")))
    each = F.slice(F.array(*map(times, marks[1:])), F.lit(1), F.size("own_words"))
    counted = counted.withColumn("common", F.concat(each, F.array(times(marks[0]))))
    total = F.aggregate("own_common", F.lit(0.0), lambda s, v: s + v)
    nothing = F.concat(F.transform("own_words", lambda o: F.lit(0)), F.array(F.lit(1)))
    # so many common words are to be expected
    expected = F.col("n_plain") * (total - F.element_at("own_common", -1)) >= min_common * total
    strange = (F.col("n_words") >= min_words) & (total > 0) & expected & (F.col("word_distance") >= max_word * js_distance(nothing, F.col("own_common")))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    counted = counted.withColumn("word_distance", js_distance(F.col("common"), F.col("own_common"))).withColumn("strange", strange)
    # the second pass reads these small rows instead of the texts
    counted = materialize(counted.select("id", "lang", *(F.col(c).cast("long") for c in measures), "classes", "word_distance", "strange"), "quality")
    parts = materialize(counted.groupBy("lang").agg(F.count("*").alias("docs"), F.array(*sums("classes", CLASSES)).alias("classes")), "classes")
    whole = parts.agg(F.array(*sums("classes", CLASSES)).alias("classes")).first()["classes"]
    own = parts.filter((F.col("docs") >= min_docs) & F.col("lang").isNotNull()).select("lang", F.col("classes").alias("own_classes"))
    scored = attach(counted.withColumn("spread", F.xxhash64("id", "word_chars")), own, "lang", "spread", LANGUAGES_BROADCAST)
    scored = scored.withColumn("class_distance", js_distance(F.col("classes"), F.coalesce("own_classes", fixed([x or 0.0 for x in whole], "double"))))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    far = F.col("strange") | (F.col("n_words") >= min_words) & (F.col("class_distance") > max_class)
    return scored.select("id", *measures, failed.alias("base_failed"), "class_distance", "word_distance", (~failed & ~far).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """The rows of docs that pass."""
    return assess(docs, docs.columns, text_col, lang_col, **limits).filter("kept").select("id.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return assess(docs, ["doc_id"]).select("id.*", "*").drop("id", "class_distance", "word_distance")


OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         list_filter(string_split(translate(coalesce(text, ''), '{(CAPITALS + BETWEEN).replace(chr(39), chr(39) * 2)}', '{SMALL + ' ' * len(BETWEEN)}'), ' '), lambda x: x <> '') AS plain
  FROM documents
), wins AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n
  FROM (SELECT r, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: ws[i:i+4])) AS win FROM d WHERE len(ws) >= 5)
), again AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM wins WHERE n > 1) GROUP BY r
), big AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_DOCS}),
counts AS (SELECT lang, CASE WHEN length(w) <= {SHORT} THEN w ELSE '{LONG}' END AS w, count(*) AS n FROM (SELECT lang, unnest(plain) AS w FROM d) GROUP BY ALL),
top AS (SELECT lang, w, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS k FROM counts WHERE lang IN (FROM big) AND w <> '{LONG}' QUALIFY k <= {COMMON}),
top_all AS (SELECT w, sum(n) AS n, row_number() OVER (ORDER BY sum(n) DESC, w) AS k FROM counts WHERE w <> '{LONG}' GROUP BY w QUALIFY k <= {COMMON}),
own AS (
  SELECT lang, list(w ORDER BY k) AS words, list_append(list(n::DOUBLE ORDER BY k), ((SELECT sum(n) FROM counts c WHERE c.lang = top.lang) - sum(n))::DOUBLE) AS wref FROM top GROUP BY lang
), own_all AS (SELECT list(w ORDER BY k) AS words, list_append(list(n::DOUBLE ORDER BY k), ((SELECT sum(n) FROM counts) - sum(n))::DOUBLE) AS wref FROM top_all),
m AS (
  SELECT d.r, doc_id, d.lang, t, ws, plain, coalesce(own.words, p.words) AS words, coalesce(own.wref, p.wref) AS wref, len(ws) AS n_words, length(list_aggregate(list_concat([''], ws), 'string_agg', '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM d LEFT JOIN again USING (r) LEFT JOIN own ON own.lang = d.lang LEFT JOIN own_all p ON true
), c AS (
  SELECT *, list_transform(['\\p{{Nd}}', '\\p{{Lu}}', '\\p{{Ll}}'], lambda x: length(t) - length(regexp_replace(t, x, '', 'g'))) AS counted,
         list_transform(words, lambda x: len(list_filter(plain, lambda y: y = x))) AS known
  FROM m
), h AS (
  SELECT *, list_concat(counted, [length(t) - word_chars, word_chars - list_sum(counted)])::DOUBLE[] AS classes, list_concat(known, [len(plain) - list_sum(known)])::DOUBLE[] AS common,
         list_concat(list_transform(words, lambda x: 0), [1])::DOUBLE[] AS nothing FROM c
), cells AS (SELECT lang, unnest(range(1, len(classes) + 1)) AS i, unnest(classes) AS v FROM h),
refs AS (SELECT lang, list(v ORDER BY i) AS ref FROM (SELECT lang, i, sum(v) AS v FROM cells WHERE lang IN (FROM big) GROUP BY ALL) GROUP BY ALL),
pooled AS (SELECT list(v ORDER BY i) AS ref FROM (SELECT i, sum(v) AS v FROM cells GROUP BY ALL)),
paired AS (SELECT h.*, coalesce(a.ref, b.ref) AS cref FROM h LEFT JOIN refs a ON a.lang = h.lang LEFT JOIN pooled b ON true),
far AS (SELECT *, <class> AS class_distance, <word> AS word_distance, <nothing> AS least FROM paired)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND (class_distance > {MAX_CLASS_DISTANCE}
         OR coalesce(list_sum(wref) > 0 AND len(plain) * (list_sum(wref) - wref[-1]) >= {MIN_COMMON} * list_sum(wref) AND word_distance >= {MAX_WORD_SHARE} * least, false))) AS kept
FROM (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM far)
"""
DISTANCE_SQL = """CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda x:
  (CASE WHEN x[1] > 0 THEN x[1] / list_sum({a}) * log2(x[1] / list_sum({a}) / ((x[1] / list_sum({a}) + x[2] / list_sum({b})) / 2)) ELSE 0 END
 + CASE WHEN x[2] > 0 THEN x[2] / list_sum({b}) * log2(x[2] / list_sum({b}) / ((x[1] / list_sum({a}) + x[2] / list_sum({b})) / 2)) ELSE 0 END) / 2)), 0)) ELSE 0 END"""
OP9_SQL = OP9_SQL.replace("<class>", DISTANCE_SQL.format(a="classes", b="cref")).replace("<word>", DISTANCE_SQL.format(a="common", b="wref")).replace("<nothing>", DISTANCE_SQL.format(a="nothing", b="wref"))
