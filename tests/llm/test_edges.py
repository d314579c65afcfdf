"""What rows may do to an operator: no id, repeated, clashing names, ties, very long texts; and plain versions of what SQL can't say."""

import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import language_id as li
from maskwright.llm.exact_dedup import label_copies
from maskwright.llm.language_id import Logs, Scorer, fit, held_out, predict
from maskwright.llm.packing import ChunkEncoder, pack
from maskwright.llm.piece_codec import Codec, encode_digests
from maskwright.llm.quality import assess, keep_good
from maskwright.llm.secret_scan import LEDGER_SETTING, op3_secret_scan, redact, scan
from maskwright.llm.simhash import near_groups, tallied
from maskwright.llm.token_counts import Counter as TokenCounter
from maskwright.llm.token_counts import count_tokens, tokenizer_path
from maskwright.llm.url_filter import RULES, judge, rule_table

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NAMES = ["filter", "dedup", "secrets", "piece", "a.b", "n", "row", "id", "th", "text_", "found", "salt", "digest", "words", "known", "spread", "group", "length", "h"]


def odd(spark):
    """Rows without an id, repeated rows, and columns with every name that an operator might use."""
    texts = [None, "", "one two three", "one two three", "secret = abcdefgh " * 3, "the of and to in a is that " * 4, "é漢字 \U0001f9ea"]
    rows = [(i if i % 3 else None, t, "en", *range(len(NAMES))) for i, t in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", "lang string", *(f"`{n}` int" for n in NAMES)])
    return spark.createDataFrame(rows + rows[2:4], schema).repartition(2)


def passed(rows, count):
    assert len(rows) == count
    for r in rows:
        assert [r[n] for n in NAMES] == list(range(len(NAMES)))


def test_other_columns_pass(spark, tmp_path):
    rows = odd(spark)
    n = rows.count()
    passed(scan(rows, f"file://{tmp_path}/a").collect(), n)
    passed(redact(rows, f"file://{tmp_path}/b").collect(), n)
    passed(label_copies(rows).collect(), n)
    passed(judge(rows.withColumn("url", F.lit("http://a.net/x")), rule_table(spark, RULES), broadcast_verdicts=-1).collect(), n)
    passed(pack(rows, tokenizer_path("word_bpe_49k.json")).collect(), n)
    passed(keep_good(rows, min_docs=1).collect(), assess(rows, ["doc_id"], min_docs=1).filter("kept").count())
    assert scan(rows, f"file://{tmp_path}/a").columns[-1] == "_secrets" and label_copies(rows).columns[-1] == "_dedup"
    assert judge(rows.withColumn("url", F.lit(None).cast("string")), rule_table(spark, RULES)).columns[-1] == "_filter"


def test_rows_without_ids_and_repeated_rows(spark):
    rows = odd(spark)
    texts = Counter((r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect())
    byte_path, piece_path = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    own, codec = TokenCounter(byte_path), Codec(piece_path)
    want, pieces = Counter(), Counter()
    for (i, t), times in texts.items():
        want[i, len((t or "").encode()), own.count([t or ""])[0]] += times
        pieces[i, codec.digests([t or ""])[0]] += times
    assert Counter(tuple(r) for r in count_tokens(rows, byte_path).collect()) == want
    assert Counter((r[0], tuple(r)[1:]) for r in encode_digests(rows, piece_path).collect()) == pieces
    groups = near_groups(rows).collect()
    assert len(groups) == rows.count() and {r["component_id"] for r in groups if r["fp"] == 0} == {1}
    model = fit(rows)
    assert predict(rows, model).count() == rows.count()
    assert rows.filter(held_out(F.col("doc_id"))).filter("doc_id is null").count() == rows.filter("doc_id is null").count()


# language


def plain_score(model, text):
    """Language and score by the rule as it is written down, one word at a time."""
    words = ["".join(run) for run in re.findall(r"[^\W\d_]+", (text or "").lower())]
    words = [w for run in words for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in run).split()]
    if not words or not model["langs"]:
        return "und", 0.0
    logs = {kind: (model[kind].index, model[kind].dense()) for kind in ("words", "grams")}
    totals = [0.0] * len(model["langs"])
    for word in words:
        index, table = logs["words"]
        if word in index:
            scored = table[index[word]]
        else:
            index, table = logs["grams"]
            padded, found = f" {word} ", []
            for i in range(len(padded)):
                longest = next((k for k in range(4, 0, -1) if len(padded) - i >= k and padded[i : i + k] in index), None)
                if longest:
                    found.append(table[index[padded[i : i + longest]]] + (4 - longest) * math.log(0.4))
            scored = math.log(0.1) + (sum(found) / len(found) if found else np.zeros(len(totals)))
        totals = [t + s for t, s in zip(totals, scored, strict=True)]
    means = [t / len(words) for t in totals]
    return model["langs"][means.index(max(means))], 1 / sum(math.exp(m - max(means)) for m in means)


def test_language_equals_the_plain_scorer_and_holds_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out(F.col("doc_id"))), words=500, grams=2000)
    for row in predict(spark.read.parquet(f"{SMALL}/documents.parquet"), model).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        lang, score = plain_score(model, row["text"])
        assert row["lang_pred"] == lang and abs(row["score"] - score) < 1e-9
    found = predict(docs, model).join(docs.filter(held_out(F.col("doc_id"))).filter("lang is not null"), "doc_id").filter("lang_pred != 'und'")
    right, every = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert every > 100 and right >= 0.95 * every


def test_language_letters_ties_and_many_languages(spark):
    texts = spark.createDataFrame([(0, "² ½ Ⅷ ①"), (1, "a²b"), (None, "zz"), (3, "q" * 200_000)], "doc_id long, text string")
    rows = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["xx", "aa"] * 3)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(texts, fit(rows)).collect()}
    assert found[0] == ("und", 0.0) and found[1] == found[None] == found[3] == ("aa", 0.5)
    random.seed(12)
    counts = [("".join(random.choices("abc", k=3)), random.randrange(30), random.randint(1, 9)) for _ in range(300)]
    counts = [(e, k, n) for (e, k), n in {(e, k): n for e, k, n in counts}.items()]
    logs = Logs.of(counts, 30)
    model = {"langs": [f"l{k:02}" for k in range(30)], "words": logs, "grams": logs}
    text = " ".join(e for e, _, _ in counts[:40]) + " abcabcab"
    sparse, dense = Scorer(model), Scorer(model)
    dense.word_logs = dense.gram_logs = logs.dense()
    assert len(model["langs"]) > li.DENSE and sparse.score(text)[0] == dense.score(text)[0] and abs(sparse.score(text)[1] - dense.score(text)[1]) < 1e-9
    few = fit(rows, entries=2)
    assert len(few["words"].index) == 1 and predict(spark.createDataFrame([], "doc_id long, text string"), few).count() == 0


# near duplicates


@pytest.mark.parametrize("pairs", [1 << 21, 50])
def test_tallies_count_shared_positional_bytes(pairs):
    rng = np.random.default_rng(13)
    for fixed in (0, 4, 6):
        parts = rng.integers(0, 3, (120, 8), dtype=np.uint8)
        parts[:, :fixed] = 7
        group = np.unique(parts.view(np.int64).ravel())
        same = (group.view(np.uint8).reshape(-1, 1, 8) == group.view(np.uint8).reshape(1, -1, 8)).sum(axis=2)
        want = {(i, j) for i, j in zip(*np.nonzero(same >= 5), strict=True) if i < j}
        assert {(i, j) for a, b in tallied(group, pairs=pairs) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == want


# secrets


def test_a_lasting_ledger_is_used_again(spark, tmp_path):
    spark.conf.set(LEDGER_SETTING, f"file://{tmp_path}/ledger")
    try:
        first = sorted(op3_secret_scan(spark, SMALL).collect())
        size = spark.read.parquet(f"{tmp_path}/ledger").count()
        assert sorted(op3_secret_scan(spark, SMALL).collect()) == first
        assert spark.read.parquet(f"{tmp_path}/ledger").count() == size > 0
    finally:
        spark.conf.unset(LEDGER_SETTING)


# quality


def test_quality_rejects_lists_without_common_words_and_judges_rare_languages_by_all(spark):
    random.seed(14)
    make = lambda letters: "".join(random.choices(letters, k=random.randint(4, 9)))
    common = "The of, and to in. a is that it was".split()
    prose = [" ".join(random.choice(common) if random.random() < 0.4 else make("aeioulnrst") for _ in range(120)) for _ in range(60)]
    listed = " | ".join(make("aeioulnrst") for _ in range(120))
    rows = [(i, t, "en", 0) for i, t in enumerate(prose)] + [(100, listed, "en", 0), (101, listed, None, 0), (102, prose[0], None, 0), (103, prose[1], "rare", 0), (104, " ".join(listed.split(" | ")[:49]), "en", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    found = {r["id"]["doc_id"]: r["kept"] for r in assess(frame, ["doc_id"]).collect()}
    assert not found[100] and not found[101] and found[102] and found[103] and found[104] and all(found[i] for i in range(60))
    assert keep_good(frame).columns == frame.columns


def test_quality_limits(spark):
    nine, ten = " ".join("abcdefghi"), " ".join("abcdefghij")
    window = "a b c d e "
    at = window * 2 + " ".join(f"w{i}" for i in range(40))  # 10 of 50 words repeat: 20 %
    rows = spark.createDataFrame([(0, nine), (1, ten), (2, at), (3, at + " a b c d e")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    found = {r["id"]["doc_id"]: r["base_failed"] for r in assess(rows, ["doc_id"]).collect()}
    assert found == {0: True, 1: False, 2: False, 3: True}


# urls


def test_urls_without_and_with_repeated_page_ids(spark):
    rows = spark.createDataFrame([(None, "http://a.net/"), (None, None), (1, "http://b.org/"), (1, "http://b.org/")], "page_id long, url string")
    for bound in (100_000, -1):
        found = Counter((r["page_id"], r["filter"]["verdict"]) for r in judge(rows, rule_table(spark, RULES), broadcast_verdicts=bound).collect())
        assert found == {(None, "block"): 1, (None, "allow"): 1, (1, "allow"): 2}


# tokens


def test_chunks_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), ChunkEncoder(path)
    random.seed(15)
    alphabet = [*"abcdethe THE  \n\t\r\x0b\x1c\x1f\x85\xa0 　'sllve0123.,!?▁éñßÿÀ×÷İſ漢字🧪́​<|>", "<|endoftext|>", "<|ENDOFTEXT|>", " the", "ing", "'s ", " I'LL", "    "]
    noise = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(5000)] + ["", "a" * 3000, " " * 777]
    encoder.known.most = 2000
    for at in range(0, len(noise), 500):
        part = noise[at : at + 500]
        assert encoder.encode(part) == [encoder.raw(e.ids) for e in own.encode_batch(part, add_special_tokens=False)]


def test_packing_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "a b c")] * 3 + [(5, None), (5, "x " * 9000)], "doc_id long, text string")
    found = pack(rows, tokenizer_path("word_bpe_49k.json")).select("doc_id", "piece.*").collect()
    assert Counter(r["doc_id"] for r in found) == {None: 3, 5: 4} and len({r["sequence_id"] for r in found if r["length"] == 4096}) == 2
    empty = next(r for r in found if r["doc_tokens"] == 1)
    assert empty["ids_crc32"] == zlib.crc32(np.array([2], "<u4").tobytes())


def test_long_units_take_time_in_proportion():
    import sentencepiece
    from tokenizers import Tokenizer

    random.seed(16)
    path = tokenizer_path("piece_bpe_32k.model")
    codec, model = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    byte_path = tokenizer_path("byte_bpe_50k.json")
    counter, library = TokenCounter(byte_path), Tokenizer.from_file(byte_path)
    texts = ["".join(random.choices("0123456789abcdef", k=1_000_000)), " " * 100_000, "".join(random.choices("etaoin", k=100_000)), "a" * 100_000]
    began = time.perf_counter()
    found = [(codec.ids(t), counter.count([t])[0]) for t in texts]
    assert time.perf_counter() - began < 30
    for text, (ids, n) in zip(texts, found, strict=True):
        assert ids == model.encode(text) and n == len(library.encode(text, add_special_tokens=False).ids)
