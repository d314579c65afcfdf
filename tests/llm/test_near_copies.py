"""Near copies against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from maskwright.llm.near_copies import drop_similar, near_copy_groups, similar
from maskwright.llm.simhash import fingerprint

from .test_operators import TEXTS, docs, empty, words_of


def plain_shingles(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)}


def plain_groups(texts):
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {i: r for i, r in enumerate(root) if i != r}


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def test_stage_drops_copies_beyond_three_bits(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    whole = " ".join(words)
    copy = next(c for c in (edited(words, 3, rng) for _ in range(500)) if ((fingerprint(whole) ^ fingerprint(c)) & (2**64 - 1)).bit_count() > 3)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs(spark, [whole, copy, edited(words, 40, rng)]), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


@pytest.mark.parametrize("common", [32, 2, 1])
def test_groups_equal_all_pairs(spark, common):
    rng = random.Random(9)
    texts = list(TEXTS)
    for _ in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(12, 150))]
        texts += [" ".join(words).upper(), *(edited(words, rng.randint(0, min(9, len(words) // 8)), rng) for _ in range(9))]
    texts += [f"{' '.join(f'line{k}' for k in range(30))} {rng.random()} {rng.random()} {'x ' * (k % 4)}" for k in range(20)]
    found = {r["id"]: r["component_id"] for r in near_copy_groups(docs(spark, texts), common_postings=common).collect()}
    assert found == plain_groups(texts) and len(found) > 20


def test_bounds_empty_tables_and_rows_without_an_id(spark):
    assert similar(set(range(9)), set(range(1, 10))) and not similar(set(range(8)), set(range(1, 9)))
    assert drop_similar(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (2, "a b")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in drop_similar(rows).collect()) == ["1", "None", "None"]


def test_group_whose_copies_are_like_their_origin_only(spark):
    rng = random.Random(10)
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [edited(words, 4, rng) for _ in range(90)] + [" ".join(words)] + [edited(words, 4, rng) for _ in range(90)]
    expected = plain_groups(texts)
    sets = [plain_shingles(t) for t in texts]
    assert sum(len(sets[0] & s) < 0.8 * len(sets[0] | s) for s in sets) > 100 and len(expected) == 180
    assert {r["id"]: r["component_id"] for r in near_copy_groups(docs(spark, texts)).collect()} == expected


def test_tables_in_between_are_deleted(spark):
    from pathlib import Path

    from maskwright.llm.near_copies import near_copy_groups
    from maskwright.sources.shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    large = lambda: {p.name for p in folder.iterdir() if p.name.split("-")[0] in ("listed", "shared", "entries", "candidates", "near")}
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(40)) + f" end{k}") for k in range(8)], "doc_id long, text string")
    before = large()
    assert {r["component_id"] for r in near_copy_groups(docs, common_postings=2).collect()} == {0}
    assert large() <= before
