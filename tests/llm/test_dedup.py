"""Substring dedup, near-dedup and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from llm import corpus as C
from scanloom.llm import decontamination, minhash, substrings, tokens


def _sorted(rows):
    return sorted(rows, key=repr)


def test_words_and_hashes_follow_the_definition():
    column = pa.array([t for _, t in C.texts()])
    for lower in (False, True):
        found = tokens.split_words(column, lower)
        want = [w for _, t in C.texts() for w in C.split(t, lower)]
        assert [bytes(found.data[a:b]) for a, b in zip(found.starts, found.ends)] == want
        assert found.counts.tolist() == [len(C.split(t)) for _, t in C.texts()]
        assert len(set(found.hashes.tolist())) == len(set(want))
        assert {h: w for h, w in zip(found.hashes.tolist(), want)}.keys() == set(found.hashes.tolist())
    sliced = tokens.split_words(column.slice(5, 4), True)
    assert sliced.counts.tolist() == [len(C.split(t)) for _, t in C.texts()[5:9]]


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    column = pa.array([t for _, t in C.texts()])
    whole = tokens.split_words(column, False).hashes
    monkeypatch.setattr(tokens, "PIECE", 64)
    assert (tokens.split_words(column, False).hashes == whole).all()


@pytest.mark.parametrize("seed,bits", [(0, 1 << 27), (1, 64)])
def test_repeats_match_brute_force(spark, monkeypatch, seed, bits):
    monkeypatch.setattr(substrings, "MAX_BITS", bits)  # a full bitmap changes no result
    rows = C.texts(seed)
    got = substrings.remove_repeats(C.table(spark, rows).repartition(3)).collect()
    want = C.repeats(rows, 35)
    assert _sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == _sorted((i, *w) for (i, _), w in zip(rows, want))
    assert any(w[1] for w in want) and not all(w[1] for w in want)


def test_repeats_across_slices_and_short_spans(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE_BYTES", 200)
    rng = random.Random(5)
    rows = [(i, " ".join(C.words(rng, rng.randrange(0, 60), 3))) for i in range(40)]
    got = substrings.remove_repeats(C.table(spark, rows), span=6, k=3).collect()
    assert _sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == _sorted((i, *w) for (i, _), w in zip(rows, C.repeats(rows, 6)))


def test_repeats_of_ids_that_are_text(spark):
    rows = C.texts()
    docs = C.table(spark, rows).withColumn("doc_id", substrings.F.concat(substrings.F.lit("d"), "doc_id"))
    got = substrings.remove_repeats(docs).collect()
    want = C.repeats(rows, 35)
    assert _sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == _sorted((None if i is None else f"d{i}", *w) for (i, _), w in zip(rows, want))


def test_repeats_of_an_empty_table(spark):
    assert substrings.remove_repeats(C.empty(spark)).count() == 0


def test_sketch_coordinates_are_full_and_estimate_similarity():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 800, dtype=np.uint64)
    own = rng.integers(0, 2**63, (2, 100), dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, o])) for o in own] + [np.array([7], np.uint64), np.empty(0, np.uint64)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketch = minhash.sketches(np.concatenate(sets), offsets, 350)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (sketch[:3] != full).all() and (sketch[3] == full).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.1


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_match_brute_force(spark, shingle):
    rows = C.texts()
    got = minhash.near_duplicates(C.table(spark, rows).repartition(3), shingle=shingle).collect()
    want = C.near_components(rows, shingle)
    assert _sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == _sorted((i, *w) for (i, _), w in zip(rows, want))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("block", [500_000, 200])
def test_groups_of_edited_copies_lose_no_link(spark, monkeypatch, block):
    """Chains of edits, where few members are similar to the least one; small blocks cut every group."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(3):
        text = C.words(rng, 60, 100_000)
        for _ in range(30):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(rng.randrange(1, 5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**9)}"
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(C.table(spark, rows), shingle=2).collect()}
    want = {i: c for (i, _), (_, c) in zip(rows, C.near_components(rows, 2))}
    assert got == want and 3 < len(set(want.values())) < 90


def test_copies_around_a_hub_lose_no_link(spark, monkeypatch):
    """Copies similar to one text that is not the least of them, hardly to each other."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    rng = random.Random(4)
    rows = []
    for group in range(2):
        base = C.words(rng, 100, 100_000)
        for i in range(25):
            text = list(base)
            for at in rng.sample(range(100), 0 if i == 20 else 5):
                text[at] = f"e{rng.randrange(10**9)}"
            rows.append((100 * group + i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(C.table(spark, rows).repartition(3), shingle=2).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(rows, C.near_components(rows, 2))} and len(set(got.values())) < 20


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(C.empty(spark)).count() == 0


def _items(rows):
    long = rows[8][1].split()
    return [
        (1, " ".join(long[45:70])), (2, " ".join(long[50:60]).upper()), (3, "Two, WORDS!"), (4, "été"), (5, None), (6, "..."), (7, "never seen anywhere in these documents at all today folks"),
        (8, " ".join(long[45:70])), (10, "ÉTÉ"), (9, "a a a"), (9, "a a a"),
    ]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_contamination_matches_brute_force(spark, limit):
    rows = C.texts()
    items = _items(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(C.table(spark, rows).repartition(3), bench, broadcast_bytes=limit).collect()
    want = C.leaked(rows, items)
    assert _sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == _sorted((i, *w) for (i, _), w in zip(rows, want))
    assert all(r["n_items"] == len(r["items"]) for r in got) and any(w[1] for w in want)


def test_contamination_of_random_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(C.words(rng, 60, 3))) for i in range(20)]
    items = [(i, " ".join(C.words(rng, rng.randrange(1, 25), 3))) for i in range(12)]
    got = decontamination.contamination(C.table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert _sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == _sorted((i, *w) for (i, _), w in zip(rows, C.leaked(rows, items)))


def test_contamination_with_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(C.empty(spark), none).count() == 0
    clean = decontamination.contamination(C.table(spark, C.texts()), none).collect()
    assert len(clean) == len(C.texts()) and not any(r["n_hit"] or r["n_items"] for r in clean)


def test_contamination_runs_no_python(spark):
    df = decontamination.contamination(C.table(spark, C.texts()[:4]), spark.createDataFrame([(1, "two words")], "item_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
