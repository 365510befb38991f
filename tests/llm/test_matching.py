"""Jaccard components and decontamination against brute force, top-k against all pairs."""

import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import decontamination, jaccard_join
from gaugeline.llm.components import connected_components
from gaugeline.llm.topk import search_cell, top_k

sys.path.insert(0, str(Path(__file__).parent))

from brute import brute_components, brute_hits  # noqa: E402

SCHEMA = "doc_id long, text string, n long, component string, id int, source string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "c", 2, "s") for i, t in texts], SCHEMA)


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice((1, 1, 3, 9))):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            if rng.random() < 0.3:
                own += passage[: rng.randint(3, 40)]
            texts.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    texts += ["", None, "  \t\n", "one two", "One  two", "one two three", "É one two three four five", texts[0], texts[3]]
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    texts = near_copies(seed)
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


def test_components_without_leaders(spark, monkeypatch):
    """With no leader confirmed, the index alone must find every link."""
    texts = near_copies(3)
    monkeypatch.setattr(jaccard_join, "_leader_pairs", lambda reps: reps.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(jaccard_join, "_neighbour_pairs", lambda lists: lists.sparkSession.createDataFrame([], "a long, b long"))
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


def boilerplate(count):
    """Texts of 96 to 104 words that share 84 of them: most pairs just miss the similarity."""
    shared = " ".join(f"s{k}" for k in range(84))
    texts = [(k, shared + " " + " ".join(f"w{k}x{j}" for j in range(12 + k % 9))) for k in range(count)]
    return texts + [(count + k, t + " end") for k, t in texts[:20]]


@pytest.mark.parametrize("hot, cell", [(250_000, 1024), (8, 7)])
def test_shared_passages_without_links(spark, monkeypatch, hot, cell):
    """Also with the lists of frequent shingles spread and their cells cut."""
    monkeypatch.setattr(jaccard_join, "HOT_POSTINGS", hot)
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", cell)
    texts = boilerplate(150)
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


def test_pairs_looked_at_grow_with_the_lists(spark):
    """Sets of 100 that share their last 80: no pair can link, and none is looked at."""
    for count in (200, 2000):
        lists = spark.range(count).select(
            F.lit(1).cast("long").alias("list"), "id", F.lit(100).alias("n"), F.lit(20).alias("position"), F.col("id").alias("component")
        )
        smaller, larger = jaccard_join._sides(lists)
        assert smaller.join(larger, ["list", "band", "row", "column"]).count() <= count
        assert jaccard_join._all_pairs(lists).count() == 0


def test_cells_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 5)
    rng = random.Random(4)
    rows = []
    for k in range(120):
        n = rng.randint(1, 60)
        rows.append((k % 3, k, n, rng.randint(0, n // 4), k % 50))
    lists = spark.createDataFrame(rows, "list long, id long, n int, position int, component long")
    want = set()
    for lx, x, nx, px, cx in rows:
        for ly, y, ny, py, cy in rows:
            if lx == ly and x < y and cx != cy and 100 * min(nx, ny) >= 75 * max(nx, ny) and 175 * min(nx - px, ny - py) >= 75 * (nx + ny):
                want.add((x, y))
    assert want and set(map(tuple, jaccard_join._all_pairs(lists).collect())) == want


def test_neighbours_across_tasks(spark):
    lists = spark.createDataFrame([(7, k, 40, 0, k) for k in range(300)] + [(8, 1000, 5, 0, 1), (9, 1001, 5, 0, 2)], "list long, id long, n int, position int, component long")
    assert set(map(tuple, jaccard_join._neighbour_pairs(lists).collect())) == {(k, k + 1) for k in range(299)}


def test_a_very_long_text(spark):
    long = " ".join(f"w{k % 7001}" for k in range(400_000))
    texts = [(1, long), (2, long + " more"), (3, "one two three"), (4, "w1 " * 300_000)]
    got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts)


def test_null_ids_and_no_rows(spark):
    got = jaccard_join.jaccard_components(frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (4, 4), (4, 4)]
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 60)] + [(5, 5), (3, 2)], "a long, b long")
    assert {r["id"]: r["component"] for r in connected_components(edges).collect()} == {**{k: 10 for k in range(10, 61)}, 2: 2, 3: 2, 5: 5}


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from a hill"
ITEMS = [(1, ITEM), (2, "short Item here"), (10, "the quick brown fox jumps over the lazy dog while seven wizards sleep"), (3, None), (4, "--"), (None, "never counted at all"), (2, "short item here")]
ITEM_SCHEMA = "item_id long, text string, doc_id long"


@pytest.mark.parametrize("block", [32 << 20, 40])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    filler = " ".join(f"x{k}" for k in range(300))
    texts = [
        (1, f"{filler} {ITEM.upper()}! {filler}"), (2, ITEM), (3, "A short-item, here short item here"), (4, None), (5, ""), (6, filler), (7, ITEM.replace("lazy", "very lazy")),
        (8, "seven wizards"), (9, f"{ITEM} {ITEM}"), (None, ITEM), (2, ITEM), (11, "été " * 20 + "short, ITEM\nhere"),
    ]
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], ITEM_SCHEMA)
    got = decontamination.decontaminate(frame(spark, texts), items).collect()
    want = [(i, *brute_hits(t, ITEMS)) for i, t in texts]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_repeated_items_fill_no_block(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1000)
    items = spark.createDataFrame([(1, ITEM, 0)] * 500 + [(2, " ".join(f"w{k}" for k in range(300)), 0)], ITEM_SCHEMA)
    blocks = list(decontamination._blocks(items, 13, "item_id", "text"))
    limit = 1000 // (8 * 13 + 24)
    assert sum(len(t.windows) for _, t in blocks) == len(ITEM.split()) - 12 + 288
    assert max(len(t.windows) for _, t in blocks) < 2 * limit


def test_hits_in_a_very_long_text(spark):
    text = " ".join(f"w{k % 9001}" for k in range(300_000)) + " " + ITEM
    items = [(1, ITEM), (2, " ".join(f"w{k}" for k in range(8990, 9001)) + " w0 w1 w2")]
    got = decontamination.decontaminate(frame(spark, [(1, text)]), spark.createDataFrame([(*i, 0) for i in items], ITEM_SCHEMA)).first()
    whole, at = len(ITEM.split()), 33
    assert (got["n_words"], got["n_hit"], got["n_items"]) == (300_000 + whole, 14 * at + whole, 2)


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], ITEM_SCHEMA)
    assert [r["contaminated"] for r in decontamination.decontaminate(frame(spark, [(1, ITEM), (2, None)]), none).collect()] == [False, False]
    assert decontamination.decontaminate(frame(spark, []), none).count() == 0


def test_phrases_and_near_matches(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma", 0)], ITEM_SCHEMA)
    docs = frame(spark, [(1, "x alpha beta gamma y"), (2, "alpha one beta two gamma"), (3, "gamma beta alpha"), (4, "alpha beta z z z gamma"), (5, None)])
    exact = decontamination.phrase_matches(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["first_word"], r["last_word"], r["exact"]) for r in exact] == [(1, "1", 1, 3, True)]
    near = decontamination.phrase_matches(docs, items, slop=2).collect()
    assert sorted((r["doc_id"], r["first_word"], r["last_word"], r["exact"]) for r in near) == [(1, 1, 3, True), (2, 0, 4, False)]


def test_phrases_of_repeated_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta", 0), (1, "alpha beta", 0), (2, "Alpha beta", 0), (3, None, 0)], ITEM_SCHEMA)
    got = decontamination.phrase_matches(frame(spark, [(1, "alpha beta"), (1, "alpha beta"), (2, None)]), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in got) == [(1, "1", 0)] * 2 + [(1, "2", 0)] * 2


def test_a_full_cell_takes_bounded_memory():
    rng = np.random.default_rng(5)
    vectors, queries = rng.integers(-99, 99, (16384, 32)), rng.integers(-99, 99, (300, 32))
    tracemalloc.start()
    q, c, score = search_cell(np.arange(-300, 0), queries, np.arange(16384), vectors, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert (score.reshape(300, 5) == -np.sort(-(queries @ vectors.T), axis=1)[:, :5]).all()


VECTORS = "vec_id long, embedding array<float>, score long, rank int"


def test_top_k_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    data = {k: rng.normal(0, 0.2, 20).astype(np.float32) for k in range(220)}
    data.update({k: data[7] for k in range(300, 330)})
    rows = [(k, v.tolist(), 1, 1) for k, v in data.items()] + [(50, data[50].tolist(), 1, 1), (400, None, 1, 1), (401, [float("nan")] * 20, 1, 1), (402, [None] * 20, 1, 1), (None, data[1].tolist(), 1, 1), (450, [float("inf")] * 20, 1, 1)]
    got = top_k(spark.createDataFrame(rows, VECTORS)).collect()
    whole = {k: np.floor(256 * v.astype(np.float64)).astype(np.int64) for k, v in data.items()}
    want = []
    for q in (k for k in whole if k % 50 == 0):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:5]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_and_large(spark):
    few = spark.createDataFrame([(0, [1e6, -2e6], 0, 0), (1, [3e6, 4e6], 0, 0), (100, [5.0], 0, 0)], VECTORS)
    assert [tuple(r) for r in top_k(few).collect()] == [(0, 1, 1, 256 * 256 * -5_000_000_000_000)]
    assert top_k(spark.createDataFrame([], VECTORS)).count() == 0
