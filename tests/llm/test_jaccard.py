import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from fedlens.llm import components, jaccard_join, queries
from fedlens.llm.shingles import shingle_sets


def shingles(text, size=3):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def brute(texts, size=3, percent=90):
    """Components by comparing every two documents."""
    sets = [(d, shingles(t, size)) for d, t in texts]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((d, len(s), find(d)) for d, s in sets)


def frame(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def edited(words, rate, rng):
    return " ".join(f"e{rng.random()}" if rng.random() < rate else w for w in words)


def test_table(spark, sf, duck):
    found = rows(queries.op8_ngram_jaccard(spark, sf), "doc_id", "n_shingles", "component_id")
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    sizes = {d: len(shingles(t)) for d, t in texts}
    assert {d: n for d, n, _ in found} == sizes
    assert found == brute(texts)


@pytest.mark.parametrize("percent, size", [(90, 3), (80, 5)])
def test_large_groups_of_near_copies(spark, monkeypatch, percent, size):
    monkeypatch.setattr(jaccard_join, "SMALL", 6)
    monkeypatch.setattr(jaccard_join, "BLOCK", 12)
    rng = random.Random(percent)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (90, 140)]
    texts = [edited(base[i % 2], rng.choice([0, 0.005, 0.01, 0.02, 0.04, 0.08]), rng) for i in range(180)]
    texts += [" ".join(f"x{rng.randint(0, 30)}" for _ in range(rng.randint(0, 12))) for _ in range(120)]
    texts = list(enumerate(texts + texts[:40]))
    rng.shuffle(texts)
    found = rows(jaccard_join.linked(spark, frame(spark, texts), size, percent), "doc_id", "n_shingles", "component_id")
    assert found == brute(texts, size, percent)


def test_hard_rows(spark, hard, nothing):
    found = jaccard_join.linked(spark, hard, 3, 90).collect()
    assert len(found) == hard.count()
    by = {r.doc_id: r for r in found}
    assert by[1].component_id == 0 and by[0].component_id == 0 and by[7].component_id == 7
    assert (by[2].n_shingles, by[2].component_id) == (0, 2) and by[4].component_id == 4
    assert by[None].component_id is None and by[None].n_shingles > 0
    assert jaccard_join.linked(spark, nothing, 3, 90).count() == 0


@settings(deadline=None, max_examples=20)
@given(st.sets(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, pairs):
    df = spark.createDataFrame(list(pairs), "u long, v long")
    root = list(range(31))
    for _ in root:
        for u, v in pairs:
            root[u] = root[v] = min(root[u], root[v])
    want = sorted({(x, root[x]) for u, v in pairs if u != v for x in (u, v)})
    assert rows(components.components(spark, df), "node", "component") == want


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(50, 100), st.integers(0, 5))
def test_prefixes_meet_as_often_as_they_ask(x, y, percent, seed):
    if 100 * len(x & y) < percent * len(x | y):
        return
    sketch = np.random.default_rng(seed).integers(0, 100, jaccard_join.SKETCH).astype(float)
    (a, k), (b, j) = (jaccard_join.prefix(np.array(sorted(s), "uint64"), sketch, float(np.median(sketch)), percent) for s in (x, y))
    assert len(set(a.tolist()) & set(b.tolist())) >= min(k, j)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=40), st.integers(1, 6))
def test_intersections(sets, rare):
    jaccard_join.RARE, usual = rare, jaccard_join.RARE
    found = jaccard_join.intersections([np.array(sorted(s), "uint64") for s in sets])
    jaccard_join.RARE = usual
    assert all(found[i, j] == len(sets[i] & sets[j]) for j in range(len(sets)) for i in range(j))


def test_rows_of_one_id_with_other_texts(spark):
    text = lambda name, last: " ".join([f"{name}w{k}" for k in range(100)] + [last])
    texts = []
    for i in range(20):
        texts += [(i, text(f"c{i}", "x")), (i, text(f"a{i}", "x")), (i, None), (100 + i, text(f"a{i}", "y")), (200 + i, text(f"c{i}", "y"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for r in jaccard_join.linked(spark, docs, 3, 90).collect():
        assert r.component_id == r.doc_id % 100


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.integers(50, 100), st.integers(0, 5))
def test_what_is_asked_of_a_pair_holds_for_linked_ones(x, y, percent, seed):
    sets = [np.array(sorted(s), "uint64") * np.uint64(0x9E3779B97F4A7C15) for s in (x, y)]
    sketch = np.random.default_rng(seed).integers(0, 100, jaccard_join.SKETCH).astype(float)
    (a, i), (b, j) = (jaccard_join.prefix(np.sort(s), sketch, float(np.median(sketch)), percent) for s in sets)
    odd = [jaccard_join.marks_of(s) for s in sets]
    assert sum(int(v).bit_count() for v in (odd[0] ^ odd[1]).view("uint64")) <= len(x ^ y)
    if 100 * len(x & y) >= percent * len(x | y):
        spare = min(i + len(x) * percent // -100, j + len(y) * percent // -100)
        assert len(set(a.tolist()) & set(b.tolist())) >= jaccard_join.common(len(x) + len(y), percent) + spare
        assert len(x ^ y) <= len(x) + len(y) - 2 * jaccard_join.common(len(x) + len(y), percent)


@pytest.mark.parametrize("uses, held", [(0, 1 << 15), (20_000, 4), (60, 64)])
def test_tokens_of_many_sets_dealt_over_tasks(spark, monkeypatch, uses, held):
    monkeypatch.setattr(jaccard_join, "SMALL", 6)
    monkeypatch.setattr(jaccard_join, "OFTEN", 0)
    monkeypatch.setattr(jaccard_join, "OFTEN_USES", uses)
    monkeypatch.setattr(jaccard_join, "HELD", held)
    rng = random.Random(uses)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (60, 110)]
    texts = [edited(base[i % 2], rng.choice([0, 0.005, 0.02, 0.05]), rng) for i in range(90)]
    texts = list(enumerate(texts + texts[:20] + [" ".join(f"x{rng.randint(0, 30)}" for _ in range(9)) for _ in range(60)]))
    found = rows(jaccard_join.linked(spark, frame(spark, texts), 3, 90), "doc_id", "n_shingles", "component_id")
    assert found == brute(texts)


def test_texts_with_a_passage_in_common_are_not_compared(spark, monkeypatch):
    """In a large corpus a sketch's cells are all alike; texts that share a passage meet, but are told apart without being moved."""
    monkeypatch.setattr(jaccard_join, "SKETCH", 1)
    compared = []
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    own = lambda i: [f"own{i}n{k}" for k in range(200)]
    shared = lambda i: [f"both{i // 2}n{k}" for k in range(150)]
    texts = [(i, " ".join(own(i) + shared(i))) for i in range(60)]
    texts += [(100 + i, " ".join(own(i) + shared(i) + ["end"])) for i in range(5)]
    found = rows(jaccard_join.linked(spark, frame(spark, texts), 3, 90), "doc_id", "component_id")
    assert found == [(i, i % 100) for i, _ in texts]
    assert compared == [5]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.none() | st.text("aAbÉ\x00 \n\t\x0b\x1c\xa0", max_size=40) | st.integers(6, 200).map(lambda n: "a b " + "x" * n + " " + "X" * (n + 1)), max_size=6), st.integers(1, 5))
def test_sets_of_many_texts_at_once(texts, size):
    found = shingle_sets(texts, size)
    assert [len(s) for s in found] == [len(shingles(t, size)) for t in texts]
    assert all((np.diff(s.astype(object)) > 0).all() for s in found)
    for a, x in zip(texts, found):
        for b, y in zip(texts, found):
            assert len(np.intersect1d(x, y)) == len(shingles(a, size) & shingles(b, size))


@settings(deadline=None, max_examples=50)
@given(st.lists(st.dictionaries(st.integers(0, 9999), st.integers(1, 70_000), max_size=30), max_size=4), st.integers(0, 300))
def test_parts_of_the_sketch_add_up(tasks, base):
    sketches = [np.full(10_000, base * i, "int64") for i in range(len(tasks))]
    for sketch, cells in zip(sketches, tasks):
        for cell, uses in cells.items():
            sketch[cell] += uses
    total = jaccard_join.added(x for sketch in sketches for x in jaccard_join.parts_of(sketch))
    whole = np.concatenate([total.get(i, np.zeros(jaccard_join.CELLS, int)) for i in range(3)])
    assert (whole[:10_000] == sum(sketches, np.zeros(10_000, int))).all() and not whole[10_000:].any()


def test_elements_of_fifty_sets_stand_out_in_a_large_corpus():
    """With so many other elements in the sketch as six GB of text have, what fifty sets share stays out of their prefixes."""
    rng = np.random.default_rng(0)
    sketch = rng.poisson(1.5e9 / jaccard_join.SKETCH, jaccard_join.SKETCH)
    usual, met = float(np.median(sketch)), 0
    shared = rng.integers(0, 1 << 63, 2000, "uint64") * np.uint64(2)
    np.add.at(sketch, (shared % np.uint64(jaccard_join.SKETCH)).astype(int), 60)
    for some in shared.reshape(100, 20):
        own = rng.integers(0, 1 << 63, 430, "uint64")
        first, _ = jaccard_join.prefix(np.sort(np.append(own, some)), sketch, usual, 90)
        met += len(np.intersect1d(first, some))
    assert met <= 4


def test_a_group_that_is_one_component_is_not_compared_in_blocks(spark, monkeypatch):
    """All are near the one that they meet around; members of other components whose marks differ are left out too."""
    monkeypatch.setattr(jaccard_join, "SMALL", 6)
    monkeypatch.setattr(jaccard_join, "OFTEN_USES", 5)
    sent = []
    block_edges = jaccard_join.block_edges
    monkeypatch.setattr(jaccard_join, "block_edges", lambda members, *rest: sent.append(members.count()) or block_edges(members, *rest))
    base = [f"w{k}" for k in range(400)]
    texts = [(i, " ".join(base[: 9 * i] + ["e"] + base[9 * i + 1 :])) for i in range(40)]
    found = rows(jaccard_join.linked(spark, frame(spark, texts), 3, 90), "doc_id", "component_id")
    assert found == [(i, 0) for i, _ in texts]
    texts += [(100 + i, " ".join(base[:40] + [f"own{i}n{k}" for k in range(60)])) for i in range(30)]
    assert rows(jaccard_join.linked(spark, frame(spark, texts), 3, 90), "doc_id", "component_id") == found + [(i, i) for i, _ in texts[40:]]
    assert sent == [0, 0]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1), min_size=1, max_size=90), st.lists(st.integers(0, 3), min_size=90, max_size=90), st.integers(50, 100))
def test_linked_sets_of_other_components_reach_each_other(sets, component, percent):
    tokens = [np.array(sorted(s), "uint64") * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    marks = np.stack([jaccard_join.marks_of(t) for t in tokens]).view("uint64")
    found = jaccard_join.reaching(np.array([len(s) for s in sets]), marks, np.array(component[: len(sets)]), percent)
    for i, x in enumerate(sets):
        near = [j for j, y in enumerate(sets) if component[i] != component[j] and 100 * len(x & y) >= percent * len(x | y)]
        assert found[i] or not near
