import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from fedlens.llm import queries, substring_dedup


def brute(texts, span=13):
    first = {}
    for d, t in texts:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - span + 1):
                run = tuple(w[i : i + span])
                first[run] = min(first.get(run, d), d)
    for d, t in texts:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - span + 1):
            if d is not None and first[tuple(w[i : i + span])] < d:
                gone.update(range(i, i + span))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield d, len(w), len(gone), hashlib.sha256(kept).hexdigest()


def check(df, texts):
    found = df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(brute(texts))


def test_table(spark, sf, duck):
    check(queries.op10_substring_dedup(spark, sf), duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("hot", [1, 20, 10**6])
def test_passages_copies_and_skew(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 500)
    rng = random.Random(hot)
    text = lambda n, v=900: [f"w{rng.randint(0, v)}" for _ in range(n)]
    common, near = text(40), text(80)
    texts = [" ".join(text(rng.randint(0, 30)) + common + text(rng.randint(0, 30))) for _ in range(80)]
    texts += [" ".join(f"e{rng.random()}" if rng.random() < 0.03 else w for w in near) for _ in range(60)]
    texts += [" ".join(near)] * 20 + [" ".join(text(60, 3)) for _ in range(25)] + ["a " * 200, "a " * 14, "a " * 12]
    texts = list(enumerate(texts))
    rng.shuffle(texts)
    check(substring_dedup.deduplicated(spark, spark.createDataFrame(texts, "doc_id long, text string")), texts)


def test_hard_rows(spark, hard, nothing):
    texts = [(r.doc_id, r.text) for r in hard.collect()]
    check(substring_dedup.deduplicated(spark, hard), texts)
    assert substring_dedup.deduplicated(spark, nothing).count() == 0
    left = substring_dedup.without_repeats(spark, hard, 13)
    assert left.columns == hard.columns
    want = collections.Counter((d, t) for d, t in texts if d != 1)
    assert collections.Counter((r.doc_id, r.text) for r in left.collect() if r.doc_id not in (0,)) == collections.Counter({k: v for k, v in want.items() if k[0] != 0})


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 4))
def test_automaton(sequences, span):
    pieces = {}
    for d, s in enumerate(sequences):
        pieces.setdefault(b" ".join(s), len(sequences) - d)
    automaton = substring_dedup.SuffixAutomaton(pieces)
    for piece in [*pieces, b"a b c c b a a"]:
        w = piece.split(b" ")
        want = []
        for i in range(len(w) - span + 1):
            holders = [d for p, d in pieces.items() if any(p.split(b" ")[j : j + span] == w[i : i + span] for j in range(len(p.split(b" "))))]
            want.append(min(holders, default=np.iinfo("int64").max))
        assert automaton.first_documents(piece, span).tolist() == want


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 60))
def test_least_places_are_the_first_of_equals(values, size):
    values = np.array(values, "uint64")
    if size <= len(values):
        view = np.lib.stride_tricks.sliding_window_view(values, size)
        assert substring_dedup.least_places(values, size).tolist() == (view.argmin(1) + np.arange(len(view))).tolist()


@settings(deadline=None, max_examples=200)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "été", "\0", "c c"]), max_size=30), min_size=1, max_size=6), st.integers(1, 15))
def test_anchors_of_a_group_are_those_of_each_text(texts, span):
    texts = [t for t in (substring_dedup.spaced_once("\t".join(t) + " \n") for t in texts) if t]
    found = substring_dedup.Anchors(texts, substring_dedup.WordSums(), span) if texts else None
    runs = {}
    for k, text in enumerate(texts):
        alone = substring_dedup.Anchors([text], substring_dedup.WordSums(), span)
        mine = found.text == k
        assert found.hash[mine].tolist() == alone.hash.tolist()
        assert (found.first[mine] - found.begins[k]).tolist() == alone.first.tolist()
        words, places = text.split(), []
        for i, j, anchor in zip(alone.first.tolist(), alone.end.tolist(), alone.hash.tolist()):
            assert alone.data[alone.starts[i] : alone.ends[j + span - 2]].split() == words[i : j + span - 1]
            places += range(i, j)
            for p in range(i, j):  # equal runs have equal anchors
                assert runs.setdefault(tuple(words[p : p + span]), anchor) == anchor
        assert places == list(range(len(words) - span + 1))


def test_marks_are_stretches_not_runs():
    piece, other = b"a b c d e f", b"x b c d y d e f"
    columns = {"anchor": [1] * 4, "salts": [1, 1, 2, 1], "key": [7, 8, 9, 9], "doc_id": [1, 2, 3, 3], "start": [0, 5, 2, 40], "piece": [piece, piece, other, b"q r s"]}
    marks = substring_dedup.marked(pa.table({k: pa.array(v) for k, v in columns.items()}), 3).to_pylist()
    closed = sorted((m["key"], m["first"], m["last"]) for m in marks if m["run"] is None)
    assert closed == [(8, 5, 8), (9, 3, 3), (9, 7, 7)]
    assert sorted((m["first"], m["run"]) for m in marks if m["run"]) == [(2, b"x b c"), (4, b"c d y"), (5, b"d y d"), (6, b"y d e")]


@pytest.mark.parametrize("text", [None, "", " \t", "a", " a  b\r\nc\x0b", "a\x1cb\u3000c \x0c"])
def test_words_are_joined_by_one_space(text):
    data = substring_dedup.spaced_once(text)
    assert data == b" ".join((text or "").encode().split())
    assert substring_dedup.count(data) == len((text or "").encode().split())
