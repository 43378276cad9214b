import collections
import math
import zlib

import numpy as np
import pytest

from fedlens.llm import classlm, queries


def tokens_of(text):
    return [w.lower() for w in (text or "").encode().split()] + [b""]


def base_rows(texts):
    count = collections.Counter()
    for doc_id, text in texts:
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10:
            count.update(tokens_of(text))
    total, scale = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    for doc_id, text in texts:
        t = tokens_of(text)
        out = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0
        yield doc_id, out, len(t), sum(count[w] > 0 for w in t), total, sum(math.log10((count[w] + 0.1) / scale) for w in t)


def check(found, texts):
    want = sorted(base_rows(texts), key=str)
    found = sorted(found, key=lambda r: str(tuple(r)[:5] + (r.base_score,)))
    assert len(found) == len(want)
    by = collections.defaultdict(list)
    for w in want:
        by[w[0]].append(w)
    for r in found:
        w = by[r.doc_id][0]
        assert tuple(r)[:5] == w[:5]
        assert math.isclose(r.base_score, w[5], rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_table(spark, sf, duck):
    found = queries.op5_class_lm(spark, sf).collect()
    check(found, duck.sql("SELECT doc_id, text FROM documents").fetchall())
    for out in (False, True):
        rows = [r for r in found if r.held_out == out]
        assert sum(r.score for r in rows) > 1.02 * sum(r.base_score for r in rows)  # likelier than single words


def test_hard_rows(spark, hard, nothing):
    check(classlm.scored(spark, hard).collect(), [(r.doc_id, r.text) for r in hard.collect()])
    assert classlm.scored(spark, nothing).count() == 0


def test_small_blocks_change_nothing(spark, sf, monkeypatch):
    docs = queries.documents(spark, sf)
    whole = {r.doc_id: r for r in classlm.scored(spark, docs).collect()}
    monkeypatch.setattr(classlm, "BLOCK_WORDS", 500)
    monkeypatch.setattr(classlm, "PIECE_TOKENS", 3000)
    for r in classlm.scored(spark, docs.repartition(5)).collect():
        assert math.isclose(r.score, whole[r.doc_id].score, rel_tol=1e-9)


def small_model(random, passes):
    """Words of two kinds that alternate: the classes must find the kinds."""
    codes = []
    for _ in range(300):
        kind = np.arange(20) % 2
        codes.append(np.append(1 + 2 * random.integers(0, 100, 20) + kind, 0))
    return codes


def count_by_hand(codes, classes):
    total = np.zeros((len(classes), 2, classlm.TOTAL), "int64")
    for doc in codes:
        units, last = classlm.units_of(doc), 0
        for u in units:
            total[u, 0, classes[last]] += 1
            total[last, 1, classes[u]] += 1
            last = u
    return total


def test_context_counts_match_a_loop(spark):
    random = np.random.default_rng(0)
    codes = [random.integers(0, classlm.HEAD + 40, 15).astype("int64") for _ in range(40)]
    df = spark.createDataFrame([(c.tolist(), i % 4 == 0) for i, c in enumerate(codes)], "codes array<long>, held_out boolean").repartition(3)
    classes = classlm.first_classes()
    found = classlm.context_counts(df, classes)
    assert (found == count_by_hand([c for i, c in enumerate(codes) if i % 4], classes)).all()


def test_exchange_raises_the_likelihood_and_finds_kinds():
    codes = small_model(np.random.default_rng(2), 4)
    classes = classlm.first_classes()
    values = []
    for turn in range(8):
        counts = count_by_hand(codes, classes)
        values.append(classlm.likelihood(classlm.class_table(counts, classes)))
        classes = classlm.exchanged(counts, classes, turn)
    assert max(values[1:]) > values[0]
    odd, even = set(classes[1:201:2]), set(classes[2:201:2])
    assert not odd & even


def test_probabilities_sum_to_one():
    random = np.random.default_rng(4)
    head, rare = 50, [(1, 30), (2, 10), (3, 5), (7, 4)]
    codes = [np.append(random.choice(np.concatenate([np.arange(1, head), np.repeat([classlm.HEAD + c for c, _ in rare], 3)]), 30), 0) for _ in range(50)]
    classes = classlm.first_classes()
    counts = count_by_hand(codes, classes)
    uses = counts[:, 0].sum(1)
    model = classlm.fitted(counts, classes, uses[: classlm.HEAD], int(uses.sum()), 0)
    assert np.allclose((10**model.step).sum(1), 1)
    by_class = np.zeros(classlm.TOTAL)
    np.add.at(by_class, classes[: classlm.HEAD], 10 ** model.share)
    used = [c for c in range(classlm.CLASSES) if uses[: classlm.HEAD][classes[: classlm.HEAD] == c].sum()]
    assert np.allclose(by_class[used], 1)


def test_rare_words_get_classes_by_their_neighbours(spark, monkeypatch):
    """Words beyond the head, met once a block, fall into the classes that their neighbours of all blocks call for."""
    monkeypatch.setattr(classlm, "BLOCK_TOKENS", 40)
    random = np.random.default_rng(7)
    common = [f"{k}{i}" for k in "pq" for i in range(2)]
    # rare a-words between p-words and rare b-words between q-words: kinds differ in neighbours only, not in counts
    texts = []
    for i in range(600):
        words = []
        for j in range(6):
            words += [f"p{random.integers(2)}", f"a{random.integers(60)}", f"p{random.integers(2)}", f"q{random.integers(2)}", f"b{random.integers(60)}", f"q{random.integers(2)}"]
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    head = [b"", *(w.encode() for w in common)]
    monkeypatch.setattr(classlm, "CLASSES", 3)  # the end and two kinds
    monkeypatch.setattr(classlm, "TOTAL", 3 + classlm.BANDS + 1)
    monkeypatch.setattr(classlm, "UNKNOWN", classlm.TOTAL - 1)
    monkeypatch.setattr(classlm, "HEAD", 5)
    blocks = classlm.in_blocks(docs, head, 4).cache()
    met = collections.Counter(w for d, t in texts if zlib.crc32(str(d).encode()) % 10 for w in t.split())
    assert blocks.where("words is not null").select("block").distinct().count() > 50
    classes = np.concatenate([[0, 1, 1, 2, 2], 3 + np.arange(classlm.BANDS + 1)])
    step = np.full((classlm.TOTAL, classlm.TOTAL), -3.0)
    step[1, 2] = step[2, 1] = -0.1  # classes alternate
    model = classlm.Model(classes, step, None, np.ones(classlm.TOTAL), np.array([600, 9, 9, 9, 9]), 0, 0)
    for r in classlm.coded(blocks, model).collect():
        for word, code in zip(dict(texts)[r.doc_id].split(), r.codes):
            if code >= classlm.HEAD:
                n, found = divmod(code - classlm.HEAD, 3)
                assert n == met[word] and found == {"a": 2, "b": 1}[word[0]]


def test_all_words_and_one_unknown_sum_to_one(spark):
    random = np.random.default_rng(9)
    rare = [(n, c) for n in (1, 1, 1, 2, 5) for c in (1, 2, 7)]  # count and class of words beyond the head
    head_counts = np.zeros(classlm.HEAD, "int64")
    tokens = [0] * 30 + [i for i in (1, 2, 3) for _ in range(4)] + [classlm.HEAD + n * classlm.CLASSES + c for n, c in rare for _ in range(n)]
    head_counts[:4] = 30, 4, 4, 4
    random.shuffle(tokens)
    df = spark.createDataFrame([(False, tokens)], "held_out boolean, codes array<long>")
    model = classlm.Model(classlm.first_classes(), None, None, None, head_counts, 0, 0)
    model = classlm.refitted(df, model)
    words = np.array([0, 1, 2, 3, *(classlm.HEAD + n * classlm.CLASSES + c for n, c in rare), classlm.HEAD])
    before = 3
    following = [10 ** classlm.log_probability(model, np.array([before, w]))[1] for w in words]
    used = {0, 1, 2, 3, 4, 7, classlm.CLASSES}
    _, classes = classlm.counts_and_classes(model, np.array([before]))
    empty = sum(10 ** model.step[classes[0], c] for c in range(classlm.CLASSES + 1) if c not in used)
    assert math.isclose(sum(following) + empty, 1)


def test_documents_of_a_group_are_scored_at_once_and_each_as_if_alone(monkeypatch):
    random = np.random.default_rng(11)
    docs = [np.append(random.choice([1, 2, 3, classlm.HEAD, classlm.HEAD + 2 * classlm.CLASSES + 7], n), 0) for n in random.integers(0, 60, 50)]
    step = classlm.transitions(random.integers(0, 9, (classlm.CLASSES + 1, classlm.CLASSES + 1)).astype(float))
    head_counts = np.append([30, 4, 1, 2], np.zeros(classlm.HEAD - 4, "int64"))
    model = classlm.Model(classlm.first_classes(), step, None, np.full(classlm.CLASSES + 1, 9.0), head_counts, 300, 7)
    calls, own = [], classlm.counts_and_classes
    monkeypatch.setattr(classlm, "counts_and_classes", lambda *x: calls.append(x) or own(*x))
    found = list(classlm.score_rows(model, docs))
    assert len(calls) == 2
    for row, doc in zip(found, docs, strict=True):
        counts = own(model, doc)[0]
        base = sum(math.log10((c + 0.1) / (300 + 0.1 * 8)) for c in counts.tolist())
        assert row[:3] == (len(doc), (counts > 0).sum(), 300) and math.isclose(row[3], base, rel_tol=1e-12)
        assert row[4] == classlm.log_probability(model, doc).sum() and row == next(classlm.score_rows(model, [doc]))
