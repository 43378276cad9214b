import collections
import random
import re
import zlib

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from fedlens.llm import merge_dropout, merge_rows, queries, token_count

PIECES = queries.vocabulary("piece_bpe_32k.model")


def greedy(vocabulary, word):
    n = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not size:
            return -1
        word, n = word[size:], n + 1
    return n


@settings(deadline=None, max_examples=300)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.text("abc", max_size=14))
def test_automaton_counts_greedy_pieces(vocabulary, word):
    assert token_count.Automaton(vocabulary).count(word.encode()) == greedy(vocabulary, word.encode())


def test_counts_of_hard_rows(spark, hard, nothing):
    vocabulary = set(token_count.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken")))
    want = []
    for r in hard.collect():
        words = (r.text or "").encode().split()
        if max(map(len, words), default=0) < 1000:
            want.append((r.doc_id, len(words), sum(greedy(vocabulary, b" " + w) for w in words), 0))
    found = [tuple(r) for r in token_count.count_tokens(spark, hard, vocabulary).collect()]
    assert not collections.Counter(want) - collections.Counter(found) and len(found) == hard.count()
    assert token_count.count_tokens(spark, nothing, vocabulary).count() == 0
    few = token_count.count_tokens(spark, hard, [b" one", b" on"]).where("doc_id IN (5, 8)")
    assert rows(few) == [(5, 10, 10, 10), (8, 1, 1, 0)]


def test_counts_of_the_table(spark, sf, duck):
    vocabulary = set(token_count.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken")))
    found = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert len(found) == len(texts)
    for doc_id, text in texts[::9]:
        assert found[doc_id].n_tokens == sum(greedy(vocabulary, b" " + w) for w in (text or "").encode().split())


def test_without_dropout_ids_are_the_models(spark, hard):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in merge_dropout.encode_documents(spark, hard, PIECES, rate=0.0).collect():
        if "▁" not in (r.text or ""):
            assert r.ids == model.encode(r.text or "")


def test_dropout_varies_repeats_and_decodes(spark, hard, nothing):
    runs = [merge_dropout.encode_documents(spark, hard.repartition(n), PIECES, rate=0.3, seed=s) for n, s in ((1, 1), (5, 1), (3, 2))]
    same, again, other = ([(r.doc_id, r.text, tuple(r.ids)) for r in x.collect()] for x in runs)
    assert collections.Counter(same) == collections.Counter(again) != collections.Counter(other)
    decoded = runs[0].withColumn("decoded", merge_dropout.decode(spark, PIECES)("ids"))
    assert all(r.decoded == (r.text or "") for r in decoded.collect())
    assert merge_dropout.digests(spark, merge_dropout.encode_documents(spark, nothing, PIECES), PIECES).count() == 0
    long = next(i for d, _, i in same if d == 0)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(long) > len(model.encode("The cat sat on the mat. " * 30))


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=40), st.floats(0, 1), st.integers(0, 9))
def test_any_text_comes_back(text, rate, seed):
    coder = merge_dropout.Encoder(VOCABULARY, rate, seed, 4)
    assert coder.decode(coder.encode(seed, text)) == text


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=" thesxé", max_size=60), st.floats(0, 1), st.integers(0, 9))
def test_both_agendas_agree(chunk, rate, seed):
    skip = merge_dropout.Variant(VOCABULARY, rate, seed, 0).dropout(chunk)
    short, long = (f(VOCABULARY.scores, chunk, skip) for f in (merge_dropout._merged_short, merge_dropout._merged_long))
    assert short == long


VOCABULARY = merge_dropout.Vocabulary(PIECES)


def test_dropout_of_the_table(spark, sf, duck):
    found = queries.op3_merge_dropout(spark, sf)
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    coder = merge_dropout.Encoder(VOCABULARY, 0.1, 20240, 2)
    for r in found.collect():
        assert r.lossless and r.n_chars == len(texts[r.doc_id] or "")
        if r.doc_id % 20 == 0:
            ids = coder.encode(r.doc_id, texts[r.doc_id])
            assert (len(ids) // 4, zlib.crc32(ids)) == (r.n_pieces, r.ids_crc32)
    assert found.count() == len(texts)


def test_every_occurrence_is_drawn_on_its_own():
    word = " international"
    coder = merge_dropout.Encoder(VOCABULARY, 0.1, 7)
    found = collections.Counter()
    for doc_id in range(40):
        text = ("the" + word * 50 + " " + "x" * 70)[: 3 + 50 * len(word) + (doc_id % 2) * 71]
        ids = np.frombuffer(coder.encode(doc_id, text), "<u4").tolist()
        want, place = [], 0
        for chunk in coder.chunks(" " + text):
            want += merge_dropout.merged(VOCABULARY, chunk, merge_dropout.Variant(VOCABULARY, 0.1, 7, doc_id).dropout(chunk, place))
            if chunk == word:
                found[tuple(merge_dropout.merged(VOCABULARY, chunk, merge_dropout.Variant(VOCABULARY, 0.1, 7, doc_id).dropout(chunk, place)))] += 1
            place += len(chunk)
        assert ids == want  # what is remembered gives the ids of merging each occurrence anew
    random = np.random.default_rng(0)
    free = collections.Counter(tuple(merge_dropout.merged(VOCABULARY, word, lambda place, piece: random.random() < 0.1)) for _ in range(2000))
    assert found.total() == 2000 and len(found) > 20
    assert all(abs(found[ids] - n) < 80 for ids, n in free.items())


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(alphabet=" thesxé", max_size=60), max_size=5), st.floats(0, 1))
def test_what_is_remembered_changes_nothing(texts, rate):
    one, other = merge_dropout.Encoder(VOCABULARY, rate, 3), merge_dropout.Encoder(VOCABULARY, rate, 3, 6)
    for i, text in enumerate(texts):
        assert one.encode(i, text) == other.encode(i, text) == merge_dropout.Encoder(VOCABULARY, rate, 3).encode(i, text)


def test_paths_stay_within_their_room():
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 40))) for _ in range(60)) for _ in range(40)]
    narrow, wide = merge_dropout.Encoder(VOCABULARY, 0.3, 3, room=1 << 18), merge_dropout.Encoder(VOCABULARY, 0.3, 3)
    for i, text in enumerate(texts * 2):
        assert narrow.encode(i, text) == wide.encode(i, text)
        kept = [*narrow.paths.values(), *narrow.older.values()]
        one_text = 1 << 18  # a text's own paths are met before the bound is looked at again
        assert sum(p.size()[1] for p in kept) <= (1 << 18) + one_text
    assert sum(p.size()[1] for p in wide.paths.values()) > 1 << 20


PAIRS = merge_rows.Pairs(VOCABULARY.scores)


def in_group(rows, rate, seed):
    ids, ends = merge_dropout.grouped(VOCABULARY, PAIRS, rate, seed).many(rows)
    return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.none() | st.text(max_size=40) | st.text(alphabet=" thesxé▁漢", max_size=90), max_size=6), st.floats(0, 1))
def test_groups_of_texts_get_the_ids_of_each_text(texts, rate):
    one = merge_dropout.Encoder(VOCABULARY, rate, 3)
    assert in_group(list(enumerate(texts)), rate, 3) == [one.encode(i, text) for i, text in enumerate(texts)]


def test_equal_costs_go_to_the_leftmost_candidate():
    costs = {"a": (9, 0), "b": (9, 1), "c": (9, 2), "ab": (1, 4), "bc": (1, 3), "abc": (2, 5), "ca": (0, 6)}
    pairs = merge_rows.Pairs(costs)
    assert (pairs.keys >= 0).sum() == 5  # a+bc and ab+c both make abc
    for chunk in ("abc", "abcab", "bcabc", "cabx", "xx"):
        parts = np.full((len(chunk) + 1, 1), pairs.other, "int32")
        parts[:-1, 0] = pairs.of_char[list(map(ord, chunk))]
        merge_rows.merge_rows(pairs, parts, lambda column, place, ids: np.zeros(len(ids), bool))
        want = merge_dropout._merged_short(costs, chunk, lambda place, piece: False)
        found = [list(costs)[p] if p < len(costs) else "x" for p in parts[:-1, 0] if p >= 0]
        assert found == want


def test_no_chunk_of_usual_length_is_merged_by_itself(monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choices("theandsoing", k=rng.randint(1, 30))) for _ in range(200))) for i in range(20)]
    want = [merge_dropout.Encoder(VOCABULARY, 0.1, 3).encode(*row) for row in rows]
    for name in ("_merged_short", "_merged_long"):
        monkeypatch.setattr(merge_dropout, name, None)
    assert in_group(rows, 0.1, 3) == want
