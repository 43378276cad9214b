import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import rows
from fedlens.llm import bpe_trie, queries

WORD = queries.vocabulary("word_bpe_49k.json")
TEXTS = st.one_of(
    st.text(max_size=40),
    st.text("abehinorst' \x1c\xa0.,!|<>1é", max_size=40),
    st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "the", "aaaa", "----", "'ll", " ", "don't", "é"]), max_size=12).map("".join),
)


@pytest.fixture(scope="module")
def table():
    return bpe_trie.MergeTable(WORD)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())


@settings(deadline=None, max_examples=150)
@given(texts=st.lists(TEXTS, max_size=6), bound=st.sampled_from([0, 1 << 20]))
def test_ids_of_texts_are_those_of_the_library(table, library, texts, bound):
    encoder = bpe_trie.Encoder(table, bound)
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_walked_once_a_task_whatever_stands_beside_it(table, library, monkeypatch):
    walked, walk = [], table.encode
    monkeypatch.setattr(table, "encode", lambda words: walked.extend(words) or walk(words))
    encoder = bpe_trie.Encoder(table)
    for text in ("Größe, (größe) Carpet.", "carpet? größe! carpet;carpet " + "größe" * 4, "GRÖßE carpet|" + "größe" * 4):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(walked) == len(set(walked))


@settings(deadline=None, max_examples=60)
@given(lists=st.lists(st.one_of(st.none(), st.lists(st.integers(0, 49407), max_size=9)), max_size=9), at_once=st.sampled_from([1, 4, 1 << 18]))
def test_lists_of_ids_are_decoded_as_the_library_does(table, library, lists, at_once):
    ids = pa.array([[5], *lists], pa.list_(pa.int32()))[1:]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe_trie, "DECODED", at_once)
        found = [text.decode() for text in bpe_trie.Decoder(table)(ids)]
    assert found == [library.decode(x or [], skip_special_tokens=False) for x in lists]


@pytest.mark.parametrize("wrong", [-1, 49408])
def test_an_unknown_id_is_refused(table, wrong):
    with pytest.raises(ValueError):
        list(bpe_trie.Decoder(table)(pa.array([[5, wrong]], pa.list_(pa.int32()))))


def test_shared_prefixes_are_walked_once(table, monkeypatch):
    seen = []
    step, edges = table.step, table.edges

    class Watched(dict):
        def get(self, key):
            seen.append(key)
            return edges.get(key)

    monkeypatch.setattr(table, "edges", Watched(edges))
    monkeypatch.setattr(table, "step", lambda node, symbol: next((0 for _ in ()), 0) if not node else step(node, symbol))
    words = [table.closed(w) for w in ("carpet", "carpets", "carp", "care", "carpet")]
    found = table.encode(words)
    assert len(found) == 4
    # c a r p e t s, and the closed ends of carp, care, carpet, carpets: every node of the trie is reached once
    letters = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert len([k for k in seen if isinstance(k, tuple)]) <= 2 * len(letters) + 8


def rule(merges, vocabulary):
    """Reference: the merge of least rank, leftmost first, until none is left."""
    ranks = {tuple(m): i for i, m in enumerate(merges)}

    def encode(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
            if best is None:
                return [vocabulary[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    return encode


@settings(deadline=None, max_examples=40)
@given(data=st.data())
def test_any_merges_in_order_give_the_rule(table, tmp_path_factory, data):
    """Small vocabularies with merges that compete, and tokens that are never made."""
    spec = json.loads(open(WORD, encoding="utf-8").read())
    letters = [p for p in spec["model"]["vocab"] if len(p.removesuffix("</w>")) == 1]
    vocabulary = {p: i for i, p in enumerate(letters)}
    pieces, merges = ["a", "b", "a</w>", "b</w>"], []
    for _ in range(data.draw(st.integers(0, 9))):
        a, b = data.draw(st.sampled_from([p for p in pieces if not p.endswith("</w>")])), data.draw(st.sampled_from(pieces))
        if a + b not in vocabulary:
            vocabulary[a + b] = len(vocabulary)
            pieces.append(a + b)
            merges.append([a, b])
    spec["model"] |= {"vocab": vocabulary, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path_factory.mktemp("bpe") / "small.json"
    path.write_text(json.dumps(spec))
    own = bpe_trie.MergeTable(str(path))
    reference = rule(merges, vocabulary)
    words = data.draw(st.lists(st.text("ab", min_size=1, max_size=12), max_size=8))
    found = own.encode({own.closed(w) for w in words})
    for w in words:
        assert found[own.closed(w)] == reference(w)


def test_vocabulary_out_of_order_is_refused(tmp_path):
    spec = json.loads(open(WORD, encoding="utf-8").read())
    spec["model"]["merges"].reverse()
    (tmp_path / "odd.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe_trie.MergeTable(str(tmp_path / "odd.json"))


def test_digests_of_hard_rows(spark, hard, nothing, library):
    found = [tuple(r) for r in bpe_trie.digests(spark, hard, WORD).collect()]
    want = [(r.doc_id, *digest(library, r.text)) for r in hard.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    encoded = bpe_trie.encode_documents(spark, hard, WORD)
    texts = sorted((tuple(r) for r in bpe_trie.decode_documents(spark, encoded, WORD).collect()), key=str)
    ids = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in hard.collect()]
    assert texts == sorted(((d, library.decode(i, skip_special_tokens=False)) for d, i in ids), key=str)
    assert bpe_trie.encode_documents(spark, nothing, WORD).count() == 0


def test_digests_of_the_table(spark, sf, duck, library):
    found = rows(queries.op13_bpe_trie(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert found == sorted((d, *digest(library, t)) for d, t in texts)
