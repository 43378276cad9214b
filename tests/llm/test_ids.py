import collections
import weakref
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import rows
from fedlens.llm import idfiles, packing, queries
from fedlens.llm.common import ChunkEncoder
from fedlens.session import workspace

BYTE, WORD = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("word_bpe_49k.json")
SPACY = st.text(alphabet=" \t\n\x0b\r\x1c\xa0 .,a1é'<|>", max_size=30)


@pytest.fixture(scope="module")
def coders():
    return [(ChunkEncoder(BYTE, False), Tokenizer.from_file(BYTE)), (ChunkEncoder(WORD, True), Tokenizer.from_file(WORD))]


@settings(deadline=None, max_examples=200)
@given(text=st.one_of(SPACY, st.text(max_size=30)))
def test_chunks_give_the_ids_of_the_whole_text(coders, text):
    for chunked, whole in coders:
        assert np.frombuffer(chunked(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=300)
@given(text=st.text(alphabet="aBsSTre'1290.,&%ßàÀÖÿÞ×÷²ªÿ<|>é\u0301 \n", max_size=40))
def test_words_of_latin_letters_give_the_ids_of_the_library(coders, text):
    for chunked, whole in coders:
        assert np.frombuffer(chunked(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_words_of_latin_letters_need_no_call_of_the_library():
    text = "Éauxtreé&&& L'été n'est-il 88.169.244.62, zuschung%%% $12.50 don't THEY'LL (ÑÕ) " + "Straße" * 20
    coder, sent = ChunkEncoder(WORD, True), []
    whole = coder.tokenizer.encode(text, add_special_tokens=False).ids

    class Library:
        def encode_batch_fast(self, chunks, add_special_tokens):
            sent.extend(chunks)
            return []

    coder.tokenizer = Library()
    assert np.frombuffer(coder(text), "<u4").tolist() == whole and not sent


def test_texts_of_latin_letters_are_cut_without_a_call_of_the_library():
    text = "Éauxtreé&&& d'été  n'est-il\n\n88.169 \t zuschüng%%% don't they'll 've '' 's\r\n" + "Größe" * 20 + " "
    coder, sent = ChunkEncoder(BYTE, False), []
    whole = coder.tokenizer.encode(text, add_special_tokens=False).ids

    class Library:
        def encode_batch_fast(self, chunks, add_special_tokens):
            sent.extend(chunks)
            return []

    coder.tokenizer = Library()
    assert np.frombuffer(coder(text), "<u4").tolist() == whole and not sent


LATIN = st.text(alphabet="aBsSTredmlv''1290.,&%ßÀÖÿé  \t\n\r<|>", max_size=40)


@settings(deadline=None, max_examples=200)
@given(groups=st.lists(st.lists(st.one_of(LATIN, SPACY, st.none(), st.just("<|endoftext|>it's"), st.just("xy" * 40)), max_size=6), max_size=4))
def test_groups_of_texts_give_the_ids_of_the_library(coders, groups):
    """Also when the table begins anew with every group."""
    for coder, whole in coders:
        bound = coder.table.bound
        for coder.table.bound in (0, bound):
            for texts in groups:
                found = [np.frombuffer(x, "<u4").tolist() for x in coder.many(texts)]
                assert found == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_what_a_task_remembers_goes_with_its_encoder():
    coder = ChunkEncoder(WORD, True)
    coder("Größe it's 12")
    table = weakref.ref(coder.table)
    del coder
    assert table() is None


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_holds_every_piece_and_no_window_overflows(counts):
    total = collections.Counter()
    for pattern, times in packing.plan_windows(counts, 64):
        assert sum(x * n for x, n in pattern.items()) <= 64
        for x, n in pattern.items():
            total[x] += n * times
    assert total == collections.Counter(counts)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_first_window_is_as_full_as_brute_force(lengths):
    first, *rest = sorted(lengths, reverse=True)
    sums = {0}
    for x in rest:
        sums |= {s + x for s in sums if s + x <= 40 - first}
    best = min(packing.padding(first + s, 40) for s in sums)
    found = packing.least_slack(collections.Counter(lengths), 40)
    assert packing.padding(sum(x * n for x, n in found.items()), 40) == best


def check_packing(pieces, texts):
    whole = Tokenizer.from_file(BYTE)
    ids = collections.defaultdict(list)
    for doc_id, text in texts:
        ids[doc_id].append(whole.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_sequence = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        own = ids[p.doc_id][0]
        assert p.doc_tokens == len(own)
        part = np.asarray(own[p.start : p.start + p.length], "<u4")
        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
        by_doc[p.doc_id] += p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc == {k: sum(map(len, v)) for k, v in ids.items()}
    pad = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        pad += packing.padding(at, 2048)
    return pad, sum(by_doc.values())


def test_packing_of_hard_rows(spark, hard, nothing):
    found = packing.pack(spark, hard, BYTE).collect()
    check_packing(found, [(r.doc_id, r.text) for r in hard.collect()])
    assert packing.pack(spark, nothing, BYTE).count() == 0


def test_packing_of_the_table_pads_little(spark, sf, duck):
    found = queries.op7_packing(spark, sf).collect()
    pad, total = check_packing(found, duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert pad < 0.01 * total


def expected(texts):
    whole, start = Tokenizer.from_file(WORD), 0
    for doc_id, text in sorted(texts, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        yield doc_id, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_of_hard_rows(spark, hard, nothing, encoding):
    path = workspace(spark, "ids")
    idfiles.write_ids(hard, path, WORD, encoding)
    found = idfiles.digests(idfiles.read_ids(spark, path)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected([(r.doc_id, r.text) for r in hard.collect()]), key=str)
    assert idfiles.read_ids(spark, path, 7, 8, ids=False).count() == 3
    idfiles.write_ids(nothing, path, WORD, encoding)
    assert idfiles.read_ids(spark, path).count() == 0


def test_files_of_the_table(spark, sf, duck):
    found = rows(queries.op9_id_files(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == sorted(expected(duck.sql("SELECT doc_id, text FROM documents").fetchall()))


def test_files_are_ordered_and_have_page_indexes(spark, sf, tmp_path):
    path = workspace(spark, "ids")
    idfiles.write_ids(queries.documents(spark, sf), path, WORD, page_rows=50)
    import glob

    last = -1
    for name in sorted(glob.glob(f"{path.removeprefix('file:')}/part-*")):
        ids = pq.read_table(name, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
        column = pq.ParquetFile(name).metadata.row_group(0).column(4)
        assert column.has_offset_index and "DICTIONARY" in str(column.encodings)
