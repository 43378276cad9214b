import collections
import re

import pytest

from conftest import rows
from fedlens.llm import collocations, queries


def expected(texts, support, longest, percent, top):
    """Counts of every phrase, cuts and containment as the docstring has them, in plain Python."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = collections.defaultdict(collections.Counter)
    for lang, text in texts:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(fold)):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    f["und" if lang is None else lang][tuple(words[at : at + size])] += 1
    for lang, counts in f.items():
        found, n = [], sum(a for p, a in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        for p, a in candidates.items():
            around = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= percent * a for b in around):
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, p.decode(), -a, l, r, n, -score


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("shards, parts", [(1, 1), (3, 5), (8, 2)])
def test_phrases_do_not_hang_on_shards(spark, sf, shards, parts):
    docs = queries.documents(spark, sf).where("doc_id < 120").repartition(parts)
    texts = [(r.lang, r.text) for r in docs.collect()]
    found = collocations.collocations(spark, docs, support=6, shards=shards, top=150)
    assert rows(found, *COLUMNS) == sorted(expected(texts, 6, 4, 80, 150))


def test_phrases_of_hard_rows(spark, hard, nothing):
    more = spark.createDataFrame(
        [(20, "To be, to be A a\x00b to\x0bbe été ÉTÉ", None, "s", 1, "k", 0), (21, None, None, None, 1, "k", 0)], hard.schema
    )
    docs = hard.union(more).union(more)
    texts = [(r.lang, r.text) for r in docs.collect()]
    found = collocations.collocations(spark, docs, support=2, longest=3)
    want = sorted(expected(texts, 2, 3, 80, 2000))
    assert rows(found, *COLUMNS) == want and any(w[0] == "und" for w in want)
    assert collocations.collocations(spark, nothing).count() == 0


def test_hashes_that_meet_do_not_join_counts(spark, monkeypatch):
    """With one hash for all words, only the exact comparison keeps phrases apart."""
    monkeypatch.setattr(collocations.Hashes, "__missing__", lambda self, word: self.setdefault(word, 7))
    texts = [("en", "a b c. a b d. c d"), ("en", "a b. c d a"), ("fr", "a b a b")]
    docs = spark.createDataFrame([(i, t, l) for i, (l, t) in enumerate(texts)], "doc_id long, text string, lang string")
    assert rows(collocations.collocations(spark, docs, support=2), *COLUMNS) == sorted(expected(texts, 2, 4, 80, 2000))
