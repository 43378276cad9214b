import math
from collections import Counter

import pytest

from conftest import rows
from fedlens.llm import queries, term_stages


def expected(docs, items, k):
    """Every document scored for every item."""
    counted = [(d, Counter(w for w in term_stages.terms_of(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    for item_id, text in items:
        asked = Counter(term_stages.terms_of(text))
        found = []
        for doc_id, counts, n in counted:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t, times in asked.items()
                if t in counts
            )
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(found)[:k], 1):
            yield item_id, rank, doc_id, -score


ITEMS = [(0, "The CAT sat"), (1, None), (2, ""), (3, "w5 w6 W6 zz été"), (3, "w5 w6 W6 zz été"), (None, "a document one"), (4, "...")]


@pytest.mark.parametrize("round_terms", [100_000, 5])
def test_search_of_hard_rows(spark, hard, nothing, monkeypatch, round_terms):
    """With few terms a round, every item is answered in a round of its own or with few others."""
    monkeypatch.setattr(term_stages, "ROUND_TERMS", round_terms)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, item int")
    found = [tuple(r) for r in term_stages.search(spark, hard, items, k=4).collect()]
    want = list(expected([(r.doc_id, r.text) for r in hard.collect()], ITEMS, 4))
    assert sorted(found, key=str) == sorted(want, key=str) and len(want) > 8
    if round_terms > 5:
        assert term_stages.search(spark, nothing, items).count() == 0
        assert term_stages.search(spark, hard, items.limit(0)).count() == 0


def test_pruning_and_blocks_change_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(term_stages, "BLOCK_DOCS", 37)
    docs = queries.documents(spark, sf).repartition(5)
    items = queries.table(spark, sf, "benchmark")
    found = rows(term_stages.search(spark, docs, items, k=3), "item_id", "rank", "doc_id", "score")
    pairs = lambda df, c: [(r[c], r.text) for r in df.select(c, "text").collect()]
    assert found == sorted(expected(pairs(docs, "doc_id"), pairs(items, "item_id"), 3))


def test_peak_bounds_every_impact():
    for n_docs, n_terms in ((1, 1), (3, 1000), (10, 25), (7, 7)):
        for most in (1, 2, 5, 40):
            bound = term_stages.peak(most, n_docs, n_terms)
            for tf in range(1, most + 1):
                for n in (tf, tf + 1, 10 * tf):
                    m = term_stages.norm(n, n_docs, n_terms)
                    assert 10**9 * tf // (1000 * tf + 8 * m) <= bound
