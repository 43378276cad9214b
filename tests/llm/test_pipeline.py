import collections
import re

import corpus_pipeline
from conftest import rows
from fedlens.llm import quality
from llm.test_ids import check_packing
from llm.test_jaccard import brute as near_groups


def removed(texts, span):
    """Texts without the runs that a smaller document holds."""
    first = {}
    split = {d: t.encode().split() for d, t in texts.items()}
    for d, w in sorted(split.items()):
        for i in range(len(w) - span + 1):
            first.setdefault(tuple(w[i : i + span]), d)
    for d, w in split.items():
        gone = {j for i in range(len(w) - span + 1) if first[tuple(w[i : i + span])] < d for j in range(i, i + span)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else texts[d]
        if kept or not gone:
            yield d, kept


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    results = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = corpus_pipeline.workspace(spark, "test-stage")
        stage(spark, results[-1], sf).write.parquet(path)
        results.append(spark.read.parquet(path))
        assert name == "packing" or results[-1].columns == columns
    texts = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in results[:-1]]
    assert set(texts[1]) < set(texts[0]) and len(texts[1]) > 0.5 * len(texts[0])
    stay = {d for d, _, group in near_groups(list(texts[1].items()), 5, 80) if d == group}
    assert texts[2] == {d: t for d, t in texts[1].items() if d in stay}
    assert texts[3] == dict(removed(texts[2], corpus_pipeline.PASSAGE_WORDS))
    assert set(texts[4]) == set(texts[3])
    for d, t in texts[4].items():
        pattern = ".*?".join(map(re.escape, t.split("[SECRET]")))
        assert re.fullmatch(pattern, texts[3][d], re.S)
    assert any("[SECRET]" in t for t in texts[4].values())
    check_packing(results[-1].collect(), list(texts[4].items()))
    assert sorted(rows(corpus_pipeline.run(spark, sf), "doc_id", "start", "ids_crc32")) == rows(results[-1], "doc_id", "start", "ids_crc32")


def test_hard_rows(spark, hard, nothing):
    for docs in (hard, nothing):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, "")
            if name != "packing":
                assert found.columns == docs.columns
            ids = collections.Counter(r.doc_id for r in found.select("doc_id").distinct().collect())
            assert set(ids) <= {r.doc_id for r in docs.collect()}


def test_the_first_stage_sends_no_rows_through_the_driver(spark, monkeypatch):
    """With Spark's own limit for broadcasts, the rows that estimates are made of are the smaller side as files, but not in memory."""
    plans, kept = [], quality.stored

    def seen(spark, df, purpose):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(spark, df, purpose)

    monkeypatch.setattr(quality, "stored", seen)
    text = "a few words that are long enough to be counted " * 9
    docs = spark.createDataFrame([(i, f"{text} {i}" if i % 9 else "short", "en", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        stage = dict(corpus_pipeline.STAGES)["quality rules"]
        assert {r.doc_id % 9 for r in stage(spark, docs, "").collect()} <= set(range(1, 9))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for p in plans for line in p.split("\n") if re.search(r"Join \[group", line)]
    assert len(joins) >= 4 and not any("BuildLeft" in line for line in joins)
