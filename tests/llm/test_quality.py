import collections
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from fedlens.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_stats(text):
    text = text or ""
    words = WORD.findall(text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


@settings(deadline=None, max_examples=300)
@given(st.text("ab \n\t#\x1c\xa0", max_size=60))
def test_stats_match_brute_force(text):
    assert quality.text_stats(text) == slow_stats(text)


def test_base_of_the_table_and_hard_rows(spark, sf, duck, hard, nothing):
    found = queries.op2_quality_rules(spark, sf).collect()
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert len(found) == len(texts)
    for r in found:
        want = slow_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    judged = quality.judged(spark, hard)
    assert judged.count() == hard.count()
    assert rows(judged.select("doc_id").where("quality.kept")) == [(7,), (7,)]
    assert quality.clean_documents(spark, hard).columns == hard.columns
    assert quality.clean_documents(spark, nothing).count() == 0


def estimate_by_hand(x, floor):
    """The same estimate of one group in numpy, row by row."""

    def bins(d2):
        return np.floor(16 * np.log2(d2 + 2.0**-8))

    def spread(v):
        q = np.percentile(v, [25, 50, 75], axis=0)
        return q[1], np.maximum((q[2] - q[0]) / 1.349, floor)

    def squared(mean, cov):
        z = x - mean
        return np.maximum(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z), 0)

    mid, s = spread(x)
    z = (x - mid) / s
    tanh = np.round(1024 * np.tanh(z))
    norm = np.sqrt((z * z).sum(1))
    signs = np.round(1024 * np.divide(z, norm[:, None], out=np.zeros_like(z), where=norm[:, None] > 0))
    eye = np.eye(4)
    begin = [np.diag(s**2)]
    for v in (tanh, signs):
        cov = np.cov(v.T, bias=True) + eye * 1e-6
        d = np.sqrt(np.diag(cov))
        begin.append(cov / np.outer(d, d) * np.outer(s, s))
    best = None
    for cov in begin:
        mean, cov = mid, cov + eye * floor**2
        for _ in range(quality.STEPS):
            b = bins(squared(mean, cov))
            order = np.sort(b)
            near = x[b <= order[int(np.ceil(0.75 * len(x))) - 1]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + eye * floor**2
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, mean, cov
    d2 = squared(*best[1:])
    middle = np.percentile(bins(d2) + 0.5, 50)
    return d2 / max((2 ** (middle / 16) - 2.0**-8) / quality.CHI_MEDIAN, 1.0)


def test_estimate_matches_numpy(spark):
    random = np.random.default_rng(3)
    x = np.round(np.vstack([random.normal([400, 200, 0, 100], [90, 200, 60, 150], (900, 4)), random.normal([900, 900, 700, 900], 30, (90, 4))]))
    df = spark.createDataFrame([("g", list(map(int, r))) for r in x], "group string, x array<long>")
    model = quality.estimate(spark, df)
    got = df.join(model, "group").select("x", (quality.distance() / quality.F.col("unit")).alias("d")).collect()
    want = collections.defaultdict(list)
    for row, d in zip(x, estimate_by_hand(x, quality.FLOOR)):
        want[tuple(map(int, row))].append(d)
    for r in got:
        assert np.isclose(r.d, want[tuple(r.x)][0], rtol=1e-6)
    again = rows(quality.estimate(spark, df.repartition(7)))
    assert again == rows(model)


def test_outliers_go_and_clean_rows_stay(spark):
    random = np.random.default_rng(1)
    vocabulary = ["".join(random.choice(list("abcdefgh"), random.integers(2, 9))) for _ in range(3000)]
    clean = [" ".join(random.choice(vocabulary, random.integers(60, 400))) for _ in range(600)]
    junk = ["#|$ ".join(random.choice(vocabulary, 120)) for _ in range(15)]
    texts = [(i, t, "en", "hot" if i % 3 else f"s{i % 50}") for i, t in enumerate(clean + junk)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.clean_documents(spark, df).select("doc_id").collect()}
    assert kept == set(range(600))


def test_planted_junk_goes_and_verdicts_move_smoothly(spark, sf):
    """Glued words, encoded blobs and dense symbols among whole documents; and a source that grows row by row."""
    import base64

    docs = [r for r in queries.documents(spark, sf).select("doc_id", "text", "lang", "source").collect()]
    base = [r for r in docs if 150 <= len(WORD.findall(r.text or "")) <= 2000][::40][:15]
    glue = lambda n: lambda t: " ".join("".join(w[i : i + n]) for w in [WORD.findall(t)] for i in range(0, len(w), n))
    blob = lambda t: " ".join(base64.b64encode(w.encode() * 6).decode() for w in WORD.findall(t))
    dense = lambda t: " ".join(w + (" #" if i % 10 == 0 else "") for i, w in enumerate(WORD.findall(t)))
    planted, kinds = [], {"twos": glue(2), "threes": glue(3), "blobs": blob, "symbols": dense}
    for k, (kind, change) in enumerate(kinds.items()):
        planted += [(10**6 * (k + 1) + r.doc_id, change(r.text), r.lang, r.source) for r in base]
    df = spark.createDataFrame([tuple(r) for r in docs] + planted, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r.quality for r in quality.judged(spark, df).select("doc_id", "quality").collect()}
    good = {r.doc_id for r in queries.table(spark, sf, "labels").where("quality = 1").collect()}
    plain = [found[r.doc_id] for r in docs if r.doc_id in good and not found[r.doc_id].base_failed]
    assert len(plain) > 200 and sum(q.kept for q in plain) > 0.98 * len(plain)
    caught = {}
    for k, kind in enumerate(kinds):
        fit = [found[10**6 * (k + 1) + r.doc_id] for r in base]
        passed = [q for q in fit if not q.base_failed]
        caught[kind] = sum(not q.kept for q in passed) / len(passed)
    assert caught.pop("twos") >= 0.8 and min(caught.values()) >= 0.9, caught


def test_estimates_move_with_every_row(spark):
    """Nothing jumps where a source passes some number of rows."""
    random = np.random.default_rng(7)
    x = [list(map(int, r)) for r in np.round(random.normal([400, 0, 0, 0], [30, 5, 5, 5], (260, 4)))]
    far = [list(map(int, r)) for r in np.round(random.normal([500, 0, 0, 0], [30, 5, 5, 5], (260, 4)))]
    centres = []
    for n in (1, 50, 150, 199, 200, 201, 260):
        rows_ = [("en", "big", v) for v in x] + [("en", "new", v) for v in far[:n]]
        df = spark.createDataFrame(rows_, "lang string, source string, x array<long>").select("*", *quality.group_names())
        each = df.select(quality.F.explode(quality.F.array("own_", "of_lang_", "of_all_")).alias("group"), "x")
        sizes = df.groupBy("lang", "source", "own_", "of_lang_", "of_all_").agg(quality.F.count("*").alias("n"))
        known = quality.blended(sizes, quality.estimate(spark, each)).where("of_source = 'new'").collect()
        centres.append(known[0].m0)
    assert abs(centres[4] - centres[3]) < 3 and abs(centres[5] - centres[4]) < 3
    assert centres[0] < 425 and centres[-1] > 440


def test_rows_never_go_through_the_driver(spark, monkeypatch):
    """Rows of few values are small as files, so that Spark would send all of them; the groups beside them are sent instead."""
    plans, kept = [], quality.stored

    def seen(spark, df, purpose):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(spark, df, purpose)

    text = "a few words that are long enough to be counted " * 9
    docs = spark.createDataFrame([(i, f"{text} {i}", "en", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(quality, "stored", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        each = quality.measure(spark, docs).select("lang", "source", *quality.group_names(), quality.shape("quality").alias("x"))
        each = kept(spark, each, "rows").selectExpr("explode(array(own_, of_lang_, of_all_)) AS group", "x")
        assert quality.estimate(spark, each).count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows_first = [p for p in plans if "posexplode" not in p and re.search(r"Join .*group", p)]
    assert len(rows_first) >= 5 and not any(re.search(r"Join \[group.*BuildLeft", p) for p in rows_first)
