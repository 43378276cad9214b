"""Quality rules: fixed limits, then robust multivariate outliers of each language and source.

Shape statistics of a text are put on a log scale and rounded to a grid, so that sums over any number of rows are exact
integers and do not hang on partitioning. Each group gets a minimum-covariance-determinant estimate: three deterministic
starts are sharpened by concentration steps, and the one with the smallest determinant wins. A step is one pass: rows are
counted, with sums and products, by group, start and a fine bin of log distance; the bins that hold the nearest three
quarters give the next centre and covariance. So the hottest group costs a few hundred rows after partial aggregation.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fedlens.llm.common import stored

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
GRID = 256
DIMS = 4
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
#: Least spread each statistic is taken to have, in log units. Mean word length varies little between texts of 50 words and
#: more. The shares jump: by one symbol, and where a line of a short text is repeated, by that line and its words at once.
FLOOR = np.array([0.06, 0.25, 0.5, 0.75]) * GRID
KEPT_SHARE = 0.75
STEPS = 3
#: Rows at which a source's own estimate and that of its language weigh the same, and so on from language to all.
HALF_ROWS = 200
#: Languages and sources whose estimates are sent to all tasks; with more, rows are shuffled to meet them.
SENT_GROUPS = 50_000
#: Median of the chi-squared distribution with four degrees of freedom, and its upper point for 1 in 10^6.
CHI_MEDIAN, CUTOFF = 3.357, 33.4
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
PARAMS = [f"m{i}" for i in range(DIMS)] + [f"p{i}{j}" for i, j in PAIRS]
MODEL = "group string, start int, logdet double, " + ", ".join(f"{c} double" for c in PARAMS)


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated windows of three."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, twice = set(), set()
        for w in windows:
            (twice if w in seen else seen).add(w)
        end = 0
        for at, w in enumerate(windows):
            if w in twice:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def stats(text: Column) -> Column:
    """The statistics of whole texts as a struct; a null text has zeros."""

    @F.pandas_udf(STATS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        rows = [text_stats(t) for t in texts]
        return pd.DataFrame(rows, columns=re.findall(r"(\w+) long", STATS), dtype="int64")

    return measured(text)


def fails_base(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def shape(s: str) -> Column:
    """Transformed statistics: log word length, and log shares of symbols, repeated lines and repeated windows."""
    words = F.greatest(F.col(f"{s}.n_words"), F.lit(1)).cast("double")
    share = [F.log1p(100 * F.col(f"{s}.{c}") / words) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]
    return F.array(*(F.round(GRID * x).cast("long") for x in (F.log(F.greatest(F.col(f"{s}.word_chars"), F.lit(1)) / words), *share)))


def group_names() -> list[Column]:
    """Names of the three groups a row is in: its language and source, its language, all. A null is a name of its own."""
    name = lambda level, *c: F.to_json(F.struct(F.lit(level).alias("level"), *c))
    return [name(0, "lang", "source").alias("own_"), name(1, "lang").alias("of_lang_"), name(2).alias("of_all_")]


def blended(sizes: DataFrame, model: DataFrame) -> DataFrame:
    """The estimate of every language and source, drawn towards its language, and that towards all.

    ``sizes`` has ``lang, source, n`` and the names of the three groups. An estimate of n rows weighs n / (n + HALF_ROWS), so
    what is judged by it moves continuously as a source grows; centre and covariance are blended, and the unit on a log scale.
    """
    lang_rows = sizes.groupBy(F.col("of_lang_").alias("l_")).agg(F.sum("n").alias("n_lang"))
    rows = sizes.join(lang_rows, F.col("of_lang_") == F.col("l_"))
    for at, name in enumerate(("own_", "of_lang_", "of_all_")):
        one = model.select(F.col("group").alias(f"g{at}"), F.array(*PARAMS, "unit").alias(f"e{at}"))
        rows = rows.join(one, F.col(name) == F.col(f"g{at}"))
    columns = ", ".join(f"{c} double" for c in (*PARAMS, "unit"))

    def parts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        inverse = np.zeros((DIMS, DIMS))
        for at, (i, j) in enumerate(PAIRS):
            inverse[i, j] = inverse[j, i] = e[DIMS + at] / (1 if i == j else 2)
        return e[:DIMS], np.linalg.inv(inverse), float(np.log(e[-1]))

    def blend(frames):
        for pdf in frames:
            found = []
            for r in pdf.itertuples():
                own, lang, all_ = (parts(np.array(e, float)) for e in (r.e0, r.e1, r.e2))
                for n, nearer in ((r.n_lang, lang), (r.n, own)):
                    w = n / (n + HALF_ROWS)
                    all_ = tuple(w * x + (1 - w) * y for x, y in zip(nearer, all_))
                mean, cov, unit = all_
                row = _params("", 0, mean, cov, 0.0)
                found.append((r.lang, r.source, *(row[c] for c in PARAMS), float(np.exp(unit))))
            yield pd.DataFrame(found, columns=["of_lang", "of_source", *PARAMS, "unit"])

    needed = rows.select("lang", "source", "n", "n_lang", "e0", "e1", "e2")
    return needed.mapInPandas(blend, f"of_lang string, of_source string, {columns}")


def _moments(x: list[Column]) -> list[Column]:
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    return [F.count(F.lit(1)).alias("n"), *sums, *(F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS)]


def _covariance(total: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    n = float(total["n"])
    mean = np.array([total[f"s{i}"] for i in range(DIMS)], float) / n
    cov = np.zeros((DIMS, DIMS))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = float(total[f"q{i}{j}"]) / n - mean[i] * mean[j]
    return mean, cov


def _params(group: str, start: int, mean: np.ndarray, cov: np.ndarray, floor: np.ndarray | float = FLOOR) -> dict:
    """A row of the model; the least spread is added to the diagonal, so the inverse always exists."""
    cov = cov + np.eye(DIMS) * floor**2
    inverse = np.linalg.inv(cov)
    row = {"group": group, "start": start, "logdet": float(np.linalg.slogdet(cov)[1])}
    row |= {f"m{i}": mean[i] for i in range(DIMS)}
    return row | {f"p{i}{j}": inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["group", "start", "logdet", *PARAMS])


def beside(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """``rows``, each with what ``groups`` has of its group; every group is there.

    Columns of few values are small as files and large in memory, so Spark would take all rows for the smaller side and send
    them through the driver. The left side of an outer join is never sent. A ``few`` groups are, whatever their files come
    to: else rows are shuffled, and all rows are one of the groups.
    """
    return rows.join(F.broadcast(groups) if few else groups, "group", "left")


def starts(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, bool]:
    """Three starts a group, all around the median: spread alone, correlation of squashed values, correlation of signs.

    With them comes whether there are few groups, so that what belongs to one can be sent to all tasks.

    Medians and quartiles come from counts by grid value, of which there are few.
    """
    grid = rows.select("group", F.posexplode("x").alias("dim", "v")).groupBy("group", "dim", "v").agg(F.count(F.lit(1)).alias("n"))
    quartiles = grid.groupBy("group", "dim").agg(F.expr("percentile(v, array(0.25, 0.5, 0.75), n)").alias("q"))
    least = F.element_at(F.array(*[F.lit(float(x)) for x in FLOOR]), F.col("dim") + 1)
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, least)
    centres = quartiles.groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct("dim", F.col("q")[1].alias("mid"), spread.alias("spread")))).alias("centre")
    )
    centres = stored(spark, centres, "quality-centres")  # its size is that of its groups, not an estimate from that of the rows
    few = centres.count() <= SENT_GROUPS
    z = [(F.col("x")[i] - F.col("centre")[i]["mid"]) / F.col("centre")[i]["spread"] for i in range(DIMS)]
    length = F.sqrt(sum(v * v for v in z))
    both = F.array(
        F.struct(F.lit(1).alias("start"), *(F.round(1024 * F.tanh(v)).cast("long").alias(f"v{i}") for i, v in enumerate(z))),
        F.struct(
            F.lit(2).alias("start"),
            *(F.when(length > 0, F.round(1024 * v / length)).otherwise(0).cast("long").alias(f"v{i}") for i, v in enumerate(z)),
        ),
    )
    kinds = beside(rows, centres, few).select("group", "centre", F.explode(both).alias("v"))
    sums = kinds.groupBy("group", F.col("v.start").alias("start")).agg(
        F.first("centre").alias("centre"), *_moments([F.col(f"v.v{i}") for i in range(DIMS)])
    )

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, total in pdf.iterrows():
            mid, spread = (np.array([c[k] for c in total["centre"]], float) for k in ("mid", "spread"))
            cov = _covariance(total)[1] + np.eye(DIMS) * 1e-6
            scale = np.sqrt(np.diag(cov))
            correlation = cov / np.outer(scale, scale)
            if total["start"] == 1:
                found.append(_params(total["group"], 0, mid, np.diag(spread**2)))
            found.append(_params(total["group"], int(total["start"]), mid, correlation * np.outer(spread, spread)))
        return _frame(found)

    return sums.groupBy("group").applyInPandas(make, MODEL), few


def distance() -> Column:
    z = [F.col("x")[i] - F.col(f"m{i}") for i in range(DIMS)]
    return F.greatest(sum(F.col(f"p{i}{j}") * z[i] * z[j] for i, j in PAIRS), F.lit(0.0))


def distance_bin() -> Column:
    return F.floor(16 * F.log2(distance() + 2.0**-8)).cast("int")


def concentrated(rows: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """One concentration step of every group and start."""
    binned = beside(rows, model, few).withColumn("bin", distance_bin())
    sums = binned.groupBy("group", "start", "bin").agg(*_moments([F.col("x")[i] for i in range(DIMS)]))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        near = pdf["n"].cumsum().shift(fill_value=0) < KEPT_SHARE * pdf["n"].sum()
        total = pdf[near].drop(columns=["group", "start", "bin"]).sum()
        return _frame([_params(pdf["group"].iat[0], int(pdf["start"].iat[0]), *_covariance(total))])

    return sums.groupBy("group", "start").applyInPandas(step, MODEL)


def estimate(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The estimate of every group: centre, inverse covariance, and ``unit``, the squared distance that counts as one.

    ``rows`` has ``group`` and ``x``, a stored table. Tables between steps have a few rows a group.
    """
    first, few = starts(spark, rows)
    model = stored(spark, first, "quality-start")
    for _ in range(STEPS):
        model = stored(spark, concentrated(rows, model, few), "quality-step")
    best = model.groupBy("group").agg(F.min_by(F.struct("start", *PARAMS), F.struct("logdet", "start")).alias("b")).select("group", "b.*")
    bins = beside(rows, best, few).groupBy("group", distance_bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    middle = bins.groupBy("group").agg(F.expr("percentile(bin + 0.5D, 0.5D, n)").alias("mid"))
    unit = F.greatest((F.pow(F.lit(2.0), F.col("mid") / 16) - 2.0**-8) / CHI_MEDIAN, F.lit(1.0))
    return stored(spark, best.join(middle, "group").select("group", *PARAMS, unit.alias("unit")), "quality-model")


def judged(spark: SparkSession, docs: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """``docs`` with the struct ``quality``: the statistics, ``base_failed``, ``distance`` and ``kept``.

    Estimates come from all rows of ``docs`` that pass the base rules; a table of statistics may be given as ``fit_on`` so
    that texts are not measured twice. A null text has no words and fails. A null language or source is a group like any
    other. Repeated rows count each. An empty table gives an empty one. A group in which nothing varies rejects nothing
    within its least spread. An own column named ``quality`` is replaced.
    """
    measured = fit_on if fit_on is not None else measure(spark, docs)
    passed = measured.where(~fails_base("quality")).select("lang", "source", *group_names(), shape("quality").alias("x"))
    passed = stored(spark, passed, "quality-rows")
    each = passed.select(F.explode(F.array("own_", "of_lang_", "of_all_")).alias("group"), "x")
    model = estimate(spark, each)
    sizes = passed.groupBy("lang", "source", "own_", "of_lang_", "of_all_").agg(F.count(F.lit(1)).alias("n"))
    known = blended(sizes, model).select("of_lang", "of_source", F.struct(*PARAMS, "unit").alias("of_model"))
    known = stored(spark, known, "quality-known")
    if fit_on is None:
        docs = docs.drop("quality").withColumn("quality", stats(F.col("text")))
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    sent = F.broadcast(known) if known.count() <= SENT_GROUPS else known
    joined = docs.join(sent, same, "left").drop("of_lang", "of_source")
    x = shape("quality")
    z = [x[i] - F.col(f"of_model.m{i}") for i in range(DIMS)]
    squared = sum(F.col(f"of_model.p{i}{j}") * z[i] * z[j] for i, j in PAIRS) / F.col("of_model.unit")
    return (
        joined.withColumn("quality", F.struct("quality.*", fails_base("quality").alias("base_failed"), squared.alias("distance")))
        .withColumn("quality", F.col("quality").withField("kept", ~F.col("quality.base_failed") & (F.coalesce(F.col("quality.distance"), F.lit(0.0)) <= CUTOFF)))
        .drop("of_model")
    )


def measure(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source`` and ``quality`` of every row, stored: small columns only."""
    return stored(spark, docs.select("doc_id", "lang", "source", stats(F.col("text")).alias("quality")), "quality-stats")


def clean_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows that pass the base rules and are no outlier, with their own columns.

    Rows are written once with their statistics, so a text is measured once, and read again beside the small table of
    estimates: texts are not shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_")
    held = stored(spark, docs.select(row, "lang", "source", stats(F.col("text")).alias("quality")), "quality-measured")
    kept = judged(spark, held, fit_on=held.drop("doc_")).where("quality.kept")
    return kept.select(*[F.col(f"doc_.`{c}`").alias(c) for c in docs.columns])
