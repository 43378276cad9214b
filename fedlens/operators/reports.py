"""Mean and deviation over repetitions: curves over rounds, one-round tables, Markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fedlens.functions.text import mean_std_text, title_words
from fedlens.operators.filters import column_name, condition, literal
from fedlens.plans.reports import (
    LAYOUTS, NO_DATA, SERVER_METRICS, STRATEGY_ORDER, TABLE_COLUMNS, TABLE_KINDS, SeriesReport, TableReport,
)

UPPER_LIMIT = 1.05  # fixed value: top of the band around a curve


def band(mean: Column, std: Column, upper: float | None = UPPER_LIMIT) -> tuple[Column, Column]:
    """Mean minus and plus the deviation, clipped to [0, upper]."""
    high = mean + std
    return F.greatest(mean - std, F.lit(0.0)), high if upper is None else F.least(high, F.lit(upper))


def deviation(column: str) -> Column:
    """Sample deviation; a single run has none and counts 0."""
    return F.coalesce(F.stddev_samp(column), F.lit(0.0))


def _stacked(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide means and deviations -> one row per metric that has data."""
    entry = lambda m: F.struct(F.lit(m).alias("metric"), F.col(f"m_{m}").alias("mean"), F.col(f"s_{m}").alias("std"))
    return df.select(*keys, F.inline(F.array(*[entry(m) for m in metrics]))).where("mean IS NOT NULL")


def mean_std_by_round(metrics: DataFrame, series: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, deviation and clipped band of each metric per series and round.

    Metrics are aggregated side by side in one pass and turned into rows afterwards, when only
    series x rounds of them are left.
    """
    keys = [*series, "round"]
    stats = [a for c in columns for a in (F.avg(c).alias(f"m_{c}"), deviation(c).alias(f"s_{c}"))]
    rows = _stacked(metrics.where("round IS NOT NULL").groupBy(*keys).agg(*stats), keys, columns)
    lo, hi = band(F.col("mean"), F.col("std"))
    return rows.withColumns({"lo": lo, "hi": hi})


def _matched(metrics: DataFrame, hits: Sequence[str]) -> DataFrame:
    """One row per hit; ``hits`` are SQL texts that give a struct or null.

    The outer explode keeps the hit list from being evaluated again in a filter that Spark would
    derive from a plain explode.
    """
    listed = F.expr(f"explode_outer(array_compact(array({', '.join(hits)})))")
    return metrics.withColumn("_hit", listed).where("_hit IS NOT NULL")


# --- series reports -------------------------------------------------------------------------

def series_label(report: SeriesReport) -> str:
    """SQL text of the label a row gets in a report."""
    key = column_name(report.series_key)
    label = f"cast({key} AS string)"
    cases = [f"WHEN {key} = {literal(v)} THEN {literal(text)}" for v, text in report.legend.items()]
    if report.is_attack:
        cases.append(f"WHEN {label} = 'FedAvg' THEN 'FedAvg (Under Attack)'")
    return f"CASE {' '.join(cases)} ELSE {label} END" if cases else label


def report_rows(metrics: DataFrame, reports: Sequence[SeriesReport]) -> DataFrame:
    """Each metrics row once per report and baseline it belongs to.

    All filters are evaluated in one pass over the rows; there is no join and no scan per report.
    """

    def hit(report: SeriesReport, filters: Mapping[str, Any], label: str, is_baseline: bool) -> str:
        return (
            f"CASE WHEN {condition(filters, metrics.columns)} THEN named_struct('report', {literal(report.name)}, "
            f"'series', {label}, 'is_baseline', {literal(is_baseline)}, 'layout', {literal(report.layout)}) END"
        )

    hits = []
    for report in reports:
        hits.append(hit(report, report.filters, series_label(report), False))
        baseline = report.baseline_filters()
        if baseline is not None:
            hits.append(hit(report, baseline, literal(report.baseline_name), True))
    return _matched(metrics, hits).select("_hit.*", *metrics.columns)


def report_series(metrics: DataFrame, reports: Sequence[SeriesReport]) -> DataFrame:
    """Curves of all reports: report, series, metric, round, mean, std, lo, hi.

    A standard report with personalised runs shows client metrics only.
    """
    columns = list(dict.fromkeys(m for layout in LAYOUTS.values() for m in layout))
    keys = ["report", "series", "is_baseline", "layout", "round"]
    stats = [a for c in columns for a in (F.avg(c).alias(f"m_{c}"), deviation(c).alias(f"s_{c}"))]
    personal_row = F.col("personalization") | F.lower("scenario_name").contains("personalized")
    cells = (
        report_rows(metrics, reports)
        .groupBy(*keys)
        .agg(*stats, F.bool_or(personal_row & ~F.col("is_baseline")).alias("_personal"))
    )
    # series x rounds rows are left here, a few hundred per report
    flagged = cells.withColumn("_personal", F.bool_or("_personal").over(W.partitionBy("report")))
    rows = _stacked(flagged, [*keys, "_personal"], columns)
    shown = F.lit(False)
    for layout, names in LAYOUTS.items():
        shown = shown | ((F.col("layout") == layout) & F.col("metric").isin(*names))
    hidden = (F.col("layout") == "standard") & F.col("_personal") & F.col("metric").isin(*SERVER_METRICS)
    lo, hi = band(F.col("mean"), F.col("std"))
    return rows.where(shown & ~hidden).drop("layout", "_personal").withColumns({"lo": lo, "hi": hi})


def overfit_curve(metrics: DataFrame) -> DataFrame:
    """Training against validation loss per scenario and round, rounds with both losses only."""
    train, val = "training_loss", "client_evaluation_loss"
    means = (
        metrics.where(F.col(train).isNotNull() & F.col(val).isNotNull())
        .groupBy("scenario_name", "round")
        .agg(
            F.avg(train).alias("train_mean"), deviation(train).alias("train_std"),
            F.avg(val).alias("val_mean"), deviation(val).alias("val_std"),
        )
    )
    for side in ("train", "val"):
        lo, hi = band(F.col(f"{side}_mean"), F.col(f"{side}_std"), None)
        means = means.withColumns({f"{side}_lo": lo, f"{side}_hi": hi})
    return means


# --- baselines as joins ---------------------------------------------------------------------

def attach_baseline(metrics: DataFrame, column: str, rows: Column, same_fraction: bool) -> DataFrame:
    """Mean of ``column`` for the selected rows beside that of the matching clean FedAvg runs.

    Both sides are aggregated to configuration x round before the join. Alpha is matched at 6
    decimals and null-safe; the clean runs share the fraction or take part in full.
    """
    alpha = F.round("dirichlet_alpha", 6).alias("alpha_key")
    keys = ["partitioner_name", alpha, "fraction_train", "round"]
    attacked = metrics.where(rows).groupBy("strategy_name", "attack_name", *keys).agg(F.avg(column).alias("mean"))
    clean = (F.col("attack_name") == "none") & (F.col("strategy_name") == "FedAvg") & ~F.col("personalization")
    if not same_fraction:
        clean = clean & (F.col("fraction_train") == 1.0)
    base_keys = keys if same_fraction else [k for k in keys if not (isinstance(k, str) and k == "fraction_train")]
    base = metrics.where(clean).groupBy(*base_keys).agg(F.avg(column).alias("baseline_mean")).alias("b")
    a = attacked.alias("a")
    on = (
        (F.col("a.partitioner_name") == F.col("b.partitioner_name"))
        & F.col("a.alpha_key").eqNullSafe(F.col("b.alpha_key"))
        & (F.col("a.round") == F.col("b.round"))
    )
    if same_fraction:
        on = on & (F.col("a.fraction_train") == F.col("b.fraction_train"))
    return a.join(base, on).select("a.*", "b.baseline_mean")


# --- table reports --------------------------------------------------------------------------

def strategy_position(name: Column) -> Column:
    """Place in the fixed strategy order; unknown names come after it."""
    place = F.array_position(F.array(*[F.lit(s) for s in STRATEGY_ORDER]), name)
    return F.when(place == 0, F.lit(len(STRATEGY_ORDER) + 1)).otherwise(place).cast("int")


def table_cells(metrics: DataFrame, tables: Sequence[TableReport], target_round: int) -> DataFrame:
    """Rows of all tables: number, place, key and one text column per metric.

    Every run that passes a table's filter counts, also one that never reached the target round: its
    metrics are missing there and its strategy reads ``N/A``. A metric the table does not list, or
    that is null in all of its runs, gives a null column.
    """
    hits = [
        f"CASE WHEN {condition(t.filters, metrics.columns)} THEN named_struct('number', {t.number}, "
        f"'kind', {literal(t.kind)}, 'key', {column_name(t.index)}, 'index', {literal(t.index)}) END"
        for t in tables
    ]
    reached = F.col("round") == target_round
    rows = _matched(metrics, hits).select("_hit.*", *(F.when(reached, F.col(c)).alias(c) for c in TABLE_COLUMNS.values()))
    stats = [
        a
        for name, c in TABLE_COLUMNS.items()
        for a in (F.avg(c).alias(f"m_{name}"), F.stddev_samp(c).alias(f"s_{name}"), F.count(c).alias(f"n_{name}"))
    ]
    cells = rows.groupBy("number", "kind", "index", "key").agg(*stats)
    table = W.partitionBy("number")  # a table has one row per strategy or scenario
    text = []
    for name in TABLE_COLUMNS:
        listed = F.col("kind").isin(*[k for k, names in TABLE_KINDS.items() if name in names])
        has_data = F.sum(f"n_{name}").over(table) > 0
        text.append(F.when(listed & has_data, mean_std_text(F.col(f"m_{name}"), F.col(f"s_{name}"))).alias(name))
    place = F.when(F.col("index") == "strategy-name", strategy_position(F.col("key"))).otherwise(F.lit(0))
    return cells.select("number", "index", place.alias("place"), "key", *text)


def markdown_lines(cells: DataFrame, tables: Sequence[TableReport]) -> DataFrame:
    """Table cells -> Markdown: number, line_no, line. A table without any value says so."""
    headings = cells.sparkSession.createDataFrame(
        [(t.number, t.heading) for t in tables], "number int, heading string"
    )
    names = list(TABLE_COLUMNS)
    # Column headers.
    headers = ["Server Accuracy", "Server F1 Score", "Client Accuracy", "Client F1 Score", "Client ASR"]
    head = [title_words(F.col("index")), *[F.lit(h) for h in headers]]
    wide = [F.greatest(F.max(F.length(head[0])) + 2, F.max(F.length("key")))] + [
        F.when(F.count(n) > 0, F.greatest(F.lit(len(h) + 2), F.max(F.length(n)))) for n, h in zip(names, headers)
    ]
    layout = cells.groupBy("number", "index").agg(F.array(*wide).alias("widths")).where(F.size(F.array_compact("widths")) > 1)

    def line(values: Sequence[Column]) -> Column:
        padded = [F.rpad(v, F.get("widths", F.lit(i)), F.lit(" ")) for i, v in enumerate(values)]
        return F.concat(F.lit("| "), F.array_join(F.array_compact(F.array(*padded)), " | "), F.lit(" |"))

    rule = F.concat(
        F.lit("|"),
        F.array_join(
            F.transform(
                F.array_compact("widths"), lambda w: F.concat(F.lit(":"), F.repeat(F.lit("-"), (w + 1).cast("int")))
            ),
            "|",
        ),
        F.lit("|"),
    )
    order = F.row_number().over(W.partitionBy("number").orderBy("place", "key"))
    body = cells.join(layout.drop("index"), "number").select(
        "number", (order + 3).alias("line_no"), line([F.col("key"), *[F.col(n) for n in names]]).alias("line")
    )
    framed = headings.join(layout, "number", "left")
    entry = lambda no, text: F.struct(F.lit(no).alias("line_no"), text.alias("line"))
    top = framed.select(
        "number",
        F.inline(
            F.when(
                F.col("widths").isNull(),
                F.array(entry(0, F.col("heading")), entry(1, F.lit("")), entry(2, F.lit(NO_DATA))),
            ).otherwise(
                F.array(entry(0, F.col("heading")), entry(1, F.lit("")), entry(2, line(head)), entry(3, rule))
            )
        ),
    )
    return top.unionByName(body)


def write_markdown(lines: DataFrame, folder: str) -> None:
    """One text file per table, in a directory of its number.

    A table has one finished line per strategy or scenario, so its text fits one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    documents = lines.groupBy("number").agg(F.array_join(ordered["line"], "\n").alias("value"))
    documents.write.partitionBy("number").text(folder)
