"""The twelve trend-and-season models for series of any span, each on its own months.

``models`` looks at two years of 24 points. Here the grid t = 1..n is that of the entity, so the
orthogonal polynomials and the norms of all weights depend on n; on 24 points both give the same.
All sums are windows per entity on the partitions of the series, so nothing is shuffled again.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.dates import month_label, months_spanned
from seasonwise.operators.models import MODELS, OVER_ENTITY, TRENDS, YEAR, _whole
from seasonwise.schemas import ENTITY

# Two cycles, so that an index is a mean of two residuals at least.
LEAST_MONTHS = 24
COEFFICIENTS = ["n", "mean_log", "c0", "c1", "c2", "c3", "c_log", "e0", "e1", "e_log"]


# Orthogonal polynomials of the grid 1..n, scaled to whole numbers.

def poly1(t: str) -> str:
    return f"({t} * 2.0D - n - 1)"


def poly2(t: str) -> str:
    return f"(({poly1(t)} * {poly1(t)} * 3.0D - (n * n - 1)) / 4.0D)"


def poly3(t: str) -> str:
    return f"({poly1(t)} * ({poly1(t)} * {poly1(t)} * 5.0D - (3 * n * n - 7)))"


def trend_value(trend: str, t: str) -> str:
    """Value of a fitted trend at any t, also beyond the span."""
    return {
        "linear": f"c0 + c1 * {poly1(t)}",
        "polynomial2": f"c0 + c1 * {poly1(t)} + c2 * {poly2(t)}",
        "polynomial3": f"c0 + c1 * {poly1(t)} + c2 * {poly2(t)} + c3 * {poly3(t)}",
        "log": f"c0 + c_log * (ln({t}) - mean_log)",
        "exp": f"exp(e0 + e1 * {poly1(t)})",
        "pow": f"exp(e0 + e_log * (ln({t}) - mean_log))",
    }[trend]


def span_window(spans: DataFrame, least_months: int = LEAST_MONTHS) -> DataFrame:
    """``level, entity, t, n, month_start, y``: all months of entities with enough of them.

    ``spans`` are gap-filled (``series.monthly_spans``); t counts an entity's own months from 1.
    """
    if least_months < 4:
        raise ValueError("a cubic trend needs four months")
    t = months_spanned(F.col("first"), F.col("month_start"))
    return spans.filter(F.col("periods") >= least_months).select(
        *ENTITY, t.cast("int").alias("t"), F.col("periods").cast("double").alias("n"),
        "month_start", F.col("turnover").alias("y"))


def coefficients(window: DataFrame) -> DataFrame:
    """Add the coefficients of all trends; those on ln(y) are NULL unless every y > 0."""
    weighted = window.selectExpr(
        "*", f"{poly1('t')} AS p1", f"{poly2('t')} AS p2", f"{poly3('t')} AS p3",
        f"avg(ln(t)) {OVER_ENTITY} AS mean_log", f"min(y) {OVER_ENTITY} > 0 AS positive",
        "CASE WHEN y > 0 THEN ln(y) END AS ly").selectExpr("*", "ln(t) - mean_log AS pl")

    def fitted(weight, values):
        return f"sum({values} * {weight}) {OVER_ENTITY} / sum({weight} * {weight}) {OVER_ENTITY}"

    return weighted.selectExpr(
        *ENTITY, "t", "n", "month_start", "y", "mean_log",
        f"avg(y) {OVER_ENTITY} AS c0", f"{fitted('p1', 'y')} AS c1", f"{fitted('p2', 'y')} AS c2",
        f"{fitted('p3', 'y')} AS c3", f"{fitted('pl', 'y')} AS c_log",
        f"CASE WHEN positive THEN avg(ly) {OVER_ENTITY} END AS e0",
        f"CASE WHEN positive THEN {fitted('p1', 'ly')} END AS e1",
        f"CASE WHEN positive THEN {fitted('pl', 'ly')} END AS e_log")


def span_points(window: DataFrame, models=MODELS, index_rows: int = 24) -> DataFrame:
    """Every month of every model: trend, index and rounded fit.

    The raw index of a calendar position is the mean of its residuals (or ratios) over all years.
    From an additive one the mean over the positions is taken ``index_rows`` / 12 times, a
    multiplicative one is divided by it; that is what the two-year models do. A position with a
    ratio by zero has no index.
    """
    trends = ", ".join(f"struct({TRENDS.index(t)} AS trend_ord, '{t}' AS trend, "
                       f"{trend_value(t, 't')} AS trend_value)"
                       for t in dict.fromkeys(t for t, _ in models))
    rows = coefficients(window).selectExpr(
        *ENTITY, "t", "month_start", "y", *COEFFICIENTS, f"(t - 1) % {YEAR} AS pos",
        f"inline(array({trends}))")
    by_trend = "OVER (PARTITION BY level, entity, trend_ord)"
    by_place = "OVER (PARTITION BY level, entity, trend_ord, pos)"
    ratio = "try_divide(y, trend_value)"
    raw = rows.selectExpr(
        "*", f"count(*) {by_place} AS years", f"avg(y - trend_value) {by_place} AS add_raw",
        f"CASE WHEN count({ratio}) {by_place} = count(*) {by_place} "
        f"THEN avg({ratio}) {by_place} END AS mul_raw")
    means = raw.selectExpr("*", *[
        f"sum({s}_raw / years) {by_trend} / least({YEAR}, n) AS {s}_mean" for s in ("add", "mul")])
    index = {"add": f"add_raw - add_mean * {index_rows / YEAR!r}D",
             "mul": "try_divide(mul_raw, mul_mean)"}
    seasons = ", ".join(f"struct({i} AS season_ord, '{s}' AS seasonality, {index[s]} AS index)"
                        for i, s in enumerate(("add", "mul")))
    fit = "CASE WHEN seasonality = 'add' THEN trend_value + index ELSE trend_value * index END"
    wanted = ", ".join(str(MODELS.index(m)) for m in models)
    return means.selectExpr(
        *ENTITY, "t", "month_start", "y", *COEFFICIENTS, "pos", "trend_ord", "trend",
        "trend_value", f"inline(array({seasons}))").selectExpr(
        "*", "trend_ord * 2 + season_ord AS ord", f"{_whole(fit)} AS fit").filter(
        f"ord IN ({wanted})").drop("trend_ord", "season_ord")


def span_scores(points: DataFrame) -> DataFrame:
    """One row per entity and model, as ``models.model_scores`` gives them, and ``n``."""
    sums = points.groupBy(*ENTITY, "ord", "trend", "seasonality", "n").agg(
        F.expr("sum((y - c0) * (y - c0)) AS tot"), F.expr("count(fit) = n AS whole"),
        F.expr("sum((y - fit) * (y - fit)) AS res"), F.expr("sum(abs(y - fit)) AS gap"),
        F.expr("sum(try_divide(abs(y - fit), y)) AS rel"), F.expr("min(y) AS least_y"))
    return sums.selectExpr(
        "*", "CASE WHEN NOT whole THEN NULL WHEN tot = 0 THEN if(res = 0, 1.0D, 0.0D) "
        "ELSE 1 - res / tot END AS r2_exact").selectExpr(
        *ENTITY, "CAST(n AS INT) AS n", "ord", "trend", "seasonality", "r2_exact",
        "rint(r2_exact * 1000) / 1000 AS r2",
        "CASE WHEN whole AND least_y <> 0 THEN rint(rel / n * 100 * 1000) / 1000 END AS mape",
        "CASE WHEN whole THEN CAST(gap / n AS BIGINT) END AS mae",
        "CASE WHEN whole THEN CAST(res / n AS BIGINT) END AS mse",
        "CASE WHEN whole THEN CAST(sqrt(res / n) AS BIGINT) END AS rmse")


def best_span_points(points: DataFrame) -> DataFrame:
    """Points of each entity's model with the largest unrounded R2; the earlier name wins a tie."""
    by_model = "OVER (PARTITION BY level, entity, ord)"
    rated = points.selectExpr(
        "*", f"sum(coalesce((y - fit) * (y - fit), double('Infinity'))) {by_model} AS res",
        f"sum((y - c0) * (y - c0)) {by_model} AS tot")
    scored = rated.selectExpr(
        "*", "CASE WHEN res = double('Infinity') THEN NULL WHEN tot = 0 THEN "
        "if(res = 0, 1.0D, 0.0D) ELSE 1 - res / tot END AS r2_exact")
    return (scored.selectExpr("*", f"max(struct(r2_exact, -ord AS last)) {OVER_ENTITY} AS top")
            .filter("r2_exact IS NOT NULL AND top.last = -ord").drop("res", "tot", "top"))


def span_forecast(best: DataFrame, horizon: int = 2,
                  shown_years: dict[int, int] | None = None) -> DataFrame:
    """Months after each span: the best model's own trend with the index of the same month.

    ``best`` comes from ``best_span_points``. The last months of a span, one per position, are
    carried on by whole years as far as asked; a position that a short span lacks has no forecast.
    """
    if horizon < 0:
        raise ValueError("horizon must not be negative")
    years = max(1, -(-horizon // YEAR))
    later = "CASE trend " + " ".join(
        f"WHEN '{t}' THEN {trend_value(t, f'(t + {YEAR} * year)')}" for t in TRENDS) + " END"
    rows = best.filter(f"t > n - {YEAR}").selectExpr(
        *ENTITY, "trend", "seasonality", "index", "n",
        f"inline(transform(sequence(1, {years}), year -> struct(CAST(t + {YEAR} * year AS INT) "
        f"AS t, add_months(month_start, {YEAR} * year) AS month_start, {later} AS trend_value)))")
    value = "if(seasonality = 'add', trend_value + index, trend_value * index)"
    return rows.filter(f"t <= n + {int(horizon)}").withColumn(
        "month_label", month_label(F.col("month_start"), shown_years)).selectExpr(
        *ENTITY, "trend", "seasonality", "t", "month_start", "month_label", "trend_value",
        f"{value} AS forecast")
