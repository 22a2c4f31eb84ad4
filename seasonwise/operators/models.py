"""Twelve trend-and-season models of a two-year window, their accuracy and forecasts.

Every fit is a set of weighted sums over the 24 points, so one window per entity yields all
six trends. Weights of the polynomial trends are the orthogonal polynomials of the grid
t = 1..24 scaled to whole numbers; sums over whole quantities are then exact.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.dates import month_label
from seasonwise.functions.windows import by_entity
from seasonwise.operators.series import MODEL_MONTHS
from seasonwise.schemas import ENTITY

TRENDS = ("linear", "polynomial2", "polynomial3", "log", "exp", "pow")
SEASONALITIES = ("add", "mul")
MODELS = tuple((trend, season) for trend in TRENDS for season in SEASONALITIES)
YEAR = 12
OVER_ENTITY = "OVER (PARTITION BY level, entity)"
COEFFICIENTS = ["c0", "c1", "c2", "c3", "c_log", "e0", "e1", "e_log"]

_GRID = range(1, MODEL_MONTHS + 1)
MEAN_LOG = sum(math.log(t) for t in _GRID) / MODEL_MONTHS


# Expressions in t are SQL text: a model needs hundreds of small terms, and one parsed
# expression is much cheaper to build than a tree of Column calls.

def poly1(t: str) -> str:
    return f"({t} * 2.0D - 25.0D)"


def poly2(t: str) -> str:
    return f"(({poly1(t)} * {poly1(t)} * 3.0D - 575.0D) / 4.0D)"


def poly3(t: str) -> str:
    return f"({poly1(t)} * {poly1(t)} * {poly1(t)} * 5.0D - {poly1(t)} * 1721.0D)"


def centred_log(t: str) -> str:
    return f"(ln({t}) - {MEAN_LOG!r}D)"


# Sums of the squared weights over the window.
_ODD = [2 * t - 25 for t in _GRID]
NORM1 = f"{float(sum(k * k for k in _ODD))!r}D"
NORM2 = f"{float(sum(((3 * k * k - 575) // 4) ** 2 for k in _ODD))!r}D"
NORM3 = f"{float(sum((5 * k ** 3 - 1721 * k) ** 2 for k in _ODD))!r}D"
NORM_LOG = f"{sum((math.log(t) - MEAN_LOG) ** 2 for t in _GRID)!r}D"


def paired_years(window: DataFrame) -> DataFrame:
    """One row per entity and month position 0..11 with the values of both years."""
    return window.groupBy(*ENTITY, F.expr("(t - 1) % 12 AS pos")).agg(
        F.expr("max(CASE WHEN t <= 12 THEN turnover END) AS y1"),
        F.expr("max(CASE WHEN t > 12 THEN turnover END) AS y2"),
        F.min("month_start").alias("month1"), F.max("month_start").alias("month2"))


def trend_coefficients(pairs: DataFrame) -> DataFrame:
    """Add the coefficients of all trends; those on ln(y) are NULL unless every y > 0."""
    def weighted(weight, first="y1", second="y2"):
        return (f"sum({weight('(pos + 1)')} * {first} + {weight('(pos + 13)')} * {second}) "
                f"{OVER_ENTITY}")
    positive = f"min(least(y1, y2)) {OVER_ENTITY} > 0"
    logs = ("CASE WHEN y1 > 0 THEN ln(y1) END", "CASE WHEN y2 > 0 THEN ln(y2) END")
    fitted = pairs.selectExpr("*", f"{logs[0]} AS ln1", f"{logs[1]} AS ln2").selectExpr(
        "*",
        f"sum(y1 + y2) {OVER_ENTITY} / 24 AS c0",
        f"{weighted(poly1)} / {NORM1} AS c1",
        f"{weighted(poly2)} / {NORM2} AS c2",
        f"{weighted(poly3)} / {NORM3} AS c3",
        f"{weighted(centred_log)} / {NORM_LOG} AS c_log",
        f"CASE WHEN {positive} THEN sum(ln1 + ln2) {OVER_ENTITY} / 24 END AS e0",
        f"CASE WHEN {positive} THEN {weighted(poly1, 'ln1', 'ln2')} / {NORM1} END AS e1",
        f"CASE WHEN {positive} THEN {weighted(centred_log, 'ln1', 'ln2')} / {NORM_LOG} END "
        "AS e_log")
    return fitted.selectExpr(
        "*", f"sum((y1 - c0) * (y1 - c0) + (y2 - c0) * (y2 - c0)) {OVER_ENTITY} AS ss_tot")


def trend_value(trend: str, t: str) -> str:
    """Value of a fitted trend at any t, also beyond the window."""
    return {
        "linear": f"c0 + c1 * {poly1(t)}",
        "polynomial2": f"c0 + c1 * {poly1(t)} + c2 * {poly2(t)}",
        "polynomial3": f"c0 + c1 * {poly1(t)} + c2 * {poly2(t)} + c3 * {poly3(t)}",
        "log": f"c0 + c_log * {centred_log(t)}",
        "exp": f"exp(e0 + e1 * {poly1(t)})",
        "pow": f"exp(e0 + e_log * {centred_log(t)})",
    }[trend]


def parameters(window: DataFrame) -> DataFrame:
    """One row per entity with the coefficients in the usual form of each trend.

    linear k, b; log a, b; exp and pow k, b; polynomials highest power first. They follow
    from poly2 = 3t^2 - 75t + 325 and poly3 = 40t^3 - 1500t^2 + 15308t - 35100.
    """
    return trend_coefficients(paired_years(window)).filter("pos = 0").selectExpr(
        *ENTITY,
        "2 * c1 AS linear_k", "c0 - 25 * c1 AS linear_b",
        "3 * c2 AS poly2_a", "2 * c1 - 75 * c2 AS poly2_b",
        "c0 - 25 * c1 + 325 * c2 AS poly2_c",
        "40 * c3 AS poly3_a", "3 * c2 - 1500 * c3 AS poly3_b",
        "2 * c1 - 75 * c2 + 15308 * c3 AS poly3_c",
        "c0 - 25 * c1 + 325 * c2 - 35100 * c3 AS poly3_d",
        "c_log AS log_a", f"c0 - c_log * {MEAN_LOG!r}D AS log_b",
        "2 * e1 AS exp_k", "exp(e0 - 25 * e1) AS exp_b",
        "e_log AS pow_k", f"exp(e0 - e_log * {MEAN_LOG!r}D) AS pow_b")


def _whole(fit: str) -> str:
    """Round half-even to a whole number.

    Noise in the last digits must not decide exact halves, and adding zero turns a negative
    zero into a plain one.
    """
    return f"rint(rint(({fit}) * 1e6) / 1e6) + 0.0D"


def model_points(window: DataFrame, models=MODELS, index_rows: int = 24) -> DataFrame:
    """Both years' points of every model: (level, entity, model) x month position.

    Additive index: mean residual of the two years minus a twelfth of the total, which sums
    ``index_rows`` rows (24 or 12). Multiplicative index: mean ratio divided by a twelfth of
    the total of twelve rows. Fitted values are rounded to whole numbers. The coefficients
    stay, for forecasts.

    The totals of all models come from one window before the models are spread to rows, on
    the partitions that are there already.
    """
    raw_index = {
        "add": "((y1 - {t}_1) + (y2 - {t}_2)) / 2",
        "mul": "(try_divide(y1, {t}_1) + try_divide(y2, {t}_2)) / 2",
    }
    index = {
        "add": f"{{m}} - {{m}}_total * {index_rows / YEAR!r}D / 12",
        "mul": "try_divide({m}, {m}_total / 12)",
    }
    trends = list(dict.fromkeys(trend for trend, _ in models))
    keys = [*ENTITY, "pos", "month1", "month2", "y1", "y2", "ss_tot", *COEFFICIENTS]
    fitted = trend_coefficients(paired_years(window)).selectExpr(*keys, *[
        f"{trend_value(trend, f'(pos + {1 + YEAR * (year - 1)})')} AS {trend}_{year}"
        for trend in trends for year in (1, 2)])
    raw = fitted.selectExpr("*", *[f"{raw_index[s].format(t=t)} AS {t}_{s}"
                                   for t, s in models])
    totals = raw.selectExpr("*", *[f"sum({t}_{s}) {OVER_ENTITY} AS {t}_{s}_total"
                                   for t, s in models])
    rows = ", ".join(
        f"struct({MODELS.index((t, s))} AS ord, '{t}' AS trend, '{s}' AS seasonality, "
        f"{t}_1 AS trend1, {t}_2 AS trend2, "
        f"{index[s].format(m=f'{t}_{s}')} AS index)" for t, s in models)
    fit = "CASE WHEN seasonality = 'add' THEN trend{i} + index ELSE trend{i} * index END"
    return totals.selectExpr(*keys, f"inline(array({rows}))").selectExpr(
        "*", *[f"{_whole(fit.format(i=i))} AS fit{i}" for i in (1, 2)])


def model_scores(points: DataFrame) -> DataFrame:
    """One row per entity and model: accuracy on the rounded fit.

    A model whose fit is undefined (a logarithm of a month without sales, a zero trend) has
    NULL scores; MAPE alone is NULL when a month has no sales.
    """
    sums = points.groupBy(*ENTITY, "ord", "trend", "seasonality").agg(
        F.max("ss_tot").alias("tot"), F.expr("count(fit1) + count(fit2) = 24 AS whole"),
        F.expr("sum((y1 - fit1) * (y1 - fit1) + (y2 - fit2) * (y2 - fit2)) AS res"),
        F.expr("sum(abs(y1 - fit1) + abs(y2 - fit2)) AS gap"),
        F.expr("sum(try_divide(abs(y1 - fit1), y1) + try_divide(abs(y2 - fit2), y2)) AS rel"),
        F.expr("min(least(y1, y2)) AS least_y"))
    return sums.selectExpr(
        "*", "CASE WHEN NOT whole THEN NULL WHEN tot = 0 THEN if(res = 0, 1.0D, 0.0D) "
        "ELSE 1 - res / tot END AS r2_exact").selectExpr(
        *ENTITY, "ord", "trend", "seasonality", "r2_exact",
        "rint(r2_exact * 1000) / 1000 AS r2",
        "CASE WHEN whole AND least_y <> 0 THEN rint(rel / 24 * 100 * 1000) / 1000 END AS mape",
        "CASE WHEN whole THEN CAST(gap / 24 AS BIGINT) END AS mae",
        "CASE WHEN whole THEN CAST(res / 24 AS BIGINT) END AS mse",
        "CASE WHEN whole THEN CAST(sqrt(res / 24) AS BIGINT) END AS rmse")


def best_models(scores: DataFrame) -> DataFrame:
    """Model with the largest unrounded R2; the earlier name wins a tie."""
    order = by_entity().orderBy(F.desc("r2_exact"), "ord")
    return (scores.filter(F.col("r2_exact").isNotNull())
            .withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn"))


def best_points(points: DataFrame) -> DataFrame:
    """Points of each entity's best model, twelve rows per entity.

    Rating is done by windows on the points themselves: one sort inside the partitions that
    are there already, instead of a join of the points with their scores.
    """
    rated = points.selectExpr(
        "*", "sum(coalesce((y1 - fit1) * (y1 - fit1) + (y2 - fit2) * (y2 - fit2), "
        "double('Infinity'))) OVER (PARTITION BY level, entity, ord) AS res")
    scored = rated.selectExpr(
        "*", "CASE WHEN res = double('Infinity') THEN NULL "
        "WHEN ss_tot = 0 THEN if(res = 0, 1.0D, 0.0D) ELSE 1 - res / ss_tot END AS r2_exact")
    return (scored.selectExpr("*", f"max(struct(r2_exact, -ord AS last)) {OVER_ENTITY} AS top")
            .filter("r2_exact IS NOT NULL AND top.last = -ord")
            .drop("ss_tot", "res", "top"))


METRICS = ["r2", "mape", "mae", "mse", "rmse"]
_SCORE_ORDER = (F.desc_nulls_last, "r2"), (F.desc_nulls_last, "mape"), (F.asc, "ord")


def _score_order():
    return [direction(column) for direction, column in _SCORE_ORDER]


def metrics_table(scores: DataFrame) -> DataFrame:
    """All models of each entity by rounded R2, then MAPE, both descending; NULLs last."""
    position = F.row_number().over(by_entity().orderBy(*_score_order()))
    return (scores.withColumn("position", position).orderBy(*ENTITY, "position")
            .select(*ENTITY, "position", "trend", "seasonality", *METRICS))


def metrics_card(scores: DataFrame) -> DataFrame:
    """First row of the metrics table of each entity, as display texts."""
    top = (scores.withColumn("_rn", F.row_number().over(by_entity().orderBy(*_score_order())))
           .filter("_rn = 1"))
    return top.select(
        *ENTITY, "trend", "seasonality",
        *[F.translate(F.col(c).cast("string"), ".", ",").alias(c)
          for c in ("mape", "mae", "rmse", "r2")])


def chart_frame(points: DataFrame, horizon: int = 0,
                shown_years: dict[int, int] | None = None) -> DataFrame:
    """Actual, fitted and forecast values of each entity's best model in one table.

    ``points`` comes from ``best_points``. Fitted values are rounded, forecast ones are not:
    the trend at any later month with the index of the same month of the year.
    """
    if horizon < 0:
        raise ValueError("horizon must not be negative")
    known = ", ".join(
        f"struct(CAST(pos + {1 + YEAR * (i - 1)} AS INT) AS t, month{i} AS month_start, y{i} AS actual, "
        f"trend{i} AS trend_value, index AS season_index, fit{i} AS fit, "
        "false AS is_forecast)" for i in (1, 2))
    years = -(-horizon // YEAR)
    later = "CASE trend " + " ".join(
        f"WHEN '{trend}' THEN {trend_value(trend, '(pos + 25 + 12 * year)')}"
        for trend in TRENDS) + " END"
    season = "CASE WHEN seasonality = 'add' THEN ahead + index ELSE ahead * index END"
    ahead = ("transform(sequence(0, {last}), year -> struct(CAST(pos + 25 + 12 * year AS INT) AS t, "
             "add_months(month2, 12 + 12 * year) AS month_start, CAST(NULL AS DOUBLE) AS actual, "
             f"{later} AS trend_value, index AS season_index, CAST(NULL AS DOUBLE) AS fit, "
             "true AS is_forecast))")
    every = f"array({known})"
    if years:
        every = f"concat({every}, {ahead.format(last=years - 1)})"
    rows = points.selectExpr(*ENTITY, "trend", "seasonality", f"inline({every})").filter(
        F.col("t") <= MODEL_MONTHS + horizon)
    rows = rows.withColumn("fit", F.when(~F.col("is_forecast"), F.col("fit")).otherwise(
        F.expr(season.replace("ahead", "trend_value").replace("index", "season_index"))))
    return rows.withColumn("month_label", month_label(F.col("month_start"), shown_years))


def fitted_series(points: DataFrame) -> DataFrame:
    """t, month, actual, trend, index and fit of the best model."""
    return chart_frame(points).drop("is_forecast")


def forecast(points: DataFrame, horizon: int = 2,
             shown_years: dict[int, int] | None = None) -> DataFrame:
    """Continuation of the best model: its own trend with the index of the same month."""
    return (chart_frame(points, horizon, shown_years).filter("is_forecast")
            .select(*ENTITY, "trend", "seasonality", "t", "month_start", "month_label",
                    "trend_value", F.col("fit").alias("forecast")))
