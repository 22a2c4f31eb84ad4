"""Registered queries: every operator on the driver tables."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonwise.functions import dates, text
from seasonwise.operators import (clean, clusters, correlation, describe, models, promo,
                                  ranges, seasonality, select, series, span_models, stability)
from seasonwise.plans import fixtures as fx
from seasonwise.plans.dashboard import dashboard_view
from seasonwise.schemas import ENTITY, HIERARCHY
from seasonwise.sources import files, lines
from seasonwise.sources.requests import read_requests

YEAR = 1996
# The two modelled years; the one between them is the skipped year.
MODEL_YEARS = (1996, 1998)
# One category with a percentile of its own.
SPECIAL_PERCENT = {"EUROPE": 65}
SHOWN_YEARS = {1996: 1997}

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that results do not depend on the order of summation."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def _hierarchy(spark, sf_dir, years=None):
    return select.sold_products(fx.supplier_sales(spark, sf_dir, years),
                                fx.supplier_products(spark, sf_dir))


def _monthly(spark, sf_dir, years=None, levels=series.LEVELS):
    return series.monthly_spans(fx.supplier_sales(spark, sf_dir, years),
                                fx.supplier_products(spark, sf_dir), levels)


def _sold_days(spark, sf_dir):
    return series.level_totals(series.product_totals(fx.supplier_sales(spark, sf_dir), "day"),
                               fx.supplier_products(spark, sf_dir))


def _clean(spark, sf_dir, year=None):
    return clean.clean_sales(fx.dirty_sales(spark, sf_dir), year=year)


# Sources

@query
def src1_raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.raw_sales_of_lines(*fx.raw_lines(fx.dirty_sales(spark, sf_dir)))


@query
def src2_raw_products(spark, sf_dir):
    return files.raw_products_of_lines(*fx.raw_lines(fx.dirty_products(spark, sf_dir),
                                                     products=True))


@query
def src3_prepared(spark, sf_dir):
    facts = clean.attach_hierarchy_to_facts(fx.supplier_sales(spark, sf_dir),
                                            fx.dirty_products(spark, sf_dir))
    return tidy(files.prepared_of_lines(*fx.prepared_lines(facts)))


@query
def src1_folder_sales(spark, sf_dir):
    """Usable lines of files with different headers."""
    return lines.accepted(lines.checked_sales(fx.folder_lines(spark, sf_dir)))


@query
def src1_rejects(spark, sf_dir):
    return lines.rejected(lines.checked_sales(fx.folder_lines(spark, sf_dir)))


@query
def src1_reject_counts(spark, sf_dir):
    return lines.reject_counts(lines.checked_sales(fx.folder_lines(spark, sf_dir)))


@query
def src4_requests(spark, sf_dir):
    return read_requests(fx.requests(spark, sf_dir))


# Cleaning

@query
def cln1_percent(spark, sf_dir):
    return fx.dirty_sales(spark, sf_dir).select(
        "discount_pct", text.percent_to_double(F.col("discount_pct")).alias("value"))


@query
def cln2_money(spark, sf_dir):
    return fx.dirty_sales(spark, sf_dir).select(
        "turnover_net", text.money_to_double(F.col("turnover_net")).alias("value"))


@query
def cln3_quantity(spark, sf_dir):
    raw = fx.dirty_sales(spark, sf_dir).filter(text.is_quantity(F.col("turnover_qty")))
    return raw.select("turnover_qty",
                      text.quantity_to_double(F.col("turnover_qty")).alias("value"))


@query
def cln4_returns(spark, sf_dir):
    return _clean(spark, sf_dir)


@query
def cln5_brackets(spark, sf_dir):
    return clean.clean_products(fx.dirty_products(spark, sf_dir))


@query
def cln6_date(spark, sf_dir):
    return fx.dirty_sales(spark, sf_dir).select(
        F.col("date").alias("date_text"), F.to_date("date", "yyyy-MM-dd").alias("date"))


@query
def cln7_year(spark, sf_dir):
    return _clean(spark, sf_dir, YEAR)


@query
def cln8_hierarchy(spark, sf_dir):
    return tidy(clean.attach_hierarchy_to_facts(
        _clean(spark, sf_dir), clean.clean_products(fx.dirty_products(spark, sf_dir))))


@query
def cln9_month(spark, sf_dir):
    return clean.with_month(fx.supplier_sales(spark, sf_dir)).select(
        "date", "product_code", "month", "turnover_qty")


@query
def cln10_display(spark, sf_dir):
    return fx.supplier_sales(spark, sf_dir).select(
        "product_code", "date",
        text.display_number(F.col("turnover_qty"), 0).alias("whole"),
        text.display_number(F.col("turnover_net") / 1000, 2).alias("plain"),
        text.display_number(F.col("turnover_qty") - 20, 2, signed=True).alias("signed"))


# Promo day

@query
def prm1_baseline(spark, sf_dir):
    return promo.promo_baseline(fx.part_sales(spark, sf_dir))


@query
def prm2_incomplete(spark, sf_dir):
    return promo.incomplete_products(fx.part_sales(spark, sf_dir))


@query
def prm3_neutralised(spark, sf_dir):
    return promo.neutralise_promo(fx.part_sales(spark, sf_dir)).select(
        "date", "product_code", "month", "turnover_qty")


@query
def prm4_complete(spark, sf_dir):
    return promo.complete_products(fx.part_sales(spark, sf_dir))


@query
def prm_months(spark, sf_dir):
    return promo.promo_free_totals(fx.part_sales(spark, sf_dir), "month")


@query
def prm_days(spark, sf_dir):
    return promo.promo_free_totals(fx.part_sales(spark, sf_dir), "day")


@query
def prm_group_months(spark, sf_dir):
    totals = promo.promo_free_totals(fx.part_sales(spark, sf_dir), "month")
    levels = series.level_totals(totals, fx.part_products(spark, sf_dir),
                                 ("subgroup", "group", "category"))
    return series.fill_gaps(levels, "month_start").select(*ENTITY, "month_start", "turnover")


# Selection

@query
def sel1_resolve(spark, sf_dir):
    return select.resolve_requests(fx.requests(spark, sf_dir), _hierarchy(spark, sf_dir))


@query
def sel2_rows(spark, sf_dir):
    hierarchy = _hierarchy(spark, sf_dir)
    resolved = select.resolve_requests(fx.requests(spark, sf_dir), hierarchy)
    return select.request_rows(fx.supplier_sales(spark, sf_dir), resolved, hierarchy).select(
        "request_id", "date", "product_code", "turnover_qty", "category", "group", "subgroup")


@query
def sel2_entity_rows(spark, sf_dir):
    hierarchy = _hierarchy(spark, sf_dir)
    resolved = select.resolve_requests(fx.requests(spark, sf_dir), hierarchy)
    return select.entity_rows(fx.supplier_sales(spark, sf_dir), select.requested_entities(resolved),
                              hierarchy).select("level", "entity", "date", "product_code",
                                                "turnover_qty", "category", "group", "subgroup")


@query
def sel2_wanted_rows(spark, sf_dir):
    """Facts wanted by any request, once each, with the number of requests that want them."""
    hierarchy = _hierarchy(spark, sf_dir)
    resolved = select.resolve_requests(fx.requests(spark, sf_dir), hierarchy)
    bitmaps = select.product_requests(select.numbered_requests(resolved), hierarchy)
    counts = bitmaps.groupBy("product_code").agg(
        F.sum(F.bitmap_count("bitmap")).alias("n_requests"))
    return select.wanted_rows(fx.supplier_sales(spark, sf_dir), counts).select(
        "date", "product_code", "turnover_qty", "n_requests")


@query
def sel3_filter(spark, sf_dir):
    facts = clean.attach_hierarchy_to_facts(fx.supplier_sales(spark, sf_dir),
                                            fx.supplier_products(spark, sf_dir))
    return select.filter_sales(facts, category="ASIA", start_date="1996-03-01",
                               end_date="1998-09-30").select(
        "date", "product_code", "turnover_qty", "category", "group", "subgroup")


@query
def sel3_ranges(spark, sf_dir):
    """Totals of many date ranges of entities of all levels."""
    blocks = ranges.day_blocks(_sold_days(spark, sf_dir))
    return tidy(ranges.range_totals(fx.ranges(spark, sf_dir), blocks))


@query
def sel4_choices(spark, sf_dir):
    return select.choices_by_parent(_hierarchy(spark, sf_dir))


@query
def sel4_groups_of_category(spark, sf_dir):
    return select.available_choices(_hierarchy(spark, sf_dir), "group", "category", "ASIA")


@query
def sel5_values(spark, sf_dir):
    return select.level_values(_hierarchy(spark, sf_dir))


@query
def sel6_bounds(spark, sf_dir):
    return select.date_bounds(fx.supplier_sales(spark, sf_dir))


@query
def sel7_level(spark, sf_dir):
    hierarchy = _hierarchy(spark, sf_dir)
    resolved = select.resolve_requests(fx.requests(spark, sf_dir), hierarchy)
    return select.request_levels(resolved, hierarchy)


# Series

@query
def ts1_monthly(spark, sf_dir):
    return series.monthly_series(fx.supplier_sales(spark, sf_dir),
                                 fx.supplier_products(spark, sf_dir),
                                 ("subgroup", "group", "category"))


@query
def ts2_daily(spark, sf_dir):
    return series.daily_series(fx.supplier_sales(spark, sf_dir),
                               fx.supplier_products(spark, sf_dir),
                               ("subgroup", "group", "category"))


@query
def ts3_product_monthly(spark, sf_dir):
    return series.monthly_series(fx.part_sales(spark, sf_dir), levels=("product",))


@query
def ts4_all_levels(spark, sf_dir):
    return series.monthly_series(fx.part_sales(spark, sf_dir), fx.part_products(spark, sf_dir))


@query
def ts5_model_window(spark, sf_dir):
    return series.model_window(_monthly(spark, sf_dir, MODEL_YEARS))


@query
def ts5_without_window(spark, sf_dir):
    return series.without_window(series.monthly_spans(
        fx.part_sales(spark, sf_dir, MODEL_YEARS), levels=("product",)))


@query
def ts6_calendar_product(spark, sf_dir):
    return series.calendar_product_totals(fx.part_sales(spark, sf_dir))


@query
def ts6_calendar_group(spark, sf_dir):
    totals = clean.attach_hierarchy(series.product_totals(fx.part_sales(spark, sf_dir)),
                                    fx.part_products(spark, sf_dir))
    return series.calendar_totals(totals.filter(F.col("group").isNotNull()), ["group"])


@query
def ts7_month_label(spark, sf_dir):
    return _monthly(spark, sf_dir, levels=("group",)).select(
        *ENTITY, "month_start",
        dates.month_label(F.col("month_start"), SHOWN_YEARS).alias("month_label"))


@query
def ts8_month_name(spark, sf_dir):
    return (fx.supplier_sales(spark, sf_dir)
            .groupBy(F.month("date").alias("month"),
                     dates.month_name(F.col("date")).alias("month_name"))
            .agg(F.sum("turnover_qty").alias("turnover")))


# Descriptive statistics

@query
def dsc1_card(spark, sf_dir):
    return describe.entity_cards(_hierarchy(spark, sf_dir))


@query
def dsc2_statistics(spark, sf_dir):
    return describe.monthly_statistics(_monthly(spark, sf_dir))


@query
def dsc3_boxplot(spark, sf_dir):
    return describe.boxplot_numbers(_monthly(spark, sf_dir))


@query
def dsc4_line(spark, sf_dir):
    return describe.line_chart(_monthly(spark, sf_dir, levels=("group", "category")))


# Seasonality

def _coefficients(spark, sf_dir):
    return seasonality.product_month_coefficients(fx.part_sales(spark, sf_dir),
                                                  fx.part_products(spark, sf_dir))


def _supplier_coefficients(spark, sf_dir):
    return seasonality.product_month_coefficients(fx.supplier_sales(spark, sf_dir),
                                                  fx.supplier_products(spark, sf_dir))


def _thresholds(spark, sf_dir):
    return seasonality.category_thresholds(_supplier_coefficients(spark, sf_dir),
                                           by_category=SPECIAL_PERCENT)


@query
def sea1_coefficients(spark, sf_dir):
    return tidy(_coefficients(spark, sf_dir))


@query
def sea2_threshold(spark, sf_dir):
    return _thresholds(spark, sf_dir)


@query
def sea2_threshold_parts(spark, sf_dir):
    return seasonality.category_thresholds(_coefficients(spark, sf_dir))


@query
def sea2_threshold_promo_free(spark, sf_dir):
    totals = promo.promo_free_totals(fx.part_sales(spark, sf_dir))
    return seasonality.category_thresholds(
        seasonality.product_month_coefficients(totals, fx.part_products(spark, sf_dir)))


@query
def sea3_request_category(spark, sf_dir):
    hierarchy = _hierarchy(spark, sf_dir)
    return seasonality.request_categories(
        select.resolve_requests(fx.requests(spark, sf_dir), hierarchy), hierarchy)


@query
def sea4_histogram(spark, sf_dir):
    return tidy(seasonality.coefficient_histogram(_coefficients(spark, sf_dir)))


@query
def sea5_month_class(spark, sf_dir):
    return tidy(seasonality.month_classes(_monthly(spark, sf_dir)))


@query
def sea6_deviation_table(spark, sf_dir):
    return tidy(seasonality.deviation_table(
        seasonality.month_classes(_monthly(spark, sf_dir))))


@query
def sea7_bars(spark, sf_dir):
    return tidy(seasonality.deviation_bars(
        seasonality.month_classes(_monthly(spark, sf_dir))))


@query
def sea8_peak_days(spark, sf_dir):
    return tidy(seasonality.peak_days(_sold_days(spark, sf_dir)))


@query
def sea9_extreme_days(spark, sf_dir):
    return seasonality.extreme_days(_sold_days(spark, sf_dir))


@query
def sea10_markers(spark, sf_dir):
    return seasonality.season_markers(seasonality.month_classes(_monthly(spark, sf_dir)))


@query
def sea11_own_threshold(spark, sf_dir):
    products = fx.supplier_products(spark, sf_dir)
    totals = series.product_totals(fx.supplier_sales(spark, sf_dir))
    thresholds = seasonality.category_thresholds(
        seasonality.product_month_coefficients(totals, products), by_category=SPECIAL_PERCENT)
    spans = seasonality.with_category_threshold(
        series.monthly_spans(totals, products), thresholds, products)
    return tidy(seasonality.month_classes(spans, threshold=None))


@query
def sea11_own_threshold_gaps(spark, sf_dir):
    products = fx.gapped_products(spark, sf_dir)
    totals = series.product_totals(fx.gapped_sales(spark, sf_dir))
    thresholds = seasonality.category_thresholds(
        seasonality.product_month_coefficients(totals, products), by_category=SPECIAL_PERCENT)
    spans = seasonality.with_category_threshold(
        series.monthly_spans(totals, products), thresholds, products)
    return tidy(seasonality.month_classes(spans, threshold=None))


# Models

def _window(spark, sf_dir):
    return series.model_window(_monthly(spark, sf_dir, MODEL_YEARS))


def _points(spark, sf_dir, seasons=models.SEASONALITIES):
    points = models.model_points(_window(spark, sf_dir), models=[
        (trend, season) for trend, season in models.MODELS if season in seasons])
    return points.select(*ENTITY, "trend", "seasonality",
                         F.explode(F.array(*[F.struct(
                             (F.col("pos") + 1 + 12 * (i - 1)).cast("int").alias("t"),
                             F.col(f"trend{i}").alias("trend_value"),
                             F.col("index").alias("season_index"),
                             F.col(f"fit{i}").alias("fit")) for i in (1, 2)])).alias("_p")
                         ).select(*ENTITY, "trend", "seasonality", "_p.*")


def _scores(spark, sf_dir):
    return models.model_scores(models.model_points(_window(spark, sf_dir)))


def _best(spark, sf_dir):
    return models.best_points(models.model_points(_window(spark, sf_dir)))


def _trend(spark, sf_dir, columns):
    return tidy(models.parameters(_window(spark, sf_dir)).select(*ENTITY, *columns), 5)


@query
def mod1_linear(spark, sf_dir):
    return _trend(spark, sf_dir, ["linear_k", "linear_b"])


@query
def mod2_quadratic(spark, sf_dir):
    return _trend(spark, sf_dir, ["poly2_a", "poly2_b", "poly2_c"])


@query
def mod3_cubic(spark, sf_dir):
    return _trend(spark, sf_dir, ["poly3_a", "poly3_b", "poly3_c", "poly3_d"])


@query
def mod4_logarithmic(spark, sf_dir):
    return _trend(spark, sf_dir, ["log_a", "log_b"])


@query
def mod5_exponential(spark, sf_dir):
    return _trend(spark, sf_dir, ["exp_k", "exp_b"])


@query
def mod6_power(spark, sf_dir):
    return _trend(spark, sf_dir, ["pow_k", "pow_b"])


@query
def mod7_additive(spark, sf_dir):
    return tidy(_points(spark, sf_dir, seasons=("add",)).drop("fit"), 4)


@query
def mod8_multiplicative(spark, sf_dir):
    return tidy(_points(spark, sf_dir, seasons=("mul",)).drop("fit"), 4)


@query
def mod9_fitted(spark, sf_dir):
    return _points(spark, sf_dir).select(*ENTITY, "trend", "seasonality", "t", "fit")


@query
def mod10_metrics(spark, sf_dir):
    return _scores(spark, sf_dir).select(*ENTITY, "trend", "seasonality", *models.METRICS)


@query
def mod11_best(spark, sf_dir):
    return models.best_models(_scores(spark, sf_dir)).select(
        *ENTITY, "trend", "seasonality", F.round("r2_exact", 6).alias("r2_exact"))


@query
def mod12_metrics_table(spark, sf_dir):
    return models.metrics_table(_scores(spark, sf_dir))


@query
def mod13_metrics_card(spark, sf_dir):
    return models.metrics_card(_scores(spark, sf_dir))


@query
def mod14_fitted_series(spark, sf_dir):
    return tidy(models.fitted_series(_best(spark, sf_dir)), 4)


@query
def mod15_forecast(spark, sf_dir):
    return tidy(models.forecast(_best(spark, sf_dir), 18)
                .drop("month_label"), 4)


@query
def mod16_forecast_labels(spark, sf_dir):
    return models.forecast(_best(spark, sf_dir), 2).select(
        *ENTITY, "t", "month_start", "month_label")


@query
def mod17_chart(spark, sf_dir):
    return tidy(models.chart_frame(_best(spark, sf_dir), 2, SHOWN_YEARS), 4)


# Models of any span

def _spans(spark, sf_dir):
    return span_models.span_window(_monthly(spark, sf_dir))


def _part_spans(spark, sf_dir):
    """Parts in the modelled years, most of which have no two-year window."""
    return span_models.span_window(series.monthly_spans(
        fx.part_sales(spark, sf_dir, MODEL_YEARS), levels=("product",)))


@query
def mod_any_span_coefficients(spark, sf_dir):
    found = span_models.coefficients(_spans(spark, sf_dir)).filter("t = 1")
    return found.selectExpr(
        *ENTITY, "CAST(n AS INT) AS n", "round(2 * c1, 5) AS linear_k",
        "round(c0 - c1 * (n + 1), 5) AS linear_b", "round(3 * c2, 5) AS poly2_a",
        "round(40 * c3, 7) AS poly3_a", "round(c_log, 5) AS log_a", "round(2 * e1, 7) AS exp_k",
        "round(e_log, 7) AS pow_k")


@query
def mod_any_span_metrics(spark, sf_dir):
    scores = span_models.span_scores(span_models.span_points(_spans(spark, sf_dir)))
    return scores.select(*ENTITY, "n", "trend", "seasonality", *models.METRICS)


@query
def mod_any_span_part_best(spark, sf_dir):
    scores = span_models.span_scores(span_models.span_points(_part_spans(spark, sf_dir)))
    return models.best_models(scores).select(
        *ENTITY, "n", "trend", "seasonality", F.round("r2_exact", 6).alias("r2_exact"))


@query
def mod_any_span_fitted(spark, sf_dir):
    best = span_models.best_span_points(span_models.span_points(_spans(spark, sf_dir)))
    return best.select(*ENTITY, "trend", "seasonality", "t", "month_start", "y",
                       F.round("trend_value", 4).alias("trend_value"),
                       F.round("index", 4).alias("season_index"), "fit")


@query
def mod_any_span_forecast(spark, sf_dir):
    best = span_models.best_span_points(span_models.span_points(_spans(spark, sf_dir)))
    return tidy(span_models.span_forecast(best, 18), 4)


@query
def mod_any_span_part_forecast(spark, sf_dir):
    best = span_models.best_span_points(span_models.span_points(_part_spans(spark, sf_dir)))
    return tidy(span_models.span_forecast(best, 18), 4)


# Correlation

def _correlations(spark, sf_dir):
    return correlation.parent_correlations(_window(spark, sf_dir),
                                           fx.supplier_products(spark, sf_dir))


@query
def cor1_correlations(spark, sf_dir):
    return _correlations(spark, sf_dir)


@query
def cor2_best_parent(spark, sf_dir):
    return correlation.best_parents(_correlations(spark, sf_dir))


@query
def cor3_parent_model(spark, sf_dir):
    return correlation.parent_models(
        _window(spark, sf_dir), correlation.best_parents(_correlations(spark, sf_dir)))


@query
def cor4_table(spark, sf_dir):
    return correlation.correlation_table(_correlations(spark, sf_dir))


# Stability

def _complete(spark, sf_dir):
    return stability.complete_year_totals(fx.supplier_sales(spark, sf_dir, (YEAR,)), None,
                                          fx.supplier_products(spark, sf_dir))


def _classified(spark, sf_dir):
    variation = stability.product_variation(_complete(spark, sf_dir))
    return stability.classify(stability.named_products(variation),
                              stability.category_limits(variation))


def _classified_groups(spark, sf_dir):
    complete = _complete(spark, sf_dir)
    return stability.classify(stability.group_variation(complete),
                              stability.category_limits(stability.product_variation(complete)))


def _gapped(spark, sf_dir):
    """Products of a silent category, and products the dimension does not know."""
    variation = stability.product_variation(stability.complete_year_totals(
        fx.gapped_sales(spark, sf_dir, (YEAR,)), None, fx.gapped_products(spark, sf_dir)))
    return stability.classify(stability.named_products(variation),
                              stability.category_limits(variation))


@query
def xyz1_complete(spark, sf_dir):
    return stability.complete_year_totals(fx.part_sales(spark, sf_dir), None,
                                          fx.part_products(spark, sf_dir))


@query
def xyz2_variation(spark, sf_dir):
    return tidy(stability.product_variation(_complete(spark, sf_dir)))


@query
def xyz3_limits(spark, sf_dir):
    return tidy(stability.category_limits(stability.product_variation(
        _complete(spark, sf_dir))))


@query
def xyz4_class(spark, sf_dir):
    return tidy(_classified(spark, sf_dir))


@query
def xyz4_class_gaps(spark, sf_dir):
    return tidy(_gapped(spark, sf_dir))


@query
def xyz5_summary_gaps(spark, sf_dir):
    return stability.sector_summary(_gapped(spark, sf_dir))


@query
def xyz5_summary(spark, sf_dir):
    return stability.sector_summary(_classified(spark, sf_dir))


@query
def xyz6_table(spark, sf_dir):
    return stability.product_table(_classified(spark, sf_dir))


@query
def xyz7_groups(spark, sf_dir):
    return tidy(_classified_groups(spark, sf_dir))


def _part_groups(spark, sf_dir):
    complete = stability.complete_year_totals(fx.part_sales(spark, sf_dir), None,
                                              fx.part_products(spark, sf_dir))
    return stability.classify(stability.group_variation(complete),
                              stability.category_limits(stability.product_variation(complete)))


@query
def xyz7_groups_of_several_categories(spark, sf_dir):
    return tidy(_part_groups(spark, sf_dir))


@query
def xyz9_curve_of_several_categories(spark, sf_dir):
    return stability.group_curve(_part_groups(spark, sf_dir))


@query
def xyz8_sector_groups(spark, sf_dir):
    return stability.sector_groups(_classified(spark, sf_dir))


@query
def xyz9_curve(spark, sf_dir):
    return stability.group_curve(_classified_groups(spark, sf_dir))


@query
def xyz10_applicable(spark, sf_dir):
    return stability.only_applicable(
        tidy(stability.product_variation(_complete(spark, sf_dir))),
        select.multi_product_entities(_hierarchy(spark, sf_dir)), "subgroup")


# Clusters

def _product_months(spark, sf_dir):
    return clusters.product_months(fx.supplier_sales(spark, sf_dir))


def _fixed_labels(spark, sf_dir):
    """Labels both engines can make, to check what is computed from labels."""
    return fx.supplier_products(spark, sf_dir).select(
        "product_code", (F.col("product_code") % 3 + 1).cast("int").alias("cluster"))


def _fit(spark, sf_dir):
    return clusters.fit_clusters(clusters.monthly_profiles(_product_months(spark, sf_dir)))


@query
def clu1_profiles(spark, sf_dir):
    return tidy(clusters.monthly_profiles(
        clusters.product_months(fx.part_sales(spark, sf_dir))))


@query
def clu2_standardised(spark, sf_dir):
    return tidy(clusters.standardised_profiles(clusters.monthly_profiles(
        clusters.product_months(fx.part_sales(spark, sf_dir)))))


def _standardised(spark, sf_dir):
    return clusters.standardised_profiles(clusters.monthly_profiles(_product_months(spark, sf_dir)))


def _given_labels(spark, sf_dir):
    """For every k the labels ``product_code % k``, which both engines can make."""
    return (fx.supplier_products(spark, sf_dir)
            .select("product_code", F.explode(F.sequence(F.lit(min(clusters.K_RANGE)), F.lit(
                max(clusters.K_RANGE)))).alias("k"))
            .withColumn("cluster", (F.col("product_code") % F.col("k")).cast("int")))


def _given_scores(spark, sf_dir):
    return clusters.silhouettes(_standardised(spark, sf_dir), _given_labels(spark, sf_dir))


@query
def clu3_given_silhouettes(spark, sf_dir):
    return tidy(_given_scores(spark, sf_dir))


@query
def clu4_given_k(spark, sf_dir):
    return clusters.chosen_k(_given_scores(spark, sf_dir))


@query
def clu5_given_labels(spark, sf_dir):
    given = _given_labels(spark, sf_dir).filter("k = 3").drop("k")
    return clusters.nearest_labels(_standardised(spark, sf_dir), given)


@query
def clu6_given_table(spark, sf_dir):
    given = _given_labels(spark, sf_dir).filter("k = 3").drop("k")
    labels = clusters.nearest_labels(_standardised(spark, sf_dir), given)
    return clusters.cluster_table(labels, fx.supplier_products(spark, sf_dir))


@query
def clu3_silhouettes(spark, sf_dir):
    """Squared Euclidean silhouette of every fitted k."""
    return tidy(clusters.silhouettes(_standardised(spark, sf_dir),
                                     _fit(spark, sf_dir).all_labels()), 5)


@query
def clu4_chosen_k(spark, sf_dir):
    """The k with the highest Euclidean silhouette."""
    return _fit(spark, sf_dir).scores().filter("chosen").select("k")


@query
def clu5_labels(spark, sf_dir):
    return _fit(spark, sf_dir).labels()


@query
def clu5_all_labels(spark, sf_dir):
    """Labels of every fitted k."""
    return _fit(spark, sf_dir).all_labels()


@query
def clu6_table(spark, sf_dir):
    return clusters.cluster_table(_fit(spark, sf_dir).labels(), fx.supplier_products(spark, sf_dir))


@query
def clu5_fit_invariants(spark, sf_dir):
    """Of the real fit: one label per product, and none nearer to the centre of another."""
    fit = _fit(spark, sf_dir)
    labels, k = fit.labels(), fit.best_k
    distance = [sum(((F.col(m) - F.lit(x)) ** 2 for m, x in zip(clusters.MONTHS, c)), F.lit(0.0))
                for c in fit.centres(k)]
    rows = _standardised(spark, sf_dir).join(fit.raw_labels(k), "product_code").join(
        labels, "product_code")
    chosen = F.element_at(F.array(*distance), F.col("raw") + 1)
    # Points and centres are rounded to the grid, distances may differ by that much.
    return rows.select("product_code", F.col("cluster").between(1, k).alias("numbered"),
                       (chosen <= F.least(*distance) + 1e-4).alias("nearest"))


@query
def clu3_fit_scores(spark, sf_dir):
    """Of the real fit: which k were tried, and that at most one is chosen."""
    scores = _fit(spark, sf_dir).scores()
    return scores.select("k", F.col("silhouette").between(-1, 1).alias("rated"),
                         (F.sum(F.col("chosen").cast("int")).over(Window.partitionBy(F.lit(1)))
                          == 1).alias("one_chosen"))


@query
def clu7_fit_profiles(spark, sf_dir):
    """Fit, labels and profiles in a chain: the products of all clusters add up to the whole."""
    labels, months = _fit(spark, sf_dir).labels(), _product_months(spark, sf_dir)
    profiles = clusters.cluster_profiles(labels, months)
    sizes = months.join(labels, "product_code").groupBy("cluster", "month").agg(
        F.count("*").alias("n"))
    return tidy(profiles.join(sizes, ["cluster", "month"]).groupBy("month").agg(
        F.sum(F.col("mean_turnover") * F.col("n")).alias("turnover")))


@query
def clu7_cluster_profiles(spark, sf_dir):
    return tidy(clusters.cluster_profiles(_fixed_labels(spark, sf_dir),
                                          _product_months(spark, sf_dir)))


@query
def clu8_groups(spark, sf_dir):
    return clusters.cluster_members(_fixed_labels(spark, sf_dir),
                                    fx.supplier_products(spark, sf_dir), "group")


@query
def clu9_subgroups(spark, sf_dir):
    return clusters.cluster_members(_fixed_labels(spark, sf_dir),
                                    fx.supplier_products(spark, sf_dir), "subgroup")


@query
def clu7_fitted_profiles(spark, sf_dir):
    return tidy(clusters.cluster_profiles(_fit(spark, sf_dir).labels(),
                                          _product_months(spark, sf_dir)))


@query
def clu8_fitted_groups(spark, sf_dir):
    return clusters.cluster_members(_fit(spark, sf_dir).labels(),
                                    fx.supplier_products(spark, sf_dir), "group")


@query
def clu9_fitted_subgroups(spark, sf_dir):
    return clusters.cluster_members(_fit(spark, sf_dir).labels(),
                                    fx.supplier_products(spark, sf_dir), "subgroup")


@query
def clu10_applicable(spark, sf_dir):
    return select.multi_product_entities(_hierarchy(spark, sf_dir))


# Dashboard

def _prepared(spark, sf_dir, years=None):
    return clean.attach_hierarchy_to_facts(fx.supplier_sales(spark, sf_dir, years),
                                           fx.supplier_products(spark, sf_dir))


@query
def view_lin_turn(spark, sf_dir):
    return dashboard_view(_prepared(spark, sf_dir), "lin_turn", category="ASIA")


@query
def view_seas_tab(spark, sf_dir):
    return tidy(dashboard_view(_prepared(spark, sf_dir), "seas_tab", category="ASIA"))


@query
def view_forecast(spark, sf_dir):
    return tidy(dashboard_view(_prepared(spark, sf_dir, MODEL_YEARS), "graph_predskaz",
                               category="ASIA", horizon=6), 4)


@query
def view_xyz_table(spark, sf_dir):
    return dashboard_view(_prepared(spark, sf_dir, (YEAR,)), "xyz_table", category="ASIA")


@query
def view_lin_turn_all(spark, sf_dir):
    return dashboard_view(_prepared(spark, sf_dir), "lin_turn")


@query
def view_boxplot(spark, sf_dir):
    return dashboard_view(_prepared(spark, sf_dir), "boxplot", category="ASIA")


@query
def view_hist_seasonality(spark, sf_dir):
    return tidy(dashboard_view(_prepared(spark, sf_dir), "hist_seasonality", category="ASIA"))


@query
def view_hist_seasonality_all(spark, sf_dir):
    return tidy(dashboard_view(_prepared(spark, sf_dir), "hist_seasonality"))


@query
def view_seas_plot(spark, sf_dir):
    return tidy(dashboard_view(_prepared(spark, sf_dir), "seas_plot", category="ASIA"))


@query
def view_seas_table_special(spark, sf_dir):
    return tidy(dashboard_view(_prepared(spark, sf_dir), "seas_table", category="EUROPE",
                               by_category=SPECIAL_PERCENT))


@query
def view_table_predskaz(spark, sf_dir):
    return dashboard_view(_prepared(spark, sf_dir, MODEL_YEARS), "table_predskaz",
                          category="ASIA")


@query
def view_xyz_graph(spark, sf_dir):
    return dashboard_view(_prepared(spark, sf_dir, (YEAR,)), "xyz_graph", category="ASIA")


@query
def view_xyz_table_all(spark, sf_dir):
    return dashboard_view(_prepared(spark, sf_dir, (YEAR,)), "xyz_table", table_rows=None)


@query
def view_cluster_table(spark, sf_dir):
    """All products of a selection, fitted by themselves."""
    return dashboard_view(_prepared(spark, sf_dir), "cluster_table", category="ASIA",
                          table_rows=None)


@query
def view_cluster_graph(spark, sf_dir):
    return tidy(dashboard_view(_prepared(spark, sf_dir), "cluster_graph", category="ASIA"))


@query
def view_cluster_table_products(spark, sf_dir):
    """The shown products carry their hierarchy and one label each, numbered from 1."""
    table = dashboard_view(_prepared(spark, sf_dir), "cluster_table", category="ASIA",
                           table_rows=None)
    return table.select(*HIERARCHY, "product_code", F.col("cluster").between(1, 8).alias("labelled"))


@query
def view_cluster_graph_months(spark, sf_dir):
    """Every cluster has twelve months."""
    graph = dashboard_view(_prepared(spark, sf_dir), "cluster_graph", category="ASIA")
    return graph.groupBy("month").agg(
        (F.count("cluster") == F.max("cluster")).alias("all_clusters"))
