"""The table behind each dashboard view of one selection.

A selection is whatever rows the filters leave; its series is their sum. Facts carry their
hierarchy here, as prepared files do.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.functions.dates import month_name
from seasonwise.operators import clusters, describe, models, seasonality, series, stability
from seasonwise.operators.select import filter_sales, selection_level, sold_products
from seasonwise.schemas import (TABLE_ROWS, THRESHOLD_PERCENT,
                                THRESHOLD_PERCENT_BY_CATEGORY)

def selection_spans(selected: DataFrame) -> DataFrame:
    """Gap-filled months of all selected rows together."""
    totals = (series.product_totals(selected)
              .groupBy(F.lit("selection").alias("level"), F.lit("selection").alias("entity"),
                       "month_start").agg(F.sum("turnover").alias("turnover")))
    return series.fill_gaps(totals, "month_start")


def selection_thresholds(selected: DataFrame, category: str | None,
                         by_category=None) -> DataFrame:
    """Threshold of the selected rows of one category (of every category for None)."""
    special = THRESHOLD_PERCENT_BY_CATEGORY if by_category is None else by_category
    coefficients = seasonality.product_month_coefficients(selected)
    if category is not None:
        coefficients = coefficients.filter(F.col("category") == F.lit(category))
    return seasonality.category_thresholds(coefficients, THRESHOLD_PERCENT, special)


def _classed(choice: "Selection") -> DataFrame:
    """Month classes by the threshold of the selection's category, the first by name."""
    one = (selection_thresholds(choice.rows, choice.category, choice.by_category)
           .agg(F.min_by("threshold", "category").cast("double").alias("threshold")))
    spans = selection_spans(choice.rows).withColumn("threshold", one.scalar())
    return seasonality.month_classes(spans, threshold=None)


def _several_products(choice: "Selection", rows: DataFrame) -> DataFrame:
    """``rows``, or none if the selection is a single product."""
    level = selection_level(choice.rows).select(F.coalesce("level", F.lit("several")))
    return rows.filter(level.scalar() != "product")


@dataclass
class Selection:
    """What the dashboard's choices leave, and the parameters of its views."""

    sales: DataFrame
    rows: DataFrame
    category: str | None
    horizon: int
    year: int | None
    by_category: dict | None
    table_rows: int | None

    def points(self) -> DataFrame:
        return models.model_points(series.model_window(selection_spans(self.rows)))

    def classified(self, variation) -> DataFrame:
        limits = stability.category_limits(stability.product_variation(
            stability.complete_year_totals(self.sales, self.year)))
        return stability.classify(
            variation(stability.complete_year_totals(self.rows, self.year)), limits)

    def labels(self) -> DataFrame:
        """Clusters; fitting them runs when the view is built."""
        if selection_level(self.rows).first()["level"] == "product":
            return self.rows.sparkSession.createDataFrame([], "product_code bigint, cluster int")
        return clusters.fit_clusters(clusters.monthly_profiles(
            clusters.product_months(self.rows))).labels()


def _deviations(choice: Selection) -> DataFrame:
    return seasonality.deviation_table(_classed(choice)).withColumn(
        "month_name", month_name(F.col("month_start")))


def _xyz_graph(choice: Selection) -> DataFrame:
    return _several_products(choice, stability.group_curve(
        choice.classified(stability.group_variation)))


def _xyz_table(choice: Selection) -> DataFrame:
    def variation(complete):
        return stability.named_products(stability.product_variation(complete))
    table = stability.product_table(_several_products(choice, choice.classified(variation)))
    return table if choice.table_rows is None else table.limit(choice.table_rows)


# The names of the dashboard's views.
VIEWS = {
    "lin_turn": lambda choice: describe.line_chart(selection_spans(choice.rows)),
    "boxplot": lambda choice: describe.boxplot_numbers(selection_spans(choice.rows)),
    "hist_seasonality": lambda choice: seasonality.coefficient_histogram(
        seasonality.product_month_coefficients(choice.rows)),
    "seas_plot": lambda choice: seasonality.deviation_bars(_classed(choice)),
    "seas_table": _deviations,
    "seas_tab": _deviations,
    "graph_predskaz": lambda choice: models.chart_frame(
        models.best_points(choice.points()), choice.horizon),
    "table_predskaz": lambda choice: models.metrics_card(models.model_scores(choice.points())),
    "xyz_graph": _xyz_graph,
    "xyz_table": _xyz_table,
    "cluster_graph": lambda choice: clusters.cluster_profiles(
        choice.labels(), clusters.product_months(choice.rows)),
    "cluster_table": lambda choice: clusters.cluster_table(
        choice.labels(), sold_products(choice.rows), choice.table_rows),
}


def dashboard_view(sales: DataFrame, view: str, start_date=None, end_date=None, category=None,
                   group=None, subgroup=None, product_code=None, horizon: int = 0,
                   year: int | None = None, by_category=None,
                   table_rows: int | None = TABLE_ROWS) -> DataFrame:
    """Rows shown by ``view`` for one selection.

    ``horizon`` is the number of forecast months, ``year`` the one the stability classes
    look at (None pools all), ``table_rows`` the length of the product tables (None: all).
    """
    if view not in VIEWS:
        raise ValueError(f"unknown view: {view}")
    rows = filter_sales(sales, category, group, subgroup, product_code, start_date, end_date)
    return VIEWS[view](Selection(sales, rows, category, horizon, year, by_category, table_rows))
