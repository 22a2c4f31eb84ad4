"""From raw text to results, on facts and on promo-free totals."""

import numpy as np
import pytest

from seasonwise.operators import (clean, clusters, models, promo, seasonality, series, stability)
from seasonwise.sources.files import read_raw_products, read_raw_sales
from tests.helpers import rows_of

RNG = np.random.default_rng(21)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    lines = ["Код товара; Дата; Оборот шт; Оборот руб за вычетом скидки; Валовый % скидки"]
    for product in range(1, 7):
        for year in (2019, 2021):
            for month in range(1, 13):
                for day, factor in ((3, 1), (15, 9), (21, 1)):
                    quantity = factor * int(RNG.integers(5, 60))
                    lines.append(f"{product};{year}-{month:02d}-{day:02d};{quantity};1 000,5;5,0%")
    lines += ["1;2021-05-05;n/a;1,0;0%", "2;2021-05-05;-7;1,0;0%"]
    (folder / "sales.csv").write_text("\n".join(lines), encoding="utf-8")
    (folder / "products.csv").write_text("\n".join(
        ["Код товара; Категория; Группа; Подгруппа"]
        + [f"{p};[c]{p % 2};[g]{p % 3};[s]{p}" for p in range(1, 7)]), encoding="utf-8")
    sales = clean.clean_sales(read_raw_sales(spark, str(folder / "sales.csv")))
    products = clean.clean_products(read_raw_products(spark, str(folder / "products.csv")))
    return sales.cache(), products.cache()


def test_whole_way(inputs):
    sales, products = inputs
    assert sales.count() == 6 * 24 * 3 + 1
    totals = promo.promo_free_totals(sales)
    months = series.fill_gaps(series.level_totals(totals, products), "month_start")
    classes = seasonality.month_classes(months)
    assert classes.count() == (6 + 6 + 3 + 2) * 36
    points = models.model_points(series.model_window(months))
    assert models.metrics_table(models.model_scores(points)).count() == 17 * 12
    assert models.forecast(models.best_points(points), 6).count() == 17 * 6


def test_totals_and_replaced_facts_give_the_same(inputs):
    sales, products = inputs
    totals, facts = promo.promo_free_totals(sales), promo.neutralise_promo(sales).drop("month")
    def both(function, *columns):
        assert rows_of(function(totals), *columns) == rows_of(function(facts), *columns)
    both(lambda f: series.monthly_series(f, products), "level", "entity", "month_start", "turnover")
    both(lambda f: seasonality.product_month_coefficients(f, products),
         "product_code", "month", "coefficient", "category")
    both(lambda f: stability.product_variation(stability.complete_year_totals(f, 2021, products)),
         "product_code", "variation")
    both(lambda f: clusters.monthly_profiles(clusters.product_months(f)),
         "product_code", *clusters.MONTHS)
