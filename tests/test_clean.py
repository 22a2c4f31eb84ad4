import pytest

from pyspark.sql import functions as F

from seasonwise.functions.text import display_number
from seasonwise.operators.clean import (attach_hierarchy, attach_hierarchy_to_facts,
                                        clean_products, clean_sales, keep_year)
from seasonwise.sources.files import read_prepared, read_raw_products, read_raw_sales
from tests.helpers import day, products_frame, rows_of, sales_frame

RAW = "product_code string, date string, turnover_qty string, turnover_net string, " \
      "discount_pct string"


def raw(spark, *quantities):
    return spark.createDataFrame(
        [(str(i), "2021-03-15", q, "1 234,50", "7,5%") for i, q in enumerate(quantities)], RAW)


def test_quantity_texts(spark):
    cleaned = clean_sales(raw(spark, "12", "1 200", "-3", "1,5", "n/a", "1d", "1e2", ".5", "",
                              None, "NaN", "+4"))
    assert rows_of(cleaned, "product_code", "turnover_qty") == [
        (0, 12.0), (1, 1200.0), (2, 0.0), (6, 100.0), (7, 0.5), (11, 4.0)]


def test_money_percent_and_date(spark):
    row = clean_sales(raw(spark, "1")).first()
    assert (row.turnover_net, row.discount_pct, row.date) == (1234.5, 7.5, day("2021-03-15"))


def test_other_date_format(spark):
    frame = raw(spark, "1").withColumn("date", F.lit("31.12.2021"))
    assert clean_sales(frame, "dd.MM.yyyy").first().date == day("2021-12-31")


def test_year_includes_both_ends(spark):
    sales = sales_frame(spark, [("2020-12-31", 1, 1), ("2021-01-01", 2, 1),
                                ("2021-12-31", 3, 1), ("2022-01-01", 4, 1)])
    assert rows_of(keep_year(sales, 2021), "product_code") == [(2,), (3,)]
    assert keep_year(sales, None).count() == 4


def test_product_without_dimension_row_keeps_null_levels(spark):
    sales = sales_frame(spark, [("2021-01-01", 1, 1), ("2021-01-02", 9, 2)])
    products = products_frame(spark, [(1, "c", "g", "s")])
    expected = [(1, "c", "g", "s"), (9, None, None, None)]
    for attach in (attach_hierarchy, attach_hierarchy_to_facts):
        rows = attach(sales, products).select("product_code", "category", "group", "subgroup")
        assert sorted(map(tuple, rows.collect()), key=str) == expected


def test_duplicate_dimension_rows_multiply_facts(spark):
    sales = sales_frame(spark, [("2021-01-01", 1, 1)])
    products = products_frame(spark, [(1, "c", "g", "s"), (1, "c", "h", "s")])
    assert attach_hierarchy_to_facts(sales, products).count() == 2


def test_raw_files(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(
        "Код товара; Дата; Прочее; Оборот шт; Оборот руб за вычетом скидки; Валовый % скидки\n"
        "17;2021-05-01;x;1 000;2 500,75;12,5%\n18;2021-05-02;y;n/a;1,0;0%\n", encoding="utf-8")
    (tmp_path / "products.csv").write_text(
        "Код товара; Подгруппа; Группа; Категория; Цвет\n17;[a]b;[c]d;[e]f;red\n",
        encoding="utf-8")
    sales = clean_sales(read_raw_sales(spark, str(tmp_path / "sales.csv")))
    products = clean_products(read_raw_products(spark, str(tmp_path / "products.csv")))
    assert [tuple(r) for r in sales.collect()] == [(day("2021-05-01"), 17, 1000.0, 12.5, 2500.75)]
    assert [tuple(r) for r in products.collect()] == [(17, "ef", "cd", "ab")]


def test_missing_column_is_reported(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("Код товара; Дата\n17;2021-05-01\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Оборот шт"):
        read_raw_sales(spark, str(tmp_path / "sales.csv"))


def test_prepared_file(spark, tmp_path):
    (tmp_path / "data.csv").write_text(
        "date,product_code,turnoverOfGoods,percentOfDisc,turnoverWithDisc,category,group,"
        "subgroup,month\n2021-02-03,5,7.0,1.5,9.25,[x]c,[y]g,[z]s,2\n")
    assert [tuple(r) for r in read_prepared(spark, str(tmp_path / "data.csv")).collect()] == [
        (day("2021-02-03"), 5, 7.0, 1.5, 9.25, "xc", "yg", "zs")]


@pytest.mark.parametrize("value, digits, signed, expected", [
    (0.125, 2, False, "0,12"), (2.676, 2, False, "2,68"), (-3.0, 1, True, "-3,0"),
    (12.0, 2, True, "+12,00"), (2.5, 0, False, "2"), (1.115, 2, False, "1,11"),
    (1234567.885, 2, True, "+1234567,89"), (None, 2, True, None), (-0.001, 2, True, "-0,00")])
def test_display_number(spark, value, digits, signed, expected):
    frame = spark.createDataFrame([(value,)], "v double")
    assert frame.select(display_number(F.col("v"), digits, signed)).first()[0] == expected
