from pyspark.sql import functions as F

from seasonwise.operators import select
from seasonwise.operators.clean import attach_hierarchy
from tests.helpers import day, products_frame, rows_of, sales_frame

# "tea" is a group of food and a category of its own; "mix" is a group below two categories.
PRODUCTS = [(1, "food", "tea", "green"), (2, "food", "mix", "a"), (3, "tea", "mix", "b"),
            (4, "tea", "leaf", "a")]


def frames(spark):
    products = products_frame(spark, PRODUCTS)
    sales = sales_frame(spark, [(f"2021-01-{p:02d}", p, p) for p, *_ in PRODUCTS])
    return sales, products, select.sold_products(sales, products)


def resolve(spark, *texts):
    _, _, hierarchy = frames(spark)
    requests = spark.createDataFrame([(t, t) for t in texts], "request_id string, request string")
    return select.resolve_requests(requests, hierarchy)


def test_first_level_that_knows_the_name_wins(spark):
    found = resolve(spark, "tea", "mix", "a", "3", "4.0", "5", "nothing", "FOOD")
    assert sorted((r.request_id, r.level, r.entity, r.found) for r in found.collect()) == sorted([
        ("tea", "category", "tea", True), ("mix", "group", "mix", True),
        ("a", "subgroup", "a", True), ("3", "product", "3", True),
        ("4.0", "product", "4", True), ("5", None, None, False),
        ("nothing", None, None, False), ("FOOD", None, None, False)])


def test_rows_of_requests(spark):
    sales, _, hierarchy = frames(spark)
    rows = select.request_rows(sales, resolve(spark, "mix", "2", "none"), hierarchy)
    assert rows_of(rows, "request_id", "product_code", "category") == [
        ("2", 2, "food"), ("mix", 2, "food"), ("mix", 3, "tea")]


def test_filter_dates_are_included(spark):
    sales, products, _ = frames(spark)
    facts = attach_hierarchy(sales, products)
    assert rows_of(select.filter_sales(facts, start_date="2021-01-02", end_date=day("2021-01-03")),
                   "product_code") == [(2,), (3,)]
    assert rows_of(select.filter_sales(facts, category="tea", group="mix"),
                   "product_code") == [(3,)]
    assert rows_of(select.filter_sales(facts, subgroup="a", product_code=4),
                   "product_code") == [(4,)]
    assert select.filter_sales(facts).count() == 4


def test_choices(spark):
    _, _, hierarchy = frames(spark)
    assert [r[0] for r in select.available_choices(hierarchy, "group").collect()] == [
        "leaf", "mix", "tea"]
    assert [r[0] for r in select.available_choices(hierarchy, "group", "category", "food")
            .collect()] == ["mix", "tea"]
    pairs = select.choices_by_parent(hierarchy).filter("parent_level = 'subgroup'")
    assert rows_of(pairs, "parent", "child") == [("a", "2"), ("a", "4"), ("b", "3"),
                                                 ("green", "1")]


def test_level_of_selection(spark):
    _, _, hierarchy = frames(spark)
    def level(condition):
        return tuple(select.selection_level(hierarchy.filter(condition)).first())
    assert level("product_code = 1") == ("product", "1")
    assert level("subgroup = 'a'") == ("subgroup", "a")
    assert level("`group` = 'mix'") == ("group", "mix")
    assert level("category = 'tea'") == ("category", "tea")
    assert level("true") == (None, None)


def test_unnamed_levels_are_not_entities(spark):
    sales = sales_frame(spark, [("2021-01-01", 8, 1)])
    hierarchy = select.sold_products(sales, products_frame(spark, PRODUCTS))
    assert rows_of(select.level_values(hierarchy), "level", "value") == [("product", "8")]


def test_several_products(spark):
    _, _, hierarchy = frames(spark)
    single = select.multi_product_entities(hierarchy).filter(~F.col("applicable"))
    assert rows_of(single, "level", "entity") == [
        ("group", "leaf"), ("group", "tea"), ("product", "1"), ("product", "2"),
        ("product", "3"), ("product", "4"), ("subgroup", "b"), ("subgroup", "green")]


def test_date_bounds_are_real_dates(spark):
    sales = sales_frame(spark, [("2020-12-05", 1, 1), ("2021-01-31", 1, 1)])
    assert tuple(select.date_bounds(sales).first()) == (day("2020-12-05"), day("2021-01-31"))
