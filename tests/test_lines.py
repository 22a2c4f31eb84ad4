"""Files with headers of their own, and lines that are not usable."""

from seasonwise.operators.clean import clean_sales
from seasonwise.sources import lines
from tests.helpers import rows_of

FILES = {
    "a.csv": ["Код товара; Дата; Оборот шт; Оборот руб за вычетом скидки; Валовый % скидки",
              "1;2021-01-02;1 200;10,5;5%", "2;2021-01-02;n/a;1;1%", "3;2021-01-02;1;1", "",
              "4;2021-01-02;-1;;"],
    "b.csv": ["note;Валовый % скидки;Оборот руб за вычетом скидки;Оборот шт;Дата;Код товара",
              '"x;""y""";5%;10,5;7;2021-01-03;5', ";;;1;02.01.2021;6", "z;5%;abc;1;2021-01-03;7",
              "z;a%;1;1;2021-01-03;8", "z;1%;1;1;2021-01-03;x9", ";;;;2021-01-03;10"],
    "c.csv": ["1;2021-01-02;1;1;1%"],
}
WANT = {"1;2021-01-02;1 200;10,5;5%": None, "2;2021-01-02;n/a;1;1%": "quantity",
        "3;2021-01-02;1;1": "columns", "4;2021-01-02;-1;;": None,
        '"x;""y""";5%;10,5;7;2021-01-03;5': None, ";;;1;02.01.2021;6": "date",
        "z;5%;abc;1;2021-01-03;7": "money", "z;a%;1;1;2021-01-03;8": "discount",
        "z;1%;1;1;2021-01-03;x9": "product_code", ";;;;2021-01-03;10": "quantity",
        "1;2021-01-02;1;1;1%": "header"}


def folder(spark, tmp_path):
    for name, rows in FILES.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n", encoding="utf-8")
    return lines.read_lines(spark, str(tmp_path))


def test_every_line_is_in_one_output(spark, tmp_path):
    checked = lines.checked_sales(folder(spark, tmp_path))
    assert {r["line"]: r["reason"] for r in checked.collect()} == WANT
    bad = {r["line"]: r["reason"] for r in lines.rejected(checked).collect()}
    assert bad == {line: reason for line, reason in WANT.items() if reason}
    assert lines.accepted(checked).count() + len(bad) == len(WANT)
    counts = {(r["file"].rsplit("/", 1)[1], r["reason"]): r["n_lines"]
              for r in lines.reject_counts(checked).collect()}
    assert counts[("a.csv", "ok")] == 2 and counts[("c.csv", "header")] == 1
    assert sum(counts.values()) == len(WANT)


def test_usable_lines_are_cleaned_whatever_their_layout(spark, tmp_path):
    sales = clean_sales(lines.accepted(lines.checked_sales(folder(spark, tmp_path))))
    assert rows_of(sales, "product_code", "turnover_qty", "turnover_net", "discount_pct") == [
        (1, 1200.0, 10.5, 5.0), (4, 0.0, None, None), (5, 7.0, 10.5, 5.0)]


def test_quoted_fields(spark):
    frame = spark.createDataFrame([('a;"b;c";"d""e";;f',), (";",), ("",)], "line string")
    got = [r[0] for r in frame.select(lines.fields("line", ";")).collect()]
    assert got == [["a", "b;c", 'd"e', "", "f"], ["", ""], [""]]


def test_products(spark):
    frame = spark.createDataFrame(
        [("p", " Группа;Код товара; Категория; Подгруппа"), ("p", "g;1;[c];s"), ("p", "g;x;c;s")],
        "file string, line string")
    assert [tuple(r)[2:] for r in lines.raw_products(frame).orderBy("line").collect()] == [
        ("1", "[c]", "g", "s", None), ("x", "c", "g", "s", "product_code")]


def test_no_lines(spark):
    assert lines.checked_sales(spark.createDataFrame([], "file string, line string")).count() == 0
