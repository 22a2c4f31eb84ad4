"""Column names, input formats and parameter defaults shared by all operators."""

from pyspark.sql import types as T

# Hierarchy levels, narrowest first, with the column that names an entity of each level.
LEVEL_COLUMNS = {
    "product": "product_code",
    "subgroup": "subgroup",
    "group": "group",
    "category": "category",
}
LEVELS = tuple(LEVEL_COLUMNS)
HIERARCHY = ("category", "group", "subgroup")
ENTITY = ["level", "entity"]

SALES = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("product_code", T.LongType()),
    T.StructField("turnover_qty", T.DoubleType()),
    T.StructField("discount_pct", T.DoubleType()),
    T.StructField("turnover_net", T.DoubleType()),
])

PRODUCTS = T.StructType([
    T.StructField("product_code", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("subgroup", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("request", T.StringType()),
])

# Headers of the raw sales and product files (blanks around them are ignored).
RAW_SALES_HEADERS = {
    "Код товара": "product_code",
    "Дата": "date",
    "Оборот шт": "turnover_qty",
    "Оборот руб за вычетом скидки": "turnover_net",
    "Валовый % скидки": "discount_pct",
}
RAW_PRODUCT_HEADERS = {
    "Код товара": "product_code",
    "Категория": "category",
    "Группа": "group",
    "Подгруппа": "subgroup",
}

# Headers of the prepared files.
PREPARED_HEADERS = {
    "date": "date",
    "product_code": "product_code",
    "turnoverOfGoods": "turnover_qty",
    "percentOfDisc": "discount_pct",
    "turnoverWithDisc": "turnover_net",
    "category": "category",
    "group": "group",
    "subgroup": "subgroup",
}

# Month names, January first.
MONTH_NAMES = (
    "Январь", "Февраль", "Март", "Апрель", "Май", "Июнь",
    "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь",
)

DATE_FORMAT = "yyyy-MM-dd"
PROMO_DAY = 15
MIN_MONTHS = 12
SEASON_THRESHOLD = 1.15
THRESHOLD_PERCENT = 75
# Fixed value: the one category whose threshold uses another percentile.
THRESHOLD_PERCENT_BY_CATEGORY = {"для окраски волос": 65}
XYZ_PERCENTS = (33, 66)
MIN_PARENT_CORRELATION = 0.5
# Rows that the dashboard's tables show; the operators give all.
TABLE_ROWS = 30
