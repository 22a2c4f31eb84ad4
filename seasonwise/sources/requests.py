"""Requests: each row asks for one product, category, group or subgroup."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?[0-9]+([.][0-9]*)?$"


def read_requests(requests: DataFrame) -> DataFrame:
    """Split (request_id, request) into a product code, if numeric, or a name."""
    text = F.trim("request")
    numeric = text.rlike(NUMERIC)
    whole = F.regexp_extract(text, r"^([+-]?[0-9]+)", 1)
    return requests.select(
        F.col("request_id").cast("string").alias("request_id"),
        F.col("request").cast("string").alias("request"),
        F.when(numeric, whole.try_cast("bigint")).alias("product_code"),
        F.when(~numeric, F.col("request")).alias("name"),
    )
