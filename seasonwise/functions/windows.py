"""Window partitions used in several operators. They need a running session, so they are
functions rather than constants."""

from pyspark.sql import Window, WindowSpec

from seasonwise.schemas import ENTITY


def by_entity() -> WindowSpec:
    return Window.partitionBy(*ENTITY)


def by_product() -> WindowSpec:
    return Window.partitionBy("product_code")
