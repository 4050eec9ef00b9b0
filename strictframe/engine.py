"""Queries in the dialect over a catalog of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans.binder import Binder
from .plans.parser import parse, parse_one
from .session import configure
from .sources.catalog import Catalog
from .types import SqlType


class Engine:
    """Parses, checks and plans; results are lazy DataFrames."""

    def __init__(self, spark: SparkSession, strict_empty: bool = False, sorted_groups: bool = True, display_names: bool = False):
        self.spark = configure(spark)
        self.catalog = Catalog(spark)
        self.strict_empty, self.sorted_groups, self.display_names = strict_empty, sorted_groups, display_names

    def sql(self, text: str, *params: object) -> DataFrame:
        """One statement; ``params`` are the values of $1, $2, … (a pair gives value and type)."""
        return self.typed(text, *params)[0]

    def typed(self, text: str, *params: object) -> tuple[DataFrame, dict[str, SqlType]]:
        """The result and its SQL types, which may be wider than what Spark holds."""
        return Binder(self.spark, self.catalog, params, self.strict_empty, self.sorted_groups, self.display_names).query(parse_one(text))

    def statements(self, text: str, *params: object) -> list[DataFrame]:
        """The results of several statements."""
        binder = Binder(self.spark, self.catalog, params, self.strict_empty, self.sorted_groups, self.display_names)
        return [binder.query(q)[0] for q in parse(text)]
