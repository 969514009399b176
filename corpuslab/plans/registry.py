"""The registry that query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its function's name, with DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Letters beyond ASCII in the test tables. DuckDB's edit distance counts bytes, so they are mapped to one-byte characters first.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def edit_distance(a: str, b: str) -> str:
    """SQL of the edit distance in characters."""
    codes = [*range(1, 9), *range(14, 32)][: len(_LETTERS)]
    plain = lambda x: f"translate({x}, '{_LETTERS}', {' || '.join(f'chr({c})' for c in codes)})"
    return f"levenshtein({plain(a)}, {plain(b)})"
