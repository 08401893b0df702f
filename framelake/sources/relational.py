"""Tables of a relational database, read in parallel partitions and written back.

A read is cut into ranges of a column: each is a query of its own, with the range as its condition, so that the database
sends every task its share. The ranges end openly and the first one takes the nulls, so no row is lost when the table grows
between the bounds' query and the read. Filters and columns of the DataFrame reach the database in each of these queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def bounds(spark: SparkSession, url: str, table: str, column: str, **options: str) -> tuple[int, int] | None:
    """The least and the greatest value of a whole-number column, which the database works out."""
    query = f"(SELECT MIN({column}) AS LO, MAX({column}) AS HI FROM {table}) bounds_of_column"
    lo, hi = spark.read.format("jdbc").options(url=url, dbtable=query, **options).load().first()
    return None if lo is None else (int(lo), int(hi))


def ranges(column: str, low: int, high: int, partitions: int) -> list[str]:
    """Conditions that share out all rows, nulls too."""
    partitions = max(1, min(partitions, high - low + 1))
    cuts = [low + (high - low + 1) * i // partitions for i in range(1, partitions)]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def read_table(spark: SparkSession, url: str, table: str, column: str, partitions: int = 8, **options: str) -> DataFrame:
    """The whole table in ranges of the column."""
    found = bounds(spark, url, table, column, **options)
    return spark.read.jdbc(url, table, predicates=ranges(column, *found, partitions) if found else ["1 = 1"], properties=options)


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, **options: str) -> None:
    """Rows in batches over at most so many connections."""
    df.write.format("jdbc").options(url=url, dbtable=table, numPartitions=str(connections), **options).mode(mode).save()
