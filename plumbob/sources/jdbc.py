"""JDBC source: partitioned reads with push-down, and the table catalogue."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.functions.columns import local_table


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def jdbc_options(config: Mapping[str, Any]) -> dict[str, str]:
    """Reader options from ``url``, or from host, port, database, user and password."""
    options = {k: str(config[k]) for k in ("user", "password", "driver", "fetchsize") if config.get(k) is not None}
    if config.get("url"):
        options["url"] = config["url"]
    else:
        host, port = config.get("host", "localhost"), config.get("port", 5432)
        options["url"] = f"jdbc:postgresql://{host}:{port}/{config['database']}"
    return options


def table_options(
    config: Mapping[str, Any],
    table: str,
    partition_column: str | None = None,
    lower=None,
    upper=None,
    partitions: int = 1,
) -> dict[str, str]:
    """Options of one table; bounds split the read into parallel ranges.

    Bounds only steer the split: rows outside them are still read, by the first
    and last range.
    """
    schema = config.get("schema", "public")
    options = jdbc_options(config) | {"dbtable": f"{quoted(schema)}.{quoted(table)}"}
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partition column needs lower and upper bounds")
        options |= {
            "partitionColumn": quoted(partition_column),
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, config: Mapping[str, Any], table: str, **split) -> DataFrame:
    """A table as a lazy DataFrame; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(**table_options(config, table, **split)).load()


def probe(spark: SparkSession, config: Mapping[str, Any]) -> bool:
    """True when the database answers."""
    return spark.read.format("jdbc").options(**jdbc_options(config), query="SELECT 1 AS one").load().count() == 1


def list_tables(spark: SparkSession, config: Mapping[str, Any], source: str = "jdbc") -> DataFrame:
    """Tables of the schema with columns and exact row counts.

    The names come from the information schema; the counts run in the database,
    one query per table, all within one Spark job.
    """
    schema = config.get("schema", "public")
    base = jdbc_options(config)
    literal = schema.replace("'", "''")

    def ask(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(**base, query=query).load()

    columns = ask(
        "SELECT c.table_name, c.column_name, c.ordinal_position FROM information_schema.columns c "
        "JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name "
        f"WHERE c.table_schema = '{literal}' AND t.table_type = 'BASE TABLE'"
    )
    described = columns.groupBy("table_name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))), lambda c: c["column_name"]
        ).alias("columns")
    )
    names = [r["table_name"] for r in described.select("table_name").collect()]
    counts = [
        ask(f"SELECT COUNT(*) AS row_count FROM {quoted(schema)}.{quoted(name)}").select(
            F.lit(name).alias("table_name"), F.col("row_count").cast("bigint").alias("row_count")
        )
        for name in names
    ]
    counted = (
        reduce(DataFrame.unionByName, counts)
        if counts
        else local_table(spark, [], "table_name string, row_count bigint")
    )
    return described.join(counted, "table_name", "left").select(
        F.col("table_name").alias("name"),
        F.concat(F.lit(f"{source}/{schema}."), "table_name").alias("source"),
        "row_count",
        F.size("columns").alias("column_count"),
        "columns",
    )
