"""Reads from relational databases over JDBC. The driver jar is the caller's."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

PREVIEW_ROWS = 50

_READ_ONLY = re.compile(r"(?is)^\s*(select|with)\b")
_NAME = re.compile(r"^[\w$ ]+(\.[\w$ ]+){0,2}$")


def dialect_of(url: str) -> str:
    """postgresql, mysql, sqlserver, sqlite or other, from a JDBC URL."""
    found = re.match(r"jdbc:(\w+):", url)
    if not found:
        raise ValueError("not a JDBC URL")
    name = {"mariadb": "mysql"}.get(found.group(1), found.group(1))
    return name if name in ("postgresql", "mysql", "sqlserver", "sqlite") else "other"


def quote_name(url: str, table: str) -> str:
    """A possibly schema-qualified name in the quotes of the database."""
    if not _NAME.match(table):
        raise ValueError(f"not a table name: {table!r}")
    left, right = {"mysql": "``", "sqlserver": "[]"}.get(dialect_of(url), '""')
    return ".".join(f"{left}{part}{right}" for part in table.split("."))


def preview_query(url: str, table: str, n: int = PREVIEW_ROWS) -> str:
    """First n rows, with the limit in the database's own words so that it runs there."""
    name = quote_name(url, table)
    kind = dialect_of(url)
    if kind == "sqlserver":
        return f"SELECT TOP {int(n)} * FROM {name}"
    if kind == "other":
        return f"SELECT * FROM {name} FETCH FIRST {int(n)} ROWS ONLY"
    return f"SELECT * FROM {name} LIMIT {int(n)}"


def tables_query(url: str) -> str:
    """Base tables of the current schema, and views of the public one."""
    kind = dialect_of(url)
    if kind == "sqlite":
        return "SELECT name AS table_name FROM sqlite_master WHERE type IN ('table', 'view')"
    own = {"postgresql": "table_schema NOT IN ('pg_catalog', 'information_schema')",
           "mysql": "table_schema = DATABASE()"}.get(kind, "table_schema = 'dbo'")
    return ("SELECT table_name FROM information_schema.tables WHERE "
            f"(table_type = 'BASE TABLE' AND {own}) OR (table_type = 'VIEW' AND table_schema = 'public')")


def columns_query(url: str, table: str) -> str:
    """Name, type, nullability, default and key membership of a table's columns."""
    schema, _, name = table.rpartition(".")
    if not _NAME.match(table):
        raise ValueError(f"not a table name: {table!r}")
    own = f" AND c.table_schema = '{schema}'" if schema else ""
    return (
        "SELECT c.column_name AS name, c.data_type AS type, "
        "CASE WHEN c.is_nullable = 'YES' THEN 1 ELSE 0 END AS nullable, "
        "c.column_default AS default_value, "
        "CASE WHEN k.column_name IS NULL THEN 0 ELSE 1 END AS primary_key, "
        "c.ordinal_position AS ordinal FROM information_schema.columns c LEFT JOIN ("
        "SELECT u.table_schema, u.table_name, u.column_name FROM information_schema.key_column_usage u "
        "JOIN information_schema.table_constraints t ON t.constraint_name = u.constraint_name "
        "AND t.table_schema = u.table_schema AND t.table_name = u.table_name "
        "WHERE t.constraint_type = 'PRIMARY KEY') k ON k.table_schema = c.table_schema "
        "AND k.table_name = c.table_name AND k.column_name = c.column_name "
        f"WHERE c.table_name = '{name}'{own}")


def read_options(url: str, query: str | None = None, table: str | None = None,
                 partition: Mapping[str, object] | None = None, **options: str) -> dict[str, str]:
    """Options of Spark's jdbc source. A query must read; a large table is read in parallel
    with ``partition`` = {column, lower, upper, parts}."""
    if (query is None) == (table is None):
        raise ValueError("give a query or a table")
    out = {"url": url, **options}
    if query is not None:
        if not _READ_ONLY.match(query):
            raise ValueError("only SELECT or WITH queries are read")
        if partition is None:
            return {**out, "query": query.strip().rstrip(";")}
        out["dbtable"] = f"({query.strip().rstrip(';')}) src"
    else:
        out["dbtable"] = quote_name(url, table)
    if partition is not None:
        out |= {"partitionColumn": str(partition["column"]), "lowerBound": str(partition["lower"]),
                "upperBound": str(partition["upper"]), "numPartitions": str(partition["parts"])}
    return out


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              partition: Mapping[str, object] | None = None, **options: str) -> DataFrame:
    """Rows of a query or table, with the types of the database."""
    return spark.read.format("jdbc").options(**read_options(url, query, table, partition, **options)).load()


def jdbc_tables(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """(table_name), sorted."""
    return read_jdbc(spark, url, tables_query(url), **options).distinct().orderBy("table_name")


def jdbc_columns(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """(name, type, nullable, default_value, primary_key, ordinal) in table order."""
    return read_jdbc(spark, url, columns_query(url, table), **options).orderBy("ordinal")


def jdbc_preview(spark: SparkSession, url: str, table: str, n: int = PREVIEW_ROWS, **options: str) -> DataFrame:
    """First n rows of a table."""
    return read_jdbc(spark, url, preview_query(url, table, n), **options)
