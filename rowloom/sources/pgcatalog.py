"""Tables of the PostgreSQL catalog, made from Spark's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Type numbers and sizes of the PostgreSQL catalog.
TYPES = {
    "boolean": (16, "bool", 1),
    "bigint": (20, "int8", 8),
    "smallint": (21, "int2", 2),
    "int": (23, "int4", 4),
    "string": (25, "text", -1),
    "float": (700, "float4", 4),
    "double": (701, "float8", 8),
    "date": (1082, "date", 4),
    "time": (1083, "time", 8),
    "timestamp_ntz": (1114, "timestamp", 8),
    "timestamp": (1184, "timestamptz", 8),
    "binary": (17, "bytea", -1),
}
SCHEMAS = {
    "PG_TYPE": "oid int, typname string, typnamespace int, typlen int, typtype string, typbasetype int",
    "PG_NAMESPACE": "oid int, nspname string",
    "PG_CLASS": "oid int, relname string, relnamespace int, relkind string",
    "PG_ATTRIBUTE": "attrelid int, attname string, atttypid int, attlen int, attnum int, attnotnull boolean, atthasdef boolean, attisdropped boolean",
    "PG_ATTRDEF": "oid int, adrelid int, adnum int, adbin string",
}


OWNER = "rowloom"  # the one owner of all tables, with the number 0


def register_functions(spark: SparkSession) -> None:
    """The catalog's functions, as SQL functions that the optimizer puts in their place."""
    kinds = " ".join(f"WHEN {oid} THEN '{name}'" for name, (oid, _, _) in TYPES.items())
    for head, returns, body in (
        ("pg_get_userbyid(oid BIGINT)", "STRING", f"CASE WHEN oid IS NULL THEN NULL WHEN oid = 0 THEN '{OWNER}' ELSE CAST(raise_error('no user ' || oid) AS STRING) END"),
        ("pg_table_is_visible(oid BIGINT)", "BOOLEAN", "true"),
        ("pg_get_expr(expression STRING, oid BIGINT)", "STRING", "CAST(NULL AS STRING)"),
        ("format_type(oid BIGINT, modifier INT DEFAULT NULL)", "STRING", f"CASE oid {kinds} END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {returns} RETURN {body}")


def catalog_table(spark: SparkSession, name: str) -> DataFrame:
    upper = name.upper()
    databases = sorted(d.name for d in spark.catalog.listDatabases())
    tables = sorted((t.name, (t.namespace or [None])[0], t.tableType) for t in spark.catalog.listTables())
    rows: list[tuple] = []
    if upper == "PG_TYPE":
        rows = [(oid, short, 1, size, "b", 0) for oid, short, size in TYPES.values()]
    elif upper == "PG_NAMESPACE":
        rows = [(1 + i, d) for i, d in enumerate(databases)]
    elif upper == "PG_CLASS":
        rows = [(10000 + i, t, 1 + databases.index(d) if d in databases else 0, "v" if "VIEW" in kind or kind == "TEMPORARY" else "r") for i, (t, d, kind) in enumerate(tables)]
    elif upper == "PG_ATTRIBUTE":
        for i, (t, _, _) in enumerate(tables):
            for k, f in enumerate(spark.table(t).schema.fields):
                oid, _, size = TYPES.get(f.dataType.simpleString(), (25, "text", -1))
                rows.append((10000 + i, f.name, oid, size, k + 1, not f.nullable, False, False))
    elif upper != "PG_ATTRDEF":
        raise ValueError(f"no catalog table {name}")
    return spark.createDataFrame(rows, SCHEMAS[upper])
