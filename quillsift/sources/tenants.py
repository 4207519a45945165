"""SQL views and table functions of stored tables that show one tenant's rows only.

The tenant is a session variable.  A view compares it in its own text, so no
reader of the view can leave it out; before a tenant is set it is null, and the
views are empty.  Spark folds the variable to a constant and pushes the filter
to the scan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

VARIABLE = "acting_tenant"


def _named(name: str) -> str:
    if not name.isidentifier():
        raise ValueError(name)
    return name


def publish(spark: SparkSession, paths: dict[str, str], column: str = "tenant_id") -> None:
    """For each name and Parquet path: the view ``name`` of the acting tenant's rows, and the function ``name_of(tenant)``.

    The session acts for no tenant afterwards.
    """
    spark.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING DEFAULT NULL")
    for name, path in paths.items():
        if "`" in path:
            raise ValueError(path)
        source = f"SELECT * FROM parquet.`{path}`"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {_named(name)} AS {source} WHERE {_named(column)} = session.{VARIABLE}")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_of(asked STRING) RETURNS TABLE({columns}) RETURN {source} WHERE {column} = {name}_of.asked")


def act_for(spark: SparkSession, tenant: str | None) -> None:
    """From now on the session's views show this tenant's rows; none for null."""
    spark.sql(f"SET VARIABLE {VARIABLE} = CAST(:tenant AS STRING)", args={"tenant": tenant})
