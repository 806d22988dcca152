"""Procedures whose tables, columns and conditions are given by name, as SQL scripts: session variables and EXECUTE IMMEDIATE."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from plotwright.session import checked_identifier

#: Fills blanks of a column from another table, as the temporary view ``{view}``: Spark gathers the result of a script in the driver, so the rows are not it. Names come in as variables and are quoted; the condition is SQL of its own.
IMPUTE = """
BEGIN
  DECLARE keys STRING DEFAULT array_join(transform({on}, k -> concat('`', k, '`')), ', ');
  DECLARE column STRING DEFAULT concat('`', {target}, '`');
  DECLARE same STRING DEFAULT array_join(transform({on}, k -> concat('t.`', k, '` = d.`', k, '`')), ' AND ');
  DECLARE wanted STRING DEFAULT concat('t.', column, ' IS NULL AND d.donor_ IS NOT NULL AND (', {condition}, ')');
  DECLARE donors STRING DEFAULT concat('SELECT ', keys, ', min_by(', column, ', `', {order}, '`) AS donor_ FROM `', {source}, '` WHERE ', column, ' IS NOT NULL GROUP BY ', keys);
  EXECUTE IMMEDIATE concat('CREATE TEMPORARY VIEW `', {view}, '` AS ',
    'SELECT t.* EXCEPT (', column, '), CASE WHEN ', wanted, ' THEN d.donor_ ELSE t.', column, ' END AS ', column,
    ', coalesce(', wanted, ', false) AS `', {flag}, '` FROM `', {table}, '` t LEFT JOIN (', donors, ') d ON ', same);
END
"""


def text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def impute(spark: SparkSession, table: str, source: str, on: Sequence[str], target: str, condition: str = "true", flag: str = "address_was_imputed", order: str = "unique_id") -> DataFrame:
    """The rows of the view ``table`` with blanks of ``target`` taken from the view ``source``, where ``condition`` (SQL over ``t``, the row) holds; ``flag`` says which. All but the condition must be plain identifiers."""
    view = f"imputed_{uuid.uuid4().hex}"
    names = {k: text(checked_identifier(v)) for k, v in {"view": view, "table": table, "source": source, "target": target, "flag": flag, "order": order}.items()}
    script = IMPUTE.format(on="array(" + ", ".join(text(checked_identifier(c)) for c in on) + ")", condition=text(condition), **names)
    spark.sql(script)
    rows = spark.table(view)
    spark.catalog.dropTempView(view)
    return rows
