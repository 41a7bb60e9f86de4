"""The text functions under names for SQL: temporary functions whose bodies Catalyst inlines, scalar and tabular."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kgloom.functions.text import EDGE, SPACE


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Name, parameters, result, body.
FUNCTIONS = (
    ("normal_form", "s STRING", "STRING", f"coalesce(btrim(regexp_replace(lower(s), {_text(SPACE)}, ' '), {_text(EDGE)}), '')"),
    ("normal_cui", "s STRING", "STRING", "upper(btrim(s))"),
    ("phrase", "s STRING", "STRING", "btrim(regexp_replace(lower(s), '[^A-Za-z0-9 ]', ' '))"),
    ("containment", "a STRING, b STRING", "DOUBLE", "try_divide(cast(size(array_intersect(array_distinct(filter(split(lower(a), '\\\\s+'), x -> x <> '')), filter(split(lower(b), '\\\\s+'), x -> x <> ''))) AS DOUBLE), size(array_distinct(filter(split(lower(a), '\\\\s+'), x -> x <> ''))))"),
    ("edit_similarity", "a STRING, b STRING", "DOUBLE", "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0D ELSE 1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)) END"),
    ("char_grams", "s STRING, n INT", "TABLE (gram STRING)", "SELECT substring(lower(s), i, n) FROM (SELECT explode(CASE WHEN length(s) >= n THEN sequence(1, length(s) - n + 1) ELSE array() END) AS i)"),
)


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS known to the session; doing so again changes nothing."""
    for name, params, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
