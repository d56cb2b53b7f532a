"""The public plans: violations as a table, results per document, one document's result, and the schema as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import RULES, Rules, errors_of, places_frame
from ..schema.compiler import compile_schema


def _found(df: DataFrame, xsd: str, xml_col: str, id_cols: list[str], rules: Rules) -> DataFrame:
    """The errors, with all id columns in one named row_id, where none of their names can clash with ours."""
    docs = df.select(F.struct(*[df[f"`{c}`"] for c in id_cols]).alias("row_id"), df[f"`{xml_col}`"].alias("xml"))
    return errors_of(docs, compile_schema(xsd), "xml", ["row_id"], rules)


def _ids(id_cols: list[str]) -> list[Column]:
    return [F.col("row_id").getField(c).alias(c) for c in id_cols]


def violations(df: DataFrame, xsd: str, xml_col: str = "xml", id_cols: list[str] | None = None, rules: Rules = RULES) -> DataFrame:
    """id columns, order_key (its place among the row's errors), code and message of every error of every row of ``df``.

    Unlike ``validate`` it keeps the errors that a fatal one (code E25) hides there.
    """
    ids = ["doc_id"] if id_cols is None else id_cols
    rows = _found(df, xsd, xml_col, ids, rules).select("row_id", F.posexplode("found").alias("order_key", "e"))
    return rows.select(*_ids(ids), "order_key", "e.code", "e.message")


def validate(df: DataFrame, xsd: str, xml_col: str = "xml", id_cols: list[str] | None = None, rules: Rules = RULES) -> DataFrame:
    """id columns, valid and errors (in order) for every row of ``df``.

    A null or malformed document, or a schema that can't be used, gives one error that
    begins with "Validation error: ".  A row is judged by itself, so ids may be null
    or repeat, and nothing is shuffled.  An empty table gives an empty result.
    """
    ids = ["doc_id"] if id_cols is None else id_cols
    fatal = F.filter("found", lambda e: e["code"] == "E25")
    messages = F.transform(F.when(F.size(fatal) > 0, F.slice(fatal, 1, 1)).otherwise(F.col("found")), lambda e: e["message"])
    found = _found(df, xsd, xml_col, ids, rules)
    return found.select(*_ids(ids), (F.size("found") == 0).alias("valid"), messages.alias("errors"))


def validate_text(spark: SparkSession, xml: str, xsd: str, rules: Rules = RULES) -> tuple[bool, list[str]]:
    row = validate(spark.createDataFrame([(0, xml)], "doc_id long, xml string"), xsd, rules=rules).first()
    return row.valid, list(row.errors)


def schema_table(spark: SparkSession, xsd: str) -> DataFrame:
    """A row for each place of the schema, as it is resolved; none where the text is no schema that can be used."""
    return places_frame(spark, compile_schema(xsd))
