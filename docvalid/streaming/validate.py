"""Validation of a stream: each micro-batch runs the batch plan, which needs no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.rules import RULES, Rules
from ..plans.validation import validate


def validate_stream(stream: DataFrame, xsd: str, sink: Callable[[DataFrame, int], None], xml_col: str = "xml", id_cols: list[str] | None = None, rules: Rules = RULES) -> DataStreamWriter:
    """A writer (not started) that hands each micro-batch's results and its number to ``sink``."""

    def run(batch: DataFrame, number: int) -> None:
        sink(validate(batch, xsd, xml_col, id_cols, rules), number)

    return stream.writeStream.foreachBatch(run)
