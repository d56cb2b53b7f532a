"""Validation of columns of XML documents against a schema, as DataFrame plans."""

from .operators.rules import RULES, Rules
from .operators.shred import bind, shred
from .plans.validation import schema_table, validate, validate_text, violations
from .schema.compiler import CompiledSchema, clear_caches, compile_schema
from .streaming.validate import validate_stream

__all__ = ["RULES", "CompiledSchema", "Rules", "bind", "clear_caches", "compile_schema", "schema_table", "shred", "validate", "validate_stream", "validate_text", "violations"]
