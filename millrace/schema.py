"""Schemas of the facts and findings that operators exchange."""

from pyspark.sql import types as T

S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINES = T.ArrayType(_struct(file=S, start_line=I, end_line=I))

#: One row a source file.
SOURCE_FILES = _struct(path=S, lang=S, module=S, text=S, bytes=L, sha256=S, loc=I, role=S)

#: One row a definition: function, method, class, import, variable, parameter.
DEFINITIONS = _struct(
    def_key=S, name=S, type=S, file=S, line=I, end_line=I, simple_name=S, owner=S, in_init=B, is_exported=B, references=I, confidence=I,
    decorators=T.ArrayType(S), base_classes=T.ArrayType(S), return_type=S, is_closure=B, is_lambda=B, is_dunder=B, conditional_import=B, complexity=I, target=S,
)

#: Bag of references: multiplicity counts.
REFS = _struct(ref=S, file=S)
CALLS = _struct(caller=S, callee=S, file=S, line=I)
IMPORTS = _struct(file=S, from_module=S, target=S, line=I, kind=S, names=T.ArrayType(S))

#: Core of every finding; rule-specific fields go to ``extra``.
FINDINGS = _struct(rule_id=S, kind=S, severity=S, category=S, name=S, value=D, threshold=D, message=S, file=S, line=I, col=I, extra=T.MapType(S, S), related_locations=LINES)

#: Severities by rank.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "WARN": 2, "LOW": 1, "INFO": 0}
