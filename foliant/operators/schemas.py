"""Whether tables have the fields that a target names: missing, extra and differing ones, with their paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

ISSUES = "table string, path string, code string, severity string, expected string, actual string"


def type_differences(actual: DataType | None, expected: DataType | None, required: bool = True, path: str = "") -> Iterator[tuple[str, str, str, str | None, str | None]]:
    """(path, code, severity, expected, actual), depth first; elements are ``path[]``, map keys and values ``path{key}`` and ``path{value}``.

    A missing field that isn't required is no issue, an extra one is information; a nullable field where none is expected
    is a warning.  What lies inside a field of another kind isn't looked at.
    """
    said = lambda t: None if t is None else t.simpleString()
    if actual is None or expected is None:
        if expected is not None and required:
            yield path, "missing_required_field", "error", said(expected), None
        elif expected is None:
            yield path, "extra_field", "info", None, said(actual)
        return
    if isinstance(actual, StructType) and isinstance(expected, StructType):
        have, want = {f.name: f for f in actual.fields}, {f.name: f for f in expected.fields}
        for name in [*want, *(n for n in have if n not in want)]:
            own, aim = have.get(name), want.get(name)
            at = f"{path}.{name}" if path else name
            yield from type_differences(own and own.dataType, aim and aim.dataType, bool(aim and aim.metadata.get("required", True)), at)
            if own and aim and own.nullable and not aim.nullable:
                yield at, "nullable_field", "warning", "not null", "null"
    elif isinstance(actual, ArrayType) and isinstance(expected, ArrayType):
        yield from type_differences(actual.elementType, expected.elementType, True, f"{path}[]")
    elif isinstance(actual, MapType) and isinstance(expected, MapType):
        yield from type_differences(actual.keyType, expected.keyType, True, path + "{key}")
        yield from type_differences(actual.valueType, expected.valueType, True, path + "{value}")
    elif actual != expected:
        yield path, "type_mismatch", "error", said(expected), said(actual)


def readiness(spark: SparkSession, tables: dict[str, tuple[StructType, StructType]]) -> DataFrame:
    """One row an issue of the named (actual, expected) schemas; a table is ready where no row is an error."""
    rows = [(name, *issue) for name, (actual, expected) in tables.items() for issue in type_differences(actual, expected)]
    return spark.createDataFrame(rows, ISSUES)


def exported_schemas(spark: SparkSession, folder: str) -> dict[str, StructType]:
    """Schemas that were written as JSON, one file a table (``<name>.json``): what ``df.schema.json()`` gives."""
    files = spark.read.text(folder, wholetext=True).selectExpr("regexp_extract(input_file_name(), '([^/]+)\\\\.json$', 1) as name", "value").collect()  # one row a table
    return {r["name"]: StructType.fromJson(json.loads(r["value"])) for r in files if r["name"]}
