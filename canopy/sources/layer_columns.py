"""The columns every file source adds to a layer's own: geometry, srid and layer name."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

# Rows handed to Spark at once.
BATCH_ROWS = 4096

ADDED = [("geometry", BinaryType()), ("srid", IntegerType()), ("_layer", StringType())]


def layer_schema(fields: list[StructField]) -> StructType:
    """The layer's own fields, then geometry, srid and ``_layer`` (the layer's name).

    An attribute whose name (in any case) is one of these, or that repeats an
    earlier one, is kept as ``<name>_attr``, ``<name>_attr2``, ...
    """
    taken, out = {n for n, _t in ADDED}, []
    for f in fields:
        name, k = f.name, 1
        while name.lower() in taken:
            name, k = f"{f.name}_attr{k if k > 1 else ''}", k + 1
        taken.add(name.lower())
        out.append(StructField(name, f.dataType))
    return StructType(out + [StructField(n, t) for n, t in ADDED])


def record_batch(schema: StructType, columns: list[list]) -> pa.RecordBatch:
    """Column lists in schema order as one Arrow batch."""
    arrow = to_arrow_schema(schema)
    columns = [_typed(c, t) for c, t in zip(columns, arrow.types)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)


def _typed(values: list, kind: pa.DataType) -> list:
    """Values of a loosely typed file as the column's type: numbers as flags, anything as text."""
    if pa.types.is_boolean(kind):
        return [None if v is None else bool(v) for v in values]
    if pa.types.is_string(kind):
        return [v if v is None or isinstance(v, str) else str(v) for v in values]
    return values
