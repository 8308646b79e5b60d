"""Configuration given in code as frames whose size the planner knows, so that it may broadcast them when they are small."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A local relation: unlike a parallelised list it needs no Python worker and has statistics."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def value(x, kind):
        if isinstance(x, tuple) and pa.types.is_struct(kind):
            return {kind.field(i).name: value(v, kind.field(i).type) for i, v in enumerate(x)}
        if isinstance(x, list) and pa.types.is_list(kind):
            return [value(v, kind.value_type) for v in x]
        return x

    columns = [pa.array([value(r[i], f.type) for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
