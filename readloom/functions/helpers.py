"""Small helpers around Arrow-batched Python functions."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def per_row(fn: Callable, kind: T.DataType, *columns: Column) -> Column:
    """fn of each row's values, over Arrow batches; for what no built-in expresses."""
    arrow = to_arrow_type(kind)

    def batch(*arrays: pa.Array) -> pa.Array:
        return pa.array([fn(*values) for values in zip(*[a.to_pylist() for a in arrays], strict=True)], arrow)

    # Spark reads the number and kind of arguments off the signature
    shapes = {1: lambda a: batch(a), 2: lambda a, b: batch(a, b), 3: lambda a, b, c: batch(a, b, c), 4: lambda a, b, c, d: batch(a, b, c, d)}
    return _arrow(shapes[len(columns)], kind)(*columns)


def _arrow(fn: Callable, kind: T.DataType):
    for name in fn.__code__.co_varnames[: fn.__code__.co_argcount]:
        fn.__annotations__[name] = pa.Array
    fn.__annotations__["return"] = pa.Array
    return F.arrow_udf(fn, kind)


def long_rows(df: DataFrame, rows: int = 500) -> DataFrame:
    """Bounds the rows of an Arrow batch, since html may be long. The session's bound is
    only ever lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= rows:
        df.sparkSession.conf.set(key, str(rows))
    return df
