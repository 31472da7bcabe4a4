"""Table functions for SQL (§2.13): windows of clips from ``SELECT * FROM sliding_windows(TABLE(t), ...)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, IntegralType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_ADDED = (("win_idx", IntegerType()), ("start_sample", LongType()), ("padded", BooleanType()))


def _added(schema: StructType) -> list[str]:
    """Names of the added columns; those that the table has already get ``_out`` at the end."""
    taken = {f.name.lower() for f in schema.fields}
    return [name + "_out" * (name in taken) for name, _ in _ADDED]


class SlidingWindows:
    """WIN-01 for any table: all its columns, then ``win_idx``, ``start_sample`` and ``padded``.

    Arguments: a table (``PARTITION BY`` and ``ORDER BY`` as wanted), the name of the column that holds a clip's samples, the
    window and the hop. ``win_idx`` counts on over the clips of a partition, so ``PARTITION BY call_id ORDER BY clip`` numbers
    the windows of a call; without it each clip starts from 0. A clip that is shorter than the window gives one padded
    window, a clip without a length none.
    """

    @staticmethod
    def analyze(clips: AnalyzeArgument, samples: AnalyzeArgument, window: AnalyzeArgument, hop: AnalyzeArgument, count_on: AnalyzeArgument = None) -> AnalyzeResult:
        if not clips.isTable:
            raise ValueError("the first argument must be TABLE(...)")
        if samples.value is None or not isinstance(samples.dataType, StringType) or samples.value not in clips.dataType.names:
            raise ValueError("the second argument must be the name of a column of the table")
        if not isinstance(clips.dataType[samples.value].dataType, IntegralType):
            raise ValueError(f"column {samples.value} must be of a whole number type")
        if not all(isinstance(a.value, int) and a.value > 0 for a in (window, hop)):
            raise ValueError("window and hop must be positive whole numbers")
        schema = StructType(list(clips.dataType.fields))
        for name, (_, kind) in zip(_added(schema), _ADDED):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def __init__(self):
        self.before = 0

    def eval(self, row, samples, window, hop, count_on=False):
        length = row[samples]
        if length is None:
            return
        count = max((length - window) // hop, 0) + 1
        for k in range(count):
            yield (*row, self.before + k, k * hop, length < window)
        self.before += count if count_on else 0


def register_table_functions(spark: SparkSession) -> None:
    """Make the table functions known to SQL of this session."""
    spark.udtf.register("sliding_windows", udtf(SlidingWindows))
