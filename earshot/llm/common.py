"""Helpers of the text operators: row ids, frozen tables, column names, and files in the shared folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def without_clash(df: DataFrame, reserved: list[str]) -> DataFrame:
    """Rename the columns of ``df`` whose names an operator needs for its own results: they get ``_in`` at the end."""
    taken = {c.lower() for c in df.columns} | {r.lower() for r in reserved}
    for column in df.columns:
        if column.lower() in {r.lower() for r in reserved}:
            name = column + "_in"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            df = df.withColumnRenamed(column, name)
    return df


_TEMPORARY: ContextVar[tuple[list[str], ...]] = ContextVar("temporary", default=())


@contextmanager
def temporary_tables(spark: SparkSession):
    """What ``frozen`` writes inside the block is removed at its end: nothing read later may come from it."""
    paths: list[str] = []
    token = _TEMPORARY.set((*_TEMPORARY.get(), paths))
    try:
        yield
    finally:
        _TEMPORARY.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def own_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, which goes with the innermost block of ``temporary_tables``, if any."""
    path = scratch(spark, label)
    for paths in _TEMPORARY.get()[-1:]:
        paths.append(path)
    return path


def frozen(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: lineage ends, row ids stay as they are."""
    path = own_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_ids(docs: DataFrame, row: str = "row_id") -> DataFrame:
    """``docs`` as one column ``doc`` (a struct, so no name can clash) beside a number that is unique per row.

    Freeze the result before it is read twice: the numbers belong to one reading.
    """
    return docs.select(F.monotonically_increasing_id().alias(row), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


# ---- rows picked by id, without an exchange of the rows -------------------------------------------------------------------


_PART = 33  # bits of a row number below the number of the partition it was given in


def write_id_lists(ids: DataFrame, folder: str) -> None:
    """Write ``ids`` (row_id) as sorted arrays below ``folder``: a file for each partition that row ids were given in.

    A list holds at most the rows of one such partition, so no task holds more.
    """

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        numbers = np.sort(table["row_id"].to_numpy())
        write_file(f"{folder}/{key[0].as_py()}", lambda out: out.write(numbers.astype("<i8").tobytes()))
        return pa.table({"part": [key[0]], "held": pa.array([len(numbers)], pa.int64())})

    parts = ids.select("row_id", F.shiftright("row_id", _PART).alias("part")).groupBy("part")
    parts.applyInArrow(run, "part long, held long").agg(F.sum("held")).collect()


@lru_cache(maxsize=8)
def _id_list(folder: str, part: int):
    import numpy as np
    from pyarrow import fs

    store, name = filesystem(f"{folder}/{part}")
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return np.zeros(0, dtype=np.int64)
    with store.open_input_stream(name) as stream:
        return np.frombuffer(stream.read(), "<i8")


def is_listed(row_id: Column, folder: str) -> Column:
    """Whether a row id is in the lists of ``folder``. Rows stay where they are: a task reads the lists of its own partitions."""

    @F.arrow_udf("boolean")
    def run(ids):
        import numpy as np
        import pyarrow as pa

        ids = ids.to_numpy()
        found, parts = np.zeros(len(ids), dtype=bool), ids >> _PART
        for part in np.unique(parts).tolist():
            own = parts == part
            held = _id_list(folder, part)
            at = np.searchsorted(held, ids[own])
            found[own] = (at < len(held)) & (np.append(held, -1)[at] == ids[own])
        return pa.array(found)

    return run(row_id)


# ---- files in the shared folder, from driver or executors -------------------------------------------------------------


def filesystem(path: str):
    """The Arrow file system of a path or URI, and the path inside it; local paths need no URI."""
    from pyarrow import fs

    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def write_file(path: str, write) -> None:
    """Let ``write(stream)`` fill a file that appears under its name only when whole, so a task can be run again."""
    store, name = filesystem(path)
    part = f"{name}.{uuid.uuid4().hex}.part"
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(part, compression=None) as stream:
        write(stream)
    store.move(part, name)
