"""Small helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encircle.session import scratch_path

#: White space of the word contracts; words are the runs of everything else.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = " \t\n\x0b\x0c\r"
#: Rows that a task turns into Python objects at a time.
SLICE = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: evaluated once, and safe when executors go."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def lower_ascii(text: Column | str) -> Column:
    """A-Z in lower case, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def own_text(frame: DataFrame, name: str) -> Column | str:
    """A text column as an input of :func:`row_step`: itself, or a cast where it is not text."""
    kind = frame.schema[name].dataType
    return name if isinstance(kind, T.StringType) else F.col(f"`{name}`").cast("string")


def replacing(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Set result columns; a column of the same name (whatever its case) gives way."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in frame.columns if c.lower() not in taken]
    return frame.select(*kept, *[value.alias(name) for name, value in columns.items()])


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows in batches of at most SLICE: what Spark puts into one batch may be large as objects.

    At the end memory that lies ready for more is given back, since workers are used again.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)
        del batch  # before the next one is read
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, idle or in another stage.

    Arrow's pool and the C library keep what was freed for their own next use; the second is only
    asked where it knows how (glibc).
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_step(
    frame: DataFrame,
    inputs: dict[str, Column | str],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    results: dict[str, T.DataType],
) -> DataFrame:
    """Append columns that Python works out row by row from ``inputs``, in Arrow batches.

    An input is an expression, or the name of a column of the frame, which then travels once.
    ``make`` is called once per task.  The frame's own columns travel under numbers, so no name
    can clash; a column named like a result gives way to it.
    """
    names = frame.columns
    own = [f"c{i}" for i in range(len(names))]
    made = [f"r{i}" for i in range(len(results))]
    given_as = {k: own[names.index(v)] if isinstance(v, str) else f"in_{k}" for k, v in inputs.items()}
    hidden = frame.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)],
        *[v.alias(f"in_{k}") for k, v in inputs.items() if not isinstance(v, str)],
    )
    kinds = {f.name: f.dataType for f in hidden.schema}
    schema = T.StructType(
        [T.StructField(o, kinds[o]) for o in own]
        + [T.StructField(m, kind) for m, kind in zip(made, results.values())]
    )
    wanted = list(inputs)

    def run(batches):
        work = make()
        for batch in in_slices(batches):
            given = pa.RecordBatch.from_arrays([batch.column(given_as[k]) for k in wanted], wanted)
            yield pa.RecordBatch.from_arrays([*(batch.column(o) for o in own), *work(given)], [*own, *made])
            del batch, given
        work = None
        give_back()

    stepped = hidden.mapInArrow(run, schema)
    taken = {name.lower() for name in results}
    return stepped.select(
        *[F.col(o).alias(c) for c, o in zip(names, own) if c.lower() not in taken],
        *[F.col(m).alias(name) for name, m in zip(results, made)],
    )
