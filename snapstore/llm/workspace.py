"""Scratch tables in the folder that the driver and all executors share, and helpers every operator uses.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests, local mode) is a
folder of our own set.  A scratch table cuts lineage: once its job has committed, later jobs read the files,
so an executor that is lost afterwards costs nothing but its running tasks.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans import lineage
from ..plans.lineage import shared_dir

_tables: dict[str, list[tuple[SparkSession, str]]] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of an Arrow batch between the JVM and Python: a batch of 10,000 long texts would be held four times over.
BATCH_BYTES = 4 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one table or file set; ``release`` or the end of the program deletes it."""
    path = f"{shared_dir(spark)}/snapstore/{name}-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(release)
    _tables.setdefault(name.split("/")[0], []).append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and return the table read back."""
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*names: str) -> None:
    """Delete scratch tables (all, or those of the named operators); call it when their results are written."""
    for name in names or list(_tables):
        for spark, path in _tables.pop(name, []):
            try:
                hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
            except Exception:  # noqa: BLE001, S110  the session has ended; nothing more can be done here
                pass


def ship(spark: SparkSession) -> None:
    """The package's source goes to the executors; Arrow batches are bounded by bytes."""
    lineage.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(run):
    """``run`` for a task of a worker that lives on: memory that it no longer uses goes back to the system at its end."""

    def task(source):
        try:
            yield from run(source)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def lower_ascii(c: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def batches(source: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterable[pa.RecordBatch]:
    """Slices of the incoming batches with about ``max_bytes`` of text each, one row at least."""
    for batch in source:
        n = batch.num_rows
        if not n:
            continue
        lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            held += int(lengths[i])
            if held >= max_bytes:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < n:
            yield batch.slice(start)


def with_decisions(docs: DataFrame, id_col: str, text_col: str, make, fields: str) -> DataFrame:
    """Columns ``row`` (all of a document's columns) and those of ``fields``, in one pass without a shuffle.

    ``make()`` runs once a task and returns a function of (ids, texts) that gives one list for each of the fields.
    The document's own columns stay inside ``row``, so their names can't clash with those of the fields.
    """
    ship(docs.sparkSession)
    kind = T.StructType([T.StructField("row", docs.schema, False), *T._parse_datatype_string(fields).fields])

    def run(source):
        decide = make()
        for batch in source:
            row = batch.column("row")
            slim = pa.RecordBatch.from_arrays([row, row.field(id_col), row.field(text_col).cast(pa.string())], ["row", "id", "text"])
            for part in batches([slim], "text"):
                columns = decide(part.column("id").to_pylist(), part.column("text").to_pylist())
                arrays = [pa.array(c, t) for c, t in zip(columns, arrow_kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), *arrays], kind.names)

    arrow_kinds = [to_arrow_type(f.dataType) for f in kind.fields[1:]]
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).mapInArrow(lean(run), kind)

