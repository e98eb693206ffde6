"""This library on the machines that run Python workers, and their memory."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_DONE = "_tablelore_shipped"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that travel to a worker at once.
BATCH_ROWS = 250


def ship(spark: SparkSession) -> None:
    """Give the library's files to Spark once, so that workers need no installation.

    Batches to workers are held to a few hundred rows, because rows are whole texts.
    """
    context = spark.sparkContext
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    if getattr(context, _DONE, False):
        return
    target = Path(tempfile.mkdtemp(prefix="tablelore-")) / "tablelore_library.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(target))
    setattr(context, _DONE, True)


def tidy(batches: Iterator) -> Iterator:
    """The batches, and at their end the worker's free memory back to the machine.

    Spark keeps workers for later stages, where what they no longer use is missing.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library
