"""Files in the shared folder that tasks write whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str) -> Iterator:
    """A stream to ``uri``: written under another name and moved when complete, so retries and lost tasks do no harm."""
    store, path = _place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with store.open_output_stream(partial) as out:
        yield out
    store.move(partial, path)


@contextmanager
def opened(uri: str) -> Iterator:
    """A seekable stream from ``uri``."""
    store, path = _place(uri)
    with store.open_input_file(path) as source:
        yield source


#: Rows of an Arrow batch of texts: a Python worker and the JVM's own buffers hold a few batches at once.
ROWS_PER_BATCH = 1_000


def small_batches(spark) -> None:
    """Texts go to Python workers in batches of few rows; set for the session, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def partition_id() -> int:
    return TaskContext.get().partitionId()


def attempt_name() -> str:
    """A file name that no other attempt at the same task has: a late attempt never replaces the file that the committed index names."""
    return f"{partition_id():06d}-{uuid.uuid4().hex}"


def each_in_a_task(rows: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Deal a small table of files out so that tasks get few rows each (adaptive execution would merge them)."""
    return rows.repartition(max(1, min(rows.count(), most)), key)
