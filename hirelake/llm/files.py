"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def open_output(folder: str, name: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file of a name that no other attempt of the same task uses."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}{suffix}"
    system, local = _resolve(path)
    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
    return path, system.open_output_stream(local, compression=None)


def open_input(path: str) -> pa.NativeFile:
    system, local = _resolve(path)
    return system.open_input_file(local)


def one_file_per_task(manifest: DataFrame, files: int) -> DataFrame:
    """Deal the rows of a manifest, one for each file, out to tasks."""
    return manifest.repartition(max(1, files), "number")


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as an Arrow batch."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
