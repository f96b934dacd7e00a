"""Plain files in the folder that all executors share, on any store that pyarrow opens."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyarrow import fs

from cohortspark.session import run_path, tuned


#: A batch that a worker gets: texts are long, and a worker holds a few copies of them at a time.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def new_folder(spark, name: str) -> str:
    """A new path under ``spark.checkpoint.dir`` for the files of one run."""
    tuned(spark)
    return run_path(spark, name)


def shipped(spark) -> None:
    """Readies a session's Python workers: this package's code, sent once, and batches of bounded size."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_cohortspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    uri = f"{new_folder(spark, 'code')}/{package.name}.zip"
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(packed.getvalue())
    context.addPyFile(uri)
    context._cohortspark_shipped = True


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = os.path.abspath(uri)
    elif uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def attempt_name(folder: str, stem: str) -> str:
    """A file name of one task attempt alone.

    A lost or speculative attempt leaves a file that no manifest names, so it is never read.
    """
    return f"{folder}/{stem}-{uuid.uuid4().hex[:12]}"


def memory_mapped(uri: str) -> pa.Buffer:
    """The bytes of a file: mapped into memory where the store is a mounted one, read where not."""
    store, path = opened(uri)
    if store.get_file_info(path).size == 0:
        return pa.py_buffer(b"")
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with store.open_input_file(path) as source:
        return source.read_buffer()
