"""Flat arrays in the shared folder, written once by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under its final name in one step, so that a task may run twice or die half-way."""
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array))
    system.move(part, f"{path}/{name}")


@lru_cache(maxsize=4096)
def mapped(folder: str, name: str, kind: str) -> np.ndarray:
    """The array, mapped in place if the folder is mounted here, else from a copy that vanishes with the process."""
    system, path = _place(folder)
    if isinstance(system, fs.LocalFileSystem):
        file = f"{path}/{name}"
        return np.asarray(np.memmap(file, kind, "r")) if os.path.getsize(file) else np.zeros(0, kind)
    with tempfile.TemporaryFile() as copy:
        with system.open_input_stream(f"{path}/{name}") as source:
            while chunk := source.read(1 << 24):
                copy.write(chunk)
        copy.flush()
        return np.asarray(np.memmap(copy, kind, "r")) if copy.tell() else np.zeros(0, kind)


def put_rows(folder: str, name: str, rows: pa.Table | pa.RecordBatch) -> None:
    """Write rows as one Arrow file, in one step as ``put`` does."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, rows.schema) as out:
        out.write(rows)
    put(folder, name, np.frombuffer(sink.getvalue(), np.uint8))


def rows(folder: str, name: str) -> pa.Table:
    """The rows, mapped in place if the folder is mounted here, else read."""
    system, path = _place(folder)
    file = f"{path}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(file)).read_all()
    with system.open_input_stream(file) as source:
        return pa.ipc.open_file(pa.py_buffer(source.read())).read_all()


@lru_cache(maxsize=256)
def _opened(folder: str, name: str):
    system, path = _place(folder)
    return system.open_input_file(f"{path}/{name}")


def piece(folder: str, name: str, kind: str, at: int, count: int) -> np.ndarray:
    """``count`` items of the array from ``at`` on, read alone."""
    width = np.dtype(kind).itemsize
    return np.frombuffer(_opened(folder, name).read_at(count * width, at * width), kind) if count else np.zeros(0, kind)
