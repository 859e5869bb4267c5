"""Files that tasks write to and read from the shared folder, on any store pyarrow can address."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs



def store_at(uri: str):
    """(file system, path) of a URI or a local path."""
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def replaced(uri: str):
    """A binary output stream whose file appears under ``uri`` only when it is complete. Tasks use a name of their own
    for every attempt: not every store can replace a file."""
    store, path = store_at(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, path)


@contextlib.contextmanager
def mapped(uri: str, dtype):
    """The file as a memory-mapped flat array; a file of a remote store is first copied to the task's
    own temporary folder, for the time of the read."""
    store, path = store_at(uri)
    if store.type_name == "local":
        yield _map(path, dtype)
        return
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "part")
        fs.copy_files(path, local, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
        yield _map(local, dtype)


def _map(path: str, dtype):
    return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)


def packed(columns: list[np.ndarray]) -> tuple[bytes, int]:
    """(compressed bytes, plain length) of columns of 8-byte values. Bytes of one place stand together, so that the
    empty ones of small numbers take next to nothing."""
    data = np.concatenate([c.view("<i8") for c in columns]).view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(data, codec="zstd", asbytes=True), len(data)


def unpacked(data: bytes, plain: int, columns: int) -> list[np.ndarray]:
    """The columns of :func:`packed`, as int64."""
    cells = np.frombuffer(pa.decompress(data, plain, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
    return list(np.ascontiguousarray(cells.T).view("<i8").reshape(columns, -1))


class PackedWriter:
    """Compressed arrays of many blocks in one new file: the blocks' bytes, then an index (block, offset, length),
    then the index's length. The file's name is new for every attempt of a task, so nothing is ever replaced; the
    caller keeps the name that the successful attempt returns."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}"
        store, path = store_at(self.name)
        store.create_dir(os.path.dirname(path), recursive=True)
        self._out, self._index, self._offset = store.open_output_stream(path), [], 0

    def add(self, block: int, columns: list[np.ndarray]) -> None:
        data, plain = packed(columns)
        self._out.write(data)
        self._index.append((block, self._offset, len(data), plain))
        self._offset += len(data)

    def close(self) -> str:
        index = np.array(sorted(self._index), "<i8").tobytes()
        self._out.write(index + np.array([len(index)], "<i8").tobytes())
        self._out.close()
        return self.name


def read_packed(uri: str, block: int, columns: int) -> list[np.ndarray]:
    """The columns of a block of a :class:`PackedWriter` file, as int64; empty ones if the file lacks it."""
    store, path = store_at(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 8)
        length = int(np.frombuffer(f.read(8), "<i8")[0])
        f.seek(size - 8 - length)
        index = np.frombuffer(f.read(length), "<i8").reshape(-1, 4)
        at = np.searchsorted(index[:, 0], block)
        if at == len(index) or index[at, 0] != block:
            return [np.zeros(0, np.int64)] * columns
        _, offset, held, plain = index[at].tolist()
        f.seek(offset)
        return unpacked(f.read(held), plain, columns)
