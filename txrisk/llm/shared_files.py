"""Files in the shared folder that tasks write whole and map into memory."""

import mmap
import os
import sys
import tempfile
import uuid

import numpy as np
import pyarrow.fs
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])


def _place(uri):
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


KINDS = ("<u8", "<i8", "|u1", "<u4")


def save_arrays(uri, arrays):
    """Writes arrays into one file. A task that is run twice replaces the file by an equal one."""
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    unfinished = f"{path}.{uuid.uuid4().hex}"
    head = [len(arrays)]
    for array in arrays:
        head += [KINDS.index(array.dtype.str), len(array)]
    with system.open_output_stream(unfinished, compression=None) as out:
        out.write(np.array(head, np.int64).tobytes())
        for array in arrays:
            raw = np.ascontiguousarray(array).tobytes()
            out.write(raw + bytes(-len(raw) % 8))
    system.move(unfinished, path)


def _map(file):
    """A read-only map; where Python allows it, without holding on to a file number."""
    own = {"trackfd": False} if sys.version_info >= (3, 13) else {}
    return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **own)


def map_arrays(uri):
    """The arrays as views of one map of their file, so that only the pages in use take memory.

    From a store that cannot be mapped the file is copied to the worker's own disk; the copy has no
    name and goes when the worker ends.
    """
    system, path = _place(uri)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        with open(path, "rb") as file:
            whole = _map(file)
    else:
        with tempfile.TemporaryFile() as copy, system.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            whole = _map(copy)
    count = int(np.frombuffer(whole, np.int64, 1)[0])
    head, at, arrays = np.frombuffer(whole, np.int64, 2 * count, 8), 8 + 16 * count, []
    for kind, length in head.reshape(-1, 2).tolist():
        arrays.append(np.frombuffer(whole, np.dtype(KINDS[kind]), length, at))
        at += -(-arrays[-1].nbytes // 8) * 8
    return arrays
