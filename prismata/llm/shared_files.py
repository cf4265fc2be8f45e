"""Files of named arrays in the folder that the cluster shares, memory-mapped by the tasks that read them."""

from __future__ import annotations

import json
import mmap
import os
import uuid
from collections import OrderedDict

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> int:
    """Write the arrays to one file, under a name of its own first, so that a task may run twice."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = (at, a.dtype.str, len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(places).encode()
    head = len(head).to_bytes(8, "little") + head
    head = head.ljust(-(-len(head) // 64) * 64, b" ")

    def put(f) -> None:
        f.write(head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % 64))

    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            put(f)
        os.replace(own, path)
    else:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(uri)
        own = f"{where}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as f:
            put(f)
        store.move(own, where)
    return len(head) + at


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped from a folder, read into memory from other stores."""
    path = local_path(uri)
    if path:
        with open(path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(uri)
        with store.open_input_file(where) as source:
            raw = source.read()
    size = int.from_bytes(raw[:8], "little")
    start = -(-(8 + size) // 64) * 64
    return {name: np.frombuffer(raw, np.dtype(kind), n, start + at) for name, (at, kind, n) in json.loads(raw[8 : 8 + size]).items()}


KEPT_FILES, KEPT_BYTES = 4096, 256 << 20
_kept: OrderedDict[str, tuple[dict[str, np.ndarray], int]] = OrderedDict()


def kept_arrays(uri: str) -> dict[str, np.ndarray]:
    """The same, kept open for the next that asks: up to ``KEPT_FILES`` files, and ``KEPT_BYTES`` of what was read into memory."""
    if uri in _kept:
        _kept.move_to_end(uri)
    else:
        arrays = map_arrays(uri)
        _kept[uri] = (arrays, 0 if local_path(uri) else sum(a.nbytes for a in arrays.values()))
        while len(_kept) > 1 and (len(_kept) > KEPT_FILES or sum(n for _, n in _kept.values()) > KEPT_BYTES):
            _kept.popitem(last=False)
    return _kept[uri][0]
