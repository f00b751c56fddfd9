"""Arrays packed into single binary values, so that shuffles move a few large rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays in one value: their lengths in bytes as four-byte numbers, then their bytes."""
    return b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], "<u4").tobytes(), *(a.tobytes() for a in arrays)])


def unpack_arrays(blob: bytes, *kinds: str) -> list[np.ndarray]:
    head = np.frombuffer(blob, "<u4", len(kinds) + 1)
    at, out = 4 * (len(kinds) + 1), []
    for kind, n in zip(kinds, head[1:].tolist(), strict=True):
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def runs_of(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(key, range) of each key among sorted keys from 0 to n - 1."""
    cuts = np.searchsorted(keys, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, slice(int(cuts[k]), int(cuts[k + 1]))
