"""Arrow strings as flat numpy code-point arrays, and back, without a Python call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def explode(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows one after the other, offsets of the rows); a null row has none."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(col) else np.empty(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) == len(raw):
        return cp, off - off[0]
    lead = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return cp, lead[off - off[0]]


def implode(cp: np.ndarray, off: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The strings of a flat code-point array; `null` marks rows that come out as null."""
    raw = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    at = np.r_[0, np.cumsum(width)][off].astype(np.int64)
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)).cast(pa.string())
    if null is not None and null.any():
        import pyarrow.compute as pc

        out = pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)
    return out


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row of each element of a flat array."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def keep(cp: np.ndarray, off: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the elements of `mask`."""
    return cp[mask], np.r_[0, np.cumsum(mask)][off]
