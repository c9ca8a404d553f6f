"""Vectorized work on the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One random 64-bit number for each byte value, from a fixed seed.
NOISE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
ODD = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.int64).astype(U) * U(2) + U(1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    off = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * width).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def trimmed(work):
    """The kernel ``work``; when it is done, its memory goes back to the system, not to the idle worker."""

    def run(batches):
        yield from work(batches)
        give_back()

    return run


def trimmed_group(work):
    """The same for a kernel of one group (or of two that meet)."""
    if len(inspect.signature(work).parameters) == 2:

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = work(left, right)
            give_back()
            return out

    else:

        def run(table: pa.Table) -> pa.Table:
            out = work(table)
            give_back()
            return out

    return run


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batches, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of ``column`` (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def binary(data: bytes | np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary array of rows cut from one buffer."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw)]).cast(pa.binary())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words end at white space (or outside ``inside``) and at the row's end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = ~SPACES[data] if inside is None else inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = is_word.copy()
    first[1:] &= ~is_word[:-1] | edge[1:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U(base))
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U)


_BASE = 0x9E3779B97F4A7C15
_CACHE: list[np.ndarray] = [np.zeros(0, U), np.zeros(0, U)]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: polynomial over random byte codes, then mixed."""
    n = len(data) + 1
    if len(_CACHE[0]) < n:
        _CACHE[0] = _powers(n, _BASE)
        _CACHE[1] = _powers(n, pow(_BASE, -1, 1 << 64))
    total = np.zeros(n, U)
    np.cumsum(NOISE[data] * _CACHE[0][: n - 1], out=total[1:])
    return mix((total[end] - total[start]) * _CACHE[1][start] + (end - start).astype(U) * ODD[0])


def row_shingles(data: np.ndarray, off: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles after lower-casing A-Z, and the first one's place for each row.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    data = LOWER[data]
    start, end, row = word_spans(data, off)
    words = span_hashes(data, start, end)
    rows = len(off) - 1
    count = np.bincount(row, minlength=rows)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=first[1:])
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    place = np.zeros(rows + 1, np.int64)
    np.cumsum(made, out=place[1:])
    out = np.empty(place[-1], U)
    n = len(words)
    if n >= width:
        run = np.zeros(n - width + 1, U)
        for j in range(width):
            run += words[j : n - width + 1 + j] * ODD[j + 1]
        ok = row[: n - width + 1] == row[width - 1 :]
        long = np.repeat(count >= width, made)
        out[long] = mix(run[ok])
    for r in np.flatnonzero((count > 0) & (count < width)):
        k = int(count[r])
        own = words[first[r] : first[r + 1]]
        out[place[r]] = mix((own * ODD[1 : k + 1]).sum(dtype=U).reshape(1) + ODD[40 + k])[0]
    return out, place


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their lengths and types, byte plane by byte plane and compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], "<i8").tobytes()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays)
    raw = head + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(-1, 2)
    out, at = [], 8 + 16 * n
    for count, width in head.tolist():
        planes = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel() if width > 1 else planes.ravel())
        at += count * width
    return out


def grouped(keys: np.ndarray):
    """(key, places) for each distinct key, places rising."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))).tolist()
    for a, b in zip(cut, [*cut[1:], len(s)], strict=True):
        yield int(s[a]), order[a:b]


def by_bucket(batches, handle, together: int = 0):
    """Feed the blobs of one bucket after the other to ``handle``; rows of another kind pass through.

    Successive buckets are fed together until their blobs unpack to ``together`` bytes.
    """
    bucket, blobs, held = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        other = batch.column("kind").to_numpy() != 0
        if other.any():
            yield batch.filter(pa.array(other))
        own = batch.filter(pa.array(~other))
        for k, blob in zip(own.column("bucket").to_pylist(), own.column("blob").to_pylist(), strict=True):
            if k != bucket and blobs and held >= together:
                yield from handle(blobs)
                blobs, held = [], 0
            bucket = k
            held += int.from_bytes(blob[:8], "little")
            blobs.append(blob)
    if blobs:
        yield from handle(blobs)
