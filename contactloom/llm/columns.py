"""Texts as columns: splitting many texts at once without an object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are split into words at a time.
PIECE = 1 << 22


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about PIECE in all, at least one each."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
        yield first, last
        first = last


def byte_sizes(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)


def byte_strings(strings: pa.Array) -> list[bytes]:
    """What ``to_pylist`` gives, as bytes and without a scalar for each string."""
    if not len(strings):
        return []
    _, at, data = strings.buffers()
    ends = np.frombuffer(at, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and how long they are."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return first, np.diff(np.r_[first, len(key)])


Layout = tuple[tuple[str, str], ...]


def blocks(columns: dict[str, np.ndarray], layout: Layout, bundle: np.ndarray, at_once: int = 64) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows as compressed blocks of columns, one for each bundle: bundles and their blocks, some at a
    time.  Shuffling blocks costs far less than shuffling rows."""
    import zstandard

    order = np.argsort(bundle, kind="stable")
    bundle, columns = bundle[order], {c: np.ascontiguousarray(columns[c][order].astype(t)) for c, t in layout}
    pack = zstandard.ZstdCompressor(level=1).compress
    first, sizes = runs(bundle)
    for a in range(0, len(first), at_once):
        made = [pack(b"".join(columns[c][x : x + n].tobytes() for c, _ in layout)) for x, n in zip(first[a : a + at_once].tolist(), sizes[a : a + at_once].tolist(), strict=True)]
        yield bundle[first[a : a + at_once]].tolist(), made


def unblocked(packed: list[bytes], layout: Layout) -> dict[str, np.ndarray]:
    """The rows of some blocks."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in layout}
    wide = sum(np.dtype(t).itemsize for _, t in layout)
    for block in packed:
        raw = unpack(block)
        size, at = len(raw) // wide, 0
        for c, t in layout:
            parts[c].append(np.frombuffer(raw, t, size, at))
            at += size * np.dtype(t).itemsize
    return {c: np.concatenate(p) for c, p in parts.items()}


def by_bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each bundle, from rows (bundle, block) in order of bundles."""
    bundle, held = None, []
    for batch in batches:
        for now, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bundle != now:
                if held:
                    yield held
                bundle, held = now, []
            held.append(block.as_py())
    if held:
        yield held


def frugal(scan):
    """``scan``, a function of Arrow batches, in a worker that afterwards gives the memory it no longer
    uses back to the system: workers live on, and the next operator's share their executor."""

    def run(batches):
        import ctypes

        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return run
