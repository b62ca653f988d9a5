"""Vectorised words, rolling hashes and minimiser spans over Arrow batches of texts.

All functions work on whole texts. A batch is cut into slices of bounded bytes (a single
longer text is a slice of its own), so that the arrays of a task stay small whatever the
batch holds. Hashes are polynomials modulo 2**64 over mixed symbols, finished by a mixer;
two of them (different bases) identify content with 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_values(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[1 - which]))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _base_powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least n of them."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        base = _BASES[which]
        pair = []
        for value in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, value, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        held = _powers[which] = tuple(pair)
    return held


class Rolling:
    """Hashes of any span of a sequence of uint64 symbols, by prefix sums."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        self.powers, self.inverse = _base_powers(which, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers[: len(symbols)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + length * np.uint64(0xA24BAED4963EE407))

    def windows(self, n: int) -> np.ndarray:
        """The hash of the n symbols from each place on (no boundary check)."""
        count = max(0, len(self.sums) - n)
        raw = (self.sums[n:] - self.sums[:count]) * self.inverse[:count]
        return mix(raw + np.uint64((n * 0xA24BAED4963EE407) % (1 << 64)))


class Texts:
    """The UTF-8 bytes of a slice of texts (nulls are empty), with their bounds."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(column)

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1

    def symbols(self, which: int = 0, data: np.ndarray | None = None) -> np.ndarray:
        return _byte_values(which).take(self.bytes if data is None else data)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte bounds, document, 64-bit hash."""

    def __init__(self, texts: Texts, data: np.ndarray | None = None):
        data = texts.bytes if data is None else data
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        bounds = texts.offsets[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < len(data))]
        first[bounds] = inside[bounds]
        last[bounds - 1] = inside[bounds - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.hash = Rolling(texts.symbols(0, data), 0).spans(self.starts, self.ends)
        #: Word bounds of the documents: words bounds[i] to bounds[i + 1] are document i's.
        self.bounds = np.searchsorted(self.starts, texts.offsets)
        self.document = np.repeat(np.arange(texts.n), np.diff(self.bounds))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of the column pass the limit."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from each place on."""
    if len(values) < width:
        return values[:0]
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def minimiser_spans(symbols: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """Group the windows of each document by the minimiser that they hold.

    Returns (start, count, anchor place) of each span: the windows starting at start, ...,
    start + count - 1 share the leftmost least k-gram, at the anchor place. A window's
    minimiser depends on nothing outside the window.
    """
    return anchored_spans(symbols, bounds, window, k)[:3]


def anchored_spans(symbols: np.ndarray, bounds: np.ndarray, window: int, k: int):
    """``minimiser_spans`` and the hash of each span's k-gram (of base 1)."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, np.zeros(0, np.uint64)
    grams = Rolling(symbols, 1).windows(k)
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(keys, window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(bounds)
    long_enough = lengths >= window
    of_windows = np.maximum(lengths - window + 1, 0)
    inside = np.repeat(np.tile([True, False], len(lengths)), np.stack((of_windows, lengths - of_windows), axis=1).ravel())[: len(least)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    starts_of_documents = bounds[:-1][long_enough]
    begins[starts_of_documents[starts_of_documents < len(begins)]] = True
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= begins[1:] | ~inside[1:]
    ends = np.flatnonzero(stops) + 1
    anchors = least[starts]
    return starts, ends - starts, anchors, grams[anchors]
