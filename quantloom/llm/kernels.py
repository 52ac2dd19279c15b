"""Vectorised text kernels shared by the corpus operators.

All of them work on one slice of documents at a time: a byte buffer plus document offsets, as Arrow
stores a string column.  Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which for
UTF-8 equals the character class ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes of text that the kernels hold expanded at once; a single longer document is taken whole.
SLICE_BYTES = 500_000
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_libc = ctypes.CDLL(None)
with contextlib.suppress(AttributeError):  # where there is glibc: large freed arrays go back to the system at once
    _libc.mallopt(-3, 1 << 20)


def release() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):
        _libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """run, for a partition or a group, leaving no freed memory behind in the worker, which idles on."""

    def on_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    def on_group(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    def on_groups(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        release()
        return out

    if inspect.isgeneratorfunction(run):
        return on_partition
    return on_group if len(inspect.signature(run).parameters) == 1 else on_groups


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _rng.integers(1, 2**63, (2, 256), dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: The primes of XXH64, fixed values.
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def xxh64_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end) for many ranges at once."""
    padded = np.zeros((len(data) // 8 + 3) * 8, np.uint8)
    padded[: len(data)] = data
    aligned = padded.view("<u8")

    def load(at: np.ndarray) -> np.ndarray:
        shift = ((at & 7) << 3).astype(U64)
        low = aligned[at >> 3] >> shift
        high = aligned[(at >> 3) + 1] << (U64(63) - shift) << U64(1)
        return low | high

    seed = U64(seed)
    length = (ends - starts).astype(np.int64)
    at = starts.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed + P5, U64)
        huge = np.flatnonzero(length > 2048)  # in all lanes at once only what takes few steps
        length[huge] = 0
        long = np.flatnonzero(length >= 32)
        if len(long):
            lanes = [np.full(len(long), s, U64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            blocks, step = length[long] >> 5, 0
            while (live := np.flatnonzero(blocks > step)).size:
                base = at[long[live]] + 32 * step
                for k in range(4):
                    lanes[k][live] = _turn(lanes[k][live] + load(base + 8 * k) * P2, 31) * P1
                step += 1
            acc = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                acc = (acc ^ (_turn(lane * P2, 31) * P1)) * P1 + P4
            h[long] = acc
            at[long] += blocks << 5
        h += length.astype(U64)
        left = length & 31
        for step in range(3):
            live = np.flatnonzero(left >= 8 * (step + 1))
            if not live.size:
                break
            h[live] = _turn(h[live] ^ (_turn(load(at[live]) * P2, 31) * P1), 27) * P1 + P4
            at[live] += 8
        live = np.flatnonzero(left & 4)
        h[live] = _turn(h[live] ^ ((load(at[live]) & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[live] += 4
        for step in range(3):
            live = np.flatnonzero((left & 3) > step)
            if not live.size:
                break
            h[live] = _turn(h[live] ^ (padded[at[live]].astype(U64) * P5), 11) * P1
            at[live] += 1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
    for i in huge.tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), int(seed))
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next call."""
    if base not in _powers or len(_powers[base]) <= n:
        out = np.full(max(n + 1, 1 << 16), base, U64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=U64)
    return _powers[base]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def range_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Cheap 64-bit hashes of codes[start:end) for many ranges: a polynomial modulo 2**64, by prefix sums.

    Equal ranges have equal hashes, but unequal ones can be made to have equal ones, whatever the base: for choosing
    and sifting only, never for what is decided."""
    base = _BASES[lane]
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(base, len(codes))[: len(codes)], out=sums[1:], dtype=U64)
    back = powers(inverse(base), len(codes))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64))


def sifting_windows(codes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """range_hashes of codes[i:i+width) for every i that has width codes from it on."""
    base, n = _BASES[lane], max(0, len(codes) - width + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(base, len(codes))[: len(codes)], out=sums[1:], dtype=U64)
    return mix((sums[width : width + n] - sums[:n]) * powers(inverse(base), len(codes))[:n] + U64(width))


def byte_codes(data: np.ndarray, lane: int = 0) -> np.ndarray:
    return _BYTE_CODES[lane][data]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most limit bytes together, or of one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the index of its first word (n+1 long)."""
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)  # a document begins or the buffer ends here
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """XXH64 of each word; the lanes have seeds of their own."""
    return xxh64_ranges(data, starts, ends, 42 + lane)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * P1 + b)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of codes[i:i+width) for every i that has width codes from it on: a tree of mixed pairs."""
    n = max(0, len(codes) - width + 1)
    level, size, out, done = mix(codes), 1, None, 0
    while True:
        if width & size:
            part = level[done : done + n]
            out, done = part if out is None else _joined(out, part), done + size
        if 2 * size > width:
            return out[:n]
        level, size = _joined(level[:-size], level[size:]) if len(level) > size else level[:0], 2 * size


#: The prime 2**31 - 1, and bases and byte codes below it, two for each lane.
_PRIME = U64(2**31 - 1)
_PRIME_BASES = ((1_582_974_133, 774_235_327), (1_120_395_761, 1_933_801_219))
_PRIME_CODES = (_rng.integers(1, 2**31 - 1, (2, 2, 256), dtype=np.int64)).astype(U64)
_prime_powers: dict[int, np.ndarray] = {}


def _powers_modulo(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo the prime, kept for the next call."""
    have = _prime_powers.get(base, np.ones(1, U64))
    while len(have) <= n:
        have = np.concatenate([have, have * U64(pow(base, len(have), int(_PRIME))) % _PRIME])
    _prime_powers[base] = have
    return have


def byte_windows(data: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """62-bit names of data[i:i+width) for every i that has width bytes from it on.

    Two polynomials modulo 2**31 - 1, by prefix sums: different strings have one name with a chance of at most
    (width / 2**31)**2, over the choice of the bases."""
    n = max(0, len(data) - width + 1)
    out = np.zeros(n, U64)
    for first in range(0, n, SLICE_BYTES // 4):  # what is expanded stays small
        last = min(n, first + SLICE_BYTES // 4)
        part, name = data[first : last + width - 1], out[first:last]
        for base, codes in zip(_PRIME_BASES[lane], _PRIME_CODES[lane], strict=True):
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(codes[part] * _powers_modulo(base, len(part))[: len(part)] % _PRIME, out=sums[1:])
            inside = (sums[width:] - sums[:-width]) % _PRIME
            name <<= U64(31)
            name |= inside * _powers_modulo(pow(base, -1, int(_PRIME)), len(part))[: len(name)] % _PRIME
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places some range [start, start + width) covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    d = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + count), one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids for comparisons; a null id is the largest."""
    return pc.fill_null(column.cast(pa.int64()), 2**63 - 1).to_numpy()
