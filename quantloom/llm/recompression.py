"""Removing word windows that an earlier document has, found by recompression.

Recompression replaces, in rounds, maximal runs of one symbol and then pairs of a "left" and a
"right" symbol by new names; names come from the content (64-bit hashes), so they agree over the
whole corpus without a dictionary, and a symbol's class is a bit of its name.  Whether two symbols
merge depends on them alone, so equal substrings get equal symbol borders inside, away from their
ends: after two rounds, a border is decided by the three words on each side of it (symbols of more
than two words, which hold a run, stay as they are in the second round).

So a window of at least 13 words always holds borders that its own words decide.  Every window
picks the one whose neighbourhood of eight words has the smallest name - or, inside a long run, its
seventh word - and only these neighbourhoods, about a quarter of all places, are named globally.
Windows around a neighbourhood that two documents share are then verified on their own names: trees of mixed
pairs over the XXH64 of their words, in two lanes with seeds of their own, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .storage import stored

U64 = np.uint64
NEAR, WIDTH = 3, 8  # words before a border, and words in all, of its neighbourhood
_SEEDS = (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))


def _left(names: np.ndarray, round_: int) -> np.ndarray:
    return (K.mix(names ^ _SEEDS[round_]) & U64(1)).astype(bool)


def _merged(names: np.ndarray, free: np.ndarray, round_: int) -> np.ndarray:
    """Whether each symbol after the first joins the one before it: as a run or as a pair."""
    left = _left(names, round_)
    same = names[1:] == names[:-1]
    return (same | (left[:-1] & ~left[1:])) & free[1:] & free[:-1]


def borders(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words begin a symbol after two rounds; first: the first word of each document, and the end."""
    n = len(codes)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    edge = begins[:n].copy()
    edge[1:] |= ~_merged(codes, np.ones(n, bool), 0)
    edge[:1] = True
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, n))
    names = K.mix(codes[start] ^ K.mix(codes[start + size - 1] + size.astype(U64)))  # of longer symbols no names are needed
    second = begins[start].copy()
    second[1:] |= ~_merged(names, size <= 2, 1)
    second[:1] = True
    out = np.zeros(n, bool)
    out[start[second]] = True
    return out


def anchors(codes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that the windows of all documents pick, and the names of their neighbourhoods."""
    n, none = len(codes), U64(2**64 - 1)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    names = K.window_hashes(codes, WIDTH)
    value = np.full(n, none, U64)
    at = np.flatnonzero(borders(codes, first))
    at = at[(at >= NEAR) & (at - NEAR < len(names))]
    value[at] = names[at - NEAR]
    count = n - window + 1
    inside = np.zeros(n + 1, np.int8)  # a window from here on stays in its document
    for a, b in ((first[:-1], np.maximum(first[1:] - window + 1, first[:-1])),):
        np.add.at(inside, a, 1)
        np.add.at(inside, b, -1)
    fits = np.cumsum(inside[:count]) > 0
    reach = range(NEAR, window - WIDTH + NEAR + 1)
    least = value[reach[0] : reach[0] + count].copy()
    for o in reach[1:]:
        np.minimum(least, value[o : o + count], out=least)
    picked = np.zeros(n, bool)
    some = fits & (least != none)
    for o in reach:
        picked[o : o + count] |= some & (value[o : o + count] == least)
    picked[2 * NEAR : 2 * NEAR + count] |= fits & ~some
    at = np.flatnonzero(picked)
    return at, names[at - NEAR]


def _in_documents(start: np.ndarray, size: np.ndarray, doc: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Key groups of two documents at least, or of which a task already knew that."""
    if not len(start):
        return np.zeros(0, bool)
    hit = (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)) | (np.maximum.reduceat(flag, start) > 0)
    return np.repeat(hit, size)


def _later(start: np.ndarray, size: np.ndarray, doc: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Entries whose name an earlier document has."""
    return doc > np.repeat(np.minimum.reduceat(doc, start), size) if len(start) else np.zeros(0, bool)


def _survey(window: int, parts: int):
    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.portions(batches, R.text_sizes):
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = K.text_buffers(batch.column(2))
            found = []
            for a, b in K.slices(offsets):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = K.words(part, local)
                at, key = anchors(K.word_hashes(part, starts, ends), first, window)
                row = np.searchsorted(first, at, "right") - 1
                found.append((key, a + row, at - first[row]))
            key, row, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(key, kind="stable")
            key, row, pos = key[order], row[order], pos[order]
            doc, copy = ids[row], copies[row]
            start, size = R.groups(key)
            shared = _in_documents(start, size, doc, np.zeros(len(doc), np.uint8))
            out = R.Entries()
            out.settle(parts, doc[shared], copy[shared], pos[shared])
            send = ~shared
            send[start] = True
            out.add(parts, 0, (key[send] % U64(parts)).astype(np.int64), (key[send] >> U64(32)).astype(np.uint32), doc[send], copy[send], pos[send], np.ones(send.sum()), shared[send].astype(np.uint8))
            yield out.batch()

    return run


def _windows(window: int, parts: int):
    """Names of the windows around shared neighbourhoods: (_doc, _copy, _z, _near) to entries."""

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.portions(batches, R.packed_sizes):
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, near = R.texts(batch.column(2)), batch.column(3).to_pylist()
            found = []
            offsets = np.cumsum([0, *map(len, raw)])
            for a, b in K.slices(offsets):
                data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
                starts, ends, first = K.words(data, offsets[a : b + 1] - offsets[a])
                last = first[1:] - window
                at = [np.frombuffer(near[a + k], "<u4").astype(np.int64) + first[k] for k in range(b - a)]
                row = np.repeat(np.arange(b - a), list(map(len, at)))
                at = np.concatenate(at)
                fits = np.zeros(len(starts), bool)
                for o in range(NEAR, window - WIDTH + NEAR + 1):
                    p = at - o
                    fits[p[(p >= first[row]) & (p <= last[row])]] = True
                p = np.flatnonzero(fits)
                row = np.searchsorted(first, p, "right") - 1
                h = [K.window_hashes(K.word_hashes(data, starts, ends, lane), window)[p] for lane in (0, 1)]
                found.append((*h, a + row, p - first[row]))
            key, other, row, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.lexsort((other, key))
            key, other, row, pos = key[order], other[order], row[order], pos[order]
            doc, copy = ids[row], copies[row]
            later = _later(*R.groups(key, other), doc, other)
            out = R.Entries()
            out.settle(parts, doc[later], copy[later], pos[later])
            send = ~later
            out.add(parts, 0, (other[send] % U64(parts)).astype(np.int64), key[send], doc[send], copy[send], pos[send], np.ones(send.sum()), other[send])
            yield out.batch()

    return run


def _kept(text: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """text without the removed words and the white space behind them."""
    step = np.zeros(len(text) + 1, np.int8)
    ends = np.append(starts[1:], len(text))
    step[starts[gone]] += 1
    step[ends[gone]] -= 1
    return np.frombuffer(text, np.uint8)[np.cumsum(step[:-1]) == 0].tobytes()


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, report: str = "repeats") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space).

    Words covered by a window of words that also starts in a document with a smaller id are removed;
    windows are judged on the input.  With keep, the columns of docs come first, whatever their names, their text
    without the removed words, and then one struct of the three numbers by the name of ``report``.  Null text has no
    words and stays null; a null id counts as the largest; rows of one id are not earlier
    than each other, whatever their texts; repeated rows come back repeated; a text of any length is read whole; an
    empty table gives an empty result; other columns don't matter."""
    if window < 13:
        raise ValueError("two rounds of recompression decide borders in windows of 13 words or more")
    if keep and report.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the columns already have a {report}: name the report otherwise")
    rows, size = R.numbered(docs, id_col, text_col)
    if keep:  # the text travels once, compressed
        rows = rows.withColumn("_row", F.col("_row").withField(f"`{text_col}`", F.lit(None).cast("string")))
    parts, doc_parts = R.parts_for(size, 7_500_000), R.parts_for(size, R.TEXT_PART)
    near = R.settled(rows.select("_doc", "_copy", "_text").mapInArrow(_survey(window, parts), R.ENTRY), _in_documents, np.uint32, np.uint8, doc_parts)
    rest = ["_row"] if keep else []
    packed = R.squeezed(rows, doc_parts, *rest)
    more = "".join(f", {c} {t}" for c, t in packed.dtypes[4:])
    results = ", n_words long, n_removed long, kept_sha256 string"

    @K.lean
    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        """Rows without a shared neighbourhood are done; the others keep their text and its places."""
        at = [p for p, _ in R.places_of(left, right)]
        n, sha = [], []
        for p, z in zip(at, left.column("_z").to_pylist(), strict=True):
            words = None if len(p) else R.text(z).split()
            n.append(None if words is None else len(words))
            sha.append(None if words is None else hashlib.sha256(b" ".join(words)).hexdigest())
        made = {
            "_near": pa.array([p.astype("<u4").tobytes() if len(p) else None for p in at], pa.binary()),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array([None if x is None else 0 for x in n], pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()),
        }
        if not keep:
            z = pa.array([z if len(p) else None for z, p in zip(left.column("_z").to_pylist(), at, strict=True)], pa.binary())
            left = left.set_column(3, "_z", z)
        for name, column in made.items():
            left = left.append_column(name, column)
        return left

    @K.lean
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for z, (p, _) in zip(left.column("_z").to_pylist(), R.places_of(left, right), strict=True):
            text = R.text(z)
            starts, _, _ = K.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            gone = K.covered(p, window, len(starts))
            kept = _kept(text, starts, gone) if len(p) else text
            out.append((len(starts), int(gone.sum()), hashlib.sha256(b" ".join(kept.split())).hexdigest(), kept if keep else None))
        n, removed, sha, kept = zip(*out, strict=True) if out else ((),) * 4
        made = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        done = left.select(["_doc", *rest]).append_column("_kept", pa.array([None if z is None else k for z, k in zip(left.column("_z").to_pylist(), kept, strict=True)], pa.binary()))
        for name, column in made.items():
            done = done.append_column(name, column)
        return done

    joined = packed.groupBy("_part").cogroup(near.groupBy("doc_part")).applyInArrow(split, "_part long, _doc long, _copy long, _z binary" + more + ", _near binary" + results)
    joined = stored(joined)
    open_ = joined.where("_near IS NOT NULL")
    again = open_.select("_doc", "_copy", "_z", "_near").mapInArrow(_windows(window, parts), R.ENTRY)
    gone = R.settled(again, _later, np.uint64, np.uint64, doc_parts)
    finished = open_.select("_part", "_doc", "_copy", "_z", *rest).groupBy("_part").cogroup(gone.groupBy("doc_part")).applyInArrow(finish, "_doc long" + more + ", _kept binary" + results)

    @K.lean
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = batch.column(1)
            kept = pa.array([None if r is None else t for r, t in zip(z.to_pylist(), R.texts(z), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:-3], kept, *batch.columns[-3:]], ["_doc", *rest, "_kept", "n_words", "n_removed", "kept_sha256"])

    done = joined.where("_near IS NULL").select("_doc", "_z", *rest, "n_words", "n_removed", "kept_sha256").mapInArrow(plain, "_doc long" + more + ", _kept binary" + results)
    both = done.unionByName(finished)
    made = ["n_words", "n_removed", "kept_sha256"]
    if keep:
        columns = [F.decode("_kept", "utf-8").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
        return both.select(*columns, F.struct(*made).alias(report))
    return both.select(F.when(F.col("_doc") != R.NULL_ID, F.col("_doc")).alias("doc_id"), *made)
