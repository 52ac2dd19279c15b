"""Removing byte strings that occur twice, by difference-cover sampling of suffixes.

A difference cover D of a period v holds, for every distance, two members that far apart modulo v.
So whatever two places i and j, some shift below v takes both to sampled places (those whose
position modulo v is in D).  If the strings of ``length`` bytes at i and j are equal, the two
sampled suffixes agree in ``length - v + 1`` bytes.  The operator therefore

1. samples suffixes by a perfect difference cover, names each by its first ``length - v + 1``
   bytes, and sorts the names over the cluster: a name that occurs once rules out all it covers;
2. takes the remaining suffixes - those that start within v bytes before a repeated sample - and
   merges them: each goes with the least 32-byte string in its window, so that equal windows meet
   in one part; runs of windows with one such string travel as one piece of text;
3. sorts each part's suffixes by the names of their first ``length`` bytes and compares neighbours.

Nothing is sorted beyond ``length`` bytes, as longer prefixes don't matter here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .storage import checkpointed, stored

U64 = np.uint64
GRAM = 32  # bytes of the strings that lead windows together
#: Windows that one task sorts at once.
PART_WINDOWS = 2_000_000


def difference_cover(prime: int) -> tuple[int, np.ndarray]:
    """Singer's perfect cover: period p*p + p + 1 and p + 1 members, each distance exactly once.

    Searched as the exponents of a primitive element of GF(p**3) that fall in a plane."""
    v = prime * prime + prime + 1
    for c in range(prime**3):
        a0, a1, a2 = c % prime, c // prime % prime, c // prime**2
        x, members = (1, 0, 0), []
        for e in range(v):
            if x[2] == 0:
                members.append(e)
            top = x[2]  # times the root of t**3 = a2 t**2 + a1 t + a0
            x = (top * a0 % prime, (x[0] + top * a1) % prime, (x[1] + top * a2) % prime)
        d = np.array(members)
        if len(d) == prime + 1 and len(np.unique((d[:, None] - d[None, :]) % v)) == v:
            return v, d
    raise ValueError(f"no cover for {prime}")


def cover_for(length: int) -> tuple[int, np.ndarray]:
    """The largest cover that leaves a third of length to name samples by."""
    fitting = [p for p in (2, 3, 5, 7, 11, 13, 17, 19, 23) if 3 * (p * p + p + 1) <= 2 * length + 2]
    if not fitting:
        raise ValueError("length must be 10 or more")
    return difference_cover(fitting[-1])


def _twice(start: np.ndarray, size: np.ndarray, doc: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Key groups of two places at least, or of which a task already knew that."""
    return np.repeat((size > 1) | (np.maximum.reduceat(flag, start) > 0), size) if len(start) else np.zeros(0, bool)


def _samples(length: int, parts: int):
    v, members = cover_for(length)
    before = np.searchsorted(members, np.arange(v))  # members below each place of a period
    width = length - v + 1

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.portions(batches, R.text_sizes):
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = K.text_buffers(batch.column(2))
            found = []
            for a, b in K.slices(offsets):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                size = np.diff(local)
                n = np.where(size >= length, size - width + 1, 0)
                n = n // v * len(members) + before[n % v]
                turn, member = np.divmod(K.ranges(np.zeros(b - a, np.int64), n), len(members))
                pos, row = turn * v + members[member], np.repeat(np.arange(b - a), n)
                at = local[row] + pos
                found.append((K.range_hashes(K.byte_codes(part), at, at + width), a + row, pos))
            key, row, pos = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.argsort(key, kind="stable")
            key, row, pos = key[order], row[order], pos[order]
            doc, copy = ids[row], copies[row]
            start, size = R.groups(key)
            shared = _twice(start, size, doc, np.zeros(len(doc), np.uint8))
            out = R.Entries()
            out.settle(parts, doc[shared], copy[shared], pos[shared])
            send = ~shared
            send[start] = True
            out.add(parts, 0, (key[send] % U64(parts)).astype(np.int64), (key[send] >> U64(32)).astype(np.uint32), doc[send], copy[send], pos[send], np.ones(send.sum()), shared[send].astype(np.uint8))
            yield out.batch()

    return run


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every width neighbours, by doubling."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _pieces(length: int, parts: int):
    """(_doc, _copy, _z, _near) to entries: runs of candidate windows with one least string, as text."""
    v, _ = cover_for(length)

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in R.portions(batches, R.packed_sizes):
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, near = R.texts(batch.column(2)), batch.column(3).to_pylist()
            offsets = np.cumsum([0, *map(len, raw)])
            whole = b"".join(raw)
            found = []
            for a, b in K.slices(offsets):
                data = np.frombuffer(whole, np.uint8)[offsets[a] : offsets[b]]
                local = offsets[a : b + 1] - offsets[a]
                places = [np.frombuffer(near[k], "<u4").astype(np.int64) for k in range(a, b)]
                row = np.repeat(np.arange(b - a), list(map(len, places)))
                s = np.concatenate(places)
                low = local[row] + np.maximum(s - v + 1, 0)
                high = local[row] + np.minimum(s, np.diff(local)[row] - length) + 1
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, low, 1)
                np.add.at(step, high, -1)
                candidate = np.cumsum(step[:-1]) > 0
                if not candidate.any():
                    continue
                gram = K.sifting_windows(K.byte_codes(data, 1), GRAM, 1)
                lead = sliding_least(gram, length - GRAM + 1)
                at = np.flatnonzero(candidate[: len(lead)])
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (lead[at[1:]] != lead[at[:-1]])
                new[1:] |= np.searchsorted(local, at[1:], "right") != np.searchsorted(local, at[:-1], "right")
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(at)))
                start = at[begin]
                row = np.searchsorted(local, start, "right") - 1
                found.append((lead[start], a + row, start - local[row], count, offsets[a] + start))
            empty = [np.zeros(0, U64)] + [np.zeros(0, np.int64)] * 4
            lead, row, pos, count, place = (np.concatenate(x) for x in zip(*found, strict=True)) if found else empty
            seen = memoryview(whole)
            names = b"".join(xxhash.xxh3_128_digest(seen[p : p + n + length - 1]) for p, n in zip(place.tolist(), count.tolist(), strict=True))
            name, other = np.frombuffer(names, U64).reshape(-1, 2).T
            order = np.lexsort((other, name))
            lead, name, other, row, pos, count, place = (x[order] for x in (lead, name, other, row, pos, count, place))
            doc, copy = ids[row], copies[row]
            start, size = R.groups(name, other)
            same = _twice(start, size, doc, np.zeros(len(doc), np.uint8))  # equal pieces: all of their windows repeat
            out = R.Entries()
            out.settle(parts, doc[same], copy[same], pos[same], count[same])
            send = ~same
            send[start] = True
            text = [whole[p : p + n + length - 1] for p, n in zip(place[send].tolist(), count[send].tolist(), strict=True)]
            out.add(parts, 0, (lead[send] % U64(parts)).astype(np.int64), np.zeros(send.sum(), np.uint8), doc[send], copy[send], pos[send], count[send], lambda o: press.compress(b"".join(text[i] for i in o.tolist())))
            yield out.batch()

    return run


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Which of the pairs of places have the same length bytes.

    A pair right behind one that is equal needs a look at its last bytes only."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    behind = np.zeros(len(a), bool)
    behind[1:] = (a[1:] == a[:-1] + 1) & (b[1:] == b[:-1] + 1)
    good = data[a + length - 1] == data[b + length - 1]

    def whole(at: np.ndarray) -> None:
        for x in range(0, len(at), 10_000):
            i = at[x : x + 10_000]
            step = np.arange(length)
            good[i] = (data[a[i, None] + step] == data[b[i, None] + step]).all(axis=1)

    whole(np.flatnonzero(~behind))
    chain = np.cumsum(~behind) - 1
    first = np.full(len(a) and int(chain[-1]) + 1, len(a))
    bad = np.flatnonzero(~good)
    np.minimum.at(first, chain[bad], bad)
    whole(np.flatnonzero(np.arange(len(a)) > first[chain]))  # behind an unequal pair
    out = np.zeros(len(a), bool)
    out[order] = good
    return out


def _compare(length: int, doc_parts: int):
    """Sorts one part's windows by name, compares neighbours byte by byte, and gives the runs that repeat."""

    @K.lean
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        done = R.places(table.filter(pa.array(kind == 1)))
        open_ = table.filter(pa.array(kind == 0))
        doc, copy, pos, count = R.places(open_)
        data, n, at = _opened(open_.column("extra").to_pylist(), count, length)
        name = K.byte_windows(data, length)[at]
        order = np.argsort(name, kind="stable")
        alike = np.flatnonzero(name[order][1:] == name[order][:-1])
        alike = alike[same_bytes(data, at[order[alike]], at[order[alike + 1]], length)]
        twice = np.zeros(len(at), bool)
        twice[order[alike]] = twice[order[alike + 1]] = True
        del name, order
        starts, ends = K.runs(twice)
        edges = np.cumsum(n)  # a run over several pieces is cut where they meet
        cuts = np.unique(np.concatenate([starts, edges[:-1][twice[edges[:-1]]]])) if len(n) else starts
        stop = np.minimum(ends[np.searchsorted(ends, cuts, "right")], edges[np.searchsorted(edges, cuts, "right")]) if len(cuts) else cuts
        piece = np.searchsorted(edges, cuts, "right")
        offset = cuts - (edges - n)[piece] if len(cuts) else cuts
        found = (doc[piece], copy[piece], (pos[piece] + offset).astype(np.uint32), (stop - cuts).astype(np.uint32))
        return R.place_rows(*(np.concatenate([a, b]) for a, b in zip(done, found, strict=True)), doc_parts)

    return run


def _opened(texts: list[bytes], count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the pieces in compressed texts, their numbers of windows, and the windows' places in the bytes."""
    unpress = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"".join(map(unpress.decompress, texts)), np.uint8)
    n = count.astype(np.int64)
    return data, n, K.ranges(np.cumsum(n + length - 1) - (n + length - 1), n)


def _single(length: int, parts: int):
    """Pieces of large parts to entries of their windows, each going by a name of 124 bits."""

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                doc, copy, pos, count = R.places(row)
                data, n, at = _opened(row.column("extra").to_pylist(), count, length)
                piece = np.repeat(np.arange(len(n)), n)
                doc, copy, pos = doc[piece], copy[piece], (pos[piece] + K.ranges(np.zeros(len(n), np.int64), n)).astype(np.uint32)
                name, other = (K.byte_windows(data, length, lane)[at] for lane in (0, 1))
                order = np.lexsort((other, name))
                doc, copy, pos, name, other = (x[order] for x in (doc, copy, pos, name, other))
                start, size = R.groups(name, other)
                out = R.Entries()
                same = np.repeat(size > 1, size)
                out.settle(parts, doc[same], copy[same], pos[same])
                out.add(parts, 0, (other[start] % U64(parts)).astype(np.int64), name[start], doc[start], copy[start], pos[start], np.ones(len(start)), other[start])
                yield out.batch()

    return run


def _met(start: np.ndarray, size: np.ndarray, doc: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.repeat(size > 1, size)


def _repeating(pieces: DataFrame, length: int, doc_parts: int) -> DataFrame:
    """Places of the windows of pieces that occur twice.

    A part of more than PART_WINDOWS windows, as one common string may lead that many, is not sorted in one place: its
    windows go on one by one, by their own names, equal ones of a task as one."""
    pieces = stored(pieces)
    sizes = pieces.where("kind = 0").groupBy("part").agg(F.sum("size").alias("windows")).where(F.col("windows") > PART_WINDOWS)
    large, windows = sizes.agg(F.count("*"), F.coalesce(F.sum("windows"), F.lit(0))).first()
    if not large:
        return pieces.groupBy("part").applyInArrow(_compare(length, doc_parts), R.PLACE)
    sizes = checkpointed(sizes.select("part"))
    few = pieces.where("kind = 1").unionByName(pieces.where("kind = 0").join(sizes, "part", "left_anti"))
    many = pieces.where("kind = 0").join(sizes, "part", "left_semi").select(pieces.columns)
    single = many.mapInArrow(_single(length, R.parts_for(windows, 1_000_000)), R.ENTRY)
    return few.groupBy("part").applyInArrow(_compare(length, doc_parts), R.PLACE).unionByName(R.settled(single, _met, U64, U64, doc_parts))


def repeated_bytes(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans (start, end), kept_sha256.

    The spans are the maximal runs of bytes that some string of length bytes covers which also starts
    anywhere else, in the same document or another; strings don't cross documents and are judged on
    the input.  Null text is empty; repeated rows repeat each other's strings and come back repeated;
    an empty table gives an empty result; other columns are ignored."""
    rows, size = R.numbered(docs, id_col, text_col)
    rows = _repeated_rows(rows.select("_doc", "_copy", "_text"))
    parts, doc_parts = R.parts_for(size, 10_000_000), R.parts_for(size, R.TEXT_PART)
    near = R.settled(rows.mapInArrow(_samples(length, parts), R.ENTRY), _twice, np.uint32, np.uint8, doc_parts)
    results = ", n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def table(doc: pa.ChunkedArray, made: list[tuple], more: dict[str, pa.Array]) -> pa.Table:
        n, spans, sha = zip(*made, strict=True) if made else ((),) * 3
        return pa.table({"_doc": doc, **more, "n_bytes": pa.array(n, pa.int64()), "spans": pa.array(spans, span_type), "kept_sha256": pa.array(sha, pa.string())})

    @K.lean
    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        """Rows without a repeated sample are done; the others keep their text and its places."""
        at = [p for p, _ in R.places_of(left, right)]
        made = [(None, None, None) if len(p) else (len(t := R.text(z)), [], hashlib.sha256(t).hexdigest()) for p, z in zip(at, left.column("_z").to_pylist(), strict=True)]
        z = pa.array([z if len(p) else None for z, p in zip(left.column("_z").to_pylist(), at, strict=True)], pa.binary())
        near = pa.array([p.astype("<u4").tobytes() if len(p) else None for p in at], pa.binary())
        return table(left.column("_doc"), made, {"_part": left.column("_part"), "_copy": left.column("_copy"), "_z": z, "_near": near}).select(["_part", "_doc", "_copy", "_z", "_near", "n_bytes", "spans", "kept_sha256"])

    @K.lean
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for z, (p, n) in zip(left.column("_z").to_pylist(), R.places_of(left, right), strict=True):
            text = R.text(z)
            step = np.zeros(len(text) + 1, np.int64)
            np.add.at(step, p, 1)
            np.add.at(step, p + n - 1 + length, -1)
            gone = np.cumsum(step[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            made.append((len(text), [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in K.runs(gone)), strict=True)], hashlib.sha256(kept).hexdigest()))
        return table(left.column("_doc"), made, {})

    packed = R.squeezed(rows, doc_parts)
    joined = packed.groupBy("_part").cogroup(near.groupBy("doc_part")).applyInArrow(split, "_part long, _doc long, _copy long, _z binary, _near binary" + results)
    joined = stored(joined)
    open_ = joined.where("_near IS NOT NULL")
    pieces_parts = R.parts_for(size, 2_000_000)
    again = open_.select("_doc", "_copy", "_z", "_near").mapInArrow(_pieces(length, pieces_parts), R.ENTRY)
    gone = _repeating(again, length, doc_parts)
    finished = open_.select("_part", "_doc", "_copy", "_z").groupBy("_part").cogroup(gone.groupBy("doc_part")).applyInArrow(finish, "_doc long" + results)
    both = joined.where("_near IS NULL").select("_doc", "n_bytes", "spans", "kept_sha256").unionByName(finished)
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("long"))
    return both.select(F.when(F.col("_doc") != R.NULL_ID, F.col("_doc")).alias("doc_id"), "n_bytes", removed.alias("n_removed"), "spans", "kept_sha256")


def _repeated_rows(rows: DataFrame) -> DataFrame:
    """Rows that agree in id and text get copy numbers of their own, as each is a place of its own.

    The numbers hold for the table that is written with them, as the rows are read more than once."""
    if rows.groupBy("_doc", "_copy").count().where("count > 1").limit(1).count():
        rows = stored(rows.withColumn("_copy", F.monotonically_increasing_id()))
    return rows
