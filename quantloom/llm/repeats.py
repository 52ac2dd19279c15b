"""What the two substring operators share: moving (key, document, place) entries in packed arrays.

A task deals its entries into parts of the key space; one row holds the entries of one Arrow batch
for one part, as byte-transposed arrays, which compress well.  Keys that repeat within a batch are
settled there, so a passage that many documents hold sends one entry a batch, not one an occurrence.
What a part has settled goes to the part of its documents, where it meets their texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import U64, lean, mix

ENTRY = "part long, kind int, key binary, doc binary, copy binary, pos binary, len binary, extra binary, size long"
PLACE = "doc_part long, doc binary, copy binary, pos binary, len binary"
#: Bytes of text of which one part of the documents holds about so many.
TEXT_PART = 8_000_000
NULL_ID = 2**63 - 1


def pack(a: np.ndarray) -> bytes:
    """The bytes of a, byte by byte of its elements: all lowest bytes first."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(blobs: list[bytes], kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel() for b in blobs if b]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


#: Bytes of text whose entries a task holds at once; a single longer text is taken whole.
PORTION = 5_000_000


def portions(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, gathered or cut into pieces of about PORTION bytes of text."""
    held, size = [], 0

    def gathered() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        ends = np.cumsum(sizes(batch))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            last = max(at + 1, int(np.searchsorted(ends, done + PORTION - size, "right")))
            held.append(batch.slice(at, last - at))
            size += int(ends[last - 1] - done)
            at = last
            if size >= PORTION or at < batch.num_rows:
                yield gathered()
                held, size = [], 0
    if held:
        yield gathered()


def text_sizes(batch: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def packed_sizes(batch: pa.RecordBatch) -> np.ndarray:
    return 3 * text_sizes(batch)


def home(doc: np.ndarray, copy: np.ndarray, parts: int) -> np.ndarray:
    """The part of a row, by its id and copy, so that rows of one id are dealt out."""
    return (mix(doc.view(U64) ^ mix(copy.astype(np.int64).view(U64))) % U64(parts)).astype(np.int64)


class Entries:
    """Collects entry rows of one batch; size: the places that a row's entries stand for."""

    names = ("part", "kind", "key", "doc", "copy", "pos", "len", "extra", "size")
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 6, pa.int64())

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, parts: int, kind: int, part: np.ndarray, key: np.ndarray, doc: np.ndarray, copy: np.ndarray, pos: np.ndarray, length: np.ndarray, extra: Callable[[np.ndarray], bytes] | np.ndarray) -> None:
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            o = order[cut[p] : cut[p + 1]]
            more = extra(o) if callable(extra) else pack(extra[o])
            self.rows.append((p, kind, pack(key[o]), pack(doc[o]), pack(copy[o].astype(np.int64)), pack(pos[o].astype(np.uint32)), pack(length[o].astype(np.uint32)), more, int(length[o].sum())))

    def settle(self, parts: int, doc: np.ndarray, copy: np.ndarray, pos: np.ndarray, length: np.ndarray | None = None) -> None:
        """Places that need no more meeting; they travel through the part of their document."""
        length = np.ones(len(doc), np.uint32) if length is None else length
        self.add(parts, 1, home(doc, copy, parts), np.zeros(len(doc), np.uint8), doc, copy, pos, length, np.zeros(len(doc), np.uint8))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, self.kinds, strict=True)], list(self.names))


def place_rows(doc: np.ndarray, copy: np.ndarray, pos: np.ndarray, length: np.ndarray, doc_parts: int) -> pa.Table:
    part = home(doc, copy, doc_parts)
    order = np.lexsort((pos, copy, doc, part))
    cut = np.searchsorted(part[order], np.arange(doc_parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(cut)).tolist():
        o = order[cut[p] : cut[p + 1]]
        rows.append((p, pack(doc[o]), pack(copy[o]), pack(pos[o]), pack(length[o])))
    kinds = (pa.int64(), *[pa.binary()] * 4)
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_part", "doc", "copy", "pos", "len"])


def places(blobs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name, kind: unpack(blobs.column(name).to_pylist(), kind)
    return get("doc", np.int64), get("copy", np.int64), get("pos", np.uint32), get("len", np.uint32)


def settled(entries: DataFrame, rule: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], key_kind: type, extra_kind: type, doc_parts: int) -> DataFrame:
    """Places of the entries of which rule(starts of the key groups, group sizes, doc, extra) is true; all in key order.

    extra is a flag of one byte, or the second half of the key."""

    @lean
    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        done = places(table.filter(pa.array(kind == 1)))
        open_ = table.filter(pa.array(kind == 0))
        key, extra = unpack(open_.column("key").to_pylist(), key_kind), unpack(open_.column("extra").to_pylist(), extra_kind)
        both = extra_kind is not np.uint8
        order = np.lexsort((extra, key)) if both else np.argsort(key, kind="stable")
        doc, copy, pos, length = (x[order] for x in places(open_))
        hit = rule(*groups(key[order], extra[order] if both else None), doc, extra[order])
        return place_rows(*(np.concatenate([a, b[hit]]) for a, b in zip(done, (doc, copy, pos, length), strict=True)), doc_parts)

    return entries.groupBy("part").applyInArrow(run, PLACE)


def groups(key: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys, or of equal pairs of key and other."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = key[1:] != key[:-1]
    start = np.flatnonzero(np.concatenate(([True], new if other is None else new | (other[1:] != other[:-1]))))
    return start, np.diff(np.append(start, len(key)))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(_doc, _copy, _text, _row) of docs, and the bytes of all texts.

    _doc: the id, a null one as the largest number.  _copy tells different texts of one id apart: 0, or a hash of
    the text where some id has several.  _row: all columns as one struct, so that their names don't matter."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID))
    out = docs.select(ident.alias("_doc"), F.lit(0).cast("long").alias("_copy"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.coalesce("_text", F.lit(""))
    ids = out.select("_doc", F.xxhash64(text).alias("h"), F.octet_length(text).alias("n")).groupBy("_doc").agg(F.sum("n").alias("n"), (F.min("h") != F.max("h")).alias("differ"))
    size, differ = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("differ"), F.lit(False))).first()
    if differ:
        out = out.withColumn("_copy", F.xxhash64(text))
    return out, size


def squeezed(rows: DataFrame, doc_parts: int, *more: str) -> DataFrame:
    """(_part, _doc, _copy, _z, more columns) of rows (_doc, _copy, _text): texts compressed for the shuffle."""
    schema = "_part long, _doc long, _copy long, _z binary" + "".join(f", {c} {dict(rows.dtypes)[c]}" for c in more)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            part = home(batch.column(0).to_numpy(), batch.column(1).to_numpy(), doc_parts)
            z = pa.array([None if t is None else press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0), batch.column(1), z, *batch.columns[3:]], ["_part", "_doc", "_copy", "_z", *more])

    return rows.select("_doc", "_copy", "_text", *more).mapInArrow(run, schema)


_unpress = zstandard.ZstdDecompressor()


def text(z: bytes | None) -> bytes:
    """A compressed text; a null one is empty."""
    return b"" if z is None else _unpress.decompress(z)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [text(z) for z in column.to_pylist()]


def places_of(docs: pa.Table, found: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and lengths found in each of the rows of docs (columns _doc, _copy)."""
    doc, copy, pos, length = places(found)
    order = np.lexsort((pos, copy, doc))
    doc, copy, pos, length = doc[order], copy[order], pos[order].astype(np.int64), length[order].astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])))) if len(doc) else np.zeros(0, np.int64)
    ranges = {(d, c): (a, b) for d, c, a, b in zip(doc[edge].tolist(), copy[edge].tolist(), edge.tolist(), np.append(edge, len(doc))[1:].tolist(), strict=True)}
    none = (0, 0)
    of = [ranges.get(k, none) for k in zip(docs.column("_doc").to_pylist(), docs.column("_copy").to_pylist(), strict=True)]
    return [(pos[a:b], length[a:b]) for a, b in of]


def parts_for(size: int, each: int) -> int:
    return max(24, math.ceil(size / each))
