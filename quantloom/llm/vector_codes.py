"""Compression of vectors to one short code a part, with codebooks that are fitted exactly.

A vector of integers is cut into consecutive parts; each part is coded by the nearest entry of its position's
codebook.  Nearest means the least squared distance in integers, the lower index among equals.  Most entries are ruled
out by one float32 matrix product a part: with unit roundoff u = 2**-24, an entry c and a part x of width d,
``|c|**2 - 2 x.c`` comes out within ``g (|c|**2 + 2 |x| |c|)`` of its true value, g = k u / (1 - k u) with k = d + 8: d
products and sums in any order, two conversions, the conversion of |c|**2 and the last subtraction make d + 3
roundings, the rest is for the radius itself, which is computed in float64.  Entries whose interval overlaps the best
one's are computed again in int64, which decides.

Codebooks are small - ``entries`` times the width of a vector - and are all that the driver and broadcasts hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import looked_up
from .kernels import lean
from .storage import checkpointed, stored

#: Parts compared at once.
BLOCK_ROWS = 8192
UNIT = 2.0**-24


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest of entries for each row of x (int64), and how many pairs int64 decided."""
    index, distance, decided = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    if not x.shape[1]:
        return index, distance, decided
    k = x.shape[1] + 8
    gamma = k * UNIT / (1 - k * UNIT)
    square = (entries * entries).sum(axis=1)
    size, low = np.sqrt(square.astype(float)), entries.astype(np.float32).T
    for a in range(0, len(x), BLOCK_ROWS):
        part = x[a : a + BLOCK_ROWS]
        about = (square.astype(np.float32) - 2 * (part.astype(np.float32) @ low)).astype(float)
        radius = gamma * (2 * np.sqrt((part.astype(float) ** 2).sum(axis=1))[:, None] * size + size * size)
        row, entry = np.nonzero(about - radius <= (about + radius).min(axis=1)[:, None])
        exact = ((part[row] - entries[entry]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(exact, np.searchsorted(row, np.arange(len(part))))
        tied = np.flatnonzero(exact == least[row])
        _, first = np.unique(row[tied], return_index=True)  # entries ascend within a row
        index[a : a + len(part)], distance[a : a + len(part)] = entry[tied[first]], least
        decided += len(row)
    return index, distance, decided


def edges(dim: int, parts: int) -> np.ndarray:
    """Borders of the parts of a vector: equal ones, or widths that differ by one where dim isn't a multiple."""
    return np.append(0, np.cumsum([dim // parts + (p < dim % parts) for p in range(parts)]))


@dataclass(frozen=True)
class Codebooks:
    """books: for each length of vectors an array of entries by components; the columns of a part are its codebook."""

    parts: int
    scale: float
    books: dict[int, np.ndarray]

    def digest(self, dim: int) -> str:
        """SHA-256 of all components, in decimals with commas, by part, entry and place."""
        book, cut = self.books[dim], edges(dim, self.parts)
        numbers = [str(n) for a, b in zip(cut[:-1], cut[1:], strict=True) for n in book[:, a:b].ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def decode(self, dim: int, code: bytes) -> np.ndarray:
        """The vector that a code stands for."""
        cut, book = edges(dim, self.parts), self.books[dim]
        return np.concatenate([book[e, a:b] for e, a, b in zip(code, cut[:-1], cut[1:], strict=True)])

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries by part, and distances summed over parts, of vectors of one length."""
        cut, book = edges(x.shape[1], self.parts), self.books[x.shape[1]]
        found = [nearest(np.ascontiguousarray(x[:, a:b]), np.ascontiguousarray(book[:, a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return np.stack([i for i, *_ in found], axis=1), np.sum([d for _, d, _ in found], axis=0, dtype=np.int64)


def integers(column: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x) of their vectors) for each length; rows whose vector is null or holds null or non-finite components are in none."""
    column = column.cast(pa.list_(pa.float64()))
    have = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.flatten()
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)[have].astype(np.int64)
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    starts = np.append(0, np.cumsum(size))
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    good = bad[starts[1:]] == bad[starts[:-1]]
    for dim in np.unique(size[good]).tolist():
        of = np.flatnonzero(good & (size == dim))
        made = np.floor(x[starts[of][:, None] + np.arange(dim)] * scale)
        if dim * (2 * np.abs(made).max(initial=0)) ** 2 >= 2.0**63:
            raise OverflowError("squared distances of these vectors don't fit a long: scale them down")
        yield have[of], made.astype(np.int64)


def _smallest(ids: pa.Array, x: np.ndarray, n: int) -> np.ndarray:
    """The rows of the n smallest ids, a null one being the largest, equal ones by their vectors."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    return np.lexsort((*x.T[::-1], key, null))[:n]


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> Codebooks:
    """Codebooks of all vectors: they start as the parts of the vectors of the smallest ids; each round assigns all parts
    and moves every entry to floor(sum / count) of its own; entries without parts stay.

    A task adds up its parts before anything is shuffled, so a round moves ``entries`` x (components + parts) numbers a task.
    Vectors of different lengths have codebooks of their own, one job each for their start: lengths should be few.  Fewer
    vectors than entries make fewer entries; no vectors, none."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    @lean
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(1), scale):
                ids = batch.column(0).take(pa.array(rows))
                pick = _smallest(ids, x, entries)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), x.shape[1])), ids.take(pa.array(pick)), pa.array(x[pick].tolist(), pa.list_(pa.int64()))], ["dim", "id", "x"])

    first = checkpointed(source.mapInArrow(heads, "dim long, id long, x array<long>"))
    lengths = [r.dim for r in first.select("dim").distinct().collect()]
    start = {d: first.where(F.col("dim") == d).orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect() for d in lengths}
    books = Codebooks(parts, scale, {d: np.array([r.x for r in rows], np.int64).reshape(len(rows), d) for d, rows in start.items()})
    for _ in range(rounds):
        books = _moved(source, books)
    return books


def _moved(source: DataFrame, books: Codebooks) -> Codebooks:
    """books after one round over (id, v)."""
    shared = source.sparkSession.sparkContext.broadcast(books)

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        sums = {d: np.zeros(b.shape, np.int64) for d, b in now.books.items()}
        counts = {d: np.zeros((len(b), now.parts), np.int64) for d, b in now.books.items()}
        for batch in batches:
            for _, x in integers(batch.column(1), now.scale):
                dim, cut = x.shape[1], edges(x.shape[1], now.parts)
                index, _ = now.assign(x)
                for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    np.add.at(sums[dim][:, a:b], index[:, p], x[:, a:b])
                    counts[dim][:, p] += np.bincount(index[:, p], minlength=len(now.books[dim]))
        for kind, made in enumerate((sums, counts)):
            for dim, table in made.items():
                cell = np.flatnonzero(table)
                columns = [np.full(len(cell), dim), np.full(len(cell), kind), cell, table.ravel()[cell]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "kind", "cell", "n"])

    totals = source.mapInArrow(add, "dim long, kind long, cell long, n long").groupBy("dim", "kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    moved = {}
    dims, kinds, cells, n = (totals.column(c).to_numpy() for c in totals.column_names)
    for dim, book in books.books.items():
        sums, counts = np.zeros(book.shape, np.int64), np.zeros((len(book), books.parts), np.int64)
        for kind, table in enumerate((sums, counts)):
            mine = (dims == dim) & (kinds == kind)
            table.ravel()[cells[mine]] = n[mine]
        each = np.repeat(counts, np.diff(edges(dim, books.parts)), axis=1)
        moved[dim] = np.where(each > 0, sums // np.maximum(each, 1), book)
    return Codebooks(books.parts, books.scale, moved)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, dim, code, error) of each usable vector whose length has codebooks; code: one byte a part."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    label = source.schema["label"].dataType
    shared = source.sparkSession.sparkContext.broadcast(books)
    names = ["vec_id", "label", "dim", "code", "error"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(1), shared.value.scale):
                if x.shape[1] in shared.value.books:
                    index, error = shared.value.assign(x)
                    ids, labels = (batch.column(c).take(pa.array(rows)) for c in (0, 2))
                    code = [r.tobytes() for r in index.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([ids, labels, pa.array(np.full(len(rows), x.shape[1])), pa.array(code, pa.binary()), pa.array(error)], names)

    return source.mapInArrow(run, f"vec_id long, label {label.simpleString()}, dim long, code binary, error long")


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, dim, code, error, label_error) for each usable vector, and the codebooks that they are coded by.

    label_error: the errors of all vectors of an equal label, nulls together.  Vectors that are null or hold null or
    non-finite components are left out.  A null id counts as the largest and stays null; repeated rows and ids each count;
    vectors of different lengths are coded apart, empty ones by zeros; lengths that aren't a multiple of ``parts`` have
    parts that differ by one; an empty table gives an empty result; other columns are ignored, whatever their names.
    Raises OverflowError in the task where squared distances don't fit a long."""
    books = fit(vectors, parts, entries, rounds, scale, id_col, vector_col)
    coded = stored(encode(vectors, books, id_col, vector_col, label_col))
    key = F.struct("label").alias("_key")  # structs of nulls are equal
    sums = coded.groupBy(key).agg(F.sum("error").alias("label_error"))
    return looked_up(coded.withColumn("_key", key), sums, "_key", "label_error").drop("_key"), books
