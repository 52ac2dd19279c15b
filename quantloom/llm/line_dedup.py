"""Lines that many documents share, found by probing minimal perfect hashes.

A line's key is the line without blanks at its ends, in small letters; its name is a 128-bit hash.  All distinct names of
the corpus are dealt into shards of about ``SHARD_LINES``.  A shard is a minimal perfect hash - levels of bit arrays, in
each of which a name has one place and stays if no other name wants it - and two arrays by that hash: fingerprints
(the second half of the name) and counts of documents.

Documents probe the arrays; no line travels to be joined.  Shards of up to ``MAX_BROADCAST`` bytes in all are broadcast,
and the texts are then read where they lie.  Beyond that names stream past their shard, once for each part of the
documents, and only those of lines that must go come back.  A line of more than one in ``HOT_SHARE`` of all lines is
known to every task beforehand, so no shard is asked for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from .kernels import P1, U64, lean, mix, text_buffers
from .storage import stored

SHARD_LINES, MIN_SHARDS = 1_000_000, 48
MAX_BROADCAST = 32_000_000
HOT_SHARE = 1000
#: Bits that a level has for each name that is left.
ROOM = 2.0

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


# Minimal perfect hash


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    turn = U64(level * int(P1) % 2**64)
    return (mix(a ^ mix(b + turn)) % U64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """levels: the bits of each level; ranks: for each level how many names stay before each of its bytes, in all levels."""

    levels: list[tuple[int, np.ndarray]]
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, levels: list[tuple[int, np.ndarray]]) -> PerfectHash:
        ranks, before = [], 0
        for _, bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        return cls(levels, ranks)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """For distinct names (a, b)."""
        levels = []
        while len(a):
            size = 8 * max(1, math.ceil(ROOM * len(a) / 8))
            at = _place(a, b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append((size, np.packbits(alone, bitorder="little")))
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls.of(levels)

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each name, below their count; that of a name that wasn't built in is any of them, or -1."""
        out, open_ = np.full(len(a), -1), np.arange(len(a))
        for level, ((size, bits), ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _place(a[open_], b[open_], level, size)
            byte, bit = bits[at >> 3], at & 7
            here = (byte >> bit.astype(np.uint8)) & 1 == 1
            below = np.bitwise_count(byte & ((1 << bit) - 1).astype(np.uint8))
            out[open_[here]] = (ranks[at >> 3] + below)[here]
            open_ = open_[~here]
        return out

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.levels), *[s for s, _ in self.levels]], np.int64).tobytes(), *[bits.tobytes() for _, bits in self.levels]])

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8), 8 + 8 * n, []
        for size in sizes.tolist():
            levels.append((size, np.frombuffer(data, np.uint8, size // 8, at)))
            at += size // 8
        return cls.of(levels)


@dataclass
class Shard:
    hash: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray

    def documents(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many documents each line is - of counts beyond the threshold so many at least; none for unknown lines."""
        at = self.hash.index(a, b)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == b[known]
        out = np.zeros(len(a), np.int64)
        out[known] = self.counts[at[known]]
        return out


# Lines


class Lines:
    """The lines of some texts.  doc: a line's text; starts, ends: its place in data; a, b: its key's name, empty is (0, 0);
    chars: its key's code points.  A null text is one empty line."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        data, offsets = text_buffers(column)
        n = len(offsets) - 1
        breaks = np.flatnonzero(data == 0x0A)
        self.data, self.offsets = data, offsets
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
        self.doc = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offsets)) + 1)
        solid = np.flatnonzero(~_BLANK[data])
        first, last = np.searchsorted(solid, self.starts), np.searchsorted(solid, self.ends)
        full = np.flatnonzero(last > first)
        key_starts, key_ends = solid[first[full]], solid[last[full] - 1] + 1
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.chars = np.zeros(len(self.starts), np.int64)
        self.chars[full] = points[key_ends] - points[key_starts]
        lower, name = memoryview(_LOWER[data]), xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join([name(lower[x:y]) for x, y in zip(key_starts.tolist(), key_ends.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        self.a, self.b = np.zeros(len(self.starts), np.uint64), np.zeros(len(self.starts), np.uint64)
        self.a[full], self.b[full] = names[:, 0], names[:, 1]

    def names(self, least: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (a, b) of the lines of least code points or more, with the number of texts that have each; of: numbers of
        texts' parts, by which they are told apart too, and which come last."""
        long = np.flatnonzero(self.chars >= least)
        a, b, doc = self.a[long], self.b[long], self.doc[long]
        part = np.zeros(len(long), np.int64) if of is None else of[doc]
        order = np.lexsort((doc, b, a, part))
        a, b, doc, part = a[order], b[order], doc[order], part[order]
        if not len(a):
            return a, b, doc, part
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (part[1:] != part[:-1])))
        once = new | np.concatenate(([True], doc[1:] != doc[:-1]))
        start = np.flatnonzero(new)
        return a[start], b[start], np.add.reduceat(once.astype(np.int64), start), part[start]

    def without(self, gone: np.ndarray) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
        """The texts without lines, None where nothing goes; and their numbers of lines, before and dropped."""
        n = len(self.offsets) - 1
        lines, dropped = np.bincount(self.doc, minlength=n), np.bincount(self.doc[gone], minlength=n)
        first = np.append(0, np.cumsum(lines))
        texts: list[bytes | None] = [None] * n
        for d in np.flatnonzero(dropped).tolist():
            stay = first[d] + np.flatnonzero(~gone[first[d] : first[d + 1]])
            texts[d] = b"\n".join([self.data[x:y].tobytes() for x, y in zip(self.starts[stay].tolist(), self.ends[stay].tolist(), strict=True)])
        return texts, lines, dropped


def shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    return (mix(b ^ mix(a)) % U64(shards)).astype(np.int64)


def _dealt(docs: DataFrame, shards: int, least: int) -> DataFrame:
    """(shard, a, b, n) of the distinct names of each portion of texts; n: documents that have the line."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.portions(batches, lambda x: _sizes(x, 0)):
            a, b, n, _ = Lines(batch.column(0)).names(least)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard_of(a, b, shards), a.view(np.int64), b.view(np.int64), n)], ["shard", "a", "b", "n"])

    return docs.select("_text").mapInArrow(run, "shard long, a long, b long, n long")


def _sizes(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _arrays(names: DataFrame, min_docs: int, hot: int) -> DataFrame:
    """One row a shard: its hash, fingerprints and counts, and the names that more than hot documents have."""
    kind = np.uint8 if min_docs < 256 else np.uint32

    @lean
    def build(table: pa.Table) -> pa.Table:
        a, b, n = (table.column(c).to_numpy() for c in ("a", "b", "n"))
        a, b = a.view(np.uint64), b.view(np.uint64)
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        start, _ = R.groups(a, b)
        a, b, n = a[start], b[start], np.add.reduceat(n, start)
        made = PerfectHash.build(a, b)
        at = made.index(a, b)
        fingerprints, counts = np.zeros(len(a), np.uint64), np.zeros(len(a), kind)
        fingerprints[at], counts[at] = b, np.minimum(n, min_docs)
        many = np.stack([a[n > hot], b[n > hot]])
        row = [made.dump(), fingerprints.tobytes(), counts.tobytes(), many.tobytes()]
        return pa.table([table.column("shard")[:1], *[pa.array([x], pa.binary()) for x in row]], names=["shard", "hash", "fingerprints", "counts", "hot"])

    return names.groupBy("shard").applyInArrow(build, "shard long, hash binary, fingerprints binary, counts binary, hot binary")


def _shard(row: dict, min_docs: int) -> Shard:
    return Shard(PerfectHash.load(row["hash"]), np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.uint8 if min_docs < 256 else np.uint32))


def _report(left: pa.RecordBatch | pa.Table, original: pa.Array | pa.ChunkedArray, lines: Lines, gone: np.ndarray) -> list[pa.Array]:
    """The texts that stay, null where they were, and the two counts."""
    texts, n, dropped = lines.without(gone)
    kept = pc.if_else(pc.and_(pa.array(dropped > 0), original.is_valid()), pa.array(texts, pa.binary()), original.cast(pa.binary()))
    return [kept.cast(pa.string()) if not isinstance(kept, pa.ChunkedArray) else kept.combine_chunks().cast(pa.string()), pa.array(n), pa.array(dropped)]


_MADE = "_kept string, n_lines long, n_dropped long"


def _by_broadcast(rows: DataFrame, arrays: DataFrame, shards: int, min_docs: int, least: int) -> DataFrame:
    """(_row, kept, counts): every text probes shards that are broadcast."""
    loaded = {r["shard"]: _shard(r, min_docs) for r in arrays.drop("hot").toArrow().to_pylist()}
    shared = rows.sparkSession.sparkContext.broadcast(loaded)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.portions(batches, lambda x: _sizes(x, 0)):
            lines = Lines(batch.column(0))
            asked = np.flatnonzero(lines.chars >= least)
            a, b = lines.a[asked], lines.b[asked]
            gone, of = np.zeros(len(lines.a), bool), shard_of(a, b, shards)
            order = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.diff(of[order], prepend=-1)).tolist() + [len(of)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                mine = order[x:y]
                gone[asked[mine]] = shared.value[int(of[mine[0]])].documents(a[mine], b[mine]) >= min_docs
            yield pa.RecordBatch.from_arrays([batch.column(1), *_report(batch, batch.column(0), lines, gone)], ["_row", "_kept", "n_lines", "n_dropped"])

    return rows.select("_text", "_row").mapInArrow(run, f"_row {dict(rows.dtypes)['_row']}, {_MADE}")


def _by_stream(rows: DataFrame, arrays: DataFrame, shards: int, size: int, min_docs: int, least: int) -> DataFrame:
    """(_row, kept, counts): names stream past their shards, and what must go comes back to the part of the documents."""
    parts = R.parts_for(size, R.TEXT_PART)
    hot = np.concatenate([np.zeros((2, 0), np.uint64), *[np.frombuffer(r.hot, np.uint64).reshape(2, -1) for r in arrays.where(F.octet_length("hot") > 0).select("hot").collect()]], axis=1)  # HOT_SHARE at most
    known = set(zip(hot[0].tolist(), hot[1].tolist(), strict=True))

    @lean
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in R.portions(batches, R.text_sizes):
            lines = Lines(batch.column(2))
            a, b, _, part = lines.names(least, R.home(batch.column(0).to_numpy(), batch.column(1).to_numpy(), parts))
            rest = np.array([k not in known for k in zip(a.tolist(), b.tolist(), strict=True)], bool) if known else np.ones(len(a), bool)
            a, b, part = a[rest], b[rest], part[rest]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard_of(a, b, shards), a.view(np.int64), b.view(np.int64), part)], ["shard", "a", "b", "part"])

    @lean
    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        a, b = (asked.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
        held = held.to_pylist()
        often = _shard(held[0], min_docs).documents(a, b) >= min_docs if held else np.zeros(len(a), bool)
        return asked.select(["part", "a", "b"]).filter(pa.array(often))

    asked = rows.select("_doc", "_copy", "_text").mapInArrow(ask, "shard long, a long, b long, part long")
    answers = asked.groupBy("shard").cogroup(arrays.drop("hot").groupBy("shard")).applyInArrow(answer, "part long, a long, b long")
    packed = R.squeezed(rows, parts, "_row")

    @lean
    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        names = known | set(zip(*(right.column(c).to_numpy().view(np.uint64).tolist() for c in ("a", "b")), strict=True))
        made = []
        for batch in R.portions(left.to_batches(), lambda x: 3 * _sizes(x, 3)):
            text = pa.array([None if z is None else R.text(z) for z in batch.column(3).to_pylist()], pa.binary()).cast(pa.string())
            lines = Lines(text)
            gone = np.array([k in names for k in zip(lines.a.tolist(), lines.b.tolist(), strict=True)], bool) & (lines.chars >= least)
            made.append(pa.table([batch.column(4), *_report(batch, text, lines, gone)], names=["_row", "_kept", "n_lines", "n_dropped"]))
        return pa.concat_tables(made) if made else pa.table([pa.array([], f.type) for f in schema], names=schema.names)

    kind = f"_row {dict(rows.dtypes)['_row']}, {_MADE}"
    schema = pa.schema([("_row", pa.null()), ("_kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    return packed.groupBy("_part").cogroup(answers.groupBy("part")).applyInArrow(drop, kind)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", report: str = "lines") -> DataFrame:
    """The rows of docs, with text_col without the lines whose key has min_chars code points or more and is in min_docs
    documents or more, and a struct (n_lines, n_dropped) by the name of ``report``.

    Every row is a document, repeated ones too.  A null text is one empty line and stays null; empty and blank lines have an
    empty key, which goes only if min_chars is 0; a text of which all lines go is empty; a text of any length is read
    whole; null ids don't matter; other columns stay, whatever their names; an empty table gives an empty result."""
    if report.lower() in map(str.lower, docs.columns):
        raise ValueError(f"the columns already have a {report}: name the report otherwise")
    rows, size = R.numbered(docs, id_col, text_col)
    text = F.coalesce("_text", F.lit(""))
    n_lines = rows.agg(F.coalesce(F.sum(F.octet_length(text) - F.octet_length(F.translate(text, "\n", "")) + 1), F.lit(0))).first()[0]
    shards = max(MIN_SHARDS, math.ceil(n_lines / SHARD_LINES))
    arrays = stored(_arrays(_dealt(rows, shards, min_chars), min_docs, max(min_docs, n_lines // HOT_SHARE)))
    held = arrays.agg(F.coalesce(F.sum(F.octet_length("hash") + F.octet_length("fingerprints") + F.octet_length("counts")), F.lit(0))).first()[0]
    slim = rows.withColumn("_row", F.col("_row").withField(f"`{text_col}`", F.lit(None).cast("string")))  # the text travels once
    made = _by_broadcast(slim, arrays, shards, min_docs, min_chars) if held <= MAX_BROADCAST else _by_stream(slim, arrays, shards, size, min_docs, min_chars)
    columns = [F.col("_kept").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return made.select(*columns, F.struct("n_lines", "n_dropped").alias(report))
