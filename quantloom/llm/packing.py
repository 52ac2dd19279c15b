"""Best-two-fit packing of token sequences.

A bin is filled greedily with the longest documents that still fit.  If a gap remains, its smallest
document is replaced by two unpacked ones whose sum fits the gap plus that document more tightly;
the replaced document goes back to the unpacked ones.

Texts never meet: only (id, piece, length) rows are dealt into groups of about ``GROUP_PIECES``, each
packed by one task; a group wastes less than a sequence or two at its end.

Tokens come from the tokenizer's file.  Words repeat, so a task encodes each distinct part of the words of a
few megabytes once, if the file is of the kind for which that gives the same ids, and whole texts if not.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean, ranges, slices, text_buffers, words
from .repeats import portions
from .storage import checkpointed

GROUP_PIECES = 20_000
#: Bytes of text that are tokenized together, each of their distinct words once.
SLICE_BYTES = 4_000_000


#: The parts of a tokenizer file by which its ids of a text are those of its words in order -
#: white space goes, letters, digits and marks are told apart, and the last token of each part says so.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: Kinds of bytes: white space, letters, digits, marks, and what makes a word one that is encoded as it is.
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[ord("'")] = _OTHER  # "'s" and its like are parts of their own
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of all words of a slice: their bytes without gaps, their borders in them, whether they are
    plain, and for each document its first part.

    A plain word (ASCII and the letters of Latin-1, without apostrophes and "<|") is cut into runs of letters
    and of marks and single digits, in lower case; any other word is one part, as it is."""
    kind = _KIND[data]
    low = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # a letter of two bytes, but for the signs of times and division
    lead = lead[(data[lead + 1] & 0xDF) != 0x97]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] |= np.where(data[lead + 1] < 0x9F, 0x20, 0).astype(np.uint8)
    if len(data) > 1:
        kind[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = _OTHER
    starts, ends, _ = words(data, offsets)
    before = np.concatenate([[0], np.cumsum(kind == _OTHER)])
    plain = before[ends] == before[starts]
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[~plain]] += 1
    step[ends[~plain]] -= 1
    as_is = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    begins = np.zeros(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != _SPACE)
    begins |= kind == _DIGIT
    begins &= ~as_is
    begins[starts] = True
    at = np.flatnonzero(begins)
    inside = kind != _SPACE
    place = np.concatenate([[0], np.cumsum(inside)])
    borders = np.append(place[at], place[-1])
    return np.where(as_is, data, low)[inside], borders, ~as_is[at], np.searchsorted(at, offsets)


class Ids:
    """Token ids of many texts at once.

    Where the tokenizer's file allows it (see ``_SPLIT``), each distinct part of the words of a slice is encoded
    once, and all plain ones as one text; else texts are encoded as they are.  The ids are the same."""

    _open: dict[str, Ids] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        spec = json.loads(Path(path).read_text())
        vocabulary, suffix = spec["model"].get("vocab", {}), spec["model"].get("end_of_word_suffix")
        letters = {c for w in vocabulary for c in w.removesuffix(suffix or "")} if isinstance(vocabulary, dict) else set()
        self.by_words = (
            spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and not spec["post_processor"]
            and bool(suffix) and len(letters) >= 256 and all(c + suffix in vocabulary for c in pre_tokenizers.ByteLevel.alphabet())
            and all(t["special"] and not t["normalized"] and not (t["lstrip"] or t["rstrip"]) and t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        if self.by_words:
            bare = Tokenizer(Tokenizer.from_file(path).model)
            bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.encode_plain = bare.encode_batch_fast
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True

    @classmethod
    def at(cls, path: str) -> Ids:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's documents, one after another, and where each document's begin (n+1 long)."""
        if not self.by_words:
            raw = data.tobytes()
            ids = [np.array(e.ids, np.uint32) for e in self.encode([raw[a:b].decode() for a, b in pairwise(offsets.tolist())], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum([0, *map(len, ids)])
        text, borders, plain, first = word_parts(data, offsets)
        coded = pa.Array.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
        parts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        is_plain = np.zeros(len(parts), bool)
        is_plain[code] = plain
        count = np.zeros(len(parts), np.int64)
        flat = []
        easy, hard = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        if len(easy):
            ids = np.array(self.encode_plain([b" ".join([parts[i] for i in easy.tolist()]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            count[easy] = np.diff(ends, prepend=0)
            flat.append(ids)
        if len(hard):
            ids = [np.array(e.ids, np.uint32) for e in self.encode([parts[i].decode() for i in hard.tolist()], add_special_tokens=False)]
            count[hard] = list(map(len, ids))
            flat += ids
        order = np.concatenate([easy, hard])
        start = np.zeros(len(parts), np.int64)
        start[order] = np.cumsum(count[order]) - count[order]
        n = count[code]
        found = np.concatenate([np.zeros(0, np.uint32), *flat])[ranges(start[code], n)]
        return found, np.concatenate([[0], np.cumsum(n)])[first]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids_xxh64, ids]): each document's ids and the end id, cut at capacity.

    One row for each piece of each row of docs, as often as rows are repeated; null text counts as empty and is
    its end id alone, a null id stays null, a text of any length is tokenized whole, an empty table gives no
    rows, other columns are ignored.  ids: little-endian unsigned 32-bit numbers; ids_xxh64: their hash."""
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids_xxh64", pa.int64()), ("ids", pa.binary())] * with_ids

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Ids.at(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in portions(batches, lambda b: pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
            data, offsets = text_buffers(batch.column(1))
            rows = []
            for a, b in slices(offsets, SLICE_BYTES if tokenizer.by_words else SLICE_BYTES // 4):
                ids, first = tokenizer.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k, (x, y) in enumerate(pairwise(first.tolist()), a):
                    packed = np.concatenate([ids[x:y], end]).astype("<u4")
                    for piece, start in enumerate(range(0, len(packed), capacity)):
                        part = packed[start : start + capacity].tobytes()
                        row = (k, piece, start, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, xxhash.xxh64_intdigest(part) - 2**63, part) if with_ids else row)
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            made = [pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(made[0]), *made[1:]], [n for n, _ in kinds])

    typed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return typed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids_xxh64 long, ids binary" * with_ids)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths are 1 to capacity."""
    left = np.bincount(lengths, minlength=capacity + 1).tolist()
    order = np.argsort(lengths, kind="stable").tolist()
    top = np.cumsum(left).tolist()  # the next of each length to take, plus one
    mask = sum(1 << n for n in range(1, capacity + 1) if left[n])  # lengths of which some are unpacked
    bins, offsets, bin_no = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while mask:
        inside: list[int] = []
        gap = capacity
        while gap and (fits := mask & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            inside.append(n)
            gap -= n
            left[n] -= 1
            if not left[n]:
                mask ^= 1 << n
        if gap and mask:
            small = inside[-1]
            best, pair, room = small, None, gap + small
            live = mask & ((1 << room) - 1)
            while live and best < room:
                b = live.bit_length() - 1
                if 2 * b <= best:
                    break
                live ^= 1 << b
                other = mask & ((2 << min(room - b, b)) - 1)
                a = other.bit_length() - 1
                if a == b and left[b] < 2:
                    a = (other ^ 1 << b).bit_length() - 1
                if a > 0 and a + b > best:
                    best, pair = a + b, (b, a)
            if pair:
                inside.pop()
                for n in pair:
                    inside.append(n)
                    left[n] -= 1
                    if not left[n]:
                        mask ^= 1 << n
                left[small] += 1
                mask |= 1 << small
        at = 0  # places are dealt only now, as what was given back has none
        for n in inside:
            top[n] -= 1
            i = order[top[n]]
            bins[i], offsets[i] = bin_no, at
            at += n
        bin_no += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Offsets in a sequence have no gaps.  The pieces are written once with a number for each row, and dealt into
    groups by it, so equal rows spread as others do.  Repeated rows are packed separately, nulls other than in
    length don't matter; no rows give no sequences."""
    pieces = checkpointed(pieces.withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    names = [c for c in pieces.columns if c != "_row"]

    @lean
    def run(table: pa.Table) -> pa.Table:
        group = table.column("packing_group")[0].as_py() if table.num_rows else 0
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32", "_row")]).select(names)
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        return table.append_column("sequence_id", pa.array(group * 2**32 + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    dealt = pieces.withColumn("packing_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes if n != "_row")
    return dealt.groupBy("packing_group").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most capacity tokens.

    Null text counts as empty: such a document is its end id alone.  Only documents longer than
    capacity are cut.  Null ids are kept, repeated rows packed separately, other columns ignored."""
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, doc_ids, ids): the packed sequences themselves, ids as little-endian 32-bit numbers.

    doc_ids: the ids of the sequence's documents in order.  Ids of tokens don't pass through packing: a piece is
    found again by its id, number and the 64-bit hash of its ids.  Nulls, repeats and empty tables as in pack_documents."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids=True)
    placed = pack(pieces.drop("ids"), capacity).alias("p")
    texts = pieces.select("doc_id", "piece", "ids_xxh64", "ids").dropDuplicates(["doc_id", "piece", "ids_xxh64"]).alias("i")
    met = placed.join(texts, F.expr("p.doc_id <=> i.doc_id AND p.piece = i.piece AND p.ids_xxh64 = i.ids_xxh64")).select("sequence_id", "offset", "p.doc_id", "ids")
    inside = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most capacity pieces
    whole = F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    return met.groupBy("sequence_id").agg(inside.alias("x")).select("sequence_id", F.col("x.doc_id").alias("doc_ids"), whole)
