"""Collocations: phrases whose words stand together far more often than apart, by language.

Phrases of one word more are counted in every pass over the texts.  A pass counts exactly what three sieves let
through, and fills the next pass's hash buckets on the way:

* a phrase's bucket must have reached ``min_count`` (hash buckets filled during the pass before),
* both phrases of one word less inside it must be frequent (their exact counts, as a bitmap of their hashes),
* and so must have been all shorter ones, by the same two bitmaps of the earlier passes.

Bitmaps err on the side of counting, so results are exact whatever their size.  That is bounded: ``MAX_BUCKETS``
buckets of one byte in a task and one bit in the broadcast, ``MAX_BITS`` bits for the frequent phrases of a length.
Buckets grow with the texts up to that bound; beyond it more phrases pass their bucket and pruning by shorter phrases
does the work.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import P1, U64, lean, mix, text_buffers, xxh64_ranges
from .storage import checkpointed, dropped, stored

#: Bytes of text that a task holds expanded at once; longer texts are cut between pieces, which no phrase crosses.
BITE = 5_000_000
MAX_BUCKETS, MAX_BITS = 1 << 26, 1 << 28
#: Buckets that travel as one row.
BLOCK = 1 << 16
#: Rows of a group that are ranked in one place.
ROOM = 50_000

_BETWEEN = re.compile(rb"[.,;:!?\x0A-\x0D]")
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _PIECE.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def bites(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts of rows (lang, text), about BITE bytes at a time."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rest = text.encode()
            while rest:
                cut = _BETWEEN.search(rest, max(0, BITE - size))
                head, rest = (rest[: cut.end()], rest[cut.end() :]) if cut else (rest, b"")
                langs.append(lang)
                texts.append(head)
                size += len(head)
                if size >= BITE:
                    yield langs, texts
                    langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


def _numbered(values: np.ndarray) -> np.ndarray:
    """A number below the count of distinct values for each, equal for equal ones."""
    return pa.array(values).dictionary_encode().indices.to_numpy().astype(np.int64)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U64(8 * len(bits) - 1)
    return (bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


class Words:
    """The words of some texts: their strings, languages and hashes, and which follow each other within a piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        inside = ~_GAP[data]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(_PIECE[data], dtype=np.int32)[starts]
        self.follows = piece[1:] == piece[:-1]
        offsets = np.append(0, np.cumsum(ends - starts))
        strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        self.vocabulary, self.word = strings.dictionary, strings.indices.to_numpy().astype(np.int64)
        names = pa.array(langs).dictionary_encode()
        self.langs = names.dictionary
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        self.lang = names.indices.to_numpy()[text].astype(np.int64)
        self.unit = _numbered(self.lang * max(1, len(self.vocabulary)) + self.word)  # a word of a language
        self.units = int(self.unit.max(initial=-1)) + 1
        buffer, cut = text_buffers(self.vocabulary)
        by_word = xxh64_ranges(buffer, cut[:-1], cut[1:])
        by_lang = mix(np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs.to_pylist()], U64))
        self.hash = mix(by_word[self.word] ^ by_lang[self.lang])

    def longer(self, at: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases of size + 1 words of which both phrases of size words are at the places at."""
        there = np.zeros(len(self.word) + 1, bool)
        there[at] = True
        both = there[at + 1]
        if size == 1:
            both[both] = self.follows[at[both]]
        at = at[both]
        return at, mix(h[both] * P1 + self.hash[at + size])

    def candidates(self, size: int, frequent: dict[int, np.ndarray], buckets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the phrases of size words that the bitmaps let through."""
        at, h = np.arange(len(self.word)), self.hash
        for k in range(1, size):
            ok = _known(frequent[k], h)
            at, h = self.longer(at[ok], h[ok], k)
            ok = _known(buckets[k + 1], h)
            at, h = at[ok], h[ok]
        return at, h

    def counted(self, at: np.ndarray, h: np.ndarray, size: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
        """Language, phrase, count and hash of each different phrase at the places at; told apart by its words."""
        number = self.unit[at]
        for k in range(1, size):
            number = _numbered(number * self.units + self.unit[at + k])
        number = _numbered(number)
        one = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        one[number] = np.arange(len(at))
        place = at[one]
        words = [self.vocabulary.take(pa.array(self.word[place + k])) for k in range(size)]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if size > 1 else words[0]
        return self.langs.take(pa.array(self.lang[place])).cast(pa.string()), phrase.cast(pa.string()), pa.array(np.bincount(number, minlength=len(one)).astype(np.int64)), pa.array(h[one].view(np.int64))


def _named(texts: DataFrame, size: int) -> DataFrame:
    """(h): the hash of each phrase of size words of rows (lang, phrase), as Words makes it."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = Words(batch.column(0).to_pylist(), [p.encode() for p in batch.column(1).to_pylist()])
            h = words.hash[::size]
            for k in range(1, size):
                h = mix(h * P1 + words.hash[k::size])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return texts.select("lang", "phrase").mapInArrow(run, "h long")


def _pass(texts: DataFrame, size: int, last: bool, n_buckets: int, min_count: int, frequent: dict[int, np.ndarray], buckets: dict[int, np.ndarray]) -> DataFrame:
    """One pass over (lang, text): rows (lang, phrase, n) of counted phrases by bite, and rows (block, counts) of filled buckets by task."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, buckets))
    kind = np.uint8 if min_count < 256 else np.uint32

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(0 if last else n_buckets, kind)
        for langs, some in bites(batches):
            words = Words(langs, some)
            at, h = words.candidates(size, *shared.value)
            found = words.counted(at, h, size)[:3]  # hashes, which nothing compresses, are made anew of the frequent phrases
            if not last:
                _, h = words.longer(at, h, size)
                bucket, n = np.unique((h & U64(n_buckets - 1)).astype(np.uint32), return_counts=True)
                filled[bucket] = np.minimum(filled[bucket] + n, min_count)
            none = len(found[0])
            yield pa.RecordBatch.from_arrays([*found, pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], names)
        press = zstandard.ZstdCompressor(level=1)
        for block in range(0, len(filled), BLOCK):
            part = filled[block : block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64())] + [pa.array([block]), pa.array([press.compress(part.tobytes())], pa.binary())], names)

    names = ["lang", "phrase", "n", "block", "counts"]
    return texts.mapInArrow(run, "lang string, phrase string, n long, block long, counts binary")


def _filled(counted: DataFrame, n_buckets: int, min_count: int) -> np.ndarray:
    """The bitmap of the buckets that reached min_count, of n_buckets bits."""
    kind = np.uint8 if min_count < 256 else np.uint32

    @lean
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(min(BLOCK, n_buckets), np.int64)
        for z in table.column("counts"):
            total += np.frombuffer(zstandard.decompress(z.as_py()), kind)
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(total >= min_count, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(n_buckets // 8, np.uint8)
    rows = counted.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(add, "block long, bits binary")
    for block, bits in rows.collect():  # n_buckets bits in all
        out[block // 8 : block // 8 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the hashes h of n phrases, with some 16 bits for each up to MAX_BITS."""
    size = min(MAX_BITS, max(1 << 16, 1 << math.ceil(math.log2(max(1, 16 * n)))))
    bit = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    rows = frequent.groupBy(F.bitmap_bucket_number(bit).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for block, bits in rows.collect():  # size bits in all
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(bits, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, most_words: int = 4, min_count: int = 30, lang_col: str = "lang", text_col: str = "text", no_lang: str = "und") -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, f) of the phrases of 1, 2, ... words with f >= min_count, and (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(no_lang)).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    bytes_ = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = min(MAX_BUCKETS, max(BLOCK, 1 << math.ceil(math.log2(max(1, bytes_ / 32)))))
    frequent: dict[int, np.ndarray] = {}
    buckets: dict[int, np.ndarray] = {}
    found, totals = [], None
    for size in range(1, most_words + 1):
        counted = stored(_pass(texts, size, size == most_words, n_buckets, min_count, frequent, buckets))
        phrases = counted.where("phrase IS NOT NULL")
        if totals is None:
            totals = checkpointed(phrases.groupBy("lang").agg(F.sum("n").alias("n")))
        of_size = stored(phrases.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))
        found.append(of_size)
        n = of_size.count()
        if size < most_words:
            frequent[size], buckets[size + 1] = _bitmap(_named(of_size, size), n), _filled(counted, n_buckets, min_count)
        dropped(counted)  # its sums and totals are written, its buckets here
    return found, totals


def _exact(c: str) -> F.Column:
    return F.col(c).cast("decimal(20,0)")


def scored(found: list[DataFrame], factor: int = 2_000_000) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words or more, by their lowest-scoring cut."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    long_ones = [t.select("lang", "phrase", F.lit(k).alias("size"), F.col("f").alias("a")) for k, t in enumerate(found[1:], 2)]
    phrases = long_ones[0]
    for more in long_ones[1:]:
        phrases = phrases.unionByName(more)
    words = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, 1, F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    side = lambda text, f: every.select("lang", F.col("phrase").alias(text), F.col("f").alias(f))
    met = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    met = met.withColumn("p", _exact("a") * F.lit(factor).cast("decimal(10,0)")).withColumn("q", _exact("l") + _exact("r"))
    least = met.groupBy("lang", "phrase").agg(F.first("size").alias("size"), F.first("a").alias("a"), F.min(F.struct(F.expr("p div q").alias("score"), "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def not_inside(phrases: DataFrame, percent: int = 80) -> DataFrame:
    """phrases (lang, phrase, size, a, ...) without those inside a longer one that has percent of their count or more."""
    words, size = F.split("phrase", " "), F.col("size")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    around = phrases.where("size > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    drop = F.coalesce(_exact("around") * 100 >= _exact("a") * percent, F.lit(False))
    return phrases.join(around, ["lang", "phrase"], "left").where(~drop).drop("around")


def first_of_each(rows: DataFrame, group: str, order: list, key: str, most: int) -> DataFrame:
    """The first most rows of each group with their rank.

    A group of over ROOM rows is dealt by a hash of key into places, of which each keeps its first rows, until it fits."""
    while True:
        sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
        largest = sizes.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
        places = math.ceil(largest / max(ROOM, 2 * most))
        if places < 2:
            return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)
        part = Window.partitionBy(group, F.pmod(F.xxhash64(key), F.lit(places))).orderBy(*order)
        rows = checkpointed(rows.withColumn("_at", F.row_number().over(part)).where(F.col("_at") <= most).drop("_at"))


def collocations(docs: DataFrame, most_words: int = 4, min_count: int = 30, percent: int = 80, most: int = 2000, lang_col: str = "lang", text_col: str = "text", no_lang: str = "und") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of 2 to ``most_words`` words.

    a, l, r: how often the phrase and the two parts of its lowest-scoring cut occur, score = floor(2000000 a / (l + r)),
    n: all words of the language.  Phrases of which a longer one around them has ``percent`` of the count are dropped.
    Ties go to the larger a and then to the phrase that comes first in bytes.  Null texts are empty, null languages are
    ``no_lang``; repeated rows count each; texts of any length count whole; an empty table, or no phrase that is
    frequent, gives an empty result; other columns are ignored, whatever their names."""
    found, totals = frequent_phrases(docs, most_words, min_count, lang_col, text_col, no_lang)
    phrases = checkpointed(not_inside(scored(found), percent))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = first_of_each(phrases, "lang", order, "phrase", most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
