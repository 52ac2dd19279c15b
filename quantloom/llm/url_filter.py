"""URL filtering by host rules and a Bloom filter cascade.

A cascade decides exact membership in a list for every key of a known universe.  Level 0 holds the
listed keys; level 1 holds the unlisted keys of the universe that level 0 lets through by mistake;
level 2 the listed keys that level 1 lets through, and so on until a level makes no mistake.  A key
is listed if the first level that rejects it has an odd number (or if it passes an even last one).

Keys are cut into shards by their hash, so that one task builds the levels of a bounded number of
keys.  Testing needs no join: the finished bits are broadcast below ``MAX_BROADCAST`` bytes; beyond that, rows are dealt
out by shard and stream past their shard's levels, which were dealt to the same place and sort first.  A shard's
rows are spread over ``SPREAD`` places, so one hot key doesn't fall to one task.

Rules are looked up by host, in a table that goes with the tasks; any number that the driver can hold will do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U64, mix
from .storage import checkpointed

MAX_BROADCAST = 32 << 20
SHARD_KEYS = 100_000
#: Places over which the rows of one shard are spread when levels are not broadcast.
SPREAD = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


class Rules:
    """Rules ("net/fr/", verdict) by host: for each the paths and verdicts, and the paths' lengths."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, dict[str, tuple[str, str]]] = {}
        for text, says in rules:
            host, slash, path = text.partition("/")
            self.by_host.setdefault(host, {}).setdefault(slash + path, (text, says))  # of equal rules the first listed
        self.sizes = {host: sorted(set(map(len, paths)), reverse=True) for host, paths in self.by_host.items()}

    def hosts(self, host: str) -> list[str]:
        """The hosts of rules that fit a host: itself and those it is a subdomain of."""
        out, at = [], -1
        while at is not None:
            name = host[at + 1 :]
            if name in self.by_host:
                out.append(name)
            at = host.find(".", at + 1)
            at = None if at < 0 else at
        return out

    def match(self, hosts: list[str], path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule and its verdict; two nulls if none fits."""
        best: tuple[str | None, str | None] = (None, None)
        for host in hosts:
            for n in self.sizes[host]:
                if (found := self.by_host[host].get(path[:n])) is not None and len(path) >= n:
                    if best[0] is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best

    def columns(self, hosts: pa.Array, paths: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The rule and verdict for each host and path."""
        coded = hosts.dictionary_encode()
        fitting = list(map(self.hosts, coded.dictionary.to_pylist()))
        found = [self.match(fitting[i], p) if fitting[i] else (None, None) for i, p in zip(coded.indices.to_pylist(), paths.to_pylist(), strict=True)]
        return tuple(pa.array(list(c), pa.string()) for c in (zip(*found, strict=True) if found else ((), ())))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    start = mix(h1 + U64(level * 0x9E3779B97F4A7C15 % 2**64))
    return (start[:, None] + np.arange(n_hashes, dtype=U64) * (h2 | U64(1))[:, None]) % U64(n_bits)


def _passes(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int, n_bits: int, n_hashes: int) -> np.ndarray:
    at = _places(h1, h2, level, n_bits, n_hashes).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, hashes, bitmap) of each level for one shard's distinct keys."""
    inside, outside, levels = np.flatnonzero(listed), np.flatnonzero(~listed), []
    rate = min(0.5, max(len(inside), 1) / max(len(outside), 1) / math.sqrt(2))
    while True:
        n_hashes = max(1, round(-math.log2(rate)))
        n_bits = max(64, math.ceil(len(inside) * -math.log2(rate) / math.log(2)) + 7 & ~7)
        bits = np.zeros(n_bits, bool)
        bits[_places(h1[inside], h2[inside], len(levels), n_bits, n_hashes).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little")
        levels.append((n_bits, n_hashes, packed.tobytes()))
        wrong = outside[_passes(packed, h1[outside], h2[outside], len(levels) - 1, n_bits, n_hashes)]
        if not len(wrong):
            return levels
        if len(levels) > 400:
            raise ValueError("a listed and an unlisted key have the same 128-bit hash")
        inside, outside, rate = wrong, inside, 0.5


def in_levels(levels: list[tuple[int, int, bytes]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys are listed."""
    out, live = np.full(len(h1), len(levels) % 2 == 1), np.arange(len(h1))
    for level, (n_bits, n_hashes, bits) in enumerate(levels):
        passed = _passes(np.frombuffer(bits, np.uint8), h1[live], h2[live], level, n_bits, n_hashes)
        out[live[~passed]] = level % 2 == 1
        live = live[passed]
    return out


def _hashes(key: Column, shards: int) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"), F.pmod(F.xxhash64(F.lit(3), key), F.lit(shards)).alias("shard")]


class Cascade:
    """Levels by shard: a DataFrame (shard, level, n_bits, n_hashes, bits) in the shared folder."""

    def __init__(self, levels: DataFrame, shards: int):
        self.levels, self.shards = levels, shards
        self.bytes = levels.agg(F.coalesce(F.sum(F.length("bits") + 40), F.lit(0))).first()[0]

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """universe, listed: one string column each; null keys are left out, repeated ones count once."""
        key = lambda df, flag: df.select(F.col(df.columns[0]).alias("key"), F.lit(flag).alias("listed")).where("key IS NOT NULL")
        keys = checkpointed(key(universe, False).union(key(listed, True)).groupBy("key").agg(F.max("listed").alias("listed")))
        shards = max(1, math.ceil(keys.count() / SHARD_KEYS))

        def build(table: pa.Table) -> pa.Table:
            h1, h2 = (table.column(c).to_numpy().view(U64) for c in ("h1", "h2"))
            levels = build_levels(h1, h2, table.column("listed").to_numpy())
            n_bits, n_hashes, bits = zip(*levels, strict=True)
            return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(levels), pa.int64()), "level": pa.array(range(len(levels)), pa.int32()), "n_bits": pa.array(n_bits, pa.int64()), "n_hashes": pa.array(n_hashes, pa.int32()), "bits": pa.array(bits, pa.binary())})

        hashed = keys.select(*_hashes(F.col("key"), shards), "listed")
        return cls(checkpointed(hashed.groupBy("shard").applyInArrow(build, "shard long, level int, n_bits long, n_hashes int, bits binary")), shards)

    def mark(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        """rows with a boolean column that says whether their key is listed; null keys are not.

        rows must not have the columns _h1, _h2, _shard, _place and _level."""
        hashes = [h.alias(n) for h, n in zip(_hashes(F.col(f"`{key}`"), self.shards), ("_h1", "_h2", "_shard"), strict=True)]
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{flag}` boolean"
        hashed = rows.select("*", *hashes, F.col(f"`{key}`").isNotNull().alias("_some"))
        if self.bytes <= MAX_BROADCAST:
            found: dict[int, list] = {}
            for r in self.levels.orderBy("shard", "level").toLocalIterator():  # at most MAX_BROADCAST bytes
                found.setdefault(r.shard, []).append((r.n_bits, r.n_hashes, bytes(r.bits)))
            shared = rows.sparkSession.sparkContext.broadcast(found)

            def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield _tested(batch, 4, shared.value, flag)

            return hashed.mapInArrow(test, names)
        return self._streamed(hashed, names, flag)

    def _streamed(self, hashed: DataFrame, names: str, flag: str) -> DataFrame:
        """Rows and levels, dealt out alike and sorted by shard, levels first."""
        spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")  # any place will do, as all have the levels
        level = "level", "n_bits", "n_hashes", "bits"
        none = {"level": "int", "n_bits": "long", "n_hashes": "int", "bits": "binary"}
        left = hashed.select(F.struct("*").alias("_row"), F.col("_shard").alias("_at"), spread.alias("_place"), *[F.lit(None).cast(t).alias(f"_{c}") for c, t in none.items()])
        right = self.levels.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col("shard").alias("_at"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_place"), *[F.col(c).alias(f"_{c}") for c in level])
        both = left.unionByName(right).repartition("_at", "_place").sortWithinPartitions("_at", F.col("_level").asc_nulls_last())

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                at, number = batch.column(1).to_numpy(), batch.column(3)
                for i in np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    shard = int(at[i])
                    held.setdefault(shard, [])
                    if len(held[shard]) == number[i].as_py():  # a shard's levels come once for each of its places here
                        held[shard].append((batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), batch.column(6)[i].as_py()))
                mine = batch.filter(number.is_null())
                if mine.num_rows:
                    yield _tested(pa.RecordBatch.from_struct_array(mine.column(0)), 4, held, flag)
                held = {k: v for k, v in held.items() if len(at) and k == int(at[-1])}  # of earlier shards no row comes any more

        return both.mapInArrow(test, names)


def _tested(batch: pa.RecordBatch, extra: int, levels: dict[int, list], flag: str) -> pa.RecordBatch:
    """A batch without its last columns - two hashes, the shard, and whether there is a key - and with the flag."""
    h1, h2, shard = (batch.column(batch.num_columns - extra + i).to_numpy() for i in range(3))
    some = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
    out = np.zeros(len(h1), bool)
    for s in np.unique(shard):
        if s in levels:
            at = np.flatnonzero((shard == s) & some)
            out[at] = in_levels(levels[s], h1[at].view(U64), h2[at].view(U64))
    return pa.RecordBatch.from_arrays([*batch.columns[:-extra], pa.array(out)], names=[*batch.schema.names[:-extra], flag])


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, listed, verdict) for every row.

    The longest fitting rule decides; without one, a listed host is blocked and any other allowed.
    A null url or one without "://" has an empty host and path, fits no rule and is judged as the
    empty host; a url of any length is read whole; null ids stay null.  Of equal rules the first listed counts.
    Repeated rows come back repeated; an empty table or list is fine; other columns are ignored."""
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    marked = Cascade.build(rows.select("host").distinct(), listed_hosts).mark(rows, "host", "listed")
    table = Rules(rules)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *table.columns(batch.column(1), batch.column(2))], [*batch.schema.names, "rule", "says"])

    kind = dict(rows.dtypes)["page_id"]
    judged = marked.mapInArrow(match, f"page_id {kind}, host string, path string, listed boolean, rule string, says string")
    return judged.select("page_id", "host", "path", "rule", "listed", F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
