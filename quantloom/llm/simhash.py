"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has 64 bits; two fingerprints link when at most ``distance`` bits differ.  A pigeonhole
over exact segments would need ``distance + 1`` of them.  Here the bits are cut into only
``segments`` pieces, few enough that one piece must agree up to a single bit; each piece is indexed
once for each of its bits with that bit replaced by a wildcard, so that pieces one bit apart share
an entry.  Entries meet by equality of (piece, wildcard place, remaining bits), and every meeting
is verified on the whole fingerprints.

Fingerprints are computed on Arrow batches (XXH64 over byte ranges, all shingles of a slice at
once).  Exact fingerprints are merged first, so copies count once.  The entries travel as packed
arrays in a fixed hash space: one row holds the entries of a task for one part of that space.
Inside one key only the edges that connect its fingerprints leave the task, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components, join_forest, looked_up
from .storage import checkpointed, stored

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def majority_bits(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each group of consecutive hashes the word whose bits more than half of them have set.

    Eight byte-wide counters are added per step, in blocks that cannot overflow a byte."""
    out = np.zeros(len(firsts), U64)
    full = np.flatnonzero(counts > 0)
    if not full.size:
        return out
    n = counts[full]
    blocks = (n + 254) // 255
    heads = np.repeat(firsts[full], blocks) + 255 * K.ranges(np.zeros(len(full), np.int64), blocks)
    first_block = np.cumsum(blocks) - blocks
    ones = U64(0x0101010101010101)
    for plane in range(8):
        partial = np.add.reduceat((hashes >> U64(plane)) & ones, heads)
        wide = np.add.reduceat(partial.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        bits = (2 * wide > n[:, None]).astype(U64)
        for byte in range(8):
            out[full] |= bits[:, byte] << U64(8 * byte + plane)
    return out


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of a slice, A-Z lower-cased, and how many every document has; fewer than width words are one."""
    starts, ends, first = K.words(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64)
    size = ends - starts
    joined = _LOWER[data[np.minimum(K.ranges(starts, size + 1), len(data) - 1)]]
    at = np.cumsum(size + 1) - (size + 1)
    joined[at + size] = 0x20
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    head = K.ranges(first[:-1], n_shingles)
    last = head + np.repeat(np.minimum(n_words, width), n_shingles) - 1
    return K.xxh64_ranges(joined, at[head], at[last] + size[last]), n_shingles


def fingerprint_texts(data: np.ndarray, offsets: np.ndarray, width: int, n_fps: int = 1) -> np.ndarray:
    """SimHashes of every document in a slice, one row each: A-Z lower-cased, shingles of width words, repeats included.

    The first counts the bits of the shingles' XXH64; each further one those of that hash mixed anew."""
    hashes, n_shingles = shingle_hashes(data, offsets, width)
    if not len(hashes):
        return np.zeros((len(offsets) - 1, n_fps), U64)
    own = [hashes if k == 0 else K.mix(hashes ^ K.mix(np.array([k], U64))) for k in range(n_fps)]
    return np.stack([majority_bits(h, np.cumsum(n_shingles) - n_shingles, n_shingles) for h in own], 1)


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", n_fps: int = 1) -> DataFrame:
    """(doc_id, fp[, fp1, ...]): fingerprints as signed longs; a text without words has 0."""
    names = ["fp", *(f"fp{k}" for k in range(1, n_fps))]

    @K.lean
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            fps = [fingerprint_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, n_fps) for a, b in K.slices(offsets)]
            fp = np.concatenate(fps) if fps else np.zeros((0, n_fps), U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(n_fps))], ["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(compute, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _variants(fp: np.ndarray, segments: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(piece, wildcard place, key) for every piece of the fingerprints and every bit of it."""
    cuts = np.linspace(0, 64, segments + 1).round().astype(int)
    for piece, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        mask = ((1 << int(high - low)) - 1) << int(low)
        for bit in range(int(low), int(high)):
            yield piece, bit, K.mix((fp & U64(mask & ~(1 << bit))) ^ K.mix(np.array([bit + 1], U64)))


def _cuts(varying: int, n: int, distance: int) -> tuple[list[int], int]:
    """Masks that cut the varying bits into pieces, and of how many of these linked fingerprints agree; the cheapest cut for n of them.

    More pieces make more choices of agreeing ones, but of more bits together."""
    bits = [k for k in range(64) if varying >> k & 1]
    best = None
    for m in range(distance + 1, min(len(bits), 12) + 1):
        agree = m - distance
        choices, width = math.comb(m, agree), len(bits) * agree // m
        cost = choices * n * (30 + n / 2.0**width)
        if best is None or cost < best[0]:
            edge = [len(bits) * k // m for k in range(m + 1)]
            best = (cost, [sum(1 << k for k in bits[x:y]) for x, y in pairwise(edge)], agree)
    return (best[1], best[2]) if best else ([], 0)


def _choices(fp: np.ndarray, varying: int, n: int, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, what fp has in some pieces) for each choice of pieces of which linked fingerprints agree in one choice at least."""
    masks, agree = _cuts(varying, n, distance)
    for number, chosen in enumerate(combinations(masks, agree)):
        yield number, fp & U64(sum(chosen))


def _varying(fp: np.ndarray) -> int:
    return int(np.bitwise_or.reduce(fp) ^ np.bitwise_and.reduce(fp))


def _links_in(fp: np.ndarray, distance: int, most: int = 1024, large: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges that connect distinct fingerprints as all links of at most distance bits do; and what is too large to be compared here.

    Up to ``most`` fingerprints are compared directly.  From a larger set, crowds around a middle are
    taken out first: their members are one component, and done once every other fingerprint has been
    tested against them.  What stays is given back if it is more than ``large``, and else split exactly: linked fingerprints
    agree in all but ``distance`` of any pieces, so those are compared that agree in some choice of pieces of the bits that vary."""
    parent = np.arange(len(fp))
    out_a, out_b = [], []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        a, b = join_forest(parent, a, b)
        out_a.append(a)
        out_b.append(b)

    rest = np.arange(len(fp))
    while len(rest) > most:  # a crowd around one fingerprint: its members are one component, and done once the others are tested against them
        bits = np.unpackbits(fp[rest].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = np.packbits(2 * bits.sum(axis=0) > len(rest), bitorder="little").view(U64)[0]
        pivot = rest[np.argmin(_popcount(fp[rest] ^ middle))]
        near = _popcount(fp[rest] ^ fp[pivot]) <= distance
        crowd = rest[near]
        if 16 * len(crowd) < len(rest):
            break
        link(np.full(len(crowd) - 1, pivot), crowd[crowd != pivot])
        rest = open_ = rest[~near]
        for x in range(0, len(crowd), most):
            met, at = np.zeros(len(open_), bool), np.zeros(len(open_), np.int64)
            for y in range(0, len(open_), most):
                hit = _popcount(fp[open_[y : y + most], None] ^ fp[None, crowd[x : x + most]]) <= distance
                met[y : y + most], at[y : y + most] = hit.any(axis=1), hit.argmax(axis=1)
            link(open_[met], crowd[x + at[met]])
            open_ = open_[~met]
    over = np.zeros(0, np.int64)
    if large is not None and len(rest) > large:
        over, rest = rest, over
    if len(rest) <= most:
        near = _popcount(fp[rest, None] ^ fp[None, rest]) <= distance
        link(*(rest[x] for x in np.nonzero(near)))
    else:
        for _, piece in _choices(fp[rest], _varying(fp[rest]), len(rest), distance):
            order = np.argsort(piece, kind="stable")
            of, own = piece[order], rest[order]
            alive, shift = np.arange(len(own) - 1), 1
            while len(alive := alive[alive + shift < len(own)]):  # equal neighbours, and theirs, and so on
                alive = alive[of[alive] == of[alive + shift]]
                near = _popcount(fp[own[alive]] ^ fp[own[alive + shift]]) <= distance
                link(own[alive[near]], own[alive[near] + shift])
                shift += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b), over) if out_a else (none, none, over)


def links_of_entries(key: np.ndarray, fp: np.ndarray, distance: int, large: int | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Verified links between entries of equal key, thinned to what keeps their components; and by key the fingerprints that are too many to be compared here."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, fp = key[fresh], fp[fresh]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(key)))
    out = []
    small = size <= 48
    for shift in range(1, 48):
        groups = small & (size > shift)
        a = K.ranges(head[groups], size[groups] - shift)
        near = _popcount(fp[a] ^ fp[a + shift]) <= distance
        out.append((fp[a[near]], fp[a[near] + shift]))
    left = []
    for g in np.flatnonzero(~small):
        part = fp[head[g] : head[g] + size[g]]
        a, b, over = _links_in(part, distance, large=large)
        out.append((part[a], part[b]))
        if len(over):
            left.append((int(key[head[g]].view(np.int64)), part[over]))
    a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1], left


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """The first column of the batches, in arrays of at least so many rows but for the last."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        if sum(map(len, held)) >= rows:
            yield np.concatenate(held)
            held = []
    if sum(map(len, held)):
        yield np.concatenate(held)


#: Fingerprints of one key that a task compares; more are dealt anew.
LARGE = 4096


def fingerprint_links(distinct: DataFrame, distance: int = 4, segments: int | None = None, parts: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to connect what is linked.

    parts: into how many parts the hash space of entries is dealt; by default one for about
    20,000 fingerprints, 64 at least."""
    segments = segments or distance // 2 + 1
    if distance // segments > 1:
        raise ValueError(f"{segments} segments leave more than one differing bit in each; take {distance // 2 + 1}")
    parts = parts or max(64, distinct.count() * segments // 60_000)

    @K.lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(batches, 20_000):
            fp = held.view(U64)
            keys = [key for _, _, key in _variants(fp, segments)]
            key, fp = np.concatenate(keys), np.tile(fp, len(keys))
            part = (key % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist() + [len(part)]
            rows = [(int(part[order[x]]), key[order[x:y]].tobytes(), fp[order[x:y]].tobytes()) for x, y in pairwise(edge)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["part", "keys", "fps"])

    def meet(large: int | None) -> Callable[[pa.Table], pa.Table]:
        @K.lean
        def run(table: pa.Table) -> pa.Table:
            read = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), U64)
            a, b, left = links_of_entries(read("keys"), read("fps"), distance, large)
            over = np.concatenate([f for _, f in left]) if left else np.zeros(0, U64)
            key = np.repeat(np.array([k for k, _ in left], np.int64), [len(f) for _, f in left]) if left else np.zeros(0, np.int64)
            columns = [np.concatenate([a, over]), np.concatenate([b, over])]
            return pa.table({"a": columns[0].view(np.int64), "b": columns[1].view(np.int64), "key": pa.array(np.append(np.zeros(len(a), np.int64), key), mask=np.arange(len(a) + len(key)) < len(a))})

        return run

    entries = distinct.select("fp").mapInArrow(deal, "part long, keys binary, fps binary")
    found = checkpointed(entries.groupBy("part").applyInArrow(meet(LARGE), "a long, b long, key long"))
    links = found.where("key IS NULL").select("a", "b")
    over = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if not over.limit(1).count():
        return links.distinct()
    # a large key is dealt anew by choices of pieces of the bits in which its fingerprints differ
    shape = over.groupBy("key").agg(F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying"), F.count("*").alias("n"))
    shaped = looked_up(checkpointed(over), checkpointed(shape), "key", "varying", "n")

    @K.lean
    def redeal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, varying, n = (batch.column(c).to_numpy() for c in ("key", "fp", "varying", "n"))
            for one in np.unique(key).tolist():
                rows = np.flatnonzero(key == one)
                for number, piece in _choices(fp[rows].view(U64), int(varying[rows[0]]) % 2**64, int(n[rows[0]]), distance):
                    name = K.mix(piece ^ K.mix(np.array([one], np.int64).view(U64) + U64(number)))
                    part = (name % U64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    edge = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist() + [len(part)]
                    made = [(int(part[order[x]]), name[order[x:y]].tobytes(), fp[rows[order[x:y]]].tobytes()) for x, y in pairwise(edge)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["part", "keys", "fps"])

    again = shaped.mapInArrow(redeal, "part long, keys binary, fps binary")
    return links.unionByName(again.groupBy("part").applyInArrow(meet(None), "a long, b long, key long").select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest doc_id reachable by links).

    Null text counts as empty and gets fingerprint 0, which links like any other.  Documents with
    equal fingerprints are linked.  A null doc_id counts as larger than any other; component_id is
    null only if all of its documents have a null id.  Repeated rows come back as often as they
    went in; an empty table gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    fps = checkpointed(fingerprints(docs, width, id_col, text_col))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    components = connected_components(spark, checkpointed(fingerprint_links(classes, distance)), "fp")
    joined = checkpointed(classes.join(components, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(looked_up(joined, least, "component", "component_id").select("fp", "component_id"))
    return looked_up(fps, named, "fp", "component_id").select("doc_id", "fp", "component_id")


#: MinHash bands that add to the candidates of the SimHashes, and the rows of each: a pair of similarity 0.8 shares no band in 4 of 10,000 cases.
BANDS, BAND_ROWS = 20, 5
_FACTORS = K.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=U64)) | U64(1)
#: Documents of one group of candidates that a task compares at once.
BLOCK = 500


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document in a slice, in order, and how many each has."""
    hashes, counts = shingle_hashes(data, offsets, width)
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[fresh], np.bincount(doc[fresh], minlength=len(counts))


def set_names(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A name of every document's set of shingles; 0 for an empty one."""
    out, full = np.zeros(len(counts), U64), np.flatnonzero(counts > 0)
    if full.size:
        out[full] = np.maximum(K.mix(np.add.reduceat(K.mix(hashes), (np.cumsum(counts) - counts)[full])), U64(1))
    return out


def set_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of every document's set of shingles; 0 for an empty one."""
    return majority_bits(hashes, np.cumsum(counts) - counts, counts)


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The BANDS MinHash keys of every document's set, one row each; zeros for an empty one."""
    out, full = np.zeros((len(counts), BANDS), U64), np.flatnonzero(counts > 0)
    if not full.size:
        return out
    first = (np.cumsum(counts) - counts)[full]
    for band in range(BANDS):
        key = np.full(len(full), band + 1, U64)
        for factor in _FACTORS[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            key = K.mix(key * K.P1 + np.minimum.reduceat(hashes * factor, first))
        out[full, band] = key
    return out


def links_of_sets(sets: list[np.ndarray], share: float) -> tuple[list[int], list[int]]:
    """Edges of a forest with the components of all pairs of sets whose Jaccard similarity is at least share."""
    out_a, out_b = [], []
    counts = np.array([len(x) for x in sets])
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(counts) - counts
    open_, found, mark = np.arange(len(sets)), [], np.zeros(len(names), np.int64)
    at = None
    while len(open_):
        if not found:
            found, open_, at = [int(open_[0])], open_[1:], None
            continue
        p = found.pop()
        if at is None:
            at, head = code[K.ranges(first[open_], counts[open_])], np.cumsum(counts[open_]) - counts[open_]
        mine = code[first[p] : first[p] + counts[p]]
        mark[mine] = 1
        both = np.add.reduceat(mark[at], head)
        mark[mine] = 0
        near = both >= share * (counts[p] + counts[open_] - both) - 1e-9
        if near.any():
            met = open_[near].tolist()
            out_a += [p] * len(met)
            out_b += met
            found += met
            open_, at = open_[~near], None
    return out_a, out_b


def _identity(docs: DataFrame) -> list:
    """Two hashes of all columns, nulls included: equal for truly equal rows alone.

    Columns that hold maps, which Spark doesn't hash, count by their JSON: maps of other orders are other rows."""
    cells = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        cells += [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c, c.isNull()]
    return [F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(1), *cells).alias("h2")]


def _sliced(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = K.text_buffers(column)
    for a, b in K.slices(offsets):
        yield shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def _links_within(units: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """(a, b): verified links among the documents (cid) of each unit, enough to connect what is linked in it."""
    units = checkpointed(units.distinct())
    parts = max(64, units.count() // 2000)

    @K.lean
    def meet(table: pa.Table) -> pa.Table:
        unit, cid = table.column("unit").to_numpy(), table.column("cid").to_numpy()
        order = np.lexsort((cid, unit))
        blobs = table.column("shingles").to_pylist()
        edge = np.flatnonzero(np.diff(unit[order], prepend=unit[order[:1]] - 1)).tolist() + [len(order)]
        out_a, out_b = [], []
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            o = order[x:y]
            a, b = links_of_sets([np.frombuffer(blobs[i], U64) for i in o.tolist()], share)
            out_a.append(cid[o[a]] if a else o[:0])
            out_b.append(cid[o[b]] if b else o[:0])
        return pa.table({"a": pa.array(np.concatenate(out_a), pa.int64()), "b": pa.array(np.concatenate(out_b), pa.int64())})

    met = units.join(sets, "cid").select(F.pmod("unit", F.lit(parts)).alias("part"), "unit", "cid", "shingles")
    return checkpointed(met.groupBy("part").applyInArrow(meet, "a long, b long").distinct())


def _block(seed: int, n: str):
    return F.pmod(F.xxhash64(F.lit(seed), "cid"), F.col(n))


def _alike(classes: DataFrame, distance: int) -> DataFrame:
    """(cid, key): the component of every set's fingerprint (fp), by links of at most distance bits over deletion variants."""
    links = checkpointed(fingerprint_links(checkpointed(classes.select("fp").distinct()), distance))
    labels = connected_components(classes.sparkSession, links, "fp")
    return checkpointed(looked_up(classes.select("cid", "fp"), labels, "fp", "component").select("cid", F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("key")))


def _similar(docs: DataFrame, width: int, share: float, distance: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, doc_id, cid) of every row, and (cid, component) of the sets that have a link."""
    spark = docs.sparkSession
    names = [f"b{k}" for k in range(BANDS)]

    @K.lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(set_names(*x), set_fingerprints(*x), band_keys(*x)) for x in _sliced(batch.column(3), width)]
            cid, fp, keys = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, U64), np.zeros(0, U64), np.zeros((0, BANDS), U64))
            columns = [cid, fp, *(np.ascontiguousarray(keys[:, k]) for k in range(BANDS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x.view(np.int64)) for x in columns)], ["h1", "h2", "doc_id", "cid", "fp", *names])

    @K.lean
    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in _sliced(batch.column(0), width):
                ends = np.cumsum(counts)
                blobs = [hashes[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_names(hashes, counts).view(np.int64)), pa.array(blobs, pa.binary())], ["cid", "shingles"])

    text = F.col(f"`{text_col}`").cast("string").alias("_text")
    slim = docs.select(*_identity(docs), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text)
    sketched = checkpointed(slim.mapInArrow(sketch, "h1 long, h2 long, doc_id long, cid long, fp long, " + ", ".join(f"{n} long" for n in names)))
    rows = sketched.select("h1", "h2", "doc_id", "cid")
    classes = checkpointed(sketched.where("cid <> 0").groupBy("cid").agg(F.min("h1").alias("h1"), *[F.min(n).alias(n) for n in ("fp", *names)]))
    entries = _alike(classes, distance).select("cid", "key").unionByName(classes.select("cid", F.explode(F.array(*names)).alias("key")))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"))
    shared = checkpointed(shared.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))  # groups that hold the same sets count once
    members = looked_up(entries, shared, "key", "n").where("n IS NOT NULL")
    members = checkpointed(members.withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    texts = slim.select("h1", "_text").join(classes.join(members.select("cid").distinct(), "cid", "left_semi").select("h1"), "h1", "left_semi").select("_text")
    sets = stored(texts.mapInArrow(shingled, "cid long, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles")))
    # a small group is one unit; a large one is dealt into blocks, each with the same one of its sets
    units = members.select(F.xxhash64("key", _block(0, "blocks")).alias("unit"), "cid")
    large = members.where("blocks > 1")
    pivots = large.groupBy("key").agg(F.min("cid").alias("cid"), F.max("blocks").alias("blocks"))
    pivots = pivots.select(F.col("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "cid")
    edges = _links_within(units.unionByName(pivots.select(F.xxhash64("key", "block").alias("unit"), "cid")), sets, share)
    if large.limit(1).count():
        # what a large group's largest component lacks is compared with all of the group
        labels = connected_components(spark, edges, "cid")
        named = checkpointed(large.join(labels, "cid", "left").withColumn("label", F.coalesce("component", "cid")).select("key", "cid", "n", "blocks", "label"))
        sizes = named.groupBy("key", "label").agg(F.count("*").alias("m"))
        tops = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
        tops = tops.where("top.m < all").select("key", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).alias("rests"))
        named = checkpointed(looked_up(named, tops, "key", "top", "rests").where("top IS NOT NULL"))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        whole = named.select("key", "cid", _block(0, "blocks").alias("j"), each("rests").alias("i"))
        rest = named.where("label <> top").select("key", "cid", _block(1, "rests").alias("i"), each("blocks").alias("j"))
        more = whole.select("key", "cid", "i", "j").unionByName(rest).select(F.xxhash64("key", "i", "j").alias("unit"), "cid")
        edges = edges.unionByName(_links_within(more, sets, share))
    return rows, connected_components(spark, edges, "cid")


def similar_documents(docs: DataFrame, width: int = 5, share: float = 0.8, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row: groups of documents that share most of their shingles.

    Candidates are the sets of shingles whose SimHashes deletion-variant signatures connect, at most
    ``distance`` bits from one to the next; two of them link if the Jaccard similarity of the whole sets is at least
    ``share``.  At 0.8 SimHashes differ in 15 of 100 bits, and more deletions aren't bearable; so sets that
    share one of BANDS MinHash keys are candidates too: of pairs at 0.8 those miss 4 in 10,000, above it
    fewer.  Only verified links are thinned.  Equal sets are merged first; texts without
    words are one group.  Nulls, repeated rows and empty tables are taken as in near_duplicates."""
    rows, components = _similar(docs, width, share, distance, id_col, text_col)
    classes = rows.groupBy("cid").agg(F.min("doc_id").alias("least"))
    joined = checkpointed(classes.join(components, "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(looked_up(joined, least, "component", "component_id").select("cid", "component_id"))
    return looked_up(rows, named, "cid", "component_id").select("doc_id", "component_id")


def keep_one_per_group(docs: DataFrame, width: int = 5, share: float = 0.8, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are the first of their near-duplicate group, as similar_documents makes them; all columns stay.

    One row of each group stays: that of the smallest id, a null one being the largest, and among rows of
    one id that of the smallest hash of all columns; of truly equal rows any.  A document without words is
    a group with its like."""
    rows, components = _similar(docs, width, share, distance, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    classes = rows.groupBy("cid").agg(F.min(order).alias("r")).join(components, "cid", "left")
    found = classes.groupBy(F.coalesce("component", "cid")).agg(F.min("r").alias("r")).select("r.h1", "r.h2")
    found = checkpointed(found)
    whole = docs.select(*_identity(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    firsts = whole.join(found, ["h1", "h2"], "left_semi")
    if rows.groupBy("h1", "h2").count().where("count > 1").limit(1).count():
        firsts = firsts.groupBy("h1", "h2").agg(F.first("row").alias("row"))  # truly equal rows
    return firsts.select("row.*")
