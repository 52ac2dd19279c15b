"""A quality classifier by co-training two views of a document.

One logistic classifier sees the text's content (word buckets, character classes, marks,
repetition), the other the page's metadata (source, language, length, and the layout of its lines).  Over some rounds
each labels the unlabelled documents it is surest of for the other: every round scores the whole corpus with
both views, each task keeps its surest rows, and the surest of all come to the driver.  Each view is then
calibrated on labelled rows kept out of training, the calibrated log odds are combined, and all documents scored.

Both views' features are computed once and written as a table; rounds and scores read that.  Bounded are the
labelled rows (``max_labelled``) and the pseudo-labels of a round (``each``), not what they are chosen from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import checkpointed, stored

U64 = np.uint64
BUCKETS = 64
#: Character classes of bytes: other, space, newline, capital, small, digit, sentence mark, symbol, part of a longer character.
_CLASS = np.zeros(256, np.int64)
_CLASS[[0x20, 0x09]] = 1
_CLASS[0x0A] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[48:58] = 5
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 6
_CLASS[[ord(c) for c in "#*$%&|<>!?@^_=+~{}[]\\/"]] = 7
_CLASS[128:] = 8
N_CLASSES, N_STATS = 9, 10
META_SOURCES, META_LANGS = 64, 16


def _mean_by(row: np.ndarray, value: np.ndarray, n: int, whole: np.ndarray) -> np.ndarray:
    return np.bincount(row, value, n) / np.maximum(whole, 1)


def content_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a document: shares of word buckets, shares of character classes, and statistics."""
    n = len(offsets) - 1
    starts, ends, first = K.words(data, offsets)
    n_words = np.diff(first)
    word_row = np.repeat(np.arange(n), n_words)
    codes = K.word_hashes(data, starts, ends)
    bucket = (codes % U64(BUCKETS)).astype(np.int64)
    words = np.bincount(word_row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(n_words, 1)[:, None]
    size = np.diff(offsets)
    cls = _CLASS[data]
    shares = np.bincount(np.repeat(np.arange(n) * N_CLASSES, size) + cls, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(size, 1)[:, None]
    last, head = cls[ends - 1], cls[starts]
    second = cls[np.minimum(starts + 1, ends - 1)]
    lines = np.flatnonzero(data == 0x0A)
    edge = np.unique(np.concatenate([offsets[:-1], lines + 1]))
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data))
    line_row = np.searchsorted(offsets, edge, "right") - 1
    name = K.range_hashes(K.byte_codes(data), edge, np.maximum(edge, stop - 1)) if len(data) else np.zeros(0, U64)
    order = np.lexsort((name, line_row))
    again = np.zeros(len(name))
    again[1:] = (name[order][1:] == name[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    inside = np.flatnonzero(word_row[2:] == word_row[:-2])  # windows of three words
    window = K.window_hashes(codes, 3)[inside]
    by = np.lexsort((window, word_row[inside]))
    twin = np.zeros(len(by))
    twin[1:] = (window[by][1:] == window[by][:-1]) & (word_row[inside][by][1:] == word_row[inside][by][:-1])
    stammer = np.zeros(len(codes))
    stammer[1:] = (codes[1:] == codes[:-1]) & (word_row[1:] == word_row[:-1])
    stats = np.stack(
        [
            _mean_by(word_row, last == 7, n, n_words), _mean_by(word_row, last == 6, n, n_words), _mean_by(word_row, (head == 3) & (second == 3), n, n_words),
            _mean_by(word_row, (ends - starts == 1) & (head == 7), n, n_words), _mean_by(word_row, (ends - starts) / 10, n, n_words), _mean_by(word_row, last == 5, n, n_words),
            _mean_by(line_row[order], again, n, np.bincount(line_row, minlength=n)),
            _mean_by(word_row[inside][by], twin, n, n_words), _mean_by(word_row, stammer, n, n_words), np.log1p(n_words) / 10,
        ], 1,
    )
    return np.hstack([words, np.sqrt(shares), np.sqrt(stats)]).astype(np.float32)


#: Bytes of markup and of addresses.
_MARKUP = np.isin(np.arange(256), list(b"<>{}[]|=#*_~`\\"))
LAYOUT = 6


def layout_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a document: shares of repeated, empty and short lines, spread of the lines' lengths, markup, and addresses."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts, ends = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offsets)) + 1)
    size = ends - starts
    name = K.range_hashes(K.byte_codes(data), starts, ends) if len(data) else np.zeros(len(starts), U64)
    order = np.lexsort((name, row))
    again = np.zeros(len(name))
    again[1:] = (name[order][1:] == name[order][:-1]) & (row[order][1:] == row[order][:-1]) & (size[order][1:] > 0)
    lines = np.bincount(row, minlength=n)
    mean = lambda x, of=row: np.bincount(of, x, n) / np.maximum(lines, 1)
    long = np.log1p(size)
    inside = np.repeat(np.arange(n), np.diff(offsets))
    per_byte = lambda hit: np.bincount(inside[hit], minlength=n) / np.maximum(np.diff(offsets), 1)
    slashes = np.flatnonzero((data[:-2] == 0x3A) & (data[1:-1] == 0x2F) & (data[2:] == 0x2F)) if len(data) > 2 else np.zeros(0, np.int64)
    spread = np.sqrt(np.maximum(mean(long**2) - mean(long) ** 2, 0)) / 3
    return np.stack([np.sqrt(mean(again, row[order])), np.sqrt(mean(size == 0)), np.sqrt(mean((size > 0) & (size < 24))), spread, np.sqrt(per_byte(_MARKUP[data])), np.sqrt(30 * per_byte(slashes))], 1)


def metadata_features(source: list[str | None], lang: list[str | None], n_bytes: np.ndarray, n_lines: np.ndarray, layout: np.ndarray) -> np.ndarray:
    """One row a document: hashed source and language, length on logarithmic scales, and layout."""
    import zlib

    n = len(source)
    out = np.zeros((n, META_SOURCES + META_LANGS + 12 + LAYOUT), np.float32)
    rows = np.arange(n)
    out[rows, [zlib.crc32((s or "").encode()) % META_SOURCES for s in source]] = 1
    out[rows, [META_SOURCES + zlib.crc32((x or "").encode()) % META_LANGS for x in lang]] = 1
    out[rows, META_SOURCES + META_LANGS + np.minimum(np.log2(1 + n_bytes).astype(int) // 2, 8)] = 1
    at = META_SOURCES + META_LANGS + 9
    out[:, at] = np.log1p(n_bytes) / 10
    out[:, at + 1] = np.log1p(n_lines) / 5
    out[:, at + 2] = np.log1p(n_bytes / np.maximum(n_lines, 1)) / 10
    out[:, at + 3 :] = layout
    return out


@dataclass
class View:
    """A logistic classifier on standardised features, with its calibration."""

    ridge: float = 2.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 1.0
    shift: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
        self.weights = _logistic(self._with_one(x), y, self.ridge)
        return self

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._with_one(x) @ self.weights

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        raw = self.raw(x)
        self.slope, self.shift = _logistic(np.stack([raw, np.ones(len(raw))], 1), y, 1e-2)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last column, the constant, is hardly penalised."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(25):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray  # weights of the calibrated views' log odds, and a constant
    exchanged: list[tuple[int, int, float, int]] = field(default_factory=list)  # round, view that learns, label, documents

    def views(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text.log_odds(content), self.meta.log_odds(metadata)

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.views(content, metadata)
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


#: A choice of unlabelled rows: the view that is sure of them, their label, and how many.
Wish = tuple[int, float, int]
Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # names, content, metadata


def _loss(odds: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss of log odds."""
    return float(np.logaddexp(0, np.where(y > 0, -odds, odds)).mean())


def _combined(text: View, meta: View, views: tuple[np.ndarray, np.ndarray], truth: np.ndarray) -> tuple[Model, float, list[float]]:
    """A model of both views, calibrated and combined on held-out rows; its log loss there, and each view's gain over the share of ones."""
    for view, x in zip((text, meta), views, strict=True):
        view.calibrate(x, truth)
    each = [v.log_odds(x) for v, x in zip((text, meta), views, strict=True)]
    odds = np.stack([*each, np.ones(len(truth))], 1)
    mix = _logistic(np.clip(odds, -10, 10), truth, 0.1)
    for k in (0, 1):  # a view can't vote against itself: without it, the other alone
        if mix[k] < 0:
            odds[:, k] = 0
            mix = _logistic(np.clip(odds, -10, 10), truth, 0.1)
    base = _loss(np.full(len(truth), np.log(truth.mean() / (1 - truth.mean()))), truth)
    return Model(text, meta, mix), _loss(np.clip(odds, -10, 10) @ mix, truth), [base - _loss(x, truth) for x in each]


#: Nats a row and in all by which a view must beat the share of ones on held-out rows in order to label for the other one; a view
#: of noise, calibrated on those rows, beats it by one nat in all, by four once in two hundred times.
LEAST_GAIN, LEAST_TOTAL = 0.01, 4.0


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, surest: Callable[[Model, list[Wish], list[set[int]]], list[Found]], rounds: int = 3, sure: float = 0.95, each: int = 200) -> Model:
    """y: 0 or 1.  Every fifth labelled row calibrates, combines and judges; the others train.

    surest(model, wishes, taken) answers each wish with the surest unlabelled rows whose names the learning view has
    not taken yet; only those at least ``sure`` are learnt.  A view that hardly beats the share of ones labels nothing; what a
    view has learnt in a round it keeps only if the combined log loss on held-out rows doesn't rise by it; rounds end when
    nothing new is kept."""
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:  # nothing to tell apart: everything scores the share of ones
        share = (y.sum() + 1) / (len(y) + 2)
        flat = lambda x: View(mean=np.zeros(x.shape[1]), scale=np.zeros(x.shape[1]), weights=np.append(np.zeros(x.shape[1]), np.log(share / (1 - share))))
        return Model(flat(content), flat(metadata), np.array([0.5, 0.5, 0.0]))
    views, truth = (content[held], metadata[held]), y[held].astype(float)
    own = [(x[~held], y[~held].astype(float)) for x in (content, metadata)]
    taken: list[set[int]] = [set(), set()]
    model, loss, gain = _combined(*(View().fit(*d) for d in own), views, truth)
    exchanged: list[tuple[int, int, float, int]] = []
    for turn in range(rounds):
        wishes = [(k, label, max(1, round(each * (y.mean() if label else 1 - y.mean())))) for k in (0, 1) if gain[k] > max(LEAST_GAIN, LEAST_TOTAL / len(truth)) for label in (1.0, 0.0)]
        told: list[list[tuple]] = [[], []]
        for (k, label, _), (names, *rows) in zip(wishes, surest(model, wishes, taken) if wishes else [], strict=True):
            odds = (model.text, model.meta)[k].log_odds(rows[k]) if len(names) else np.zeros(0)
            good = _sigmoid(odds if label else -odds) >= sure
            if good.any():
                told[1 - k].append((rows[1 - k][good], label, names[good]))
        kept = False
        for learner in (0, 1):
            if not told[learner]:
                continue
            x = np.vstack([own[learner][0], *(rows for rows, *_ in told[learner])])
            labels = np.concatenate([own[learner][1], *(np.full(len(rows), label) for rows, label, _ in told[learner])])
            taught = [model.text, model.meta]
            taught[learner] = View().fit(x, labels)
            new, new_loss, new_gain = _combined(*taught, views, truth)
            if new_loss <= loss:
                model, loss, gain, own[learner], kept = new, new_loss, new_gain, (x, labels), True
                taken[learner].update(n for *_, names in told[learner] for n in names.tolist())
                exchanged += [(turn, learner, label, len(rows)) for rows, label, _ in told[learner]]
        if not kept:
            break
    model.exchanged = exchanged
    return model


def _views(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the columns text, source and lang from column at on."""
    data, offsets = K.text_buffers(batch.column(at))
    source, lang = batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist()
    content, metadata = [], []
    for a, b in K.slices(offsets):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        content.append(content_features(part, local))
        newlines = np.searchsorted(np.flatnonzero(part == 0x0A), local)
        metadata.append(metadata_features(source[a:b], lang[a:b], np.diff(local), np.diff(newlines) + 1, layout_features(part, local)))
    return tuple(np.vstack(x) if x else np.zeros((0, w), np.float32) for x, w in zip((content, metadata), (CONTENT, METADATA), strict=True))


CONTENT, METADATA = BUCKETS + N_CLASSES + N_STATS, META_SOURCES + META_LANGS + 12 + LAYOUT


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, name, content, metadata): both views of every row, as bytes of 32-bit numbers; name: their hash.

    A null text counts as empty and has no content features; missing or null source and language count as
    empty; a null id stays null; repeated rows come back repeated; a text of any length is read whole; an empty
    table gives no rows; other columns are ignored."""

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, metadata = ([x.tobytes() for x in view] for view in _views(batch, 1))
            names = [xxhash.xxh64_intdigest(a + b) - 2**63 for a, b in zip(content, metadata, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(content, pa.binary()), pa.array(metadata, pa.binary())], ["doc_id", "name", "content", "metadata"])

    have = set(docs.columns)
    typed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("source", "lang")])
    return typed.mapInArrow(run, "doc_id long, name long, content binary, metadata binary")


def _read(batch: pa.RecordBatch | pa.Table, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The views in the columns from at on."""
    return tuple(np.frombuffer(b"".join(batch.column(at + i).to_pylist()), np.float32).reshape(-1, w).astype(float) for i, w in enumerate((CONTENT, METADATA)))


def surest_rows(rows: DataFrame, model: Model, wishes: list[Wish], taken: list[set[int]]) -> list[Found]:
    """For each wish the surest of all distinct rows of features that its learner has not taken; of equally sure ones the least names.

    Every task keeps the surest n of its rows, so what leaves it is bounded by the wishes alone."""

    def best(names: np.ndarray, surety: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((names, -surety))
        _, first = np.unique(names[order], return_index=True)  # equal rows are one
        return order[np.sort(first)[:n]]

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table | None] = [None] * len(wishes)
        for batch in batches:
            names = batch.column(0).to_numpy()
            odds = model.views(*_read(batch, 1))
            for i, (k, label, n) in enumerate(wishes):
                surety = np.round(_sigmoid(odds[k] if label else -odds[k]), 9)
                old = np.flatnonzero(np.isin(names, list(taken[1 - k]), invert=True))
                pick = old[best(names[old], surety[old], n)]
                new = pa.Table.from_batches([batch]).take(pick).append_column("surety", pa.array(surety[pick]))
                both = new if held[i] is None else pa.concat_tables([held[i], new])
                held[i] = both.take(best(both.column("name").to_numpy(), both.column("surety").to_numpy(), n))
        for i, table in enumerate(held):
            if table is not None:
                yield from table.append_column("wish", pa.array(np.full(table.num_rows, i, np.int32))).combine_chunks().to_batches()

    kept = checkpointed(rows.select("name", "content", "metadata").mapInArrow(run, "name long, content binary, metadata binary, surety double, wish int"))
    out = []
    for i, (_, _, n) in enumerate(wishes):
        one = kept.where(F.col("wish") == i).groupBy("name").agg(F.max("surety").alias("surety"), F.first("content").alias("content"), F.first("metadata").alias("metadata"))
        table = one.orderBy(F.desc("surety"), "name").limit(n).toArrow()
        out.append((table.column("name").to_numpy(), *_read(table, 2)))
    return out


def fit(rows: DataFrame, labels: DataFrame, max_labelled: int = 6000, label_col: str = "quality", label_id: str = "doc_id", **options) -> Model:
    """A model from rows of features and a table of labels; the same in every run.

    Training takes at most ``max_labelled`` labelled documents, those of the least hashed ids; pseudo-labels come
    from all other rows.  Labels other than 0 and 1 and null ids are left out; of an id's contradicting labels 1
    wins; of rows with one id that of the least features is taken; labels without a document are ignored.  Without two different
    labels everything scores the share of ones."""
    label = F.col(f"`{label_col}`").cast("int")
    ids = F.col(f"`{label_id}`").cast("long")
    usable = labels.select(ids.alias("doc_id"), label.alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = checkpointed(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))  # at most max_labelled rows of two numbers are broadcast
    met = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("content", "metadata")).alias("x"))
    table = met.select("label", "x.content", "x.metadata").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    content, metadata = _read(table, 1)
    rest = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    return co_train(content, metadata, table.column("label").to_numpy(), lambda *w: surest_rows(rest, *w), **options)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) for every row of features; kept: score is one half or more."""

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, meta, both = model.scores(*_read(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text), pa.array(meta), pa.array(both), pa.array(both >= 0.5)], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return rows.select("doc_id", "content", "metadata").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def classified(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of all documents by a model fitted on those that have labels; see features, fit and score."""
    rows = stored(features(docs))
    return score(rows, fit(rows, labels, **options))
