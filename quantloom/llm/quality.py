"""Line-first quality cleaning.

Every line is judged on its own by punctuation, navigation and boilerplate rules; lines that fail
are removed; a document that loses too much of its text that way, or that fails the document rules
(too short, too repetitive), is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean

_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"
_NOISY = re.compile(rb"[#*$%&|<>]|!!|\?\?|\.\.\.\.")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = frozenset([b"|", b">", b"/", b"::", *(x.encode() for x in "»•·")])
_ENDS = tuple(x.encode() for x in ".!?:;…。！？\"'”’»)]")
#: Phrases of pages rather than of texts, in the corpus's languages.
BOILERPLATE = (
    "all rights reserved|privacy policy|terms of use|terms of service|cookie|javascript|lorem ipsum|subscribe to our|sign up for|click here|read more"
    "|alle rechte vorbehalten|datenschutzerkl|tous droits réservés|politique de confidentialité|todos los derechos reservados|política de privacidad"
)
_BOILERPLATE = re.compile(BOILERPLATE.encode())


@dataclass(frozen=True)
class LineRules:
    """min_words, max_repeat_percent: the document rules.  max_noisy, max_upper: shares of a line's words
    with symbols or doubled marks, or in capitals.  min_marks, mark_share: separators that make a line
    navigation.  max_lost: the share of words a document may lose."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_noisy: float = 0.3
    max_upper: float = 0.6
    min_marks: int = 3
    mark_share: float = 0.2
    max_lost: float = 0.4


def line_fault(line: bytes, words: list[bytes], rules: LineRules) -> str | None:
    """The first rule a line with words fails."""
    n = len(words)
    marks = sum(map(_MARKS.__contains__, words))
    if marks >= rules.min_marks and marks >= rules.mark_share * n:
        return "navigation"
    if _NOISY.search(line) and sum(1 for w in words if _NOISY.search(w)) > rules.max_noisy * n:
        return "punctuation"
    if n >= 4 and 3 * len(line.translate(None, _CAPITALS)) < 2 * len(line) and sum(w.isupper() and len(w) > 1 for w in words) > rules.max_upper * n:
        return "punctuation"
    if n >= 8 and not words[-1].endswith(_ENDS) and b"." not in line:
        return "punctuation"
    if _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def judge_text(text: str, rules: LineRules) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    data = text.encode("utf-8", "replace")
    lines = [(line, line.split()) for line in data.split(b"\n")]
    words = [w for _, of_line in lines for w in of_line]
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, _SEPARATORS)))
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        until = 0  # words before this place are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    base_failed = n < rules.min_words or 100 * repeated > rules.max_repeat_percent * n
    earlier: set[bytes] = set()
    stay, lost, n_dup = [], 0, 0
    for line, of_line in lines:
        fault = None
        if of_line:
            if line in earlier:
                n_dup += 1
                fault = "boilerplate"
            else:
                earlier.add(line)
                fault = line_fault(line, of_line, rules)
        if fault:
            lost += len(of_line)
        else:
            stay.append(line)
    return n, word_chars, n_symbols, n_dup, repeated, base_failed, not base_failed and lost <= rules.max_lost * n, b"\n".join(stay).decode()


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
_KINDS = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()]
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, cleaned string"


def _judged(texts: list[str | None], rules: LineRules) -> list[pa.Array]:
    rows = [judge_text(t or "", rules) for t in texts]
    return [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, _KINDS, strict=True)]


def judge_documents(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept, cleaned) for every row, in one pass without a shuffle.

    Null and empty texts have no words and fail the base rules.  Repeated rows come back repeated; an
    empty table gives an empty result; other columns are ignored.  A text is judged as a whole."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *_judged(batch.column(1).to_pylist(), rules)], ["doc_id", *_NAMES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {_SCHEMA}")


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of docs that are kept, with their failing lines removed from text; other columns stay.

    Null, empty and wordless texts are not kept; null ids and clashing names don't matter; repeated rows are judged each
    for itself, with one verdict; a text of any length is judged whole; an empty table gives an empty result."""
    at, names = docs.columns.index("text"), docs.columns

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, kept, cleaned = _judged(batch.column(at).to_pylist(), rules)
            columns = [cleaned if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names).filter(kept)

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
