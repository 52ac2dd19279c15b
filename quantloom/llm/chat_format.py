"""Chat formatting of typed content parts.

A turn's content is a list of parts: text, image, audio or document.  A visitor flattens them in
order; attachments become placeholders, with a record of what they refer to, where they stand and
how many tokens they expand to.  The template's control strings inside texts and roles are escaped
by a backslash, reversibly, so no text can open or close a turn.

One row is one turn: a conversation's formatted text is its turns' pieces in order, and no
conversation is ever gathered in one place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<ordinal:int,kind:string,ref:string,at:int,tokens:bigint>>"
IMAGE_PATCH, AUDIO_TOKENS_A_SECOND, PAGE_TOKENS = 28, 25, 576
#: Where one of the template's control strings begins, or a backslash.
_CONTROL = re.compile(r"(?:[<\[](?=\||s>|/s>|INST\]|/INST\])|\|(?=>)|\\)")


def escape(text: str) -> str:
    """Double backslashes and put one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\\\|(?<=[<\[|])\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


class PartVisitor:
    """Flattens one turn's parts; ``at`` counts code points from the turn's content on."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.at = 0
        self.attachments: list[dict] = []
        self.texts: list[str] = []

    def visit(self, part: dict | None) -> None:
        if part is not None:
            kind = part.get("kind") or "text"
            method = getattr(self, f"visit_{kind}", None)
            if method is None:
                raise ValueError(f"content parts are text, image, audio or document, not {kind!r}")
            method(part)

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.texts.append(text)
        self._put(escape(text))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref"), "at": self.at, "tokens": tokens})
        self._put(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        sides = [math.ceil((part.get(k) or IMAGE_PATCH) / IMAGE_PATCH) for k in ("width", "height")]
        self._attach("image", part, sides[0] * sides[1])

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, PAGE_TOKENS * max(1, part.get("pages") or 1))


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def as_parts(conversations: DataFrame, text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, parts) of a table whose turns are plain texts, a row for each row; a null text is a part of null text,
    which counts as empty; nulls in other columns stay; an empty table gives an empty result; other columns are ignored."""
    part = F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return conversations.select("conv_id", "turn", "role", F.array(part).cast(PARTS).alias("parts"))


def format_turns(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(conv_id, turn, piece, loss_start, loss_end, attachments, n_tokens) for each turn.

    piece: ``<|role|>`` and the flattened parts; an assistant's ends with ``</s>`` and its content is
    the loss span, in code points of the piece; any other stands between ``[INST]`` and ``[/INST]``
    and has an empty span.  n_tokens: tokens of the texts (with a tokenizer, else 0) and of the
    expanded attachments.  A null role counts as empty, null parts as none; repeated rows come back
    repeated; an empty table gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                visitor = PartVisitor()
                for part in parts or ():
                    visitor.visit(part)
                assistant = role == "assistant"
                head = ("" if assistant else "[INST]") + f"<|{escape(role or '')}|>"
                content = "".join(visitor.out)
                tokens = sum(a["tokens"] for a in visitor.attachments)
                if tokenizer_path:
                    tokens += sum(len(e.ids) for e in _tokenizer(tokenizer_path).encode_batch(visitor.texts, add_special_tokens=False))
                for a in visitor.attachments:
                    a["at"] += len(head)
                rows.append((head + content + ("</s>" if assistant else "[/INST]"), len(head), len(head) + len(content) if assistant else len(head), visitor.attachments, tokens))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])), pa.int64())
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["conv_id", "turn", "piece", "loss_start", "loss_end", "attachments", "n_tokens"])

    typed = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("parts").cast(PARTS))
    return typed.mapInArrow(run, f"conv_id long, turn long, piece string, loss_start int, loss_end int, attachments {ATTACHMENTS}, n_tokens long")


_PIECE = re.compile(r"(?s)(?:\[INST\])?<\|(.*?)\|>(.*)(?:</s>|\[/INST\])\Z")


def read_piece(piece: str | None) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay as they are.  A null piece has an empty role and text."""
    if piece is None:
        return "", ""
    role, content = _PIECE.fullmatch(piece).groups()
    return unescape(role), unescape(content)


def read_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, chars), read back from the formatted pieces alone.

    A null piece reads as an empty role and text of no characters, a null end of the loss span as no loss; repeated rows come back
    repeated; an empty table gives an empty result; other columns are ignored.  What format_turns makes of null roles and texts
    reads as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            role, text = zip(*map(read_piece, texts), strict=True) if texts else ((), ())
            loss = ["" if None in (t, a, b) else unescape(t[a:b]) for t, a, b in zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(loss, pa.string()), pa.array([len(t or "") for t in texts], pa.int64())], ["conv_id", "turn", "role", "text", "loss_text", "chars"])

    return pieces.select("conv_id", "turn", "piece", "loss_start", "loss_end").mapInArrow(run, "conv_id long, turn long, role string, text string, loss_text string, chars long")


def digests(turns: DataFrame) -> DataFrame:
    """Digests of each conversation's turns, in order of turn, role and text.

    A task reads its conversations in sorted order and keeps only running hashes, so that a
    conversation of any length takes no memory.  A null id is a conversation of its own, a null role or text counts as
    empty; turns of equal number follow each other by role and text, repeated rows count each; an empty table
    gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        def row() -> list:
            return [now, n, turn_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars]

        now, n = None, 0
        for batch in batches:
            out = []
            for conv, role, text, loss, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                role, text, loss, size = role or "", text or "", loss or "", size or 0
                if n and conv != now:
                    out.append(row())
                    n = 0
                if not n:
                    now, turn_hash, loss_hash, loss_chars, chars = conv, sha256(), sha256(), 0, 0
                turn_hash.update(f"{role}\n{text}\n".encode())
                loss_hash.update(loss.encode())
                n, loss_chars, chars = n + 1, loss_chars + len(loss), chars + size
            yield _digest_rows(out)
        yield _digest_rows([row()] if n else [])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text", "loss_text", "chars").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
