"""Vector bin packing of token sequences.

An example is a row of ids; those from `loss_start` on bear loss. A sequence has
three limits at once: tokens, segments and loss-bearing tokens. The heuristic is
bin-centric: into the open sequence goes the waiting example that fits whole and
has the largest dot product between its demands and the room left, both as
shares of the limits. When none fits whole, and for the last segment, examples
are cut to the room that is left, and the piece with the largest dot product goes
in; its rest waits on. Examples longer than a sequence open one each time as
much of them as fits has come; where the loss limit leaves room beside it, ids
without loss of other examples fill it.

For plain documents the first CONTEXT ids give the model something to predict
from and bear no loss, as a prompt does; all others do. So text of long documents
fills a sequence up to the loss limit, and openings of others fill the rest.

Each task packs what it reads and keeps at most WINDOW examples waiting, so
memory is bounded, nothing is shuffled, and a lost task is redone alike. A
sequence that ends short (a limit other than tokens was met, or the task ended)
is cut into sequences of power-of-two lengths, which need no padding.

Defined cases: a null or empty text is the closing id alone; an added token
written out in a text is its one id, as the tokenizer file says; a null id stays
null; repeated rows are packed each; an empty table gives an empty one; other
columns are not read; limits below 1 are refused.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fractile.llm.common import map_frames, table

WINDOW = 2048
#: Characters that are encoded at once.
BATCH_CHARS = 4_000_000
#: Fixed value: how the vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 8
    loss: int = 1984

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError(f"limits must be 1 at least: {self}")


#: Ids at the beginning of a plain document that bear no loss.
CONTEXT = 64


@dataclass
class Piece:
    example: int
    start: int
    length: int


def bearing(piece: Piece, loss_start: int) -> int:
    """How many ids of a piece bear loss."""
    return max(0, piece.start + piece.length - max(piece.start, loss_start))


class Packer:
    """Packs examples one task's worth at a time; finished sequences go to `done` as lists of pieces."""

    def __init__(self, limits: Limits = Limits(), window: int = WINDOW) -> None:
        self.limits, self.window, self.done = limits, window, []
        self._scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], float)
        self._n = 0
        self._example = np.zeros(window, np.int64)
        self._start, self._left, self._loss_start = (np.zeros(window, np.int64) for _ in range(3))
        self._open: list[Piece] = []
        self._room = np.array([limits.tokens, limits.segments, limits.loss], np.int64)

    @property
    def waiting(self) -> set[int]:
        """Examples that are not wholly in finished sequences."""
        return set(self._example[: self._n].tolist()) | {p.example for p in self._open}

    def add(self, example: int, length: int, loss_start: int = 0) -> None:
        start = 0
        while length - start > (most := min(self.limits.tokens, max(0, loss_start - start) + self.limits.loss)):
            self._place(Piece(example, start, most), loss_start)
            if self._room[0] > 0:
                self._fill()
            else:
                self._close()
            start += most
        if length == start:
            return
        if self._n == self.window:
            self._fill()
        k = self._n
        self._example[k], self._start[k], self._left[k], self._loss_start[k] = example, start, length - start, loss_start
        self._n += 1

    def finish(self) -> None:
        while self._n:
            self._fill()

    def _place(self, piece: Piece, loss_start: int) -> None:
        self._open.append(piece)
        self._room -= (piece.length, 1, bearing(piece, loss_start))

    def _fill(self) -> None:
        """Put pieces of waiting examples into the open sequence until none fits, and close it."""
        while self._n and self._room[0] > 0 and self._room[1] > 0:
            n = self._n
            left = self._left[:n]
            before = np.maximum(0, self._loss_start[:n] - self._start[:n])  # ids without loss that come first
            size = np.minimum(left, np.minimum(self._room[0], self._room[2] + before))
            usable = size == left
            if self._room[1] == 1 or not usable.any():
                usable = size > 0
                if not usable.any():
                    break
            weight = self._room * self._scale * self._scale
            merit = size * weight[0] + weight[1] + np.maximum(0, size - before) * weight[2]
            k = int(np.argmax(np.where(usable, merit, -1.0)))
            taken = int(size[k])
            self._place(Piece(int(self._example[k]), int(self._start[k]), taken), int(self._loss_start[k]))
            if taken == left[k]:
                self._n -= 1
                for a in (self._example, self._start, self._left, self._loss_start):
                    a[k] = a[self._n]
            else:
                self._start[k] += taken
                self._left[k] -= taken
        self._close()

    def _close(self) -> None:
        used = self.limits.tokens - int(self._room[0])
        if used == self.limits.tokens:
            self.done.append(self._open)
        else:
            self.done.extend(_powers(self._open, used))
        self._open = []
        self._room[:] = (self.limits.tokens, self.limits.segments, self.limits.loss)


def _powers(pieces: list[Piece], total: int) -> Iterator[list[Piece]]:
    """The pieces again, cut into runs whose lengths are the powers of two in total, largest first."""
    rest = [Piece(p.example, p.start, p.length) for p in reversed(pieces)]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        run = []
        while size:
            p = rest[-1]
            take = min(size, p.length)
            run.append(Piece(p.example, p.start, take))
            size -= take
            if take == p.length:
                rest.pop()
            else:
                p.start, p.length = p.start + take, p.length - take
        yield run


#: Characters of white space in a row beyond which the fast splitter could run out of stack.
LONG_SPACE = 500_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """The ids of the byte-level tokenizer file at path.

    tiktoken merges the same vocabulary several times faster than the tokenizers
    library, but knows no added tokens and splits by recursion. Texts in which an
    added token is written out, or that hold very long white space, go to the
    tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in self.added}
        self._fast = tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._full = Tokenizer.from_file(path)

    def plain(self, text: str) -> bool:
        """Whether the fast way gives the same ids."""
        if any(a in text for a in self.added):
            return False
        return len(text) <= LONG_SPACE or max(map(len, re.split(r"\S+", text))) <= LONG_SPACE

    def encode(self, text: str) -> list[int]:
        if self.plain(text):
            return self._fast.encode_ordinary(text)
        return self._full.encode(text, add_special_tokens=False).ids


def load_encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(texts: list[str], path: str, end_id: int = 1) -> list[np.ndarray]:
    encode = load_encoder(path).encode
    return [np.array([*encode(t), end_id], dtype="<u4") for t in texts]


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"
_NAMES = ["doc_id", *[c.split()[0] for c in PIECES.split(", ")]]


def _pack_task(batches: Iterator[list[tuple[object, np.ndarray, int]]], limits: Limits, with_ids: bool) -> Iterator[pd.DataFrame]:
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 40
    packer, held, count = Packer(limits), {}, 0
    for batch in _with_end(batches):
        if batch is None:
            packer.finish()
        else:
            for doc_id, ids, loss_start in batch:
                held[count] = (doc_id, ids, loss_start)
                packer.add(count, len(ids), loss_start)
                count += 1
        rows = []
        for pieces in packer.done:
            offset = 0
            for p in pieces:
                doc_id, ids, loss_start = held[p.example]
                part = ids[p.start : p.start + p.length].tobytes()
                row = (doc_id, p.start, p.length, zlib.crc32(part), len(ids), sequence, offset, bearing(p, loss_start))
                rows.append((*row, part) if with_ids else row)
                offset += p.length
            sequence += 1
        packer.done = []
        waiting = packer.waiting
        held = {k: v for k, v in held.items() if k in waiting}
        if rows:
            yield pd.DataFrame(rows, columns=[*_NAMES, *["ids"] * with_ids])


def _with_end(batches):
    yield from batches
    yield None


def _slices(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    begin, chars = 0, 0
    for k, text in enumerate(texts):
        if chars + len(text) > BATCH_CHARS and k > begin:
            yield ids[begin:k], texts[begin:k]
            begin, chars = k, 0
        chars += len(text)
    yield ids[begin:], texts[begin:]


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, with_ids: bool = False, context: int = CONTEXT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss (how many of its ids bear loss), and with with_ids its ids as little-endian unsigned 32-bit binary. The first `context` ids of a document bear no loss."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def batches():
            for frame in frames:
                texts = ["" if t is None else t for t in frame["text"].tolist()]
                for some, part in _slices(frame["doc_id"].tolist(), texts):
                    yield [(i, ids, context) for i, ids in zip(some, encode_documents(part, tokenizer_path, end_id))]

        yield from _pack_task(batches(), limits, with_ids)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return map_frames(rows, task, "doc_id", PIECES + ", ids binary" * with_ids)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """The same for examples already in ids: columns doc_id, ids array<int>, loss_start (ids before it, as a prompt's, bear no loss)."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def batches():
            for frame in frames:
                yield [(i, np.asarray([] if x is None else x, "<u4"), 0 if pd.isna(s) else int(s)) for i, x, s in zip(frame["doc_id"], frame["ids"], frame["loss_start"])]

        yield from _pack_task(batches(), limits, with_ids)

    rows = examples.select(examples["doc_id"].cast("long").alias("doc_id"), "ids", "loss_start")
    return map_frames(rows, task, "doc_id", PIECES + ", ids binary" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str, tokenizer: Callable[[], str] = default_tokenizer) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer())
