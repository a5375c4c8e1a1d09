"""Vector bin packing of token sequences by the dot-product heuristic.

An example uses up three things in a sequence: tokens, one segment, and loss-bearing tokens. All three are
limited. A sequence is filled by taking, of the pieces that fit, the one whose demands have the largest dot
product with what is left, both as shares of the limits. When nothing fits, a piece is cut to fill the rest.

Each task packs its own rows: no shuffle, and memory for a pool of pieces of fixed size.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

END_OF_TEXT = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def token_ids(text: str, ranks_path: str, pattern: str) -> list[int]:
    """Ids of a byte-level BPE; the end-of-text string in a text is one id."""
    enc = _encoder(ranks_path, pattern)
    return enc.encode(text, allowed_special={END_OF_TEXT}) if END_OF_TEXT in text else enc.encode_ordinary(text)


def first_lines(text: str, n: int) -> str:
    """The first n lines with their line ends; nothing if the text doesn't go on after them."""
    end = 0
    for _ in range(n):
        end = text.find("\n", end) + 1
        if not end:
            return ""
    return text[:end] if end < len(text) else ""


class Packer:
    """Takes examples one by one, yields finished sequences as lists of (id, start, ids, example tokens)."""

    NONE = 1 << 40

    def __init__(self, capacity: int, max_segments: int, max_loss: int, pool: int, min_piece: int):
        self.limits = (capacity, max_segments, max_loss)
        self.piece = min(capacity, max_loss)
        self.pool, self.min_piece = pool, min_piece
        slots = 2 * pool + 64
        # what a piece uses up: tokens (NONE in a free slot), loss-bearing tokens, and one segment
        self.tokens, self.loss = np.full(slots, self.NONE), np.zeros(slots, dtype=np.int64)
        self.items: list[tuple | None] = [None] * slots
        self.free = list(range(slots))
        self.held = 0

    def _put(self, item: tuple) -> None:
        i = self.free.pop()
        _, start, ids, _, loss_from = item
        self.items[i], self.tokens[i], self.loss[i] = item, len(ids), max(0, start + len(ids) - max(start, loss_from))
        self.held += 1

    def _take(self, i: int) -> tuple:
        item, self.items[i], self.tokens[i] = self.items[i], None, self.NONE
        self.free.append(i)
        self.held -= 1
        return item

    def add(self, ident, ids: np.ndarray, loss_from: int) -> Iterator[list[tuple]]:
        at, n = 0, len(ids)
        while n - at >= self.piece:
            whole = (ident, at, ids[at : at + self.piece], n, loss_from)
            if self.piece == self.limits[0]:
                yield [whole[:4]]
            else:
                self._put(whole)
                yield from self._shrink()
            at += self.piece
        if at < n:
            self._put((ident, at, ids[at:], n, loss_from))
            yield from self._shrink()

    def _shrink(self) -> Iterator[list[tuple]]:
        if self.held > 2 * self.pool:
            while self.held > self.pool:
                yield self._sequence()

    def rest(self) -> Iterator[list[tuple]]:
        while self.held:
            yield self._sequence()

    def _sequence(self) -> list[tuple]:
        (capacity, segments, max_loss), out = self.limits, []
        left, loss_left = capacity, max_loss
        while len(out) < segments and left and self.held:
            fits = (self.tokens <= left) & (self.loss <= loss_left)
            # demands times what is left, as shares of the limits; every piece takes one segment, so that part is the same for all
            score = self.tokens * (left / capacity**2) + self.loss * (loss_left / max_loss**2) + (segments - len(out)) / segments**2
            i = int(np.argmax(np.where(fits, score, -1.0)))
            if fits[i]:
                item = self._take(i)
            elif left >= self.min_piece:
                # the piece of which most still fits; its first tokens may be a prompt, which bears no loss
                most = np.where(self.tokens < self.NONE, np.minimum(np.minimum(self.tokens, left), self.tokens - self.loss + loss_left), 0)
                i = int(np.argmax(most))
                n = int(most[i])
                if n < self.min_piece or n == self.tokens[i]:
                    break
                ident, start, ids, total, loss_from = self._take(i)
                item = (ident, start, ids[:n], total, loss_from)
                self._put((ident, start + n, ids[n:], total, loss_from))
            else:
                break
            _, start, ids, _, loss_from = item
            left -= len(ids)
            loss_left -= max(0, start + len(ids) - max(start, loss_from))
            out.append(item[:4])
        return out


def pack_documents(
    docs: DataFrame,
    *,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    prompt_lines: int = 0,
    end_id: int = 0,
    capacity: int = 1024,
    max_segments: int = 256,
    max_loss: int = 1024,
    pool: int = 256,
    min_piece: int = 8,
) -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, n_loss, ids (little-endian unsigned 32-bit).

    An example is the ids of prompt_col (if given), then those of text_col, then end_id; prompt tokens bear no loss. The first
    prompt_lines lines of a longer text are prompt as well: as many tokens as they have by themselves. Null or
    empty texts are end_id alone. Every id lies in exactly one piece; longer examples than a sequence are cut, and so are
    pieces where a rest of min_piece or more would be padding. Pieces lie in a sequence without gaps from offset 0. The last sequence
    of a task may be short. sequence_id holds the task's partition and a count, so a task that runs again gives the same
    ids. Repeated rows are packed as rows of their own; empty tables give none; other columns are ignored.
    """
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "n_loss", "ids"]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, max_segments, max_loss, pool, min_piece)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        kind = None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(names)
            types = [kind, *[pa.int64()] * 6, pa.binary()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        def place(done: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for (ident, prompt), start, ids, total in done:
                rows.append((ident, start, len(ids), total, sequence, at, max(0, start + len(ids) - max(start, prompt)), ids.tobytes()))
                at += len(ids)
            sequence += 1

        for b in batches:
            kind = b.column(0).type
            prompts = b.column(2).to_pylist() if prompt_col else None
            for k, (ident, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                head = token_ids(prompts[k], ranks_path, pattern) if prompts and prompts[k] else []
                ids = np.array([*head, *(token_ids(text, ranks_path, pattern) if text else []), end_id], dtype="<u4")
                free = len(head) + (len(token_ids(first, ranks_path, pattern)) if text and (first := first_lines(text, prompt_lines)) else 0)
                for done in packer.add((ident, free), ids, free):
                    place(done)
                if len(rows) >= 2000:
                    yield flush()
        for done in packer.rest():
            place(done)
            if len(rows) >= 2000:
                yield flush()
        if rows:
            yield flush()

    columns = [id_col, text_col, *([prompt_col] if prompt_col else [])]
    return docs.select(*columns).mapInArrow(run, f"`{id_col}` {id_type}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, n_loss bigint, ids binary")
