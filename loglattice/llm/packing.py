"""Hierarchical packing of documents into sequences of several context sizes.

Method. A document is cut into full windows of the largest size; what remains is routed to the smallest
context size that holds it. Each tier is then packed, longest first: a remainder opens a window of its
tier, and the gap is filled with the best fit from the same or shorter tiers; a gap of more than `max_gap`
tokens for which nothing fits takes the head of the shortest piece, whose tail stays in its tier. Windows
below the largest size are filled to the last token. The last, partial window is split over the smaller
sizes. Finished sequences are dealt to step groups in order of their attention cost, forward and backward
in turn, so that all steps of a group carry nearly equal work.

Packing runs inside each partition over a bounded number of tokens at a time, while the texts are
tokenised: token ids are never shuffled, and one partition leaves at most one partly padded sequence for
each `batch_tokens` of its text.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STOPS, END = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b"\xff"
TIERS = (256, 512, 1024, 2048)
PIECES = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long, context int, step_id long"


class Words(dict):
    """Token ids, as bytes, of blank-separated chunks.

    No token of this tokenizer crosses a blank, so a text is the chain of its chunks. A chunk of Latin
    letters, with or without ASCII punctuation behind it, is one word of the tokenizer: its merges, read
    from the same file, are applied by a merge engine without the bookkeeping of offsets, which takes most
    of the time otherwise. All other chunks go through the tokenizer itself. Both give the same ids; the
    tests compare them on whole texts. At most `size` chunks are remembered.
    """

    def __init__(self, path: str, size: int):
        from tokenizers import Tokenizer

        self.encode, self.size = Tokenizer.from_file(path).encode, size
        self.merge, self.known = merge_engine(path)
        self.tail = lru_cache(maxsize=10_000)(self.ids)

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.lower()
        word = low.rstrip(STOPS)
        if self.merge and word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            ids = b"".join(map(self.known.__getitem__, self.merge(word.encode() + END)))
            if len(word) < len(low):
                ids += self.tail(low[len(word) :])
        else:
            ids = self.ids(chunk)
        if len(self) < self.size and len(chunk) <= 64:
            self[chunk] = ids
        return ids


def merge_engine(path: str):
    """(merge, ids): the merges of a byte-level BPE file with end-of-word marks, ranked for tiktoken.

    The mark becomes a byte that no UTF-8 text holds and joins the last byte of a word before anything else.
    ids gives the file's id of each rank, as four bytes. (None, None) for a file of another kind, or where two merges give
    the same token, as the engine would not tell them apart.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or "th" not in model["vocab"]:
        return None, None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    byte = {c: b for b, c in shown.items()}

    def raw(token: str) -> bytes:
        return bytes(byte[c] for c in token.removesuffix("</w>")) + END * token.endswith("</w>")

    ordered = [shown[b] for b in range(255)] + [None] + [shown[b] + "</w>" for b in range(255)]
    ordered += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ranks = {END if token is None else raw(token): rank for rank, token in enumerate(ordered)}
    if len(ranks) != len(ordered):
        return None, None
    engine = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    return engine._core_bpe.encode_single_piece, [b"" if t is None else model["vocab"][t].to_bytes(4, "little") for t in ordered]


@lru_cache(maxsize=2)
def known_words(path: str, size: int) -> Words:
    return Words(path, size)


def token_bytes(texts: list[str | None], words: Words, end_id: int) -> list[bytes]:
    """Little-endian 32-bit ids of each text with the closing id."""
    end = end_id.to_bytes(4, "little")
    return [b"".join(map(words.__getitem__, t.replace("\n", " ").split(" "))) + end if t else end for t in texts]


class Shelf:
    """Pieces by length, with a bit per length that is in stock, so the best fit is one step."""

    def __init__(self):
        self.by_length, self.stock = defaultdict(list), 0

    def put(self, piece: tuple[int, int, int]) -> None:
        self.by_length[piece[2]].append(piece)
        self.stock |= 1 << piece[2]

    def take(self, length: int) -> tuple[int, int, int]:
        row = self.by_length[length]
        piece = row.pop()
        if not row:
            self.stock &= ~(1 << length)
        return piece

    def longest(self, limit: int) -> int:
        """Greatest length in stock up to `limit`; 0 if none."""
        return (self.stock & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.stock & ((1 << (limit + 1)) - 1) else 0

    def shortest(self) -> int:
        return (self.stock & -self.stock).bit_length() - 1 if self.stock else 0

    def fit(self, gap: int) -> int:
        """An exact fit, else a length whose rest is in stock too, else the longest that fits."""
        best = length = self.longest(gap)
        if best == gap:
            return best
        for _ in range(48):
            if not length:
                break
            rest = gap - length
            if self.stock >> rest & 1 and (rest != length or len(self.by_length[length]) > 1):
                return length
            length = self.longest(length - 1)
        return best


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS, max_gap: int = 16) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (context, pieces), a piece being (document, start, length), for documents of these lengths."""
    largest, done, shelf = tiers[-1], [], Shelf()
    for doc, n in enumerate(lengths):
        for start in range(0, n - largest + 1, largest):
            done.append((largest, [(doc, start, largest)]))
        if n % largest:
            shelf.put((doc, n - n % largest, n % largest))
    left = sum(n % largest for n in lengths)
    # every tier from the longest down; a window is opened only while there is enough to fill it
    for context, low in zip(tiers[:0:-1], tiers[-2::-1], strict=True):
        while left >= context and (seed := shelf.longest(context)) > low:
            done.append((context, _window(shelf, context, seed, max_gap if context == largest else 0)))
            left -= sum(p[2] for p in done[-1][1])
    for context in reversed(tiers):
        while left >= context:
            done.append((context, _window(shelf, context, shelf.longest(context), max_gap if context == largest else 0)))
            left -= sum(p[2] for p in done[-1][1])
    if left:
        done.append((largest, [shelf.take(shelf.shortest()) for _ in iter(lambda: shelf.stock, 0)]))
    return done


def _window(shelf: Shelf, context: int, seed: int, max_gap: int) -> list[tuple[int, int, int]]:
    pieces, gap = [], context
    if seed:
        pieces.append(shelf.take(seed))
        gap -= seed
    while gap > 0:
        if length := shelf.fit(gap):
            pieces.append(shelf.take(length))
            gap -= length
        elif gap <= max_gap or not shelf.stock:
            break
        else:
            doc, start, length = shelf.take(shelf.shortest())
            pieces.append((doc, start, gap))
            shelf.put((doc, start + gap, length - gap))
            gap = 0
    return pieces


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], per_step: int) -> list[int]:
    """A step for each sequence: dealt by attention cost, there and back, so steps carry like work."""
    steps = max(1, -(-len(sequences) // per_step))
    cost = [sum(p[2] ** 2 for p in pieces) for _, pieces in sequences]
    out = [0] * len(sequences)
    for rank, i in enumerate(sorted(range(len(sequences)), key=lambda i: -cost[i])):
        lap, at = divmod(rank, steps)
        out[i] = at if lap % 2 == 0 else steps - 1 - at
    return out


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, max_gap: int = 16, per_step: int = 64,
    batch_tokens: int = 4_000_000, cached_words: int = 250_000,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, tokens (32-bit little-endian ids), doc_tokens,
    sequence_id, offset, context (the size of the sequence) and step_id.

    Null and empty texts hold the closing id alone. Each row is a document of its own, repeats included.
    A sequence of the largest context may lack up to `max_gap` tokens, and the last one of a batch more;
    smaller contexts are always full. An empty table gives no piece. `batch_tokens` bounds the memory of a
    task besides its longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, first, first_step = known_words(tokenizer, cached_words), TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36
        ids, tokens = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                block = batch.slice(at, 512)
                ids += block.column(0).to_pylist()
                tokens += token_bytes(block.column(1).to_pylist(), words, end_id)
                if sum(map(len, tokens)) >= 4 * batch_tokens:
                    done = yield from emit(ids, tokens, first, first_step)
                    first, first_step, ids, tokens = *done, [], []
        if ids:
            yield from emit(ids, tokens, first, first_step)

    def emit(ids, tokens, first, first_step):
        sequences = pack_lengths([len(t) // 4 for t in tokens], tiers, max_gap)
        steps = step_groups(sequences, per_step)
        rows: list[tuple] = []
        for k, (context, pieces) in enumerate(sequences):
            at = 0
            for doc, start, length in pieces:
                rows.append((ids[doc], start, length, tokens[doc][4 * start : 4 * (start + length)], len(tokens[doc]) // 4, first + k, at, context, first_step + steps[k]))
                at += length
                if len(rows) == 4096:
                    yield to_batch(rows)
                    rows = []
        if rows:
            yield to_batch(rows)
        return first + len(sequences), first_step + max(steps, default=0) + 1

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


