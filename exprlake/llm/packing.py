"""Packing of token streams into fixed windows by Karmarkar-Karp multiway differencing.

A document is cut into whole windows from its start, and what is left over into pieces of at most ``grain``
tokens. Each task gathers a bounded batch of those pieces and partitions it into the fewest windows that
could hold them: the pieces, largest first, form partial partitions of ``k`` sums; the two partial
partitions of largest imbalance are merged again and again, the large sums of one meeting the small sums of
the other, until one partition is left. When a window then exceeds the capacity, ``k`` rises and the batch
is differenced anew.

The work is one pass over the text without a shuffle. A task holds one batch of pieces, however large its
input is, and a retried task makes the same windows.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.llm.common import names as column_names
from exprlake.llm.common import kept

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k-1) of each size, by largest differencing over ``k`` sums."""
    order = np.argsort(-sizes, kind="stable")
    heap: list[tuple[int, int, np.ndarray]] = []
    slots = np.zeros(len(sizes), np.int64)  # slot of an item in its partial partition, through `moves` of the merges
    part_of = np.zeros(len(sizes), np.int64)
    members: dict[int, list[int]] = {}
    for n, i in enumerate(range(0, len(sizes), k)):
        index = order[i : i + k]
        sums = np.zeros(k, np.int64)
        sums[: len(index)] = sizes[index]
        slots[index] = np.arange(len(index))
        part_of[index] = n
        members[n] = [n]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n, sums))
    moves = {n: np.arange(k) for n in members}  # of each first partition: where its slots lie by now
    n = len(members)
    while len(heap) > 1:
        _, a, large = heapq.heappop(heap)
        _, b, small = heapq.heappop(heap)
        met = large + small[::-1]
        rank = np.argsort(-met, kind="stable")
        to = np.empty(k, np.int64)
        to[rank] = np.arange(k)
        for x in members[a]:
            moves[x] = to[moves[x]]
        for x in members[b]:
            moves[x] = to[k - 1 - moves[x]]
        members[n] = members.pop(a) + members.pop(b)
        sums = met[rank]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), n, sums))
        n += 1
    out = np.empty(len(sizes), np.int64)
    for x, to in moves.items():
        own = part_of == x
        out[own] = to[slots[own]]
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size such that no window exceeds ``capacity``; the count starts at its lower bound and rises."""
    if not len(sizes):
        return np.empty(0, np.int64)
    k = -(-int(sizes.sum()) // capacity)
    while True:
        at = difference(sizes, k)
        if np.bincount(at, sizes, k).max() <= capacity:
            return at
        k += max(1, k // 400)


class _Chunks(dict):
    """Token ids (as little-endian bytes) of text chunks between ASCII white space, remembered within a bound.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks in turn.
    """

    LIMIT = 1_000_000
    PART = 20_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def learn(self, chunks: set[bytes]) -> None:
        new = [x for x in chunks if x not in self]
        if len(self) + 2 * len(new) > self.LIMIT:
            self.clear()
            new = list(chunks)
        parts = {x: plain(x) for x in new}
        bare = list({y for x in parts.values() for y in x if y and y not in self})
        for i in range(0, len(bare), self.PART):
            part = bare[i : i + self.PART]
            found = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in part], add_special_tokens=False)
            self.update((x, array("I", e.ids).tobytes()) for x, e in zip(part, found, strict=True))
        for x, (stem, mark) in parts.items():
            if x not in self:
                self[x] = self[stem] + (self[mark] if mark else b"")


def plain(chunk: bytes) -> tuple[bytes, bytes]:
    """A chunk as a lower-case stem and a final mark that is a token run of its own; the ids are those of both in turn.

    The tokenizer lower-cases what it reads, but knows its special tokens, which hold "<|", by case.
    """
    if b"<|" in chunk:
        return chunk, b""
    chunk = chunk.lower()
    if chunk[-1:] in b".,;:?!" and chunk[-2:-1].isalnum():
        return chunk[:-1], chunk[-1:]
    return chunk, b""


def token_ids(texts: list[str | None], tokenizer: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; ``tokenizer`` names a file of ``public_tokenizers``."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the texts out already
    path = public_tokenizers.path(tokenizer)
    known = kept(f"chunks of {path}", lambda: _Chunks(path))
    for i in range(0, len(texts), 200):
        split = [(x or "").encode("utf-8", "replace").split() for x in texts[i : i + 200]]
        known.learn(set().union(*split))
        for chunks in split:
            yield b"".join(map(known.__getitem__, chunks))


def pack(
    docs: DataFrame, capacity: int = 2048, grain: int = 512, batch_pieces: int = 16_384, tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of all documents and their windows.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece. Each document's ids (those of the
    tokenizer, then ``end_id``) lie in exactly one piece each; a null or empty text is the end id alone. Repeated rows
    are packed once each and can be told apart by their sequence and offset only. Ties of size go by order of arrival.
    A null key is kept. Extra columns are not read. ``sequence_id`` is unique, not dense: the task in the high bits.

    ``batch_pieces`` bounds the left-over pieces that are differenced together, ``grain`` their length.
    """
    if not 0 < grain <= capacity:
        raise ValueError("grain must lie between 1 and capacity")

    columns = column_names(PIECES)
    types = pa.schema([(x, pa.int64()) for x in columns])
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        whole: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = list(whole)
            if held:
                at = windows(np.asarray([x[2] for x in held], np.int64), capacity)
                filled: dict[int, int] = {}
                for i in np.argsort(at, kind="stable").tolist():
                    w = int(at[i])
                    offset = filled.get(w, 0)
                    rows.append((*held[i], sequence + w, offset))
                    filled[w] = offset + held[i][2]
                sequence += int(at.max()) + 1
            whole.clear()
            held.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=types)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(keys, token_ids(texts, tokenizer), strict=True):
                ids += end
                total = len(ids) // 4
                start = 0
                while start < total:
                    length = capacity if total - start >= capacity else min(grain, total - start)
                    piece = (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total)
                    if length == capacity:
                        whole.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        held.append(piece)
                    start += length
                if len(held) >= batch_pieces or len(whole) >= batch_pieces:
                    yield from flush()
        yield from flush()

    narrow = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"))
    return narrow.mapInArrow(run, PIECES)
