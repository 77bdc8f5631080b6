"""Packing of tokenized documents into windows by Karmarkar-Karp multiway differencing.

Each task packs the documents it reads and keeps only one group of open pieces in memory. A document's full windows stand
alone; its rest is cut into pieces. Once the open pieces fill ``ways`` windows less a small slack, differencing deals them
out: the two partial partitions with the largest imbalance are merged, the fullest window of one onto the emptiest of the
other, until one partition of near-equal windows is left. Whenever its fullest window exceeds the capacity, the number of
windows rises and the group is dealt anew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
WAYS = 32
PIECE = 256
SLACK = 12
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary on this machine; every machine has the same."""
    import public_tokenizers

    return public_tokenizers.path(name)


def difference(sizes: list[int], ways: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal sizes into ``ways`` near-equal sums: the window of each size, and the sums by window."""
    heap, sums, made = [], [], []
    for n, size in enumerate(sizes):
        row = np.zeros(ways, np.int64)
        row[0] = size
        sums.append(row)
        heap.append((-int(size), n))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        row = sums[a] + sums[b][::-1]
        order = np.argsort(-row, kind="stable")
        row = row[order]
        made.append((a, b, order))
        sums[a] = sums[b] = None
        sums.append(row)
        heapq.heappush(heap, (-int(row[0] - row[-1]), len(sums) - 1))
    # from the last merge back to the sizes: which window each slot of a partial partition became
    slots = {len(sums) - 1: np.arange(ways)}
    for n in range(len(made) - 1, -1, -1):
        a, b, order = made[n]
        at = slots.pop(len(sizes) + n)
        left, right = np.empty(ways, np.int64), np.empty(ways, np.int64)
        left[order] = at
        right[ways - 1 - order] = at
        slots[a], slots[b] = left, right
    window = np.array([slots[n][0] for n in range(len(sizes))], np.int64)
    return window, np.bincount(window, weights=sizes, minlength=ways).astype(np.int64)


def deal(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each size: as few windows as differencing fits within the capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        window, sums = difference(sizes, ways)
        if sums.max() <= capacity:
            return window
        ways += 1


class _Words:
    """Ids by word. White space never enters a token, so a text's ids are those of its words in order."""

    KEEP = 1_000_000  # words a worker holds; emptying the store only costs time
    _made: dict[str, _Words] = {}  # a reused worker goes on with its words

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    @classmethod
    def at(cls, path: str) -> _Words:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)  # of the word before each

    def _learn(self, new: list[bytes]) -> None:
        words = [w.decode() for w in new]
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        at = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])  # first character of each word
        ids = np.array(e.ids, np.uint32)
        of = np.searchsorted(at, np.array([o[0] for o in e.offsets], np.int64), "right") - 1
        have, n = len(self.known), int(self.ends[len(self.known)])
        while len(self.flat) < n + len(ids):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while len(self.ends) < have + len(new) + 1:
            self.ends = np.resize(self.ends, 2 * len(self.ends))
        self.flat[n : n + len(ids)] = ids
        self.ends[have + 1 : have + len(new) + 1] = n + np.cumsum(np.bincount(of, minlength=len(new)))
        self.known.update(zip(new, range(have, have + len(new))))

    @staticmethod
    def _split(text: bytes) -> list[bytes]:
        # the vocabulary folds case; before a combining mark or in a special token that may not be the same as folding first
        plain = b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text
        return (text.lower() if plain else text).split()

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.known) > self.KEEP:
            self._clear()
        split = [self._split(t) for t in texts]
        known = self.known
        if new := list(dict.fromkeys(w for words in split for w in words if w not in known)):
            self._learn(new)
        out = []
        for words in split:
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            starts = self.ends[at]
            n = self.ends[at + 1] - starts
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ways: int = WAYS, piece: int = PIECE, slack: int = SLACK, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it comes from in its document, and where it lies in its sequence.

    ``docs`` needs doc_id and text; other columns are ignored. A null or empty text is the end id alone. Each row is a
    document of its own, repeated ids and rows included; a null id stays null. No rows give no pieces. Sequence ids are
    unique, not gapless: the task's number in the high bits. A text of any length is cut at the capacity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words.at(tokenizer)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 33
        open_rows: list[tuple] = []
        room = full = ways * (capacity - slack)
        done: list[tuple] = []

        def close() -> None:
            nonlocal sequence, open_rows, room
            if open_rows:
                window = deal([r[2] for r in open_rows], capacity)
                filled: dict[int, int] = {}
                for row, w in zip(open_rows, window.tolist()):
                    done.append((*row, sequence + w, filled.get(w, 0)))
                    filled[w] = filled.get(w, 0) + row[2]
                sequence += int(window.max()) + 1
            open_rows, room = [], full

        def rows() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = list(zip(*done)) if done else [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 64):
                for doc, ids in zip(batch.column("doc_id")[at : at + 64].to_pylist(), words.ids(texts[at : at + 64])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    start, total = 0, len(ids)
                    while start < total:
                        whole = total - start >= capacity
                        size = capacity if whole else min(piece, total - start, room)
                        row = (doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), total)
                        if whole:
                            done.append((*row, sequence, 0))
                            sequence += 1
                        else:
                            open_rows.append(row)
                            room -= size
                        start += size
                        if not room:
                            close()
            if done:
                yield rows()
        close()
        if done:
            yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
