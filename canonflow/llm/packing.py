"""Packing by Karmarkar-Karp multiway differencing.

Documents are packed in groups of about `group_tokens` tokens, each group
within its task.  Of a document longer than a window, whole windows are cut
off first, and the rest, since it is cut anyway, may be cut again.  The other
documents start as partial partitions of k windows with one document each;
the two with the largest differences between their windows are merged again
and again, the fullest windows of one with the emptiest of the other, until
one partition is left whose windows are nearly equal.  If a window exceeds the
capacity, the number of windows rises by one and all is merged anew.  Rests of
long documents then fill the windows to the brim.

Where a rise by `rise_share` is not enough (documents of a bit more than half
a window would leave the other half empty), the longest documents are filled
in like the rests, and the count starts from the least again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import word_tokenizer

CAPACITY = 4096
OUT_BYTES = 8 << 20


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indices of `sizes` in k windows of nearly equal sums."""
    if not sizes:
        return [[] for _ in range(k)]
    if k == 1:
        return [list(range(len(sizes)))]
    n = len(sizes)
    after = np.full(n, -1)  # pieces of a window are a chain
    # a partition: the differences of its windows above the emptiest, in falling order, and first and last piece of each; windows left out are empty
    heap = [(-s, i, np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a, a_first, a_last = heapq.heappop(heap)
        _, _, b, b_first, b_last = heapq.heappop(heap)
        free = k - len(a)
        # a's fullest window meets b's emptiest: b's windows in rising order take the last places
        over = len(b) - free
        if over > 0:
            tail = np.arange(len(a) - over, len(a))
            met = np.arange(len(b) - 1, len(b) - 1 - over, -1)
            first, last, total = a_first.copy(), a_last.copy(), a.copy()
            has_a, has_b = a_first[tail] >= 0, b_first[met] >= 0
            both = has_a & has_b
            after[a_last[tail][both]] = b_first[met][both]
            first[tail] = np.where(has_a, a_first[tail], b_first[met])
            last[tail] = np.where(has_b, b_last[met], a_last[tail])
            total[tail] += b[met]
            rest = slice(0, len(b) - over)
            total, first, last = np.concatenate([total, b[rest]]), np.concatenate([first, b_first[rest]]), np.concatenate([last, b_last[rest]])
        else:
            total, first, last = np.concatenate([a, b]), np.concatenate([a_first, b_first]), np.concatenate([a_last, b_last])
        order = np.argsort(-total, kind="stable")
        total, first, last = total[order], first[order], last[order]
        least = total[-1] if len(total) == k else 0
        total = total - least
        heapq.heappush(heap, (-int(total[0]), count, total, first, last))
        count += 1
    windows = []
    for head in heap[0][3].tolist():
        own = []
        while head >= 0:
            own.append(head)
            head = int(after[head])
        windows.append(own)
    return windows + [[] for _ in range(k - len(windows))]


def fill(sizes: list[int], capacity: int, rise_share: float) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length); every token of every size lies in one."""
    whole, solid, fluid = [], [], []
    for i, s in enumerate(sizes):
        at = s // capacity * capacity
        whole += [[(i, a, capacity)] for a in range(0, at, capacity)]
        if s > at:
            (fluid if at else solid).append((i, at, s - at))
    total = sum(n for _, _, n in solid + fluid)
    if not total:
        return whole
    solid.sort(key=lambda x: -x[2])
    least = k = -(-total // capacity)
    most, cut = max(least + 1, int(least * (1 + rise_share))), 0
    while True:
        parts = differencing([n for _, _, n in solid[cut:]], k)
        if max(sum(solid[cut + j][2] for j in w) for w in parts) <= capacity:
            break
        if k < most:
            k += 1
        else:  # more windows would pad more than that: the longest pieces are cut, as few as powers of two tell
            k, cut = least, max(1, 2 * cut)
    windows = [[solid[cut + j] for j in w] for w in parts]
    room = [capacity - sum(n for _, _, n in w) for w in windows]
    w = 0
    for i, at, n in fluid + solid[:cut]:
        while n:
            if fits := min(n, room[w]):
                windows[w].append((i, at, fits))
                at, n, room[w] = at + fits, n - fits, room[w] - fits
            if not room[w]:
                w += 1
    return whole + [x for x in windows if x]


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, group_tokens: int = 2_000_000, rise_share: float = 0.01, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of SCHEMA: the pieces of documents in sequences of at most `capacity` tokens; ids are unsigned 32-bit little-endian numbers.

    A document is its text's ids and `end_id`; null and empty texts are `end_id` alone. Rows that repeat or lack an id are
    packed like others. A document of `capacity` tokens or fewer is cut only where its group would otherwise pad more than
    `rise_share` and two sequences. sequence_id: the task's number times 2**32 and the sequence's number in it, so it is the
    same when a lost task runs again. Other columns are not read. No exchange; a task holds one group.
    """
    docs = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].cast("string").alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def write(ids: list, parts: list[np.ndarray], base: int) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        windows = fill([len(x) for x in parts], capacity, rise_share)
        for sequence, pieces in enumerate(windows):
            offset = 0
            for i, start, length in pieces:
                rows.append((ids[i], start, length, parts[i][start : start + length].astype("<u4").tobytes(), len(parts[i]), base + sequence, offset))
                offset += length
                held += 4 * length + 64
            if held > OUT_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)
        counted[0] = base + len(windows)

    counted = [0]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        counted[0] = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for at, to, tokens, first in tokenizer.chunks(batch.column(1)):
                for i, key in enumerate(batch.column(0).slice(at, to - at).to_pylist()):
                    own = tokens[first[i] : first[i + 1]]
                    ids.append(key)
                    parts.append(np.append(own, np.uint32(end_id)))
                    held += len(parts[-1])
                    if held >= group_tokens:
                        yield from write(ids, parts, counted[0])
                        ids, parts, held = [], [], 0
        if parts:
            yield from write(ids, parts, counted[0])

    return docs.mapInArrow(run, SCHEMA)
