"""Packed token-id output: best-fit-decreasing with a segment tree over remaining capacities.

Documents are encoded and end with an end id. Blocks of a whole capacity fill rows of their own; the
rests (overlong documents are split, never cut off) are packed by windows: in decreasing size, each
goes to the row with the least room that still holds it, which a segment tree over the capacities
finds in log(capacity) steps. A task keeps one window of rests at most and shuffles nothing.

Each result row is a row of the id matrix: ``ids`` holds ``capacity`` little-endian ids (unsigned 16
bits where the vocabulary fits, else 32), padded with ``PAD_ID``; ``cu_seqlens`` the cumulative
segment lengths from 0; ``position_resets`` the places where position ids start again from 0.

Defined results: null text counts as empty and still has its end id; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import read_table, text_or_empty
from sievemark.llm.packing import _task
from sievemark.llm.tokens import default_path, encoder

CAPACITY, WINDOW, END_ID, PAD_ID = 1024, 8192, 0, 50256
ROWS = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"
_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary())])


class RoomTree:
    """A segment tree over capacities 0..most: which of them some open row has left."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The (room, row) with the least room of at least ``size``, taken out."""
        count, k = self.count, size + self.leaves
        while not count[k]:
            while k & 1:  # a right child: nothing further right below this parent
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        row = self.rows[room].pop()
        while k:
            count[k] -= 1
            k >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Lists of item numbers, one a row."""
    tree, out = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            found = capacity, len(out)
            out.append([])
        out[found[1]].append(i)
        if found[0] > sizes[i]:
            tree.put(found[0] - sizes[i], found[1])
    return out


def pack_rows(batches: Iterator[pa.RecordBatch], path: str, capacity: int, pad: int, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    code, end, sequence = encoder(path), np.uint32(END_ID).tobytes(), _task() << 32
    kind = "<u2" if max(code.vocabulary, pad + 1) <= 1 << 16 else "<u4"
    filler = np.full(capacity, pad, kind)
    rests: list[tuple[bytes, int, int]] = []
    rows: list[tuple] = []

    def row(parts: list[tuple[bytes, int, int]]) -> None:
        nonlocal sequence
        ids, ends = np.frombuffer(b"".join(p[0] for p in parts), "<u4").astype(kind), np.cumsum([0] + [len(p[0]) // 4 for p in parts]).tolist()
        rows.append((sequence, ends[-1], [p[1] for p in parts], [p[2] for p in parts], ends, ends[:-1], ids.tobytes() + filler[ends[-1] :].tobytes()))
        sequence += 1

    def flush() -> pa.RecordBatch:
        nonlocal rows
        out, rows = rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 7, _SCHEMA)], schema=_SCHEMA)

    def close() -> None:
        for members in best_fit_decreasing([len(r[0]) // 4 for r in rests], capacity):
            row([rests[i] for i in members])
        rests.clear()

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids, start = code.encode(text) + end, 0
            while len(ids) // 4 - start >= capacity:
                row([(ids[4 * start : 4 * (start + capacity)], doc, start)])
                start += capacity
            if 4 * start < len(ids):
                rests.append((ids[4 * start :], doc, start))
                if len(rests) >= window:
                    close()
            if len(rows) >= 1024:
                yield flush()
    close()
    yield flush()


def packed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, pad_id: int = PAD_ID) -> DataFrame:
    path = tokenizer or default_path()
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(lambda batches: pack_rows(batches, path, capacity, pad_id), ROWS)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the id matrix and its segment arrays as Parquet; Spark's commit keeps it whole if tasks fail."""
    packed_rows(docs, **options).write.parquet(path)


def positions(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Position ids of a row: they start again at every segment, and at the padding."""
    starts = np.zeros(capacity, np.int64)
    for s in [*cu_seqlens[1:]]:
        if s < capacity:
            starts[s] = s
    return np.arange(capacity) - np.maximum.accumulate(starts)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(read_table(spark, sf_dir, "documents"))
