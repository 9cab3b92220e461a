"""Packing by vector bin packing: the dot-product heuristic under three limits at once.

An item asks for tokens, one segment and its loss-bearing tokens. The open bin takes, among the items
that fit all limits, the one with the largest dot product of its demand and the bin's remaining
capacity, weighted by the mean demand. Where cutting is allowed and nothing fits, the largest
item fills the bin's rest and what is left of it stays in the pool. A task keeps a pool of at most
``POOL`` items and emits sequences as it goes, so memory is bounded, nothing is shuffled, and a task
that is run again gives the same sequences.

Defined results: null text counts as empty and still has its end id; repeated rows are packed each;
texts of any length are cut into blocks of the capacity first; an empty table gives an empty result;
other columns are ignored; an item beyond a limit by itself, where cutting isn't allowed, gets a
sequence of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import lean, read_table, text_or_empty
from sievemark.llm.tokens import default_path, encoder

CAPACITY, SEGMENTS, POOL, LEAST_CUT, END_ID = 1024, 64, 1024, 4, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PLACES = "id long, sequence_id long, place int, offset long"


class Pool:
    """Items waiting for a bin: parallel arrays of demands and a list of what they are."""

    def __init__(self, caps: np.ndarray, cut: bool, size: int = POOL) -> None:
        self.caps, self.cut, self.room = caps, cut, size
        self.need = np.zeros((2 * size, 3))
        self.items: list = []
        self.total, self.seen = np.zeros(3), 0

    def add(self, tokens: int, loss: int, what) -> None:
        self.need[len(self.items)] = (tokens, 1, loss)
        self.total += (tokens, 1, loss)
        self.seen += 1
        self.items.append(what)

    def full(self) -> bool:
        return len(self.items) >= self.room

    def fill(self) -> list[tuple]:
        """One bin: (item, tokens taken, is cut) in order. Takes its items out of the pool."""
        n = len(self.items)
        need, left, used, out = self.need[:n], self.caps.copy(), np.zeros(n, bool), []
        weight = self.total / max(1, self.seen) / self.caps**2
        while True:
            fits = (need <= left).all(axis=1) & ~used
            if fits.any():
                i = int(np.argmax(np.where(fits, need @ (weight * left), -1.0)))
                used[i] = True
                left = left - need[i]
                out.append((self.items[i], int(need[i, 0]), False))
                if left[0] <= 0 or left[1] <= 0:
                    break
                continue
            if not out:  # beyond a limit by itself
                i = int(np.argmax(~used))
                used[i] = True
                out.append((self.items[i], int(need[i, 0]), False))
            elif self.cut and left[0] >= LEAST_CUT and left[1] >= 1 and left[2] >= left[0] and not used.all():
                i = int(np.argmax(np.where(used, -1.0, need[:, 0])))
                room = int(left[0])
                out.append((self.items[i], room, True))
                need[i, 0] -= room
                need[i, 2] = max(0, need[i, 2] - room)
            break
        keep = np.flatnonzero(~used)
        self.need[: len(keep)] = need[keep]
        self.items = [self.items[i] for i in keep]
        return out


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def pack_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, segments: int, loss: int) -> Iterator[pa.RecordBatch]:
    code, schema = encoder(path), pa.schema([(n.split()[0], pa.int64()) for n in PIECES.split(", ")])
    pool, sequence, rows = Pool(np.array([capacity, segments, loss], float), True), _task() << 32, []
    end = np.uint32(END_ID).tobytes()

    def emit(ids: bytes, doc: int, start: int, size: int, tokens: int, offset: int) -> None:
        rows.append((doc, start, size, zlib.crc32(ids), tokens, sequence, offset))

    def one_bin() -> None:
        nonlocal sequence
        offset = 0
        for item, size, cut in pool.fill():
            ids, doc, start, tokens = item
            emit(ids[: 4 * size], doc, start, size, tokens, offset)
            if cut:
                item[0], item[2] = ids[4 * size :], start + size
            offset += size
        sequence += 1

    def flush() -> pa.RecordBatch:
        nonlocal rows
        out, rows = rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 7)], schema=schema)

    block = min(capacity, loss)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = code.encode(text) + end
            tokens, start = len(ids) // 4, 0
            while tokens - start >= block:
                emit(ids[4 * start : 4 * (start + block)], doc, start, block, tokens, 0)
                sequence += 1
                start += block
            if start < tokens:
                pool.add(tokens - start, tokens - start, [ids[4 * start :], doc, start, tokens])
                if pool.full():
                    while len(pool.items) > POOL // 2:
                        one_bin()
            if len(rows) >= 8192:
                yield flush()
    while pool.items:
        one_bin()
    yield flush()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, limit = tokenizer or default_path(), loss or capacity
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(lean(lambda batches: pack_pieces(batches, path, capacity, segments, limit)), PIECES)


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None) -> DataFrame:
    """Whole examples (instruction data) into sequences: id, sequence_id, place, offset."""
    caps = np.array([capacity, segments, loss or capacity], float)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, sequence = Pool(caps, False), _task() << 32

        def some(least: int) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            while len(pool.items) > least:
                offset = 0
                for place, (item, size, _) in enumerate(pool.fill()):
                    rows.append((item, sequence, place, offset))
                    offset += size
                sequence += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["id", "sequence_id", "place", "offset"])

        for batch in batches:
            for name, tokens, bearing in zip(*(c.to_pylist() for c in batch.columns)):
                pool.add(tokens, bearing, name)
                if pool.full():
                    yield some(POOL // 2)
        yield some(0)

    return examples.select(F.col(id_col).cast("long").alias("id"), number(tokens_col).alias("tokens"), number(loss_col).alias("loss")).mapInArrow(lean(run), PLACES)


def conversation_sizes(turns: DataFrame, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", bearing: str = "assistant", tokenizer: str | None = None) -> DataFrame:
    """(id, tokens, loss) of each conversation: every turn's ids and an end id; ``bearing`` turns bear the loss."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            sizes = [len(code.encode(t)) // 4 + 1 for t in batch.column(2).to_pylist()]
            loss = [n if r == bearing else 0 for n, r in zip(sizes, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(loss, pa.int64())], names=["id", "tokens", "loss"])

    slim = turns.select(F.col(id_col).cast("long").alias("id"), F.col(role_col).cast("string").alias("role"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(lean(run), "id long, tokens long, loss long").groupBy("id").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations under all three limits: 1024 tokens, 8 conversations, 512 tokens that bear loss."""
    sizes = conversation_sizes(read_table(spark, sf_dir, "conversations"))
    return pack_examples(sizes, "id", "tokens", "loss", CAPACITY, 8, CAPACITY // 2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
