"""Embedding near-duplicates by an inverted multi-index.

Vectors of a label are compared by cosine, in double precision. Equal vectors become one weighted
representative first. Codebooks are fitted to the two halves of a bounded sample of unit vectors (in
hash order); their product is a grid of cells. A codebook has as many words as give cells of about
``ROWS_PER_CELL`` vectors (so words grow with the root of the table, up to ``MOST_WORDS``), and the sample
holds ``SAMPLE`` vectors or ``SAMPLE_PER_WORD`` a word. Every representative is indexed in the cell of its
nearest centres. A multi-sequence traversal lists the cells nearest to it in order of distance, as
many as find the share ``TARGET`` of made pairs at exactly the least similarity, the hardest ones there are,
so the number depends on no link's being in the sample. A vector meets the members of the cells it
visits; cells are compared block by block, so a crowded cell is many tasks, each of bounded size, and
blocks grow with a cell, so vectors are sent to fewer of them.

Each length of vector is a space of its own, and all lengths go through the same steps together. The
``GRIDS`` most frequent lengths and every other of more than ``sample`` vectors have a grid; a length
of fewer is one cell, so its vectors meet all of their label and length and the result is exact.

A pair may meet twice, from either side; it is counted from the side of the smaller id, or from
the only side that visits. Tasks return link counts and spanning links, never pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors without a label, link with nothing; vectors of different lengths never meet; those of one
component are compared by sign; repeated rows
of an id are one vector each and link with each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm.common import materialize, read_table
from sievemark.llm.components import connected

LEAST, SAMPLE, SAMPLE_PER_WORD, ROWS_PER_CELL, MOST_WORDS, BLOCK, MOST_BLOCK, TARGET, MADE, GRIDS = 0.93, 4096, 32, 256, 1024, 512, 4096, 0.995, 2048, 16


def words_for(rows: int) -> int:
    """Words of a codebook for so many vectors."""
    return int(np.clip(np.ceil(np.sqrt(rows / ROWS_PER_CELL)), 4, MOST_WORDS))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres * centres).sum(1)
    return np.concatenate([(size - 2 * x[k : k + 4096] @ centres.T).argmin(1) for k in range(0, len(x), 4096)])


def fit_codebook(x: np.ndarray, words: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of Lloyd's algorithm from distinct seeded rows."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:words]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, column, len(centres)) for column in x.T], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def visits(first: np.ndarray, second: np.ndarray, count: int) -> list[int]:
    """The ``count`` cells (i * len(second) + j) of least first[i] + second[j], in order."""
    a, b = np.argsort(first, kind="stable")[:count], np.argsort(second, kind="stable")[:count]
    first, second, width = first.tolist(), second.tolist(), len(second)
    a, b = a.tolist(), b.tolist()
    heap, seen, out = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heappop(heap)
        out.append(a[i] * width + b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


class Grid:
    """Two codebooks; ``probes`` cells are visited for each vector."""

    def __init__(self, sample: np.ndarray, words: int, least: float = LEAST, target: float = TARGET) -> None:
        self.half = sample.shape[1] // 2
        words = max(1, min(words, len(sample) // 4))
        self.books = [fit_codebook(part, words, seed=k) for k, part in enumerate(self._halves(sample))]
        self.probes = self.probes_for(sample, least, target)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = [(b * b).sum(1) - 2 * part @ b.T for part, b in zip(self._halves(x), self.books)]
        return first, second

    def ranked(self, x: np.ndarray) -> list[list[int]]:
        """The cells that each unit vector visits, its own first."""
        return [visits(p, q, self.probes) for p, q in zip(*self.distances(x))]

    def probes_for(self, sample: np.ndarray, least: float, target: float, seed: int = 9) -> int:
        """The visits with which the share ``target`` of pairs of cosine ``least`` in any direction meet.

        A pair meets if either visits the other's cell. A cell's place in a traversal is the number of
        cells with a lesser sum of distances.
        """
        x = sample[:MADE]
        other = np.random.default_rng(seed).normal(size=x.shape)
        other = _unit(other - (other * x).sum(1, keepdims=True) * x + 1e-12)
        y = _unit(least * x + np.sqrt(1 - least * least) * other)
        needed = np.full(len(x), np.inf)
        for own, met in ((x, y), (y, x)):
            (p, q), (h, k) = self.distances(own), self.distances(met)
            sums = p[np.arange(len(x)), h.argmin(1)] + q[np.arange(len(x)), k.argmin(1)]
            ordered = np.sort(q, axis=1)
            place = [int(np.searchsorted(o, s - f, "left").sum()) + 1 for o, s, f in zip(ordered, sums, p)]
            needed = np.minimum(needed, place)
        cells = len(self.books[0]) * len(self.books[1])
        return int(np.clip(np.sort(needed)[min(len(x) - 1, int(target * len(x)))], min(4, cells), cells))


def _usable(vector: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 2))


def _place(grids: dict[int, Grid]):
    """Rows of a vector for the index (its cell) and for each cell that it visits; without a grid, cell 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(0)).to_numpy()
            gridded = np.isin(lengths, list(grids))
            for length in [None, *np.unique(lengths[gridded]).tolist()]:
                own = batch.filter(pa.array(~gridded if length is None else lengths == length))
                if own.num_rows:
                    order = [[0]] * own.num_rows if length is None else grids[length].ranked(_unit(_matrix(own.column(0))))
                    yield pa.RecordBatch.from_arrays([*own.columns[1:], own.column(0), pa.array(order, pa.list_(pa.int32()))], names=["rep", "weight", "label", "length", "vector", "cells"])

    return run


def _compare(least: float):
    """Links of one task: index rows (side 0) against visiting rows (side 1)."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        table = table.combine_chunks()
        rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        x = _unit(_matrix(table.column("vector").combine_chunks()))
        cells = table.column("cells").to_pylist()
        own, guest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        home = np.array([c[0] for c in cells])[guest]
        # For every cell that a guest comes from: which members visit it themselves.
        wanted = {c: k for k, c in enumerate(np.unique(home).tolist())}
        sees = np.zeros((len(wanted), len(own)), bool)
        for b, i in enumerate(own):
            sees[[wanted[c] for c in cells[i] if c in wanted], b] = True
        place = np.array([wanted[c] for c in home.tolist()], np.int64)
        names, at = np.unique(rep, return_inverse=True)
        counts, label, out = np.zeros(len(names), np.int64), np.arange(len(names)), []
        for k in range(0, len(guest), 256):
            part = guest[k : k + 256]
            met = x[part] @ x[own].T >= least
            i, j = rep[part][:, None], rep[own][None, :]
            met &= (i < j) | ((i > j) & ~sees[place[k : k + 256]])
            np.add.at(counts, at[part], met @ weight[own])
            np.add.at(counts, at[own], weight[part] @ met)
            for a in np.flatnonzero(met.any(1)).tolist():
                mine = at[part[a]]
                those = at[own[met[a]]]
                _, first = np.unique(label[those], return_index=True)
                for b in those[first].tolist():
                    if label[b] != label[mine]:
                        label[label == label[b]] = label[mine]
                        out.append((int(names[mine]), int(names[b])))
        some = np.flatnonzero(counts)
        rows = [(int(names[n]), int(counts[n]), None) for n in some] + [(i, 0, j) for i, j in out]
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], names=["a", "n", "b"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST, sample: int = SAMPLE, words: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    v = F.col(vector_col).cast("array<double>")
    v = F.when(F.size(v) == 1, F.transform(v, lambda x: F.try_divide(x, F.abs(x)))).otherwise(v)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.col(label_col).cast("string").alias("label"))
    rows = rows.withColumn("usable", F.coalesce(_usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    groups = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    groups = materialize(groups.withColumn("length", F.size("vector")), "vectors")
    counted = groups.where("length > 1").groupBy("length").count()
    wanted = counted.orderBy(F.desc("count"), "length").limit(GRIDS).union(counted.where(F.col("count") > sample))
    grids = {}
    for length, count in sorted({(r["length"], r["count"]) for r in wanted.collect()}):
        own = words or words_for(count)
        some = groups.where(F.col("length") == length).select("vector").orderBy(F.xxhash64("vector", "label")).limit(max(sample, SAMPLE_PER_WORD * own)).collect()
        grids[length] = Grid(_unit(np.array([r.vector for r in some])), own, least)
    placed = materialize(groups.select("vector", "rep", "weight", "label", "length").mapInArrow(_place(grids), "rep long, weight long, label string, length int, vector array<double>, cells array<int>"), "placed")
    # Blocks of a cell: as many as its members need; visitors go to each, cut alike.
    place = ["label", "length", "cell"]
    members = placed.groupBy("label", "length", F.get("cells", 0).alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    lot = F.greatest(F.lit(block), F.least(F.lit(max(block, MOST_BLOCK)), F.ceil(F.col("m") / 32)))
    lots = materialize(members.select(*place, lot.alias("lot"), F.ceil(F.col("m") / lot).cast("int").alias("lots")), "cells")
    index = placed.withColumn("cell", F.get("cells", 0)).join(lots, place).withColumn("i", F.pmod(F.xxhash64("rep"), "lots"))
    guests = placed.withColumn("cell", F.explode("cells")).join(lots, place).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots").cast("bigint") - 1)))
    loads = guests.groupBy(*place, "i").agg(F.count(F.lit(1)).alias("g"), F.max("lot").alias("size"))
    cuts = materialize(loads.select(*place, "i", F.ceil(F.col("g") / (2 * F.col("size"))).cast("int").alias("cuts")), "loads")
    columns = [*place, "i", "j", "side", "rep", "weight", "vector", "cells"]
    held = index.join(cuts, [*place, "i"]).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts").cast("bigint") - 1))).withColumn("side", F.lit(0)).select(columns)
    come = guests.join(cuts, [*place, "i"]).withColumn("j", F.pmod(F.xxhash64(F.lit(1), "rep"), "cuts").cast("bigint")).withColumn("side", F.lit(1)).select(columns)
    found = materialize(held.unionByName(come).groupBy(*place, "i", "j").applyInArrow(_compare(least), "a long, n long, b long"), "links")
    edges = connected(found.where("b is not null").select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    known = groups.join(counts, "rep", "left").join(edges.toDF("rep", "root"), "rep", "left")
    known = materialize(known.select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "known")
    # Back to the rows: unusable ones match nothing and are spread by their id.
    key = F.when(F.col("usable"), F.xxhash64("label", "vector")).otherwise(F.xxhash64("vec_id"))
    left = rows.withColumn("key", key)
    right = known.select(F.xxhash64("label", "vector").alias("key"), F.col("label").alias("l"), F.col("vector").alias("v"), "n_links", "component_id")
    joined = left.join(right, left["usable"] & (left["key"] == right["key"]) & (left["label"] == right["l"]) & (left["vector"] == right["v"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def measured_recall(vectors: DataFrame, found: DataFrame, queries: int = 512, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> float:
    """The share of links of ``queries`` vectors (in hash order) that ``found`` counts, by brute force.

    The queries are broadcast, a set of fixed size; every other vector meets them in blocks.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(_usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).collect()
    shipped = vectors.sparkSession.sparkContext.broadcast([(r.vec_id, _unit(np.array([r.vector]))[0], r.label) for r in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), np.array(batch.column(2).to_pylist())
            own = [_unit(np.array([v]))[0] for v in batch.column(1).to_pylist()]
            size = np.array([len(v) for v in own])
            for name, v, label in shipped.value:
                like = np.flatnonzero((labels == label) & (size == len(v)))
                n = int((np.stack([own[k] for k in like]) @ v >= least).sum() - (ids[like] == name).sum()) if len(like) else 0
                totals[name] = totals.get(name, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["vec_id", "n"])

    true = rows.select("vec_id", "vector", "label").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
    sums = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum("n"), F.sum("n_links")).first()
    return (sums[1] or 0) / sums[0] if sums[0] else 1.0


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
