"""N-gram Jaccard join by token-combination prefixes, exact at its threshold.

1. One pass hashes every document's 5-word shingles and counts them in a sketch of ``SLOTS`` counters
   (a fixed size, summed in streams). Equal sets share a 128-bit key and count as one from here on.
2. Most sets have no partner, which a necessary condition shows without moving them: of its first
   |x| - t + m shingles by hash (t = ceil(0.8 |x|), m a tenth of |x|), a set must share m with a
   partner's. Tasks send these hashes as sorted runs to their hash range, which answers with counts
   of those that are not alone; sets that fall short are done.
3. Shingles of the others are ordered by rarity: first the rare class (counters near the usual), then
   the frequent ones by count. A set's prefix holds |x| - t + 1 shingles; similar sets share one.
   Rare ones are indexed singly. Where the prefix reaches frequent shingles it is extended by c more,
   the frequent ones are dealt into c classes by hash, and 2-combinations within a class are indexed:
   similar sets then share c + 1 of the extended prefix, so a rare one or two of some class. c depends
   on the size band, which is part of every signature, and a set indexes its own band and the next, so
   similar sets meet in one and sets of far-apart sizes don't.
4. Signature groups of the same members count as one. Sets that share a signature are joined to
   candidate components, which are cut into blocks in order of size and compared block pair by block
   pair, so far-apart sizes never meet, with exact intersections of the hash sets. Each comparison
   returns links that span, never pairs.

A fixed-size bitmap tells the pass that writes the remaining sets which texts it needs; texts
that it lets through by chance are compared like the others.

Sets are compared by 64-bit hashes of their shingles and named by 128 bits (64 in the component step),
so results are exact up to collisions of those.

Defined results: null text counts as empty; an empty set links with nothing, not even another empty
one; repeated rows share their class, and rows that share an id only by chance don't; rows without an
id take part, and their component is that of their text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemark.llm.common import lean, lean_group, materialize, read_table, release, rows_kept, text_or_empty, unused
from sievemark.llm.components import connected
from sievemark.llm.packing import _task
from sievemark.llm.shingles import mix, set_key, shingle_sets

PERCENT, SLOT_BITS, RANGES = 80, 20, 256
#: Slots of the bitmap of needed texts; sets that one task gets, about.
BITMAP, TASK_SETS = 1 << 23, 4096
#: Blocks hold a 32nd of their sets within these bounds, and so many shingles at most on average.
BLOCK_LEAST, BLOCK_MOST, BLOCK_SHINGLES = 64, 4096, 4_000_000
#: Hashes of a range that one task answers for, about; ranges grow in number with the corpus.
RANGE_HASHES, RANGE_BITS = 250_000, 10
_BATCH, REMEMBERED = 1 << 21, 500_000

FIRST = "kind int, doc_id long, row long, n long, k1 long, k2 long, slot int, counts binary"


def _in_parts(texts: list[str], most: int = _BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` characters at most, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (kind 0) of size and key for every document, and a task's counters (kind 1)."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    names = [c.split()[0] for c in FIRST.split(", ")]
    kinds = [pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.binary()]
    for batch in batches:
        ids, numbers, texts = (c.to_pylist() for c in batch.columns)
        for a, b in _in_parts(texts):
            sets = shingle_sets(texts[a:b])
            total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
            rows = [(0, i, k, len(s), *set_key(s), None, None) for i, k, s in zip(ids[a:b], numbers[a:b], sets)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    parts = total.reshape(RANGES, -1)
    rows = [(1, *[None] * 5, k, zlib.compress(p.astype("<i8").tobytes(), 1)) for k, p in enumerate(parts) if p.any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(packed), "<i8")
            sums[slot] = sums[slot] + own if slot in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["slot", "counts"])


def frequency_classes(first: DataFrame) -> np.ndarray:
    """A byte for every counter: 0 is rare, else frequent, more so as it grows. Of fixed size."""
    rows = first.where("kind = 1").select("slot", "counts").repartition(RANGES, "slot").mapInArrow(lean(_sum_counts), "slot int, counts binary").collect()
    count = np.zeros((RANGES, (1 << SLOT_BITS) // RANGES))
    for r in rows:
        count[r.slot] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    count = count.ravel()
    usual = np.median(count)
    limit = usual + 6 * np.sqrt(usual + 1) + 8
    return np.where(count <= limit, 0, np.clip(1 + 8 * np.log2(np.maximum(count, 1) / limit), 1, 255)).astype(np.uint8)


def band(n: int) -> int:
    """Sizes of one band differ by a quarter at most, so similar sets lie in one band or two next to it."""
    return int(np.log(n) / np.log(100 / PERCENT) + 1e-9)


def _classes_of(b: int) -> int:
    """The number of classes of a size band: as many as its prefixes have shingles."""
    return max(1, int((100 / PERCENT) ** b * (1 - PERCENT / 100)) + 1)


def signatures(own: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The 64-bit signatures of a set of sorted hashes; similar sets that differ share one at least."""
    n = len(own)
    least = -(-PERCENT * n // 100)
    prefix = n - least + 1
    klass = frequency[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    order = np.argsort(klass, kind="stable")
    rare = int((klass == 0).sum())
    single = own[order[: min(prefix, rare)]]
    parts = []
    b = band(n)
    for scheme in (b, b + 1):
        parts.append(mix(single + np.uint64(scheme * 0xA24BAED4963EE407 % (1 << 64))))
        if rare >= prefix:
            continue
        c = _classes_of(scheme)
        often = own[order[rare : min(n, prefix + c)]]
        home = (mix(often + np.uint64(scheme)) % np.uint64(c)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        often, home = often[by], home[by]
        for gap in range(1, len(often)):
            same = home[gap:] == home[:-gap]
            if not same.any():
                break
            x, y = often[:-gap][same], often[gap:][same]
            parts.append(mix(np.minimum(x, y) * np.uint64(0xD1B54A32D192ED03) + mix(np.maximum(x, y)) + np.uint64(scheme)))
    return np.concatenate(parts)


def _asked(own: np.ndarray) -> tuple[int, int]:
    """How many of a set's least hashes to ask about, and how many must be shared with a partner's.

    The partner's own number may be that of a set of 0.8 the size, so the lesser one counts.
    """
    n = len(own)
    return min(n, n - -(-PERCENT * n // 100) + n // 10 + 1), PERCENT * n // 1000 + 1


def _of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """(name, hashes to ask about, number that must be shared) of texts; a task asks once for equal ones."""
    seen: set[tuple[int, int]] = set()
    for batch in _fresh(batches):
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in _in_parts(texts, _BATCH // 2):
            for name, own in zip(names[a:b], shingle_sets(texts[a:b])):
                if len(own) and (key := set_key(own)) not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(key)
                    first, shared = _asked(own)
                    yield name, own[:first], shared


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose name (the first column) the task hasn't met; it remembers a bounded number of names."""
    seen: set[int] = set()
    for batch in batches:
        names, take = batch.column(0).to_pylist(), []
        for k, name in enumerate(names):
            if name not in seen:
                take.append(k)
                if len(seen) < REMEMBERED:
                    seen.add(name)
        yield batch if len(take) == len(names) else batch.take(pa.array(take, pa.int64()))


def _of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """The same of whole sets, of which 80 % must be shared."""
    for batch in batches:
        for name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(tokens, "<u8")
            yield name, own, -(-PERCENT * len(own) // 100)


def _ask(frequency, range_bits: int, questions):
    """Rows (chunk, range, payload): sorted hashes and their owners' numbers, and a header a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = frequency.value == 0
        chunk = _task() << 24
        ids: list[int] = []
        need: list[int] = []
        known: list[int] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal chunk, size
            hashes = np.concatenate(parts)
            owners = np.repeat(np.arange(len(parts), dtype="<u2"), [len(p) for p in parts])
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            cuts = np.searchsorted(hashes, np.arange(1, 1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits))
            runs = [(r, h.astype("<u8").tobytes() + o.tobytes()) for r, (h, o) in enumerate(zip(np.split(hashes, cuts), np.split(owners, cuts))) if len(h)]
            runs.append((-1 - chunk, np.array([ids, need, known], "<i8").tobytes()))
            out = pa.RecordBatch.from_arrays([pa.array([chunk] * len(runs), pa.int64()), pa.array([r for r, _ in runs], pa.int64()), pa.array([x for _, x in runs], pa.binary())], names=["chunk", "range", "payload"])
            for x in (ids, need, known, parts):
                x.clear()
            chunk, size = chunk + 1, 0
            return out

        for name, own, shared in questions(batches):
            rare = usual[(own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
            ids.append(name)
            need.append(shared)
            known.append(int((~rare).sum()))
            parts.append(own[rare])
            size += len(own)
            if size >= 1_000_000 or len(ids) >= 60_000:
                yield flush()
        if ids:
            yield flush()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For one hash range: of each chunk, the documents with hashes that are not alone, and how many. Headers pass."""
    chunks, payloads = table.column("chunk").to_pylist(), table.column("payload").to_pylist()
    header = table.column("range")[0].as_py() < 0
    if not header:
        hashes = [np.frombuffer(x, "<u8", len(x) // 10) for x in payloads]
        _, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        shared, at, asked, chunks = count[place] > 1, 0, list(zip(chunks, hashes, payloads)), []
        payloads = []
        for chunk, h, x in asked:
            owners = np.frombuffer(x, "<u2", len(h), 8 * len(h))[shared[at : at + len(h)]]
            at += len(h)
            if len(owners):
                own, n = np.unique(owners, return_counts=True)
                chunks.append(chunk)
                payloads.append(own.astype("<u2").tobytes() + n.astype("<u4").tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "header": pa.array([header] * len(chunks), pa.bool_()), "payload": pa.array(payloads, pa.binary())})


def _settle(table: pa.Table) -> pa.Table:
    """The documents of one chunk that share enough."""
    header, counts = np.zeros((3, 0), np.int64), []
    for is_header, x in zip(table.column("header").to_pylist(), table.column("payload").to_pylist()):
        if is_header:
            header = np.frombuffer(x, "<i8").reshape(3, -1)
        else:
            counts.append((np.frombuffer(x, "<u2", len(x) // 6), np.frombuffer(x, "<u4", len(x) // 6, len(x) // 3)))
    ids, need, known = header
    total = known.copy()
    for own, n in counts:
        total[own] += n
    return pa.table({"rep": pa.array(ids[total >= need], pa.int64())})


def hopeful(rows: DataFrame, questions, frequency, hashes: int) -> DataFrame:
    """(rep): the names in ``rows`` that share enough of the hashes they ask about; ``hashes`` in all.

    What moves is every hash once, and back one count for each document and range in which it shares
    something.
    """
    bits = min(20, max(RANGE_BITS, int(np.ceil(np.log2(max(1, hashes) / RANGE_HASHES)))))
    asked = rows.mapInArrow(lean(_ask(frequency, bits, questions)), "chunk long, range long, payload binary")
    answers = asked.groupBy("range").applyInArrow(lean_group(_answer), "chunk long, header boolean, payload binary")
    return answers.groupBy("chunk").applyInArrow(lean_group(_settle), "rep long")


def _postings(sets: DataFrame, frequency) -> DataFrame:
    """(sign, key, n): the signatures of (k1, tokens), and the sets' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [np.frombuffer(x, "<u8") for x in part.column(1).to_pylist()]
                signs = [signatures(x, frequency.value) for x in sets]
                times = [len(s) for s in signs]
                keys, sizes = np.repeat(part.column(0).to_numpy(), times), np.repeat([len(x) for x in sets], times)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs).view(np.int64)), pa.array(keys), pa.array(sizes, pa.int64())], names=["sign", "key", "n"])

    return sets.select("k1", "tokens").mapInArrow(lean(run), "sign long, key long, n long")


def _links(members: list[np.ndarray], sizes: np.ndarray, ids: list[int], split: int | None) -> list[tuple[int, int]]:
    """Spanning links among sets: all pairs, or those across ``split`` only."""
    order = np.argsort(np.concatenate(members), kind="stable")
    tokens = np.concatenate(members)[order]
    owner = np.repeat(np.arange(len(members)), sizes)[order]
    fresh = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    run = np.diff(np.concatenate([fresh, [len(tokens)]]))
    head, length = np.repeat(fresh, run), np.repeat(run, run)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    parent = list(range(len(members)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, at = [], 0
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(members)):
        own = back[bounds[i] : bounds[i + 1]]
        own = own[length[own] > 1]
        if not len(own):
            continue
        lengths = length[own]
        places = np.repeat(head[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[places], minlength=len(members))
        union = sizes[i] + sizes - both
        near = np.flatnonzero((100 * both >= PERCENT * union) & (both > 0))
        for j in near.tolist():
            if j < i and (split is None or (j < split) != (i < split)):
                x, y = find(i), find(j)
                if x != y:
                    parent[x] = y
                    out.append((ids[i], ids[j]))
    return out


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of signatures with two keys or more; of signatures with the same keys, one stays.

    A signature's group is summed to a few numbers with map-side combining; only groups that stay come
    back to the postings, in a join whose large groups Spark can split.
    """
    kept = materialize(postings, "postings")
    sums = kept.groupBy("sign").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"))
    one = sums.where("a <> z").groupBy("a", "z", "m", "x", "y").agg(F.min("sign").alias("sign"))
    return materialize(kept.join(one.select("sign", "a"), "sign").select("a", "key", "n"), "shared")


def _compared(seats: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the sides of every cell of (cell, side, key); tasks hold several cells."""

    def run(table: pa.Table) -> pa.Table:
        cell, side, key = (table.column(c).to_numpy() for c in ("cell", "side", "key"))
        tokens = [np.frombuffer(x, "<u8") for x in table.column("tokens").to_pylist()]
        order = np.lexsort((key, side, cell))
        out: list[tuple[int, int]] = []
        for rows in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            split = int((side[rows] == 0).sum())
            own = [tokens[i] for i in rows]
            if len(rows) > 1:
                out += _links(own, np.array([len(x) for x in own]), key[rows].tolist(), split if split < len(rows) else None)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    seats = materialize(seats, "seats")
    count = seats.count()
    task = F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-count // TASK_SETS))))
    held = seats.withColumn("task", task).join(sets.select(F.col("k1").alias("key"), "tokens"), "key")
    return materialize(held.groupBy("task").applyInArrow(lean_group(run), "a long, b long").where("a <> b"), "links")


def components_of(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, root) of the sets that link with others, from (a, key, n): a key and the least one that it shares a signature with.

    A set's place in its candidate component comes from the counts of smaller sizes and a hash among equal
    sizes, so no task sorts a component. Blocks also hold ``BLOCK_SHINGLES`` shingles at most on average.
    """
    near = shared.select("key", "n").distinct().join(connected(shared.select("a", F.col("key").alias("b"))).toDF("key", "group"), "key")
    near = materialize(near, "near")
    each = near.groupBy("group", "n").agg(F.count(F.lit(1)).alias("equal"))
    own = Window.partitionBy("group")
    m, tokens = F.sum("equal").over(own), F.sum(F.col("equal") * F.col("n")).over(own)
    lot = F.greatest(F.lit(16), F.least(F.greatest(F.lit(BLOCK_LEAST), F.least(F.lit(BLOCK_MOST), F.ceil(m / 32))), F.ceil(F.lit(BLOCK_SHINGLES) * m / tokens)))
    start = F.sum("equal").over(own.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("equal")
    sized = materialize(each.select("group", "n", "equal", start.alias("start"), lot.alias("lot")), "lots")
    block = F.floor((F.col("start") + F.pmod(F.xxhash64("key"), F.col("equal"))) / F.col("lot")).cast("int")
    placed = materialize(near.join(sized, ["group", "n"]).select("key", "n", "group", block.alias("block")), "blocks")
    spans = placed.groupBy("group", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = spans.toDF("group", "i", "low_i", "high_i"), spans.toDF("group", "j", "low_j", "high_j")
    meets = left.join(right, "group").where((F.col("i") <= F.col("j")) & (100 * F.col("high_i") >= PERCENT * F.col("low_j")))
    cells = meets.select("group", "i", "j", F.xxhash64("group", "i", "j").alias("cell"))
    seats = cells.select("group", F.col("i").alias("block"), F.lit(0).alias("side"), "cell").union(cells.where("i < j").select("group", F.col("j").alias("block"), F.lit(1).alias("side"), "cell"))
    return connected(_compared(placed.join(seats, ["group", "block"]).select("cell", "side", "key"), sets)).toDF("key", "root")


def _needed_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(k1, k2, tokens) of texts whose name may be in ``needed`` (rep): a bitmap of fixed size decides."""
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(BITMAP)) + 1
    bits = needed.select(place("rep").alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect()
    whole = np.zeros(BITMAP // 8, np.uint8)
    for r in bits:
        own = np.frombuffer(bytes(r.bits), np.uint8)
        whole[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(own)] = own
    shipped = docs.sparkSession.sparkContext.broadcast(whole)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(1).to_numpy() - 1
            yield batch.filter(pa.array((shipped.value[p >> 3] >> (p & 7)) & 1 == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _fresh(wanted(batches)):
            texts = own.column(2).to_pylist()
            for a, b in _in_parts(texts):
                rows = [(*set_key(s), s.astype("<u8").tobytes()) for s in shingle_sets(texts[a:b]) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))], names=["k1", "k2", "tokens"])

    return docs.select("name", place("name").cast("long").alias("p"), "text").mapInArrow(lean(run), "k1 long, k2 long, tokens binary")


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, vertex, least): one row per row of ``docs`` (doc_id, row, text).

    ``vertex`` names the component of a text that isn't empty, ``least`` is the component's least id.
    """
    docs = docs.withColumn("name", F.xxhash64("text"))
    first = materialize(docs.select("doc_id", "row", "text").mapInArrow(lean(first_pass), FIRST), "sizes")
    sizes = first.where("kind = 0").select("doc_id", "row", "n", "k1", "k2")
    frequency = docs.sparkSession.sparkContext.broadcast(frequency_classes(first))
    shingles = sizes.agg(F.sum("n")).first()[0] or 0
    some = materialize(hopeful(docs.select("name", "text"), _of_texts, frequency, int(shingles * 0.3)), "hopeful")
    first_sets = materialize(_needed_sets(docs, some).groupBy("k1", "k2").agg(F.first("tokens").alias("tokens")), "sets")
    # Once more, whole sets among themselves: what is left has 80 % of its shingles elsewhere.
    total = first_sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    fewer = materialize(hopeful(first_sets.select("k1", "tokens"), _of_sets, frequency, total // 8).distinct(), "hopeful")
    sets = materialize(first_sets.join(fewer.toDF("k1"), "k1"), "sets")
    release(first_sets)
    roots = components_of(_shared(_postings(sets, frequency)), sets)
    classes = sizes.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    joined = materialize(classes.join(roots.toDF("k1", "root"), "k1"), "linked")
    lowest = joined.groupBy("root").agg(F.min("least").alias("lowest"))
    labels = joined.join(lowest, "root").select("k1", "k2", "root", "lowest")
    classes = classes.join(labels, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("root", "k1").alias("vertex"), F.coalesce("lowest", "least").alias("least"))
    return sizes.join(materialize(classes, "labels"), ["k1", "k2"], "left").select("doc_id", "row", "n", "vertex", F.when(F.col("n") > 0, F.col("least")).alias("least"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), text_or_empty(text_col).alias("text"))
    return _classes(slim).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: its least id (rows without one come last).

    Rows are chosen by number, so rows that share an id only by chance stay both. Empty texts stay.
    """
    (number,) = unused(docs, "_row")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    slim = numbered.select(F.col(id_col).cast("long").alias("doc_id"), F.col(number).alias("row"), text_or_empty(text_col).alias("text"))
    found = materialize(_classes(slim), "classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = found.where("n > 0").groupBy("vertex").agg(F.min(order)["row"].alias("row")).select("row").union(found.where("n = 0").select("row"))
    return rows_kept(numbered, number, kept).drop(number)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"))
