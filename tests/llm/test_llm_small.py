"""Small fixtures for every operator: brute force, round trips, and odd tables (nulls, ties, empties, clashes)."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.llm import common, exact_dedup, html_text, mixing, ngram_join, packing, pii, quality, sharding, token_output, tokens, vector_dedup
from sievemark.llm.components import connected
from sievemark.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_key` string, recipe string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


def texts(n, seed=1, least=1, most=60):
    g = random.Random(seed)
    vocabulary = ["".join(g.choice("abcdefgh") for _ in range(g.randint(2, 7))) for _ in range(400)]
    return [" ".join(g.choice(vocabulary) for _ in range(g.randint(least, most))) + g.choice([".", "!\n", ""]) for _ in range(n)]


ODD = [(1, None, "a"), (2, "", None), (3, "x", "a"), (3, "x", "a"), (4, "x", None), (5, "X y\n\tz", ""), (6, "w " * 30000, "b"), (7, "a" * 50000, "b"), (8, "é ü 日本 \U0001f600", "b"), (9, " \n ", "a"), (10, "w " * 30000, "c")]


def long_texts():
    g = random.Random(3)
    base = texts(40, 5, 200, 900)
    return [(k, base[g.randrange(40)] if k % 3 else base[0], f"s{k % 4}" if k % 5 else None) for k in range(300)] + [(1000 + i, t, s) for i, t, s in ODD]


@pytest.mark.parametrize("name_of", [None, lambda c: F.length(c).cast("long")], ids=["hashed", "colliding"])
def test_exact_dedup(spark, name_of):
    rows = long_texts()
    found = exact_dedup.exact_dedup(table(spark, rows), name_of=name_of).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    assert len(found) == len(rows)
    whole = {i: t or "" for i, t, _ in rows}
    for r in found:
        own = groups[whole[r.doc_id]]
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(own), len(own), hashlib.sha256(whole[r.doc_id].encode()).hexdigest())
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.keep_one(table(spark, rows)).count() == len(groups)


def test_chunks_join_to_the_text(spark):
    rows = table(spark, [(i, t, s) for i, t, s in long_texts() if t])
    assert rows.where(F.array_join(exact_dedup.chunks(F.col("text")), "") != F.col("text")).count() == 0


def test_empty_and_null_tables(spark):
    empty = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (exact_dedup.exact_dedup(empty), sharding.shard_rows(empty), mixing.mix(empty), packing.pack_documents(empty), token_output.packed_rows(empty), ngram_join.jaccard_classes(empty), quality.score_quality(empty, labels), html_text.extract(pages), pii.find_personal_data(empty), vector_dedup.near_duplicates(vectors)):
        assert df.collect() == []
    none = spark.createDataFrame([(None,) * 7, (None,) * 7], SCHEMA)
    assert [r.kept for r in exact_dedup.exact_dedup(none).collect()].count(True) == 1
    for df in (sharding.shard_rows(none), mixing.mix(none), packing.pack_documents(none), ngram_join.jaccard_classes(none), quality.score_quality(none, labels), pii.find_personal_data(none)):
        assert df.count() == 2
    assert ngram_join.keep_one(none).count() == 2 and mixing.apply_mix(none).count() == 0


def test_sharding(spark):
    rows = long_texts()
    df = table(spark, rows)
    found = sharding.shard_rows(df, rows_per_bucket=16).collect()
    again = sharding.shard_rows(df, rows_per_bucket=16).collect()
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, found)) == sorted(map(key, again))
    sizes = Counter(r.shard for r in found)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == s) == list(range(n))
    whole = {i: (t or "").encode() for i, t, _ in rows}
    assert all(r.size == len(whole[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(whole[r.doc_id]) and r.law == "rows" for r in found)
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order) and order != sorted(order, reverse=True)


def test_sharding_of_repeated_ids(spark):
    rows = [(None, "same", "a")] * 700 + [(7, f"t{k % 50}", "a") for k in range(700)] + [(k, "x", "a") for k in range(700)]
    df = table(spark, rows)
    found = sharding.shard_rows(df, shards=7, rows_per_bucket=70).collect()
    assert Counter((r.shard, r.slot) for r in found) == Counter((g % 7, g // 7) for g in range(2100))
    assert Counter((r.doc_id, r.text_crc32) for r in found) == Counter((i, zlib.crc32(t.encode())) for i, t, _ in rows)
    spread = [sum(r.doc_id is None for r in found if r.slot // 30 == k) for k in range(10)]
    assert min(spread) > 35 and max(spread) < 110  # 70 of every 210 places, about
    again = sharding.shard_rows(df.repartition(3), shards=7, rows_per_bucket=70).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_bucket_offsets(spark):
    g = random.Random(4)
    counts = [(k, g.randrange(1, 9)) for k in range(300) if g.random() < 0.8]
    found = dict(sharding.bucket_offsets(spark.createDataFrame(counts, "_bucket long, _n long"), 7).collect())
    assert found == {k: sum(n for j, n in counts if j < k) for k, _ in counts}


def test_written_shards(spark, tmp_path):
    rows = long_texts() + [(None, "same", "a")] * 40
    sharding.write_shards(table(spark, rows), str(tmp_path / "out"), 5, bucket_bytes=20000)
    back = spark.read.parquet(str(tmp_path / "out")).select("*", F.input_file_name().alias("file")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t) for i, t, _ in rows)
    assert Counter((r.shard, r.slot) for r in back) == Counter((g % 5, g // 5) for g in range(len(rows)))
    by_file = defaultdict(list)
    for r in back:
        by_file[r.file].append((r.shard, r.slot))
    assert all(len({s for s, _ in own}) == 1 and own == sorted(own) for own in by_file.values())


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark):
    rows = [(k, t, s) for k, t, s in long_texts() if k != 1003]
    found = mixing.mix(table(spark, rows), rows_per_range=8).collect()
    words = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = Counter()
    for i in words:
        sizes[source[i]] += words[i]
    targets, taken = brute_targets(sizes), Counter()
    assert len(found) == len(rows)
    for r in found:
        s = source[r.doc_id]
        assert r["size"] == words[r.doc_id] and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(targets[s])
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    out = mixing.apply_mix(table(spark, rows), rows_per_range=8)
    assert out.columns == table(spark, rows).columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == Counter({r.doc_id: r.taken for r in found if r.taken})


def test_mix_takes_rows_without_an_id(spark):
    rows = [(None if k % 3 else k // 4, f"r{k} " * (k % 17 + 1), "abc"[k % 5 % 3]) for k in range(120)] + [(None, "same", "a")] * 9
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    out = mixing.apply_mix(table(spark, rows), rows_per_range=8).collect()
    for r in out:
        taken[r.source] += len(WORD.findall(r.text))
    targets = brute_targets(sizes)
    assert any(r.doc_id is None for r in out) and all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_mix_of_crowded_ranges(spark):
    rows = [(5, f"w{k} " * (k % 9 + 1), "a") for k in range(400)] + [(k, "x y z", "ab"[k % 2]) for k in range(200)]
    found = mixing.mix(table(spark, rows), rows_per_range=8).collect()
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    names = {n: s for s, n in sizes.items()}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[names[r.source_size]] += r.taken
    targets = brute_targets(sizes)
    assert len(found) == len(rows) and len(names) == 2 and all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    part = sum(r.taken % r["size"] != 0 for r in found)
    assert part <= 2  # one document a source is cut


def test_rows_kept_by_bitmaps(spark):
    numbered = spark.range(0, 100000, 1, 3).select((F.col("id") + F.floor(F.col("id") / 40000) * (1 << 33)).alias("n"), F.lit("x").alias("_bits"))
    kept = numbered.where("pmod(n, 7) = 3").select("n")
    assert sorted(r.n for r in common.rows_kept(numbered, "n", kept).collect()) == sorted(r.n for r in kept.collect())
    assert common.rows_kept(numbered, "n", kept.limit(0)).count() == 0


PATH = tokens.default_path()


def batch(rows):
    return iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t or "" for _, t in rows])], names=["a", "b"])])


def test_encoder_agrees_with_the_library():
    code = tokens.encoder(PATH)
    assert code.fast is not None
    for t in [t or "" for _, t, _ in ODD] + texts(50) + ["a  b", " a ", "x\n y", "<|endoftext|>", "it's 'll", "\x00"]:
        assert code.encode(t) == code.whole(t)


def test_encoder_agrees_with_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    code, fresh = tokens.encoder(PATH), Tokenizer.from_file(PATH)
    assert code.fast is not None and fresh.encode("x<|endoftext|> y", add_special_tokens=False).ids == [87, 50256, 331]
    for t in ["x<|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext| >", "x y"] + texts(20):
        assert np.frombuffer(code.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_packing_pieces(spark):
    rows = long_texts()
    found = packing.pack_documents(table(spark, rows)).collect()
    code, whole = tokens.encoder(PATH), defaultdict(list)
    for r in found:
        whole[r.doc_id].append(r)
    filled = defaultdict(list)
    for i, t, _ in {r[0]: r for r in rows}.values():
        ids, at = code.encode(t or "") + b"\0\0\0\0", 0
        copies = 2 if i == 1003 else 1
        for r in sorted(whole[i], key=lambda r: (r.start, r.sequence_id))[::copies]:
            assert r.start == at and r.doc_tokens == len(ids) // 4
            if copies == 1:
                assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    for r in found:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY and len(parts) <= packing.SEGMENTS
    used = sum(n for parts in filled.values() for _, n in parts)
    assert used / (len(filled) * packing.CAPACITY) > 0.97


def test_packing_examples_keeps_all_limits(spark):
    g = random.Random(9)
    rows = [(k, g.randint(1, 300), g.randint(0, 120)) for k in range(1500)] + [(9999, 5000, 10)]
    df = spark.createDataFrame(rows, "id long, tokens long, loss long")
    found = packing.pack_examples(df, "id", "tokens", "loss", 1024, 6, 300).collect()
    need, bins = {i: (t, s) for i, t, s in rows}, defaultdict(list)
    for r in found:
        bins[r.sequence_id].append(r.id)
    assert sorted(r.id for r in found) == sorted(need)
    for own in bins.values():
        assert own == [9999] or (sum(need[i][0] for i in own) <= 1024 and len(own) <= 6 and sum(need[i][1] for i in own) <= 300)


def brute_bins(rows, caps):
    """The dot-product heuristic from its definition, one candidate at a time, over one pool."""
    waiting, total, out = list(rows), [sum(r[1] for r in rows), len(rows), sum(r[2] for r in rows)], []
    weight = [t / len(rows) / c**2 for t, c in zip(total, caps)]
    while waiting:
        left, own = list(caps), []
        while True:
            best = None
            for r in waiting:
                need = (r[1], 1, r[2])
                if all(n <= x for n, x in zip(need, left)):
                    score = sum(w * x * n for w, x, n in zip(weight, left, need))
                    if best is None or score > best[0] + 1e-12:
                        best = (score, r, need)
            if best is None:
                break
            waiting.remove(best[1])
            own.append(best[1][0])
            left = [x - n for x, n in zip(left, best[2])]
            if left[0] <= 0 or left[1] <= 0:
                break
        out.append(own or [waiting.pop(0)[0]])
    return out


def test_packing_heuristic_by_brute_force(spark):
    g = random.Random(3)
    rows = [(k, g.randint(1, 400), g.randint(0, 300)) for k in range(300)] + [(900, 3000, 1), (901, 10, 900)]
    found = packing.pack_examples(spark.createDataFrame(rows, "id long, tokens long, loss long").coalesce(1), "id", "tokens", "loss", 1024, 6, 512).collect()
    bins = defaultdict(dict)
    for r in found:
        bins[r.sequence_id][r.place] = r.id
    assert [[own[k] for k in sorted(own)] for _, own in sorted(bins.items())] == brute_bins(rows, (1024, 6, 512))
    need = {r[0]: r for r in rows}
    assert sum(sum(need[i][2] for i in own.values()) > 400 for own in bins.values()) > 20  # the third limit binds


def test_packing_conversations(spark, tmp_path):
    g = random.Random(8)
    turns = [(k // 4, k % 4, ["system", "user", "assistant", "assistant"][k % 4], t) for k, t in enumerate(texts(400, 5, 1, 90))] + [(500, 0, None, None), (None, 0, "user", "x")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    code, need = tokens.encoder(PATH), defaultdict(lambda: [0, 0])
    for i, _, role, t in turns:
        n = len(code.encode(t or "")) // 4 + 1
        need[i][0] += n
        need[i][1] += n * (role == "assistant")
    bins = defaultdict(list)
    for r in packing.packing_conversations(spark, str(tmp_path)).collect():
        bins[r.sequence_id].append((r.offset, r.id))
    assert Counter(i for own in bins.values() for _, i in own) == Counter(list(need))
    for own in bins.values():
        assert [a for a, _ in sorted(own)] == [sum(need[i][0] for _, i in sorted(own)[:k]) for k in range(len(own))]
        assert len(own) == 1 or (sum(need[i][0] for _, i in own) <= 1024 and sum(need[i][1] for _, i in own) <= 512 and len(own) <= 8)


def test_token_output_is_lossless(spark):
    rows = [(i, t, s) for i, t, s in long_texts() if i != 1003]
    found = token_output.packed_rows(table(spark, rows)).collect()
    code, parts = tokens.encoder(PATH), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens :] == token_output.PAD_ID).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[d].append((s, ids[a:b].astype("<u4").tobytes()))
        place = token_output.positions(r.cu_seqlens)
        assert all(place[a] == 0 for a in r.position_resets)
    for i, t, _ in rows:
        assert b"".join(x for _, x in sorted(parts[i])) == code.encode(t or "") + b"\0\0\0\0"


def test_best_fit_decreasing_by_brute_force():
    g = random.Random(2)
    for _ in range(100):
        sizes, room, where = [g.randint(1, 64) for _ in range(g.randint(0, 60))], [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [k for k in range(len(room)) if room[k] >= sizes[i]]
            k = min(fits, key=lambda k: room[k]) if fits else len(room)
            if not fits:
                room.append(64)
            room[k] -= sizes[i]
            where[i] = k
        found = token_output.best_fit_decreasing(sizes, 64)
        assert len(found) == len(room) and sorted(i for b in found for i in b) == list(range(len(sizes)))
        assert sorted(64 - sum(sizes[i] for i in b) for b in found) == sorted(room)


def brute_shingles(t):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_family(seed, n, words=120):
    g = random.Random(seed)
    base = [f"w{seed}x{g.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(g.randrange(8)):
            own[g.randrange(words)] = f"e{g.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def brute_classes(rows):
    sets = {i: brute_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("slots", ["usual", "all frequent"])
def test_ngram_join(spark, slots, monkeypatch):
    if slots == "all frequent":
        monkeypatch.setattr(ngram_join, "frequency_classes", lambda first: np.ones(1 << ngram_join.SLOT_BITS, np.uint8))
        monkeypatch.setattr(ngram_join, "BLOCK_LEAST", 8)
    g, passage = random.Random(4), " ".join(f"p{k}" for k in range(60))
    rows = [t for s in range(6) for t in near_family(s, 25)] + [f"{passage} {t}" for t in texts(60, 8, 5, 90)] + texts(40, 6, 1, 6) + near_family(99, 30, 7)
    g.shuffle(rows)
    rows = list(enumerate(rows)) + [(5000 + i, t) for i, t, _ in ODD if i != 3]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(table(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert found == brute_classes(rows)
    if slots == "usual":
        rows += [(3, f"its own text {k} of many words") for k in range(3)] + [(None, rows[0][1]), (None, "nothing like this text anywhere"), (None, "")]
        out = ngram_join.keep_one(table(spark, [(i, t, "a") for i, t in rows])).collect()
        kept = {i for i, (_, c) in found.items() if i == c}
        assert {r.doc_id for r in out if r.doc_id != 3} == kept - {3} | {None}
        assert sorted(r.text for r in out if r.doc_id is None) == ["", "nothing like this text anywhere"]
        assert {r.text for r in out if r.doc_id == 3} >= {f"its own text {k} of many words" for k in range(3)}


def test_shingle_sizes():
    all_texts = texts(200, 3, 0, 30) + [t or "" for _, t, _ in ODD] + ["A b C d E f", "a B c D e F"]
    found = shingle_sets(all_texts)
    assert [len(s) for s in found] == [len(brute_shingles(t)) for t in all_texts]
    for small in (1, 7, 50):
        few = [k for k, t in enumerate(all_texts) if len(t) < 3000]
        assert all(np.array_equal(found[k], s) for k, s in zip(few, shingle_sets([all_texts[k] for k in few], small)))
    assert (found[-1] == found[-2]).all()


def test_components(spark):
    g = random.Random(1)
    pairs = [(g.randrange(400), g.randrange(400)) for _ in range(250)] + [(500 + k, 501 + k) for k in range(12)] + [(1000, 1001 + k) for k in range(200)]
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {v: find(v) for v in root if any(v in p and p[0] != p[1] for p in pairs)}


def test_vector_dedup(spark):
    g = np.random.default_rng(5)
    centres = g.normal(size=(40, 16))
    rows, k = [], 0
    for c in centres:
        for _ in range(g.integers(1, 9)):
            rows.append((k, (c + g.normal(scale=0.12, size=16)).tolist(), k % 2))
            k += 1
    rows += [(k + j, rows[0][1], 0) for j in range(30)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None), (n + 4, [1.0], 0), (n + 5, [], 1), (n + 6, [None] * 16, 1), (n + 7, [float("inf")] * 16, 0), (n + 8, [1e-200] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("vector", F.lit("clash"))
    found = {r.vec_id: r for r in vector_dedup.near_duplicates(df, block=16).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    got = sum(found[i].n_links for i in range(n))
    assert all(found[i].n_links <= near[i].sum() for i in range(n)) and got >= 0.97 * near.sum()
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i, _, _ in odd)
    assert all(found[i].kept == (found[i].component_id == i) for i in range(n))


def test_vector_dedup_of_many_lengths(spark):
    g, rows = np.random.default_rng(11), []
    for length in range(2, 24):
        for _ in range(4):
            c = g.normal(size=length)
            rows += [(len(rows) + j, (c + g.normal(scale=0.05, size=length)).tolist(), j % 2) for j in range(4)]
    signs = [(len(rows) + k, [x], 0) for k, x in enumerate([3.0, 0.25, -1.0, -7.5, 2.0, 0.0])]
    df = spark.createDataFrame(rows + signs, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r for r in vector_dedup.near_duplicates(df, block=4).collect()}
    links = defaultdict(set)
    for i, x, a in rows + signs[:-1]:
        for j, y, b in rows + signs[:-1]:
            if i != j and a == b and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i].add(j)
    assert len(found) == len(rows + signs)
    # The 16 most frequent lengths, here 2 to 17, go by the grid; the others are exact.
    assert all(found[i].n_links == len(links[i]) for i, x, _ in rows + signs if not 2 <= len(x) <= 17)
    assert sum(len(links[i]) for i, x, _ in rows if len(x) > 17) >= 48
    assert {found[i].component_id for i, _, _ in signs} == {signs[0][0], signs[2][0], signs[5][0]}


def test_vector_dedup_measures_its_recall(spark):
    g = np.random.default_rng(8)
    centres = g.normal(size=(60, 24))
    rows = [(k, (centres[k % 60] + g.normal(scale=0.2, size=24)).tolist(), k % 3 % 2) for k in range(1500)] + [(1500 + k, centres[0].tolist(), 0) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vector_dedup.near_duplicates(df, words=8, block=64)
    assert vector_dedup.measured_recall(df, found, 200) > 0.97
    grid = vector_dedup.Grid(vector_dedup._unit(g.normal(size=(2000, 24))), 16)
    assert 1 < grid.probes < 256 and vector_dedup.words_for(10**8) > 3 * vector_dedup.words_for(10**6) / 2


def test_multi_sequence_order():
    g = np.random.default_rng(1)
    a, b = g.random(6), g.random(7)
    sums = [float(a[c // 7] + b[c % 7]) for c in vector_dedup.visits(a, b, 42)]
    assert sums == sorted(sums) and len(set(vector_dedup.visits(a, b, 42))) == 42


def test_vote_by_brute_force():
    g = np.random.default_rng(3)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    known, asked, labels = unit(g.normal(size=(200, 12))), unit(g.normal(size=(40, 12))), g.integers(0, 2, 200).astype(float)
    found = quality.vote(asked, known, labels, 9, 8.0)
    for v, score in zip(asked, found):
        near = sorted(((float(np.dot(v, k)), y) for k, y in zip(known, labels)), reverse=True)[:9]
        weight = [np.exp(8.0 * c) for c, _ in near]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight), abs=1e-5)
    assert (quality.vote(asked, known[:0], labels[:0]) == 0.5).all() and len(quality.vote(asked, known[:3], labels[:3])) == 40


def test_quality(spark):
    g = random.Random(5)
    rows, labels = [], []
    for k, t in enumerate(texts(400, 11, 30, 80)):
        bad = g.random() < 0.3
        rows.append((k, t.upper().replace(" ", "!! ") if bad else t, "s"))
        labels.append((k, int(not bad), 0))
    labels += [(0, None, None), (None, 1, 0), (99999, 1, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = table(spark, rows + [(100000 + i, t, s) for i, t, s in ODD])
    found = quality.score_quality(df, known).collect()
    assert len(found) == len(rows) + len(ODD)
    truth = {i: q for i, q, _ in labels if q is not None}
    held = [r for r in found if r.held_out and r.doc_id in truth and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in found)


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B</h1><p>The   story of\nthe day was <b>told</b> to all.<br>And more of it, so that it is a long block of text.<p>Short&nbsp;one.
    <div class="ad">Buy the best of the best</div><form><p>Name</p></form><p>Streing | isheedheat | nothing</p></article>
    <section id="comments"><p>I liked the story and it was good to read for all of us in the town.</p></section>
    <aside><p>Related to the story of the day and to all that it was about in the end.</p></aside><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == ["A & B", "The story of the day was told to all. And more of it, so that it is a long block of text.", "Short one.", "Streing | isheedheat | nothing"]
    plain = "<body><div>Menu</div><p>It was the best of times, it was the worst of times, and all of it was in the town where they lived.</p><p>Yes.</p><p>And so it was that they went to the sea and from there to the other side of the world for a day.</p></body>"
    assert html_text.main_text(plain).split("\n")[-2] == "Yes."
    for odd in (None, "", "<", "<p", "text < 3 > 2", "<p>&#x41;&bogus;</p>", "<a" * 3000, "</p>" * 3000, "<!--", "<script>x"):
        assert isinstance(html_text.main_text(odd), str)


def test_html_scanning_is_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        page = "<div>" * n + "</section>" * n + "<p>text"
        start = time.perf_counter()
        assert html_text.main_text(page) == "text"
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_html_unclosed_link():
    story = "It was the best of times, and it was the worst of times for all of the people in the town."
    assert html_text.main_text(f"<body><p><a href=x>Read on</p><p>{story}</p>") == story
    assert html_text.main_text(f"<body><div><a href=x>Read</div><div>{story}</div>") == story
    assert html_text.main_text(f"<body><a href=x><div>{story}</div></a>") == ""


def brute_labels(found):
    """The rules from their definition, a block at a time."""
    inside = any(b.region and not b.banned for b in found)

    def decided(b):
        words = re.findall(r"[^\W\d_]+", b.text.lower())
        if b.banned or (inside and not b.region) or b.links / max(1, len(b.text)) > html_text.LINKS_HIGH:
            return "bad"
        if len(b.text) >= html_text.LONG and sum(w in html_text.STOP_WORDS for w in words) / max(1, len(words)) >= html_text.STOP_HIGH:
            return "good"
        return "bad" if not inside and not words else ""

    first = [decided(b) for b in found]
    if not inside and "good" not in first:
        return [x or "good" for x in first]
    out = []
    for i, b in enumerate(found):
        sides = []
        for js in (range(i - 1, -1, -1), range(i + 1, len(found))):
            j = next((j for j in js if first[j] == "good" or (first[j] == "bad" and not inside)), None)
            if j is not None and found[j].region == b.region:
                sides.append((abs(i - j), first[j] != "good", first[j]))
        out.append(first[i] or (min(sides)[2] if sides else "good" if inside else "bad"))
    return out


def test_html_rules_by_brute_force():
    g = random.Random(12)
    for _ in range(400):
        found = []
        for _ in range(g.randint(0, 14)):
            words = g.choices(["the", "and", "of", "Haus", "zebra", "x1", "42", "|"], k=g.randint(1, 30))
            text = " ".join(words)
            found.append(html_text.Block(text, g.choice([0, 0, len(text)]), g.choice([0, 0, 1, 2]) if g.random() < 0.5 else 0, g.random() < 0.2, False))
        wanted = brute_labels(found)
        assert [b.label for b in html_text.classify(found)] == wanted


def test_html_rows(spark):
    rows = [(1, "u", None, "c"), (2, None, "", "c"), (3, "u", "<p>" + "The cat and the dog of the house were in it. " * 20000, "c"), (3, "u", "<p>x", "c"), (None, "u", "<p>x", "c")]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in found] == [(1, "u", 0), (2, None, 0), (3, "u", 45 * 20000 - 1), (3, "u", 1), (None, "u", 1)]
    assert all(r.n_chars == len(r.text) for r in found)


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return pii.ordered(out)


def test_personal_data_base_rules():
    g = random.Random(8)
    for _ in range(6000):
        t = "".join(g.choice("ab1234567890.@+- ()é٣") for _ in range(g.randint(0, 60)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")


def test_decoding_by_brute_force():
    """The whole-text decoding skips only what can't matter: its path scores as much as the best of all."""
    import itertools

    g = np.random.default_rng(6)
    for n in (1, 2, 5):
        for _ in range(20):
            s, trans = g.normal(scale=3, size=(n, 4)), g.normal(size=(4, 4))
            s[:, 0] += g.choice([0, 8])
            value = lambda tags: sum(s[i, t] for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:]))
            assert value(pii.viterbi(s, trans).tolist()) == pytest.approx(max(map(value, itertools.product(range(4), repeat=n))), abs=1e-5)
    for _ in range(20):
        s, trans = g.normal(scale=2, size=(60, 4)), g.normal(scale=0.7, size=(4, 4))
        s[:, 0] += g.choice([0, 6], size=60)
        best = s[0]
        for t in range(1, 60):
            best = (best[:, None] + trans).max(0) + s[t]
        tags = pii.viterbi(s, trans).tolist()
        assert sum(s[i, t] for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])) == pytest.approx(best.max(), abs=1e-4)


def test_windows_cover_every_character():
    for size in (0, 1, 511, 512, 513, 992, 993, 3000):
        own = pii.windows(size)
        assert {i for a, b in own for i in range(a, b)} == set(range(size)) and all(b - a <= pii.WINDOW for a, b in own)
        assert all(x[1] - y[0] == pii.OVERLAP for x, y in zip(own, own[1:]))
        for lo, hi in ((0, size // 2), (size // 2, size)):
            assert hi <= lo or set(pii.windows(size, lo, hi)) == {w for w in own if w[0] < hi and w[1] > lo}


def test_personal_data_model(spark, monkeypatch):
    held = pii.made_examples(300, seed=77)
    model = pii.default_model()
    found = pii.model_spans([t for t, _ in held], model)
    inner = [(m, s) for (t, spans), m in zip(held, found) for s in spans if s[1] > 0 and s[2] < len(t)]
    assert sum(s in m for m, s in inner) / len(inner) > 0.85
    assert sum(s not in spans for (_, spans), m in zip(held, found) for s in m) / len(inner) < 0.08
    forms = "Please ask bob (at) example.com about it, or call 030/1234567 today. The card 4111.1111.1111.1111 was used from 10[.]0[.]0[.]7 last week, said the (555) 123-4567 desk."
    spans = pii.all_spans([forms], model)[0][1]
    seen = {forms[a:b] for _, a, b in spans}
    assert {"4111.1111.1111.1111", "10[.]0[.]0[.]7"} <= seen and len(seen) >= 4
    text = "Write to ann.lee@mail.example.com or +1 (503) 555-8963, from 10.0.0.1. " * 3
    long = "the cat sat on the mat and so on. " * 400 + forms + " and so it went on for a while. " * 300 + forms
    whole = pii.all_spans([text, "", long, forms], model)
    with monkeypatch.context() as m:  # parts and neighbours don't matter
        m.setattr(pii, "PART", 3000)
        assert pii.all_spans([long, text], model) == [whole[2], whole[0]]
    assert pii.all_spans([long], model)[0] == whole[2]
    rows = pii.find_personal_data(table(spark, [(0, text, "a"), *ODD])).collect()
    own = next(r for r in rows if r.doc_id == 0)
    base = brute_spans(text)
    assert (own.n_email, own.n_ip, own.n_phone, own.n_card) == (3, 3, 3, 0)
    assert own.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest() and set(pii.listed(base).split(",")) <= set(own.spans.split(","))
    assert all(r.spans == "" for r in rows if r.doc_id)
    clean = {r.doc_id: r.text for r in pii.redact(table(spark, [(0, text, "a")])).collect()}[0]
    assert clean == "Write to [EMAIL] or [PHONE], from [IP]. " * 3


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    g, rows, labels = random.Random(6), [], []
    for k, t in enumerate(texts(120, 21, 30, 80) + [t for t in near_family(3, 10)] * 2):
        bad = k < 120 and g.random() < 0.2
        rows.append((k, t.upper().replace(" ", "!! ") if bad else t, f"s{k % 3}"))
        labels.append((k, int(not bad), 0))
    table(spark, rows).drop("_key", "recipe").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, [r.asDict() for r in docs.collect()]
    for name, stage in pipeline.STAGES:
        out = [r.asDict() for r in stage(spark, spark.createDataFrame([tuple(r[c] for c in columns) for r in seen], docs.schema), str(tmp_path)).collect()]
        if name == "packing":
            size = lambda t: len(tokens.encoder(PATH).encode(t)) // 4 + 1
            assert sum(r["length"] for r in out) == sum(size(r["text"]) for r in seen)
            break
        assert list(out[0]) == columns
        if name == "quality":
            assert sum(labels[r["doc_id"]][1] for r in out) >= 0.97 * sum(q for _, q, _ in labels) and sum(1 - labels[r["doc_id"]][1] for r in out) <= 2
        if name == "exact_dedup":
            last = {r["text"]: r["doc_id"] for r in sorted(seen, key=lambda r: r["doc_id"])}
            assert sorted(r["doc_id"] for r in out) == sorted(last.values())
        if name == "ngram_join":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in seen])
            assert {r["doc_id"] for r in out} == {i for i, (_, c) in classes.items() if i == c}
        seen = out


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and an empty table pass through every stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    base = " ".join(f"q{k}" for k in range(60))
    near = [base, base + " end", base.upper(), base + " stop"]
    rows = [*ODD, (None, "a text of its own without any id at all", "a"), (None, near[0], None), (3, "another text of the id three", "a"), *[(50 + k, t, "b") for k, t in enumerate(near)]]
    for name, some in (("odd", rows), ("none", [])):
        table(spark, some).drop("_key", "recipe").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (50, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        found = pipeline.run(spark, str(tmp_path / name)).collect()
        if not some:
            assert found == []
            continue
        # Every row is good to a classifier that knows good ones only; then one of equal and of similar texts stays.
        kept = {t for _, t, _ in rows if t and t.strip()} - set(near)
        docs = table(spark, rows).drop("_key", "recipe")
        once = ngram_join.keep_one(exact_dedup.keep_one(docs)).collect()
        assert Counter(r.text for r in once if r.text and r.text.strip()) == Counter(kept | {near[0]}) and [r.doc_id for r in once if r.text == near[0]] == [50]
        assert found and all(r.length > 0 and r.offset + r.length <= 1024 for r in found) and None in {r.doc_id for r in found}
