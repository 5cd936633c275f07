"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidlake.llm import (hnsw, language, mixing, packing, sharding, signature_join, suffixes, token_store, toxicity,
                         vector_dedup)
from bidlake.llm.common import fresh_folder, text_steps
from bidlake.llm.subwords import all_words
from bidlake.llm.tokens import Encoder, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"
ODD = [(1, None, "en", "a", 0, "x"), (2, "", "en", None, 0, "x"), (None, "word", None, "b", 4, "x"),
       (3, "one two three four five six", "en", "a", 0, "x"), (3, "one two three four five six", "en", "a", 0, "x"),
       (4, "One two THREE four five six", "fr", "b", 0, "x"), (5, " \t\n ", None, "b", 0, "x"), (6, "12 34 — ☃", "fr", "c", 0, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    random.seed(3)
    letters = list("ab1.,' \n\té× ’日_-")
    texts = ["".join(random.choices(letters, k=random.randint(0, 14))) for _ in range(5000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    encoder = Encoder(vocabulary_path())
    for part, data, starts in text_steps(iter([batch]), step_bytes=20_000):
        ids, before = encoder.encode(data, starts)
        for i, text in enumerate(part.column("text").to_pylist()):
            assert ids[before[i]:before[i + 1]].tolist() == _ids(library, text)


def test_added_tokens_equal_the_library(library):
    random.seed(4)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<", "|>", "a", "12", " ", "\n", "'s", "é", "’", "."]
    texts = ["see <|endoftext|> here", "<|endoftext|>", "<|endof", "text|>", "<|endof", "text|><|endoftext|>"] + [
        "".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(5000)]
    assert _ids(library, texts[0]) == [3826, 220, 50256, 994]
    encoder = Encoder(vocabulary_path())
    for part, data, starts in text_steps(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), step_bytes=20_000):
        ids, before = encoder.encode(data, starts)
        for i, text in enumerate(part.column("text").to_pylist()):
            assert ids[before[i]:before[i + 1]].tolist() == _ids(library, text)


def test_token_store(spark, small, library, odd, empty):
    rows = token_store.stored_index(small, vocabulary_path()).orderBy("doc_id").collect()
    start = 0
    for r, d in zip(rows, small.orderBy("doc_id").collect(), strict=True):
        ids = np.array([*_ids(library, d.text), 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_store.stored_index(odd, vocabulary_path()).count() == len(ODD)
    assert token_store.stored_index(empty, vocabulary_path()).count() == 0


def test_any_id_is_read_alone(spark):
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    held = token_store.Segment(token_store.encode_segment(np.array([7]), np.array([False]), np.array([0, 5000]), ids))
    assert (held.all_ids() == ids).all()
    at = np.random.default_rng(2).permutation(5000)[:700]
    assert (held.ids_at(at) == ids[at]).all()
    with pytest.raises(IndexError):
        held.ids_at(np.array([5000]))


def test_packing(spark, small, library, odd, empty):
    rows = packing.pack(small, vocabulary_path(), capacity=300).collect()
    pieces = {(r.doc_id, r.piece): r for r in rows}
    for d in small.collect():
        ids = np.array([*_ids(library, d.text), 0], "<u4")
        first = len(ids) % 300 or 300
        for i, at in enumerate([0, *range(first, len(ids), 300)]):
            r = pieces.pop((d.doc_id, i))
            want = ids[at:first] if i == 0 else ids[at:at + 300]
            assert (r.start, r.length, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
    assert not pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 300
    assert packing.pack(odd, vocabulary_path()).count() == len(ODD)
    assert packing.pack(empty, vocabulary_path()).count() == 0


def _fewest(items, capacity):
    """The least number of bins, by search."""
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                put(i + 1, bins)
                bins[k] -= items[i]
        put(i + 1, bins + [items[i]])

    put(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(300):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        left = {s: items.count(s) for s in items}
        fixed = packing.reduce_by_dominance(left, 20)
        rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + _fewest(rest, 20) == _fewest(items, 20)
        packed = packing.plan({s: items.count(s) for s in items}, 20)
        assert sorted(s for p, n in packed for s in p * n) == sorted(items) and all(sum(p) <= 20 for p, _ in packed)


def test_mix(spark, small, odd, empty):
    rows = mixing.mix(small).collect()
    by = {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        held = by.setdefault(r.source, [r.target, r.source_size, 0, 0])
        held[2] += r.taken
        held[3] = max(held[3], r.size)
    assert sum(h[0] for h in by.values()) == pytest.approx(sum(h[1] for h in by.values()))
    for target, size, taken, largest in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= largest
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    assert sorted(map(str, mixing.mix(small).collect())) == sorted(map(str, rows))
    weighed = mixing.mix(small.withColumn("w", 1.0 + F.col("doc_id") % 3), importance="w").groupBy("source").agg(
        F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("m"), F.first("source_size").alias("s"))
    assert all(abs(r.t - r.target) <= r.m for r in weighed.collect() if r.target < 1.5 * r.s)


def test_shards(spark, small, odd, empty):
    rows = sharding.shard(small, limit=50_000).collect()
    held = {}
    for r in rows:
        assert len(r.shard) == r.depth
        held.setdefault((r.shard, r.page), []).append(r.n_bytes)
    assert all(sum(x) <= 50_000 or len(x) == 1 for x in held.values())
    names = sorted({s for s, _ in held})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    same = spark.createDataFrame([(9, "x" * 10)] * 100, "doc_id long, text string")
    pages = sharding.shard(same, limit=50).groupBy("page").agg(F.sum("n_bytes").alias("b")).collect()
    assert sum(p.b for p in pages) == 1000 and all(p.b <= 50 for p in pages)
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(empty).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    found = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang = lang_pred").count() >= 0.97 * found.count()
    out = {(r.doc_id, r.lang_pred) for r in language.predict(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (5, "und"), (6, "und")} <= out
    assert language.predict(empty, model).count() == 0
    assert language.accepted(odd, model).columns == odd.columns
    assert {r.lang_pred for r in language.predict(odd, language.fit(empty)).collect()} == {"und"}


@pytest.mark.parametrize("learnt", [["en"], ["en", "fr"], ["en", "fr", "de"]])
def test_unlearnt_languages_are_rejected(spark, learnt):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.filter(F.col("lang").isin(learnt)))
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    clean = [r.rejected for r in rows if r.lang in learnt]
    strange = [r.rejected for r in rows if r.lang not in learnt and r.n >= 200]
    assert sum(clean) <= 0.01 * len(clean) and sum(strange) >= 0.9 * len(strange) > 0
    texts = docs.filter(F.col("lang") == "es").limit(50)
    assert language.accepted(texts, model).count() < 10


def test_toxicity(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    flagged = [r.toxic for r in found if r.predicted]
    assert sum(flagged) >= 0.9 * len(flagged) and sum(flagged) >= 0.6 * sum(r.toxic for r in found)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(docs, labels.filter("toxic = 0"))).collect()} == {0.0}


def test_samples_hold_one_row_of_a_repeated_id(spark, monkeypatch):
    sizes = []

    def noted(table, **options):
        sizes.append(table.num_rows)
        return all_words(table, **options)

    monkeypatch.setattr(language, "all_words", noted)
    monkeypatch.setattr(toxicity, "all_words", noted)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1][:20]
    rows = [(i, f"word{i} und text", "en") for i in ids] + [(ids[0], f"other {k % 7}", "en") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    language.fit(docs, per_language=10)
    toxicity.fit(docs, spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int"))
    assert sizes == [10, 20]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _set(text):
    w = _words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _roots(keys, linked):
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_signature_join(spark, odd, empty):
    rng = random.Random(8)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.choice([3, 12, 40, 90, 300]))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = "z" + str(rng.randint(0, 5))
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {i: _set(t) for i, t in enumerate(texts)}
    want = _roots(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_join.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in signature_join.near_duplicates(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 2, 3), (5, 0, 5), (None, 1, None)} <= out
    assert signature_join.near_duplicates(empty).count() == 0


def test_trees_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(signature_join, "BLOCK_SETS", 3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:30] + [f"x{i}"] + words[31:])) for i in range(20)]
    got = signature_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


@pytest.mark.parametrize("block", [512, 3])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(signature_join, "BLOCK_SETS", block)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(30):
        copy = list(words)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"x{rng.randint(0, 5)}"
        texts.append(" ".join(copy))
    texts += [texts[0], "alone here", texts[3], ""]
    sets = [_set(t) for t in texts]
    want = {i: sum(bool(a) and i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    rows = [*enumerate(texts), (None, texts[0])]
    got = signature_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == {**want, None: 0}


def _row_groups(rows):
    """(links, least doc_id reached, place of the row that stays) of every row (doc_id, text), by brute force."""
    sets = [_set(t) if d is not None else set() for d, t in rows]
    linked = lambda i, j: bool(sets[i]) and i != j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    top = _roots(list(range(len(rows))), linked)
    out = []
    for i, (d, _) in enumerate(rows):
        group = [j for j in top if top[j] == top[i]]
        out.append((sum(linked(i, j) for j in group), d if d is None else min(rows[j][0] for j in group), top[i]))
    return out


def test_join_of_repeated_ids_with_unlike_texts(spark):
    a, b = [" ".join(f"{x}{i}" for i in range(80)) for x in "ab"]
    rows = [(5, a), (5, b), (7, b.replace("b40", "z")), (8, a.replace("a40", "z")), (8, a), (8, a), (9, "alone"), (None, a), (4, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = signature_join.near_duplicates(docs).collect()
    want = [(d, len(_set(t)), c, n) for (d, t), (n, c, _) in zip(rows, _row_groups(rows), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {(r.doc_id, r.n_links) for r in got if r.doc_id in (7, 8)} == {(7, 1), (8, 3)}
    left = signature_join.one_of_each_group(docs.withColumns({"row": F.lit(1), "first": F.lit(2), "text_key": F.lit("x")}))
    assert left.columns == ["doc_id", "text", "row", "first", "text_key"]
    assert sorted(map(str, map(tuple, left.select("doc_id", "text").collect()))) == sorted(
        map(str, [(5, a), (5, b), (9, "alone"), (None, a), (4, ""), (4, None)]))
    assert {tuple(r)[2:] for r in left.collect()} == {(1, 2, "x")}
    assert signature_join.one_of_each_group(docs.limit(0)).count() == 0


def test_join_of_random_repeated_ids(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randint(0, 300)}" for _ in range(70)] for _ in range(5)]
    rows = []
    for _ in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(70)] = f"x{rng.randint(0, 9)}"
        rows.append((rng.randint(0, 14), " ".join(words)))
    got = signature_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, len(_set(t)), c, n) for (d, t), (n, c, _) in zip(rows, _row_groups(rows), strict=True)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_unlike_long_words_have_unlike_hashes(spark):
    word = [0]
    while len(word) < 2048:
        word += [1 - x for x in word]
    texts = ["".join("ab"[x] for x in word), "".join("ba"[x] for x in word)]
    got = signature_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in got} == {(0, 0, 0), (1, 1, 0)}


def _removed(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for r in raw:
        for i in range(len(r) - window + 1):
            seen[r[i:i + window]] = seen.get(r[i:i + window], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[r[i:i + window]] > 1:
                gone[i:i + window] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [50_000, 1])
def test_suffix_dedup(spark, odd, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
    rng = random.Random(4)
    passages = ["".join(rng.choices("abé ", k=rng.randint(30, 90))) for _ in range(4)]
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 60))) + rng.choice(passages) + "".join(rng.choices("abé ", k=rng.randint(0, 60)))
             for _ in range(30)] + ["ab" * 60, None, "", passages[0], passages[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(docs, window=24).collect()}
    assert got == dict(enumerate(_removed(texts, 24)))
    if hot > 1:
        assert suffixes.remove_repeats(odd).count() == len(ODD) and suffixes.remove_repeats(empty).count() == 0
        kept = suffixes.remove_repeats(docs, window=24, texts=True).collect()
        assert all("�" not in (r.text or "") for r in kept)


def test_family_of_suffix_arrays():
    data = np.random.default_rng(3).integers(97, 99, 3000).astype(np.uint8)
    lengths = np.full(60, 50)
    context, place = suffixes.repeated_windows(lengths, data, 12, batch_bytes=200)
    seen = {}
    for c in range(60):
        for p in range(39):
            seen.setdefault(data[c * 50 + p:c * 50 + p + 12].tobytes(), []).append((c, p))
    assert sorted(zip(context.tolist(), place.tolist())) == sorted(x for v in seen.values() if len(v) > 1 for x in v)


VECTORS = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]),
           (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [float("inf"), 1.0]), (100, [1.0, 0.1])]


def test_vectors(spark):
    rows = spark.createDataFrame(VECTORS, "id long, vector array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(rows).collect()}
    assert {i: got[i] for i in (1, 2, 3, 100)} == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 100: (3, 1, False)}
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10))
    found = hnsw.search(hnsw.build_index(rows, 4), rows.filter("id % 100 = 0"), 3).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(100, 1, 1), (100, 2, 2), (100, 3, 3)]
    assert found[0].score == pytest.approx(0.1)
    none = rows.limit(0)
    assert vector_dedup.near_duplicates(none).count() == 0
    assert hnsw.search(hnsw.build_index(none, 4), none, 3).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + rng.normal(scale=0.12, size=(200, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = _roots(list(range(400)), lambda a, b: near[a, b])
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(rows, tile_rows=64, leading=3).collect()}
    assert got == {i: (int(near[i].sum()), root[i]) for i in range(400)}
    found = hnsw.search(hnsw.build_index(rows, 6, shard_nodes=100), rows.filter("id % 20 = 0"), 5).collect()
    hits = 0
    for q in range(0, 400, 20):
        gaps = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(400), gaps)) if i != q][:5]
        hits += len(set(order) & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.9 * 100


def test_staged_tables_use_the_named_folder(spark):
    assert fresh_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir", spark.conf.get("spark.sql.warehouse.dir")))
