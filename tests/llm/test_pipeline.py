"""The corpus pipeline, stage by stage: join, suffix dedup and packing against brute force, the
language stage and the mix against the decisions of their own operators."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidlake.llm import language, mixing
from bidlake.llm.common import SMALL_STEP_BYTES
from bidlake.llm.tokens import vocabulary_path
from tests.llm.test_operators import _ids, _row_groups, library  # noqa: F401

# names that the operators use themselves
EXTRA = ["k1", "k2", "spans", "row", "row_key", "letters", "lower", "size", "copies", "copy", "first", "text_key", "_letters", "w"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with 150 documents of the given table and cases of their own."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150)
    words = [w for r in docs.select("text").collect() for w in (r.text or "").split()]
    rng = random.Random(2)
    passage = " ".join(rng.choices(words, k=60))
    texts = [" ".join([*rng.choices(words, k=80), passage, *rng.choices(words, k=80)]) for _ in range(3)]
    long_ = " ".join(f"{w}{i}" for i, w in enumerate(rng.choices(words, k=700_000)))
    assert len(long_) > SMALL_STEP_BYTES
    near = " ".join(rng.choices(words, k=100))
    rows = [(None, texts[0], "a"), (None, texts[0], "b"), (9001, texts[1], "a"), (9001, texts[2], None), (9002, near, "a"),
            (9002, near, "a"), (9003, near + " more", "b"), (9004, None, "a"), (9005, "", "b"), (9006, "12 34", None), (9007, long_, "b")]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name, kind in docs.dtypes:
        if name not in own.columns:
            own = own.withColumn(name, F.lit(0 if name == "n_chars" else None).cast(kind))
    both = docs.unionByName(own.select(docs.columns))
    folder = str(tmp_path_factory.mktemp("corpus"))
    both.withColumns({c: F.concat(F.lit(c), F.md5(F.coalesce("text", F.lit("")))) for c in EXTRA}).write.parquet(f"{folder}/documents.parquet")
    return folder


def _key(rows):
    return Counter((r.doc_id, r.text, r.source) for r in rows)


def _without_repeats(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hash(r[i:i + window]) for r in raw for i in range(len(r) - window + 1))
    out = []
    for t, r in zip(texts, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - window + 1):
            if seen[hash(r[i:i + window])] > 1:
                gone[i:i + window] = True
        # a character that loses a byte goes whole
        place = np.cumsum((np.frombuffer(r, np.uint8) & 0xC0) != 0x80)
        gone |= np.isin(place, place[gone])
        out.append(t if t is None else np.frombuffer(r, np.uint8)[~gone].tobytes().decode())
    return out


def test_stages(spark, corpus, library):  # noqa: F811
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = corpus_pipeline.stage(stages[name](spark, df, corpus), name)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c].startswith(c) and len(r[c]) == len(c) + 32 for r in rows for c in EXTRA)
        return out, rows

    known, rows = step("language_id", docs)
    model = language.fit(docs)
    rejected = language.predict(docs.select("doc_id", "text"), model).filter("rejected").groupBy("doc_id").count().collect()
    lost = Counter(r.doc_id for r in before)
    lost.subtract(Counter(r.doc_id for r in rows))
    assert {d: n for d, n in lost.items() if n} == {r.doc_id: r["count"] for r in rejected}
    assert not {9004, 9005, 9006} & {r.doc_id for r in rows}

    single, kept = step("ngram_jaccard_join", known)
    groups = _row_groups([(r.doc_id, r.text) for r in rows])
    stay = {}
    for r, (_, least, top) in zip(rows, groups, strict=True):
        if r.doc_id is None:
            stay.setdefault(("null", len(stay)), {(None, r.text)})
        elif r.doc_id == least:
            stay.setdefault(top, set()).add((r.doc_id, r.text))
    assert len(kept) == len(stay)
    have = Counter((r.doc_id, r.text) for r in kept)
    assert all(any(have[c] for c in choices) for choices in stay.values())

    cut, left = step("suffix_array_dedup", single)
    want = _without_repeats([r.text for r in kept])
    assert _key(left) == Counter((r.doc_id, t, r.source) for r, t in zip(kept, want, strict=True))
    assert all(r.n_chars == len(r.text) for r in left) and any(a != b.text for a, b in zip(want, kept, strict=True))

    mixed, taken = step("source_mix", cut)
    decided = Counter()
    for r in mixing.mix(cut).collect():
        decided[r.doc_id, r.source, r.size] += r.copies
    size = mixed.select("doc_id", "source", F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).collect()
    assert Counter((r.doc_id, r.source, r.n) for r in size) == +decided and set(_key(taken)) <= set(_key(left))

    packed = corpus_pipeline.pack_sequences(spark, mixed, corpus).collect()
    ids = Counter()
    for r in taken:
        whole = np.array([*_ids(library, r.text), 0], "<u4")
        first = len(whole) % 2048 or 2048
        for at in [0, *range(first, len(whole), 2048)]:
            part = whole[at:first] if at == 0 else whole[at:at + 2048]
            ids[r.doc_id, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == ids
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_whole_run(spark, corpus, tmp_path):
    out = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    spark.read.parquet(f"{corpus}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_rows_of_null_ids(spark):
    rows = [(None, " ".join(["w"] * (1 + i % 5)), "xyz"[i % 3]) for i in range(300)] + [(3, "a b c", "z")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = mixing.mixed_rows(docs).groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()
    assert {r.source: r.n for r in got} == want
