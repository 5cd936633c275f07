"""Toxicity under wrong labels and misspellings, on documents made here and on held-out ones."""

import random
import zlib

import numpy as np

from bidlake.llm import toxicity

SYLLABLES = ["ra", "to", "mi", "len", "kor", "va", "des", "pu", "nin", "shal", "go", "ther", "wi", "bel", "xa", "quo"]


def _corpus(spark, wrong, n=900, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(3000)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["zyggorf", "brumfid", "hekklot"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic and rng.random() >= wrong), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, truth int"))


def _rates(docs, labels, model):
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r.truth for r in rows if r.predicted)
    return hits / sum(r.truth for r in rows), hits / max(sum(r.predicted for r in rows), 1)


def test_wrong_labels_do_not_veto_words(spark):
    for wrong in (0.0, 0.05):
        docs, labels = _corpus(spark, wrong)
        recall, precision = _rates(docs, labels, toxicity.fit(docs, labels.select("doc_id", "toxic")))
        assert recall >= 0.8 and precision >= 0.8, (wrong, recall, precision)


def test_misspellings_share_the_n_grams(spark):
    docs, labels = _corpus(spark, 0.0)
    model = toxicity.fit(docs, labels.select("doc_id", "toxic"))
    clean = docs.filter("doc_id = 1").first().text
    rows = [(0, clean), (1, clean + " zyggorff"), (2, "brumfidd " + clean)]
    score = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert score[1] > score[0] and score[2] > score[0]


def test_evidence_bears_a_few_clean_documents():
    toxic, everywhere, rare = (100, 105), (50, 500), (1, 1)
    evidence, open_ = toxicity._evidence(np.array([toxic[0], everywhere[0], rare[0]]), np.array([toxic[1], everywhere[1], rare[1]]), 0.1)
    assert open_.tolist() == [True, False, True] and evidence[0] > 100 and evidence[1] == 0 and evidence[2] < 3


def test_line_of_separable_rows_is_finite():
    x = np.concatenate([np.full(50, -4.0), np.full(10, 5.0)])
    slope, offset = toxicity._line(x, x > 0)
    assert slope > 0 and np.isfinite([slope, offset]).all()
    assert 1 / (1 + np.exp(-(slope * 5 + offset))) > 0.9 and 1 / (1 + np.exp(-(slope * -4 + offset))) < 0.1


def test_the_held_out_fold_is_the_contract_s(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(30)], "doc_id long, text string")
    rows = toxicity.score(docs, toxicity.ToxicityModel(None)).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1}
