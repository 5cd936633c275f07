"""Tokenizer alignment against a token by token brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from bidlake.llm import alignment

DOCS = "doc_id long, text string, a string, pairs long"


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY_A))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.VOCABULARY_B))


def _letters():
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {(chr(b) if b in printing else chr(next(others))): b for b in range(256)}


def _spans(tokens):
    at = 0
    for number, raw in tokens:
        yield number, at, at + len(raw)
        at += len(raw)


def brute(texts, libraries):
    one, two = libraries
    back = _letters()
    said, counts = [], collections.Counter()
    for text in texts:
        a = [(i, bytes(back[x] for x in one.id_to_token(i))) for i in one.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())
             for i in two.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(raw for _, raw in x) != whole for x in (a, b)):
            said.append(None)
            continue
        a, b = list(_spans(a)), list(_spans(b))
        links = [(x, y) for i, (x, s, e) in enumerate(a) for y, p, q in b if s < q and p < e]
        counts.update(set(links))
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, before = [], 0
        for end in common:
            groups.append(([x for x, s, e in a if before < e <= end], [y for y, s, e in b if before < e <= end]))
            before = end
        said.append((len(a), len(b), groups, links))
    most = collections.Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for row in said:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
            continue
        n_a, n_b, groups, links = row
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups)))
    return out


def _texts():
    rng = random.Random(5)
    letters = list("abcdeéß ’日本語 \n\t.,'0123<|>") + ["the ", " and", "ing ", "<|endoftext|>", "<0x41>", "  ", "</s>"]
    return [None, "", " ", "  ", "a ", "▁x", "see <|endoftext|> here", "日本語" * 30, "same words here"] * 2 + [
        "".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(150)] + ["word " * 3000, "x" * 500]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 40, 0])
def test_digest_equals_brute_force(spark, libraries, frequent):
    texts = _texts()
    rows = [(None if i % 7 == 0 else i // 2, t, "clash", i) for i, t in enumerate(texts)]
    found = alignment.alignment_digest(spark.createDataFrame(rows, DOCS).repartition(5), frequent_pairs=frequent).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]
    want = [(r[0], *x) for r, x in zip(rows, brute(texts, libraries), strict=True)]
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in found), key=str) == sorted(want, key=str)


def test_links_and_groups_fit_the_texts(spark, libraries):
    rows = [(i, t, "", 0) for i, t in enumerate(_texts())]
    one, two = libraries
    for r in alignment.alignments(spark.createDataFrame(rows, DOCS)).collect():
        assert sum(r["group_a"]) == len(r["a"]) and sum(r["group_b"]) == len(r["b"])
        assert len(r["link_a"]) == len(r["a"]) + len(r["b"]) - len(r["group_a"])
        text = rows[r["doc_id"]][1]
        if r["a"]:
            assert list(r["a"]) == one.encode(" " + text, add_special_tokens=False).ids and list(r["b"]) == two.encode(text)
            assert sum(r["link_bytes"]) == len(text.encode()) + 1


def test_gustavson_sums_equal_columns():
    rng = np.random.default_rng(0)
    left, right = (rng.random((7, 5)) < 0.4), (rng.random((5, 6)) < 0.4)
    csr = [(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1]) for m in (left, right)]
    starts, columns, values = alignment.gustavson(*csr, 6)
    dense = np.zeros((7, 6), int)
    dense[np.repeat(np.arange(7), np.diff(starts)), columns] = values
    assert (dense == left.astype(int) @ right.astype(int)).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert alignment.alignment_digest(none).count() == 0 and alignment.alignments(none).count() == 0
