"""Hashed subword bags with a linear softmax, trained in numpy by stochastic gradient descent.

A word is a run of letters (ASCII letters and all non-ASCII bytes of the lower-cased text); its bag
holds the byte n-grams of the word between ``<`` and ``>``. A bag's embedding is the mean of its
n-gram vectors. As the softmax is linear, a trained model is a table of one logit per n-gram bucket
and class, and the logits of any text are the mean over its n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bidlake.llm.common import byte_strings, mixed, ranges, text_steps, words_of

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[ord("a"):ord("z") + 1] = True
_WORD_BYTES[128:] = True


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with lower-cased ``text``."""
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pc.utf8_lower(batch.column(at).cast(pa.large_string())))


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words of the step, number of each occurrence's word, its text)."""
    begins, ends, text = words_of(data, starts, _WORD_BYTES)
    words = byte_strings(data, begins, ends).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), text


def all_words(texts: pa.Table, step_bytes: int = 2_000_000) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``distinct_words`` of a whole table of texts, read in small steps; numbers are 32 bits wide."""
    parts, owners, before = [], [], 0
    for batch, data, starts in text_steps(map(lowered, texts.select(["text"]).to_batches(max_chunksize=256)), step_bytes=step_bytes):
        begins, ends, text = words_of(data, starts, _WORD_BYTES)
        parts.append(byte_strings(data, begins, ends).dictionary_encode())
        owners.append((text + before).astype(np.int32))
        before += len(batch)
    if not parts:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(0, np.int32)
    joined = pa.chunked_array(parts).unify_dictionaries()
    return joined.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in joined.chunks]), np.concatenate(owners)


def bags(words: pa.Array, sizes: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of ``words``, by word."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    lengths = np.diff(offsets) + 2
    first = np.cumsum(lengths) - lengths
    framed = np.full(int(lengths.sum()), ord("<"), np.uint64)
    framed[first + lengths - 1] = ord(">")
    framed[ranges(first + 1, lengths - 2)] = data
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(first + lengths, lengths) - np.arange(len(framed))  # bytes from here to the word's end
    numbers, found = [], []
    value = np.zeros(len(framed), np.uint64)
    for n in range(1, sizes[1] + 1):
        m = len(framed) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(257) + framed[n - 1:n - 1 + m]
        if n >= sizes[0]:
            at = np.flatnonzero(room[:m] >= n)
            numbers.append(owner[at])
            found.append((mixed(value[at] + np.uint64(n << 56)) % np.uint64(buckets)).astype(np.int64))
    numbers, found = np.concatenate(numbers), np.concatenate(found)
    order = np.argsort(numbers, kind="stable")
    return numbers[order], found[order]


@dataclass
class Model:
    """One logit per bucket and class, with the biases and the n-gram sizes."""

    logits: np.ndarray
    bias: np.ndarray
    sizes: tuple[int, int]

    def word_sums(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of n-gram logits of each word and class, n-grams of each word)."""
        number, bucket = bags(words, self.sizes, len(self.logits))
        sums = np.stack([np.bincount(number, self.logits[bucket, c], len(words)) for c in range(self.logits.shape[1])], axis=1)
        return sums, np.bincount(number, minlength=len(words))


def train(words: np.ndarray, size: np.ndarray, label: np.ndarray, grams: tuple[np.ndarray, np.ndarray], classes: int,
          buckets: int, sizes: tuple[int, int], dim: int = 8, epochs: int = 5, rate: float = 2.0, together: int = 256,
          weight: np.ndarray | None = None, seed: int = 1) -> Model:
    """Train embeddings and softmax jointly on bags of words: bag i holds the next ``size[i]`` of
    ``words`` and has class ``label[i]``; ``grams`` are the ``bags`` of all words. N-grams of a bag are
    looked up when its turn comes, so memory is that of the words. Same input, same model."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    matrix = random.normal(0, 1 / np.sqrt(dim), (dim, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    grams_of = np.bincount(grams[0], minlength=int(words.max(initial=-1)) + 1)
    first_gram = np.cumsum(grams_of) - grams_of
    first = np.cumsum(size) - size
    full = np.flatnonzero(size)
    weight = np.ones(len(label), np.float32) if weight is None else weight.astype(np.float32)
    steps, step = max(epochs * -(-len(full) // together), 1), 0
    for _ in range(epochs):
        order = random.permutation(full)
        for i in range(0, len(order), together):
            rows = order[i:i + together]
            members = words[ranges(first[rows], size[rows])]
            ids = grams[1][ranges(first_gram[members], grams_of[members])]
            count = np.add.reduceat(grams_of[members], np.cumsum(size[rows]) - size[rows])
            grams_in = count.astype(np.float32)[:, None]
            bag = np.add.reduceat(vectors[ids], np.cumsum(count) - count, axis=0) / grams_in
            z = bag @ matrix + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p *= weight[rows, None]
            lr = np.float32(rate * (1 - step / steps))
            back = (p @ matrix.T) / grams_in
            np.add.at(vectors, ids, np.repeat(-lr * back, count, axis=0))
            matrix -= lr / len(rows) * (bag.T @ p)
            bias -= lr * p.mean(axis=0)
            step += 1
    return Model(vectors @ matrix, bias, sizes)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)
