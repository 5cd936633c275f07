"""Token ids of whole texts by the tokenizers library, as flat arrays.

A text is cut only where the byte-level pattern always ends a piece: between ASCII (or Latin-1)
letters, digits and punctuation, before a blank and after a line feed next to them. Equal pieces of
a step are encoded once, and a worker remembers pieces between tasks. Pieces of one class are one
unit of the pattern and go straight to the library's merge model; all others take its whole path.
An added token of the vocabulary inside a text is a piece of its own, as the library matches it, and
the texts before and after it are cut as if they stood alone. The ids are those of encoding the text
whole, which the tests check.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bidlake.llm.common import ranges, worker_state

VOCABULARY = "byte_bpe_50k.json"
# Pieces that a Python worker remembers at most (some 40 bytes each).
REMEMBERED = 600_000
_OTHER, _LETTER, _DIGIT, _MARK, _BLANK, _FEED = range(6)
_TOGETHER = 500  # new pieces in one call string
_SEPARATOR = 1  # a control byte; pieces that hold it take the whole path


def vocabulary_path() -> str:
    """Place of the public vocabulary on the machine that calls."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_classes() -> np.ndarray:
    classes = np.full(256, _OTHER, np.uint8)
    for b in range(33, 127):
        classes[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK
    classes[ord("'")] = _OTHER  # may begin a contraction
    classes[ord(" ")], classes[ord("\n")] = _BLANK, _FEED
    return classes


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printing ones stand for
    themselves, the others take the code points from 256 on in turn."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printing else chr(next(others)) for b in range(256)}


class Encoder:
    """Encodes the texts of Arrow steps; ``path`` is a byte-level vocabulary of the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take blanks or need word borders are not supported")
        self.added = [t.content.encode() for t in added]
        # the longest of those that begin at one place, as the library does
        self.any_added = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.letters = _byte_letters()
        separator = self.letters[_SEPARATOR]
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split(separator, "isolated")
        self.separator = self.library.token_to_id(separator)
        self.classes = _byte_classes()
        self._forget()

    @staticmethod
    def of(path: str) -> Encoder:
        """The encoder of this worker for ``path``."""
        held = worker_state().__dict__.setdefault("encoders", {})
        if path not in held:
            held[path] = Encoder(path)
        return held[path]

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids before each text plus the total)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        data = np.ascontiguousarray(data)
        cuts = self._cuts(data, starts)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        places = self._places(pieces.dictionary)[pieces.indices.to_numpy()]
        first = np.cumsum(self.sizes) - self.sizes
        lengths = self.sizes[places]
        before = np.zeros(len(cuts), np.int64)
        np.cumsum(lengths, out=before[1:])
        return self.flat[ranges(first[places], lengths)], before[np.searchsorted(cuts, starts)]

    def _class_of(self, data: np.ndarray) -> np.ndarray:
        kind = self.classes[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # all but the two signs
        kind[lead] = _LETTER
        kind[lead + 1] = _LETTER
        return kind

    def _added(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of every added token that the library matches in the texts."""
        raw, texts, spans = data.tobytes(), set(), []
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(starts, at, side="right")) - 1
                end = int(starts[text + 1])
                if at + len(token) <= end:
                    texts.add(text)
                    at = raw.find(token, end)
                else:  # it lies across two texts
                    at = raw.find(token, at + 1)
        for text in sorted(texts):
            spans += [m.span() for m in self.any_added.finditer(raw, int(starts[text]), int(starts[text + 1]))]
        found = np.array(spans, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        begin, end = self._added(data, starts)
        if len(begin):
            starts = np.union1d(starts, np.concatenate([begin, end]))
        kind = self._class_of(data)
        plain = (kind >= _LETTER) & (kind <= _MARK)
        cut = np.zeros(len(data) + 1, bool)
        left, right = kind[:-1], kind[1:]
        inner = cut[1:-1]
        inner |= plain[:-1] & (left != right) & (right != _OTHER)
        inner |= (left == _FEED) & plain[1:]
        follows = plain.copy()
        follows[starts[starts < len(data)]] = False  # the next text does not follow this one
        inner[:-1] |= ((right[:-1] == _BLANK) | (right[:-1] == _FEED)) & follows[2:]
        cut[ranges(begin, end - begin)] = False
        cut[starts] = True
        return np.flatnonzero(cut)

    def _places(self, words: pa.Array) -> np.ndarray:
        """The place of each distinct piece among the known ones, after learning the new ones."""
        if len(self.known) + len(words) > REMEMBERED and len(self.known) > len(words):
            self._forget()
        places = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = len(self.known) + np.arange(len(new))
            missing = words.take(pa.array(new))
            flat, sizes = self._learn(missing)
            self.known = pa.concat_arrays([self.known, missing])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return places

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of ``words`` one after another, ids in each)."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        ends = ends - ends[0]
        kind = self._class_of(data)
        odd = (kind == _OTHER) | (kind == _FEED)
        blank = kind == _BLANK
        blank[ends[:-1]] = False
        odds = np.concatenate([[0], np.cumsum(odd | blank)])
        lengths = np.diff(ends)
        simple = (odds[ends[1:]] == odds[ends[:-1]]) & ~((lengths == 1) & (kind[ends[:-1]] == _BLANK))
        simple &= ~pc.is_in(words, value_set=pa.array(self.added, pa.large_binary())).to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(words), np.int64)
        parts: list = [None] * len(words)
        other = np.flatnonzero(~simple)
        for i, e in zip(other, self.library.encode_batch_fast(
                [bytes(data[ends[i]:ends[i + 1]]).decode("utf-8", "replace") for i in other], add_special_tokens=False),
                strict=True):
            parts[i] = e.ids
            sizes[i] = len(e.ids)
        chosen = np.flatnonzero(simple)
        if not len(chosen):
            return np.array([x for p in parts for x in p], np.uint32), sizes
        size = lengths[chosen]
        total = int(size.sum()) + len(chosen)
        joined = np.full(total, _SEPARATOR, np.uint8)
        joined[ranges(np.cumsum(size + 1) - size - 1, size)] = data[ranges(ends[chosen], size)]
        text = joined.tobytes().decode("latin-1").translate(self.letters)
        after = np.append(np.cumsum(size + 1)[_TOGETHER - 1:-1:_TOGETHER], total)  # group ends
        groups = [text[a:b] for a, b in zip(np.append(0, after[:-1]), after, strict=True)]
        encoded = self.merges.encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        marks = np.flatnonzero(ids == self.separator)
        sizes[chosen] = np.diff(np.concatenate([[-1], marks])) - 1
        flat = np.zeros(int(sizes.sum()), np.uint32)
        first = np.cumsum(sizes) - sizes
        flat[ranges(first[chosen], sizes[chosen])] = ids[ids != self.separator]
        for i in other:
            flat[first[i]:first[i] + sizes[i]] = parts[i]
        return flat, sizes
