"""Many keyword queries against many texts by one automaton per block of queries.

A conjunction is looked for by its longest term alone; its other terms are tested on the few texts that
hold that one. Boolean queries are answered on the (text, term) pairs of an Arrow batch. The terms looked
for become one multi-pattern automaton, so that a text is read once for all queries of a block and is
neither exploded nor shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa

from bidlake.functions.keywords import AND, NOT, TERM, Step, parse


class QueryBlock:
    """Queries in postfix order; ``wildcards`` gives ``%`` and ``_`` in terms a meaning."""

    def __init__(self, queries: list[list[Step]], wildcards: bool):
        import ahocorasick

        self.wildcards = wildcards
        self.patterns: dict[str, re.Pattern] = {}
        self.boolean: list[tuple[int, list[Step]]] = []
        self.number: dict[str, int] = {}  # terms of boolean queries
        self.tests: dict[int, list[str]] = {}  # what a conjunction still asks of a text that holds its anchor
        self.unanchored: list[int] = []
        words: dict[str, int] = {}
        anchored: list[list[int]] = []
        seeded: list[list[str]] = []

        def word(seed: str) -> int:
            if seed not in words:
                words[seed] = len(words)
                anchored.append([])
                seeded.append([])
            return words[seed]

        for q, steps in enumerate(queries):
            terms = list(dict.fromkeys(s.term for s in steps if s.op == TERM))
            if all(s.op in (TERM, AND) for s in steps):
                term, seed = max(((t, self._seed(t)) for t in terms), key=lambda x: len(x[1]), default=("", ""))
                self.tests[q] = [t for t in terms if t != term or t in self.patterns]
                if seed:
                    anchored[word(seed)].append(q)
                else:
                    self.unanchored.append(q)
            else:
                self.boolean.append((q, steps))
                for t in terms:
                    if t not in self.number:
                        self.number[t] = len(self.number)
                        if self._seed(t):
                            seeded[word(self._seed(t))].append(t)
        self.anchored, self.seeded = anchored, seeded
        self.everywhere = [t for t in self.number if not self._seed(t)]  # terms without a literal character
        self.automaton = None
        if words:
            self.automaton = ahocorasick.Automaton()
            for seed, i in words.items():
                self.automaton.add_word(seed, i)
            self.automaton.make_automaton()

    def _seed(self, term: str) -> str:
        """The longest literal part of a term; terms with wildcards get their pattern."""
        if not self.wildcards or not re.search("[%_]", term):
            return term
        if term not in self.patterns:
            self.patterns[term] = re.compile("".join(
                ".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term.strip("%")), re.DOTALL)
        return max(re.split("[%_]", term), key=len)

    def _holds(self, term: str, text: str) -> bool:
        pattern = self.patterns.get(term)
        return term in text if pattern is None else pattern.search(text) is not None

    def answers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(query, text) numbers of all queries that hold; a null text holds no term."""
        asked: list[int] = []
        rows: list[int] = []
        places: dict[int, list[int]] = {i: [] for i in self.number.values()}
        second = itemgetter(1)
        for i, text in enumerate(texts):
            for q in self.unanchored:
                if not self.tests[q] or (text is not None and all(self._holds(t, text) for t in self.tests[q])):
                    asked.append(q)
                    rows.append(i)
            if text is None:
                continue
            for t in self.everywhere:
                if self._holds(t, text):
                    places[self.number[t]].append(i)
            for seed in set(map(second, self.automaton.iter(text))) if self.automaton is not None and text else ():
                for q in self.anchored[seed]:
                    if all(self._holds(t, text) for t in self.tests[q]):
                        asked.append(q)
                        rows.append(i)
                for t in self.seeded[seed]:
                    if t not in self.patterns or self._holds(t, text):
                        places[self.number[t]].append(i)
        every = np.arange(len(texts))
        found = [(np.array(asked, np.int64), np.array(rows, np.int64))]
        for q, steps in self.boolean:
            held = self._evaluate(steps, lambda n: np.array(places[n], np.int64), every)
            found.append((np.full(len(held), q), held))
        return np.concatenate([q for q, _ in found]), np.concatenate([r for _, r in found])

    def _evaluate(self, steps: list[Step], rows_of: Callable[[int], np.ndarray], every: np.ndarray) -> np.ndarray:
        stack: list[np.ndarray] = []
        for step in steps:
            if step.op == TERM:
                stack.append(rows_of(self.number[step.term]))
            elif step.op == NOT:
                stack.append(np.setdiff1d(every, stack.pop(), assume_unique=True))
            else:
                right, left = stack.pop(), stack.pop()
                stack.append((np.intersect1d(left, right, assume_unique=True) if step.op == AND else np.union1d(left, right)))
        return stack[0] if stack else every


def matching(shared, wildcards: bool, types: tuple[pa.DataType, pa.DataType]) -> Callable:
    """A task that turns batches of (id, text) into (qid, id); ``shared`` holds the query ids and queries of one block."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries = shared.value
        block = QueryBlock([[Step(*s) for s in q] for q in queries], wildcards)
        ids = pa.array(qids, types[0])
        for batch in batches:
            q, rows = block.answers(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), batch.column("id").take(pa.array(rows))], ["qid", "id"])

    return task


def parsed(queries: list[str | None]) -> list[list[Step]]:
    return [parse(q) for q in queries]
