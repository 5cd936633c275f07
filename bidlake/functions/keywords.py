"""Boolean keyword syntax: AND, OR, NOT, ``-term``, "quoted phrases" and parentheses.

A query is parsed by precedence (NOT binds tighter than AND, AND tighter than OR; words side by side
are joined by AND) into postfix order. A term is contained in a text or not, by case and character for
character; a null text contains nothing. ``field:"phrase"`` asks for ``field`` and the phrase. Operators
are written in capitals; ``and`` is a word. A query without terms matches every text.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM, NOT, AND, OR = "TERM", "NOT", "AND", "OR"
POSTFIX = "array<struct<op: string, term: string>>"
_BINDS = {OR: 1, AND: 2, NOT: 3}


class KeywordSyntaxError(ValueError):
    """A query that cannot be read; ``position`` counts characters from 0."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.position = position


class Token(NamedTuple):
    kind: str
    text: str
    position: int


class Step(NamedTuple):
    """One step of a query in postfix order."""

    op: str
    term: str = ""


def _tokens(query: str) -> list[Token]:
    found: list[Token] = []
    at = 0
    while at < len(query):
        here = query[at]
        if here.isspace():
            at += 1
        elif here in "()":
            found.append(Token(here, here, at))
            at += 1
        elif here == '"':
            end = query.find('"', at + 1)
            if end < 0:
                raise KeywordSyntaxError("quote without an end", at)
            if not query[at + 1:end]:
                raise KeywordSyntaxError("empty phrase", at)
            found.append(Token(TERM, query[at + 1:end], at))
            at = end + 1
        elif here == "-" and at + 1 < len(query) and not query[at + 1].isspace():
            found.append(Token(NOT, "-", at))
            at += 1
        else:
            end = at
            while end < len(query) and not query[end].isspace() and query[end] not in '()"':
                end += 1
            word = query[at:end]
            if word in _BINDS:
                found.append(Token(word, word, at))
            elif word.endswith(":") and query[end:end + 1] == '"' and len(word) > 1:
                found += [Token(TERM, word[:-1], at), Token(AND, "", end)]
            else:
                found.append(Token(TERM, word, at))
            at = end
    return found


def parse(query: str | None) -> list[Step]:
    """``query`` in postfix order; no steps for a query without terms."""
    out: list[Step] = []
    waiting: list[Token] = []
    operand = True  # whether an operand comes next
    last = Token("", "", 0)

    def shift(token: Token) -> None:
        while waiting and waiting[-1].kind != "(" and _BINDS[waiting[-1].kind] >= _BINDS[token.kind]:
            out.append(Step(waiting.pop().kind))
        waiting.append(token)

    for token in _tokens(query or ""):
        if token.kind in (TERM, NOT, "(") and not operand:
            shift(Token(AND, "", token.position))
            operand = True
        if token.kind == TERM:
            out.append(Step(TERM, token.text))
            operand = False
        elif token.kind == NOT:
            waiting.append(token)
        elif token.kind == "(":
            waiting.append(token)
        elif operand:
            raise KeywordSyntaxError(f"{token.text or token.kind} without a term before it", token.position)
        elif token.kind == ")":
            while waiting and waiting[-1].kind != "(":
                out.append(Step(waiting.pop().kind))
            if not waiting:
                raise KeywordSyntaxError(") without (", token.position)
            waiting.pop()
        else:
            shift(token)
            operand = True
        last = token
    if operand and (waiting or out):
        raise KeywordSyntaxError(f"{last.text} without a term after it", last.position)
    while waiting:
        token = waiting.pop()
        if token.kind == "(":
            raise KeywordSyntaxError("( without )", token.position)
        out.append(Step(token.kind))
    return out


def condition(text: str | Column, query: str) -> Column:
    """One query as a condition; its containment tests can reach the scan."""
    column = F.col(text) if isinstance(text, str) else text
    stack: list[Column] = []
    for step in parse(query):
        if step.op == TERM:
            stack.append(column.contains(step.term))
        elif step.op == NOT:
            stack.append(~F.coalesce(stack.pop(), F.lit(False)))
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left & right if step.op == AND else left | right)
    return stack[0] if stack else F.lit(True)


def postfix(query: str) -> Column:
    """The steps of a query as a literal column, for ``holds``."""
    steps = [F.struct(F.lit(s.op).alias("op"), F.lit(s.term).alias("term")) for s in parse(query)]
    return (F.array(*steps) if steps else F.array()).cast(POSTFIX)


def holds(text: str | Column, steps: str | Column) -> Column:
    """Whether the query in the column ``steps`` (postfix order) holds for ``text``: a fold over its steps
    whose state is the stack of truth values."""
    text, steps = (F.col(c) if isinstance(c, str) else c for c in (text, steps))

    def push(stack: Column, step: Column) -> Column:
        top, next_ = F.element_at(stack, -1), F.element_at(stack, -2)
        rest = F.slice(stack, 1, F.greatest(F.size(stack) - 2, F.lit(0)))
        return (F.when(step["op"] == TERM, F.concat(stack, F.array(F.coalesce(text.contains(step["term"]), F.lit(False)))))
                .when(step["op"] == NOT, F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(~top)))
                .when(step["op"] == AND, F.concat(rest, F.array(next_ & top)))
                .otherwise(F.concat(rest, F.array(next_ | top))))

    return F.aggregate(steps, F.array().cast("array<boolean>"), push, lambda stack: F.coalesce(F.get(stack, 0), F.lit(True)))


def all_of(terms: list[str]) -> list[Step]:
    """The postfix order of a conjunction."""
    return reduce(lambda steps, term: [*steps, Step(TERM, term), *([Step(AND)] if steps else [])], terms, [])
