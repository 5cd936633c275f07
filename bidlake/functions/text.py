"""Column helpers for text: terms, previews, tokens, headings, entities and formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS = 200
WHITESPACE = "[ \\t\\n\\x0b\\f\\r]+"
_WHITESPACE_CHARS = " \t\n\x0b\f\r"

# Section title words and the entity patterns of procurement prose.
SECTION_WORDS = (("requisiti", "requirements"), ("scadenza", "deadlines"))
ROUTES = (("graph_only", ("scadenza", "quando", "data")), ("graph_first", ("requisiti", "obbligatorio")))
DEFAULT_ROUTE = "vector_first"
ENTITY_PATTERNS = {
    "lots": r"(?:Lotto [0-9IVX]+|CIG [0-9A-Z]+)",
    "requirements": r"(?i)(?:obbligatori[oa]|pena esclusione|deve)",
    "deadlines": r"(?i)(?:entro il|scadenza|termine)[^.\n]*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "amounts": r"€ ?[0-9]+(?:[.,][0-9]+)*",
    "organisations": r"(?:Comune|Ministero|Regione|Provincia) (?:di |del |della )?[A-Z][a-z]+",
}


def query_terms(query: str) -> list[str]:
    """Whitespace-separated terms of a query literal."""
    return query.split()


def like_pattern(term: str) -> str:
    """Containment pattern; ``%`` and ``_`` stay wildcards, a backslash stays an ordinary character."""
    return "%" + term.replace("\\", "\\\\") + "%"


def contains_all(text: str | Column, terms: Sequence[str]) -> Column:
    """Case-sensitive conjunction of containment tests; no terms means every row matches."""
    column = F.col(text) if isinstance(text, str) else text
    if not terms:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [column.like(like_pattern(t)) for t in terms])


def boolean_match(
    text: str | Column,
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
) -> Column:
    """AND / OR / NOT over terms or whole phrases, given as lists."""
    column = F.col(text) if isinstance(text, str) else text
    condition = contains_all(column, all_of)
    if any_of:
        condition = condition & reduce(lambda a, b: a | b, [column.like(like_pattern(t)) for t in any_of])
    for term in none_of:
        condition = condition & ~column.like(like_pattern(term))
    return condition


def icontains(column: str | Column, needle: str) -> Column:
    """Case-insensitive containment without wildcards."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(column).contains(needle.lower())


def preview(text: str | Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.coalesce(F.substring(text, 1, chars), F.lit(""))


def tokens(text: str | Column) -> Column:
    """Non-empty whitespace tokens."""
    trimmed = F.btrim(text, F.lit(_WHITESPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITESPACE))


def token_count(text: str | Column) -> Column:
    return F.size(tokens(text))


def section_type(title: str | Column) -> Column:
    """Class of a section from words in its title."""
    title = F.lower(title)
    result = F.lit("other")
    for word, label in reversed(SECTION_WORDS):
        result = F.when(title.contains(word), label).otherwise(result)
    return result


def route(question: str | Column) -> Column:
    """Retrieval strategy from words in the question; the first list that matches wins."""
    question = F.lower(question)
    result = F.lit(DEFAULT_ROUTE)
    for label, words in reversed(ROUTES):
        hit = reduce(lambda a, b: a | b, [question.contains(w) for w in words])
        result = F.when(hit, label).otherwise(result)
    return result


def entities(text: str | Column, patterns: Mapping[str, str] = ENTITY_PATTERNS) -> Column:
    """Struct with one array of matched spans per entity type."""
    return F.struct(*[
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(name) for name, pattern in patterns.items()
    ])


def entity_flags(text: str | Column, patterns: Mapping[str, str] = ENTITY_PATTERNS) -> Column:
    """Struct ``has_<type>`` of whether a text holds an entity of each type; null for a null text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.struct(*[column.rlike(pattern).alias(f"has_{name}") for name, pattern in patterns.items()])


def first_truthy(first: str | Column, second: str | Column) -> Column:
    """``first`` unless null or empty, else ``second``."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def stable_id(*parts: str | Column) -> Column:
    """Reproducible identifier in place of a random one, so retried tasks agree."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def file_suffix(filename: str | Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.[^./]*$", 0))


def euros(amount: str | Column) -> Column:
    return F.concat(F.lit("€"), F.format_number(amount, 0))


def percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def clean(text: str | Column) -> Column:
    """Drop control characters and replacement marks, unify line ends and runs of blanks."""
    text = F.regexp_replace(text, "\\r\\n?", "\n")
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\uFFFD\\u200B\\uFEFF]", "")
    text = F.regexp_replace(text, "[ \\t\\u00A0]+", " ")
    return F.trim(text)
