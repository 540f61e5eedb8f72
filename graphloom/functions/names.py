"""Functions of identifiers and query texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a question that carry no subject, and what is cut off the others.
STOP_WORDS = frozenset([
    "the", "and", "for", "with", "from", "into", "that", "this", "these", "those", "are", "was", "were", "been", "being", "has", "have", "had", "does",
    "did", "doing", "can", "could", "should", "would", "will", "how", "what", "where", "which", "who", "why", "when", "there", "here", "about", "work",
    "works", "working", "happen", "happens", "handled", "implemented", "code", "find", "show", "all", "any", "some", "its", "our", "your", "you", "not",
    "use", "used", "uses",
])
#: The first suffix that leaves at least MIN_STEM letters; a plain s only after another letter.
SUFFIXES = ("ions", "ion", "ings", "ing", "ed", "es", "s")
MIN_STEM = 4
# Words that make a short search text a question.
QUESTION_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "do", "does", "did", "can", "could", "should", "would", "will", "where", "what", "when", "how", "why",
    "who", "which", "with", "for", "to", "in", "on", "at", "of", "and", "or", "not", "this", "that", "these", "those", "we", "i", "you", "it", "its",
    "be", "been",
)
#: Dotted, scoped, snake-case and camel-case names.
IDENTIFIER = r"\w+(?:\.\w+)+|::|\w+_\w+|[a-z0-9][A-Z]"


def bare(fqn: Column) -> Column:
    """Last dotted segment."""
    return F.regexp_extract(fqn, r"([^.]*)$", 1)


def is_exported(symbol: Column) -> Column:
    return bare(symbol).rlike(r"^\p{Lu}")


def camel_tokens(text: str) -> list[str]:
    """Lower-case tokens of a query: split at blanks, then where a capital begins a word."""
    out = []
    for word in text.split():
        out += [m.lower() for m in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^A-Z]+", word)]
    return list(dict.fromkeys(out))


def stem(term: str) -> str:
    for suffix in SUFFIXES:
        rest = term.removesuffix(suffix)
        if rest != term and len(rest) >= MIN_STEM and not (suffix == "s" and rest.endswith("s")):
            return rest
    return term


def lexical_terms(query: str) -> list[str]:
    """Search terms: alphanumeric runs, lower case, of three letters or more, no stop words; stemmed, each once."""
    out: dict[str, None] = {}
    for word in re.findall(r"[^\W_]+", query.lower()):
        if len(word) >= 3 and word not in STOP_WORDS:
            out.setdefault(stem(word))
    return list(out)


def classify_query(query: str) -> str:
    """'identifier' for names and for one or two words without a question word, else 'natural_language'."""
    text = re.sub(r"[.?!]$", "", query.strip())
    words = text.split()
    short = 0 < len(words) <= 2 and not any(w.lower() in QUESTION_WORDS for w in words)
    return "identifier" if re.search(IDENTIFIER, text) or short else "natural_language"


def query_class(text: Column) -> Column:
    """The same for a column."""
    clean = F.regexp_replace(F.trim(text), r"[.?!]$", "")
    words = F.filter(F.split(F.lower(clean), r"\s+"), lambda w: w != "")
    short = F.size(words).between(1, 2) & ~F.arrays_overlap(words, F.array(*map(F.lit, QUESTION_WORDS)))
    return F.when(clean.rlike(IDENTIFIER) | short, "identifier").otherwise("natural_language")
