"""Query planning: tokens, weights, relaxed patterns and provider variants, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import collapse, fold

# Word lists and bounds that results depend on.
STOPWORDS = ("a", "an", "and", "for", "how", "in", "of", "the", "to", "what", "with", "如何", "什么", "怎么", "一个")
LOW_SIGNAL = ("ai", "code", "project", "search", "tool")
HOST_STOPWORDS = ("a", "ai", "an", "best", "build", "code", "device", "example", "examples", "for", "github", "how", "implementation", "in", "of", "protocol", "source", "the", "to", "with")
MOST_TOKENS = 12
PATTERN_TOKENS = 6
TOKEN = r"[\p{L}\p{N}_@.-]+"


def normalized(query: Column) -> Column:
    """A query with single blanks; null where nothing is left."""
    text = collapse(query)
    return F.when(text != "", text)


def tokens(query: Column, most: int = MOST_TOKENS) -> Column:
    """Distinct tokens of two characters or more that aren't stopwords, in order; case tells tokens apart."""
    found = F.filter(F.regexp_extract_all(query, F.lit(TOKEN), F.lit(0)), lambda t: (F.length(t) > 1) & ~fold(t).isin(*STOPWORDS))
    return F.slice(F.array_distinct(found), 1, most)


def relaxed_pattern(token_list: Column) -> Column:
    """Alternation of the first tokens, escaped; null for fewer than two tokens."""
    escaped = F.transform(F.slice(token_list, 1, PATTERN_TOKENS), lambda t: F.regexp_replace(t, r"([.\-])", r"\\$1"))
    return F.when(F.size(token_list) >= 2, F.array_join(escaped, "|"))


def weight(token: Column) -> Column:
    """A quarter for words that tell little, else one."""
    return F.when(fold(token).isin(*LOW_SIGNAL), 0.25).otherwise(1.0)


def host_variants(query: Column) -> Column:
    """The query, then a relaxed one of its first two topics and all its qualifiers, where that differs."""
    text = normalized(query)
    parts = F.regexp_extract_all(text, F.lit(r'"[^"]+"|\S+'), F.lit(0))
    qualifies = lambda t: F.contains(t, F.lit(":")) | F.startswith(t, F.lit("-"))
    topics = F.filter(parts, lambda t: ~qualifies(t) & ~F.lower(F.trim(t, F.lit('"'))).isin(*HOST_STOPWORDS))
    relaxed = F.array_join(F.concat(F.slice(topics, 1, 2), F.filter(parts, qualifies)), " ")
    return F.when((F.size(topics) >= 2) & (relaxed != text), F.array(text, relaxed)).otherwise(F.array(text))
