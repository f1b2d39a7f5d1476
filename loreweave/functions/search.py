"""Query tokens and the column expressions of keyword scoring."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query drops.
STOP_WORDS = frozenset(
    "的 是 了 什么 在 有 和 与 对 从 the is a an what how are was were do does did be been being have has had it its in on at to for of with by this that these those".split()
)
#: Punctuation beside ASCII's that separates query tokens.
WIDE_PUNCTUATION = "，。！？、；：“”‘’（）·～…"
#: Weights of the page score.
STEM_BONUS, TITLE_PHRASE_BONUS, PHRASE_WEIGHT, PHRASE_LIMIT, TITLE_WEIGHT, CONTENT_WEIGHT = 200, 50, 20, 10, 5, 1
#: Characters of context on each side of a snippet's hit, and the rank constant of fusion.
SNIPPET_CONTEXT, RRF_K = 80, 60

_SEPARATORS = re.compile(f"[\\s{re.escape(string.punctuation)}{WIDE_PUNCTUATION}]+")
_IDEOGRAPH = re.compile("[㐀-鿿]")


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query, sorted: words over one character that aren't stop words.

    A word with ideographs of more than two characters also gives its pairs and
    its single characters.
    """
    found = set()
    for word in _SEPARATORS.split(query.lower()):
        if len(word) < 2 or word in STOP_WORDS:
            continue
        found.add(word)
        if len(word) > 2 and _IDEOGRAPH.search(word):
            found.update(word[i : i + 2] for i in range(len(word) - 1))
            found.update(c for c in word if c not in STOP_WORDS)
    return sorted(found)


def query_phrase(query: str) -> str:
    """The query in lower case without separators at its ends."""
    return re.sub(f"^(?:{_SEPARATORS.pattern})|(?:{_SEPARATORS.pattern})$", "", query.lower())


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    if not phrase:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def tokens_contained(text: Column, tokens: list[str]) -> Column:
    """How many of the tokens the text contains."""
    total = F.lit(0)
    for token in tokens:
        total = total + F.contains(text, F.lit(token)).cast("int")
    return total


def page_score(stem: Column, title: Column, content: Column, query: str) -> dict[str, Column]:
    """Score and its parts; all three texts in lower case."""
    tokens, phrase = query_tokens(query), query_phrase(query)
    in_title = F.contains(title, F.lit(phrase)) if phrase else F.lit(False)
    exact = (stem == phrase) if phrase else F.lit(False)
    parts = {
        "phrase_hits": F.least(occurrences(content, phrase), F.lit(PHRASE_LIMIT)),
        "title_tokens": tokens_contained(title, tokens),
        "content_tokens": tokens_contained(content, tokens),
    }
    score = exact.cast("int") * STEM_BONUS + in_title.cast("int") * TITLE_PHRASE_BONUS
    score = score + parts["phrase_hits"] * PHRASE_WEIGHT + parts["title_tokens"] * TITLE_WEIGHT + parts["content_tokens"] * CONTENT_WEIGHT
    return parts | {"score": score.cast("double"), "title_match": (parts["title_tokens"] > 0) | in_title}


def snippet(content: Column, query: str) -> Column:
    """Text around the phrase, or else the first token found, or else from the start; line ends as blanks."""
    tokens, phrase = query_tokens(query), query_phrase(query)
    lower = F.lower(content)
    anchors = [a for a in (phrase, *tokens) if a]
    where = F.lit(1)
    width = F.lit(max(1, len(query)))
    for anchor in reversed(anchors):
        at = F.locate(anchor, lower)
        where, width = F.when(at > 0, at).otherwise(where), F.when(at > 0, F.lit(len(anchor))).otherwise(width)
    start = F.greatest(where - SNIPPET_CONTEXT, F.lit(1))
    end = F.least(where + width + SNIPPET_CONTEXT, F.length(content) + 1)
    cut = F.replace(content.substr(start, end - start), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end <= F.length(content), "...").otherwise(""))


def chunk_snippet(text: Column, heading: Column) -> Column:
    """A chunk's first 160 characters behind its heading path; empty for a blank chunk."""
    plain = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(plain) > 2 * SNIPPET_CONTEXT, F.concat(F.substring(plain, 1, 2 * SNIPPET_CONTEXT), F.lit("..."))).otherwise(plain)
    path = F.coalesce(F.trim(heading), F.lit(""))
    return F.when(F.coalesce(plain, F.lit("")) == "", "").when(path == "", short).otherwise(F.concat(path, F.lit(": "), short))


def reciprocal_rank(rank: Column) -> Column:
    """1 / (60 + rank), 0 without a rank."""
    return F.coalesce(1.0 / (F.lit(float(RRF_K)) + rank), F.lit(0.0))


def search_mode(tokens: int, with_vector: bool) -> str:
    if not with_vector:
        return "keyword"
    return "hybrid" if tokens else "vector"


#: What separates tokens and what is cut from the ends of a phrase in the dialect that counts occurrences, with the greatest length and start of its snippets.
NARROW_SEPARATORS, PHRASE_ENDS = r"[\s,，。！？、；：“”‘’\"'（）()\-_/\\·~～…]+", "^[\\s\"'「」『』]+|[\\s\"'「」『』.,，。！？!?]+$"
WINDOW, LEAD, FALLBACK = 200, 60, 160


def counted_tokens(query: str) -> list[str]:
    """Tokens of a query in order, in the dialect that counts occurrences: full stops, colons and the like stay inside tokens."""
    found: list[str] = []
    for word in re.split(NARROW_SEPARATORS, query.lower()):
        if len(word) < 2 or word in STOP_WORDS:
            continue
        if len(word) > 2 and _IDEOGRAPH.search(word):
            found += [word[i : i + 2] for i in range(len(word) - 1)] + [c for c in word if c not in STOP_WORDS]
        found.append(word)
    return list(dict.fromkeys(found)) or [w for w in [query.strip().lower()] if w]


def counted_phrase(query: str) -> str:
    return re.sub(PHRASE_ENDS, "", query.lower()).strip()


def counted_score(stem: Column, title: Column, body: Column, query: str) -> dict[str, Column]:
    """Score in the dialect that counts occurrences, and whether the title matches; all three texts in lower case."""
    tokens, phrase = counted_tokens(query), counted_phrase(query)
    in_title = sum((occurrences(title, t) for t in tokens), F.lit(0))
    in_body = sum((occurrences(body, t) for t in tokens), F.lit(0))
    exact = (stem == re.sub(r"\s+", "-", phrase)) if phrase else F.lit(False)
    titled = F.contains(title, F.lit(phrase)) if phrase else F.lit(False)
    score = exact.cast("int") * STEM_BONUS + in_title * TITLE_WEIGHT + in_body * CONTENT_WEIGHT
    score = score + titled.cast("int") * TITLE_PHRASE_BONUS + F.least(occurrences(body, phrase), F.lit(PHRASE_LIMIT)) * PHRASE_WEIGHT
    return {"score": score.cast("double"), "title_match": exact | (in_title > 0) | titled}


def counted_snippet(body: Column, query: str) -> Column:
    """200 characters from 60 before the phrase, or else the first token found, or else the first 160; line feeds as blanks."""
    lower = F.lower(body)
    at = F.lit(0)
    for anchor in reversed([a for a in (counted_phrase(query), *counted_tokens(query)) if a]):
        found = F.locate(anchor, lower)
        at = F.when(found > 0, found).otherwise(at)
    cut = F.when(at < 1, F.substring(body, 1, FALLBACK)).otherwise(F.substring(body, F.greatest(at - LEAD, F.lit(1)), F.lit(WINDOW)))
    return F.replace(cut, F.lit("\n"), F.lit(" "))
