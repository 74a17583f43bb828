"""Text expressions: tokens, trigrams, snippets, dates. All are columns to columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that graph tokens leave out.
STOPWORDS = (
    "the a an and or but of to in on for with is are was were be been it this that from by at as its his her their we you they not no "
    "has have had do does did will would can could should into via through using used use more most"
).split()


def words(text: Column) -> Column:
    """Index tokens: split at all but letters, digits, underscore and hyphen, lower-cased, 2 to 100 long."""
    return F.filter(F.transform(F.split(text, r"[^\p{L}\p{N}_\-]+"), F.lower), lambda t: F.length(t).between(2, 100))


def graph_tokens(text: Column) -> Column:
    """Distinct tokens of the graph's maintenance rules: longer than two letters, no stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9_-]*"), F.lit(0)))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(STOPWORDS))


def query_tokens(query: str) -> list[str]:
    """A graph query's tokens."""
    return query.lower().split()


def index_tokens(query: str) -> list[str]:
    """An index query's tokens, cut by the index tokeniser's own rule."""
    return list(dict.fromkeys(t.lower() for t in re.split(r"[^\w\-]+", query) if 2 <= len(t) <= 100))


def contains_ci(text: Column, token: str) -> Column:
    """Case-insensitive containment; no character of the token is a wildcard."""
    return F.contains(F.lower(text), F.lit(token.lower()))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces; none for texts shorter than three."""
    n = F.length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, 3)))).otherwise(F.array().cast("array<string>"))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of trigrams of lower-cased texts; short texts count by containment."""
    x, y = F.lower(a), F.lower(b)
    both = F.size(F.array_intersect(trigrams(x), trigrams(y)))
    union = F.size(F.array_union(trigrams(x), trigrams(y)))
    short = F.least(F.length(x), F.length(y)) < 3
    return (
        F.when(x == y, 1.0)
        .when((F.length(x) == 0) | (F.length(y) == 0), 0.0)
        .when(short, F.when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(0.0))
        .otherwise(both / union)
    )


def normalised_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def clipped(text: Column, n: int) -> Column:
    """At most n characters, an ellipsis after a cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def date_in_name(name: Column) -> Column:
    """The first ISO date in a file's name, or a question mark."""
    found = F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0)
    return F.when(found == "", "?").otherwise(found)


def header_date(text: Column) -> Column:
    """The date in a transcript's header line, null if there is none or it is no date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(?m)^Date:\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).cast("date")


def json_object(text: Column) -> Column:
    """The outermost braces of a reply, code fences and all else dropped."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def message_snippet(content: Column, tool_names: Column, raw: Column, n: int = 300) -> Column:
    """A message's content, else the tools it calls, else a note; for a broken line the line."""
    calls = F.array_join(F.transform(tool_names, lambda t: F.concat(t, F.lit("(...)"))), " | ")
    return F.coalesce(F.nullif(F.substring(content, 1, n), F.lit("")), F.nullif(calls, F.lit("")), F.when(raw.isNotNull() & content.isNull() & tool_names.isNull(), F.substring(raw, 1, n)), F.lit("(no content)"))


# What makes a pattern dangerous, and how that is called.
DANGERS = [
    (r"[*+?]\)\s*[+*]", "nested quantifier after group"),
    (r"\([^)]*\|[^)]*\)\s*[+*]", "alternation with quantifier"),
    (r"[+*?][+*?]", "adjacent quantifiers"),
]


def regex_danger(query: str) -> str | None:
    """Why a pattern could run away on long texts, or None. Checked before a plan is built; some harmless ones are refused too."""
    return next((reason for rule, reason in DANGERS if re.search(rule, query)), None)


def pattern(query: str, regex: bool, case_sensitive: bool) -> str:
    """A query as a Java pattern; refuses dangerous ones."""
    if regex:
        if reason := regex_danger(query):
            raise ValueError(f"refused pattern: {reason}")
        body = query
    else:
        body = r"\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    return body if case_sensitive else "(?iu)" + body
