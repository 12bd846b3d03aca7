"""Text expressions: title keys, kinds, embedding text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no identity in a title.
STOPWORDS = ("a", "an", "the", "and", "or", "screen", "screens", "flow", "flows", "feature", "features", "page", "pages", "view", "views")
#: Fixed value: the least share of common words that nominates a pair of titles.
OVERLAP = 0.8


def title_tokens(title: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, without stopwords.  A capital I with a dot is an i, as in the SQL."""
    parts = F.split(F.regexp_replace(F.lower(F.translate(F.coalesce(title, F.lit("")), "\u0130", "i")), "[^a-z0-9]+", " "), " ")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOPWORDS))


def norm_title(title: Column) -> Column:
    return F.array_join(title_tokens(title), " ")


def titles_match(left: Column, right: Column) -> Column:
    """Equal keys, or enough common words; an empty key matches nothing."""
    a, b = F.array_distinct(title_tokens(left)), F.array_distinct(title_tokens(right))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return (F.size(a) > 0) & (F.size(b) > 0) & ((norm_title(left) == norm_title(right)) | (share >= OVERLAP))


def kind_of(node_type: Column, kinds: tuple[str, ...] = ("knowledge", "entity")) -> Column:
    """The part before the slash if the vocabulary has it, else knowledge."""
    head = F.split_part(node_type, F.lit("/"), F.lit(1))
    return F.when(head.isin(*kinds), head).otherwise(F.lit("knowledge"))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def embed_text(title: Column, summary: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit(""))))


def merged_summary(summary: Column, more: Column) -> Column:
    """Distinct non-blank summaries in order, joined by a middle dot; null if none is left."""
    parts = F.transform(F.concat(F.array(summary), F.coalesce(more, F.array().cast("array<string>"))), lambda s: strip(s))
    kept = F.array_distinct(F.filter(parts, lambda s: s.isNotNull() & (s != "")))
    return F.nullif(F.array_join(kept, " · "), F.lit(""))


def folded_summary(summary: Column, more: Column) -> Column:
    """All summaries by line, without line feeds at the ends."""
    return F.trim(F.concat_ws("\n", summary, F.array_join(F.coalesce(more, F.array().cast("array<string>")), "\n")), F.lit("\n"))
