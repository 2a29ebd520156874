"""Text expressions: everything here is a Column built from Spark functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits, filler text and context prefix that results depend on.
EMBED_MAX_CHARS = 8192
REQUEST_MAX_CHARS = 8000
REQUEST_ELLIPSIS = "..."
MIN_REVIEW_CHARS = 100
MIN_SUMMARISABLE_CHARS = 50
NO_DESCRIPTION = " - A casino slot game with no detailed description available."
EMBED_PREFIX = "Casino game summary: "
WHITESPACE = " \t\n\r"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

REQUEST_TEMPLATE = (
    "Summarise this review of '%s' in four short lines.\n"
    "1. what the game is about\n"
    "2. its main features\n"
    "3. what the reviewer concludes\n"
    "4. how it looks and sounds, if the review says so\n"
    "Review text: %s"
)


def strip(text: Column) -> Column:
    """Remove blanks, tabs and line breaks on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL and for text of only white space."""
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def truncate_plain(text: Column, limit: int = EMBED_MAX_CHARS) -> Column:
    return F.substring(text, 1, limit)


def truncate_marked(text: Column, limit: int = REQUEST_MAX_CHARS) -> Column:
    """Text over ``limit`` is cut there and marked; other text is unchanged."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(REQUEST_ELLIPSIS))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def summary_request(title: Column, review: Column) -> Column:
    """Request text for a caller-supplied summariser."""
    return F.format_string(REQUEST_TEMPLATE, title, truncate_marked(review))


def placeholder_summary(title: Column) -> Column:
    return F.concat(title, F.lit(NO_DESCRIPTION))


def has_review(review: Column, minimum: int = MIN_REVIEW_CHARS) -> Column:
    return F.coalesce(F.length(strip(review)) >= minimum, F.lit(False))


def csv_quoted(text: Column) -> Column:
    """A CSV field as text: quotes doubled, the whole in quotes."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


# The entries of Spark's English stop list that a token can equal. Written
# out so that the list is also available where no session runs.
ENGLISH_STOP_WORDS = tuple(
    """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did
doing an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very can will just don should
now cannot could ought would
""".split()
)


def english_stop_words() -> tuple[str, ...]:
    return ENGLISH_STOP_WORDS


def tokens(text: Column) -> Column:
    """Lower-cased runs of at least two letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def content_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """Tokens without the stop words (the literal list becomes a hash set)."""
    if not stop_words:
        return tokens(text)
    return F.filter(tokens(text), lambda t: ~t.isin(*stop_words))


def bigrams(words: Column) -> Column:
    """Neighbouring word pairs, formed after stop words are gone."""
    return F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def sentences(text: Column) -> Column:
    """Sentences in order: runs ended by ``.``, ``!`` or ``?``, stripped, non-empty."""
    runs = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(runs, strip), lambda s: F.length(s) > 0)
