"""Tokens, snippets and other column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: separators and the edges that are stripped
BLANKS = "[ \\t\\n\\r\\f]+"
WORD = "[a-z](?:[^ \\t\\n\\r\\f]*[a-z])?"  # from the first to the last letter of a run between blanks


def raw_tokens(text: str | Column) -> Column:
    """Lower-case runs between blanks, empty ones left out."""
    return F.filter(F.split(F.lower(text), BLANKS), lambda x: x != "")


def clean(word: Column) -> Column:
    """A token without the leading and trailing run of anything but a to z."""
    return F.regexp_replace(word, "^[^a-z]+|[^a-z]+\\z", "")


def tokens(text: str | Column) -> Column:
    """Clean tokens of a text, in order; those that clean to nothing are left out; null text gives null.

    One pattern finds them in one pass over the text: no function is applied to each token.
    """
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def first_words(raw: Column, at: int = 100) -> Column:
    """Distinct clean words at positions of raw tokens below ``at``, and the first one at or after it.

    Only the head and that one are cleaned: a token is clean and not empty just if it has a letter of a to z.
    """
    tail = F.filter(F.slice(raw, at, F.greatest(F.size(raw) - at + 1, F.lit(0))), lambda x: x.rlike("[a-z]"))
    few = F.filter(F.slice(raw, 1, at - 1), lambda x: x.rlike("[a-z]"))
    return F.array_distinct(F.transform(F.concat(few, F.slice(tail, 1, 1)), clean))


def head_parts(text: str | Column, at: int = 100) -> Column:
    """The raw tokens of a text before the one numbered ``at``, and as the one numbered so all that is left of the text."""
    return F.split(F.ltrim(F.lower(text), F.lit(" \t\n\r\f")), BLANKS, at)


def head_words(parts: Column, at: int = 100) -> Column:
    """``first_words`` of ``head_parts``, which better is a column of its own: an explode takes it once for each mention."""
    rest = F.regexp_extract(F.coalesce(F.get(parts, F.lit(at - 1)), F.lit("")), WORD, 0)
    head = F.transform(F.slice(parts, 1, at - 1), lambda x: F.regexp_extract(x, WORD, 0))
    return F.array_distinct(F.filter(F.concat(head, F.array(rest)), lambda x: x != ""))


def snippet(text: str | Column, most: int = 80) -> Column:
    """The first line, cut to ``most`` characters and marked if it is longer."""
    line = F.substring_index(F.substring(text, 1, most + 1), "\n", 1)  # the head alone tells
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def feature_id(word: Column) -> Column:
    """A feature number below 2**20, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(word), 1, 5), 16, 10).cast("int")
