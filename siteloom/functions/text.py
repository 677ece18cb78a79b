"""String functions with the Unicode rules that captured pages need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in a page text.
SPACES = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(value: Column) -> Column:
    """Cut white space (also no-break and line separators) at both ends."""
    return F.trim(value, F.lit(SPACES))


def collapse(value: Column) -> Column:
    """Each run of white space becomes one blank."""
    return F.regexp_replace(value, SPACE_CLASS + "+", " ")


def title_case(value: Column) -> Column:
    """Capital after every non-letter, the rest small: ``o'neil 3d`` becomes ``O'Neil 3D``."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(value, F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(0))
    # the capital of one letter may be two letters, of which only the first stays one
    first = lambda run: F.upper(F.substring(run, 1, 1))
    rest = lambda run: F.lower(F.concat(F.substr(first(run), F.lit(2)), F.substr(run, F.lit(2))))
    return F.array_join(F.transform(runs, lambda run: F.concat(F.substring(first(run), 1, 1), rest(run))), "")


def cut(value: Column, length: int | None) -> Column:
    """The first ``length`` characters; all without a length."""
    return value if length is None else F.substring(value, 1, length)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def level_slug(name: Column) -> Column:
    """Level name as a field prefix: lower case, ``_`` between words, ``level`` if nothing is left."""
    slug = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(blank_to_null(slug), F.lit("level"))
