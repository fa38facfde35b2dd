"""Column functions over text, file names and paths. All of them stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters, and the characters Python's
# str.split() treats as whitespace; as regex classes and, by rule, as plain characters.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
WHITESPACE = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PUNCTUATION_CHARS = string.punctuation
WHITESPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The rules of the published mteval-v13a tokeniser, as (pattern, replacement).
TOKENISER_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _spaced(text, drop: str = "") -> Column:
    """One pass turns whitespace into spaces and deletes `drop`; runs and ends follow."""
    mapped = F.translate(_col(text), WHITESPACE_CHARS + drop, " " * len(WHITESPACE_CHARS))
    return F.trim(F.regexp_replace(mapped, " {2,}", " "))


def collapse_spaces(text) -> Column:
    """Whitespace runs become one space, none at the ends."""
    return _spaced(text)


def strip(text) -> Column:
    """Remove surrounding whitespace of any kind (Spark's trim knows only the space)."""
    return F.trim(_col(text), F.lit(WHITESPACE_CHARS))


def normalize(text) -> Column:
    """Lower case, no ASCII punctuation, single spaces."""
    return _spaced(F.lower(_col(text)), drop=PUNCTUATION_CHARS)


def is_blank(text, stripped: bool = True) -> Column:
    """Null, or empty (after stripping unless told otherwise). Never null itself."""
    value = strip(text) if stripped else _col(text)
    return F.length(F.coalesce(value, F.lit(""))) == 0


def blank_to_null(text) -> Column:
    return F.nullif(_col(text), F.lit(""))


def words(text) -> Column:
    """Words of a text whose whitespace is already single spaces; [] for an empty text."""
    return F.filter(F.split(_col(text), " "), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def tokenize_13a(text) -> Column:
    """Tokens joined by spaces, for scoring text that has not been normalised."""
    value = F.regexp_replace(_col(text), "<skipped>", "")
    value = F.regexp_replace(F.regexp_replace(value, "-\n", ""), "\n", " ")
    for entity, char in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    value = F.concat(F.lit(" "), value, F.lit(" "))
    for pattern, replacement in TOKENISER_13A:
        value = F.regexp_replace(value, pattern, replacement)
    return collapse_spaces(value)


def same_text(left, right) -> Column:
    """Equality that ignores case and surrounding whitespace."""
    return F.lower(strip(left)) == F.lower(strip(right))


def stem(path) -> Column:
    """File name without folder and without its last suffix."""
    # The expression alone would begin anew at every character of every folder.
    return F.regexp_extract(F.substring_index(_col(path), "/", -1), r"([^/]+?)(\.[^./]*)?$", 1)


def unit_stem(name) -> Column:
    """Stem of a unit file's text partner."""
    return F.replace(_col(name), F.lit("_units"), F.lit(""))


def participant_id(name) -> Column:
    """Speaker id of a stem such as `P-17_0042`; null for other stems."""
    return F.when(_col(name).startswith("P-"), F.split_part(_col(name), F.lit("_"), F.lit(1)))


def join_path(folder, name) -> Column:
    return F.concat_ws("/", _col(folder), _col(name))


def units_to_text(units) -> Column:
    return F.array_join(F.transform(_col(units), lambda u: u.cast("string")), " ")


def text_to_units(text) -> Column:
    """Parse a unit string back, ignoring every token that is not a plain number."""
    tokens = F.filter(F.split(collapse_spaces(text), " "), lambda t: t.rlike("^[0-9]+$"))
    return F.transform(tokens, lambda t: t.cast("int"))
