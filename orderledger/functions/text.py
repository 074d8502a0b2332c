"""Text normalisation that stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Letters that have a case. Title casing starts a word at a cased letter that
# follows anything else, so digits, quotes and hyphens all end a word.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_INNER_WORD_START = rf"(?<=[^ {_CASED}])(?=[{_CASED}])"
_HAS_INNER_WORD = rf"[^ {_CASED}][{_CASED}]"

# A Unicode noncharacter, reserved for use inside a program: it marks the word
# starts initcap() does not know of and is taken out again afterwards.
_MARK = "\ufdd0 "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Cut all Unicode whitespace from both ends; null stays null.

    Text that begins and ends with a visible ASCII character is kept without
    looking further, which is most text and half the cost.
    """
    text = _col(c)
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    settled = first.between("!", "~") & last.between("!", "~")
    return F.when(settled, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and whitespace-only text; never null."""
    # Cutting the left end alone decides it, and stops at the first real character.
    return F.coalesce(F.ltrim(_col(c), F.lit(WHITESPACE)), F.lit("")) == F.lit("")


def title_case(c: Column | str) -> Column:
    """Strip, then capitalise each run of cased letters and lower the rest.

    ``initcap`` alone starts a word only after a space; ``o'neil 3rd`` has to
    become ``O'Neil 3Rd``. Text without such inner word starts takes the
    short path.
    """
    low = F.lower(strip(c))
    marked = F.regexp_replace(low, _INNER_WORD_START, _MARK)
    return F.when(
        low.rlike(_HAS_INNER_WORD),
        F.replace(F.initcap(marked), F.lit(_MARK), F.lit("")),
    ).otherwise(F.initcap(low))
