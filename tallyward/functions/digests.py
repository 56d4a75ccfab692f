"""Short stand-ins for long texts, computed once per text, on which a pattern finds what it finds in the text.

A pattern over digits meets nothing in a page of prose, but looks at every word of it. In the digest of a text each
stretch without digits is cut down to its ends, so such patterns look at a few characters around each number only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# From behind a character other than digit, blank and hyphen to before such a one, with four characters left on
# either side: what is left of a stretch still parts its two numbers wherever the whole stretch does.
_STRETCH = r"(?<=[^0-9]{3}[^0-9 \-])[^0-9]+(?=[^0-9 \-][^0-9]{3})"

# Without so many characters in a row that are no digits there is nothing to cut: numbers and dates pass as they are.
_LONG_STRETCH = "[^0-9]{9}"

# The address pattern that is looked for around each ``@``, and its parts before and behind the sign.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_LOCAL_END = r"[A-Za-z0-9._%+-]$"
_DOMAIN = r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def near_digits(text: Column) -> Column:
    """The surroundings of the digits of a text; null for a text without any.

    A pattern gives the same answer on it as on the text when the gaps between its digits hold at most seven
    characters, or blanks and hyphens only, and when it looks at most three characters beyond its outer digits.
    """
    cut = F.when(text.rlike(_LONG_STRETCH), F.regexp_replace(text, _STRETCH, "")).otherwise(text)
    return F.when(text.rlike("[0-9]"), cut)


def has_email(text: Column) -> Column:
    """Whether :data:`EMAIL_PATTERN` occurs: only what stands directly around each ``@`` is looked at."""
    parts = F.split(text, "@", -1)
    ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda part: F.right(part, F.lit(1)).rlike(_LOCAL_END))
    starts = F.transform(F.slice(parts, 2, F.size(parts)), lambda part: part.rlike(_DOMAIN))
    return text.contains("@") & F.exists(F.zip_with(ends, starts, lambda a, b: a & b), lambda both: both)
