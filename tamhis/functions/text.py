"""Text rules as Column -> Column functions on built-in, JVM-side expressions.

The rules are defined on Unicode white space and digits, while Java's ``\\s`` and ``\\d`` are ASCII, so
the classes are spelled out. Quantifiers are possessive where the next character cannot be part of the
run, so that every pattern is linear in the text, also on megabyte-long tokens.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamhis.profiles import ARABIC, LanguageProfile

# The characters that count as white space (Unicode White_Space and U+001C..U+001F).
SPACE_CHARS = "".join(
    chr(c) for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# One composite class for these characters is slow in Java, and much slower still when several tasks
# of an executor match at once. So the classes are alternations: Latin-1 characters listed one by one
# (a table lookup), plain ranges that hold no white space, and the small mixed range, whose characters
# are looked at a second time.
_RARE_SPACE = r"[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _latin(keep) -> str:
    return "[" + "".join(rf"\x{c:02x}" for c in range(256) if keep(chr(c))) + "]"


def _visible(keep=lambda c: True) -> str:
    latin = _latin(lambda c: c not in SPACE_CHARS and keep(c))
    return rf"(?:{latin}+|[\u0100-\u167f]+|[\u3001-\x{{10ffff}}]+|[\u1681-\u2fff](?<!{_RARE_SPACE}))"


def _space(keep=lambda c: True) -> str:
    return rf"(?:{_latin(lambda c: c in SPACE_CHARS and keep(c))}|[\u1680-\u3000](?<={_RARE_SPACE}))"


WS, _WS_IN_LINE = _space(), _space(lambda c: c != "\n")
NWS, _NWS_BUT_AT = _visible(), _visible(lambda c: c != "@")


def _any_of(words) -> str:
    return "|".join(rf"\Q{w}\E" for w in words)


def strip(c: Column) -> Column:
    """Drop leading and trailing white space (Unicode)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


# -- normalisation, used for the keyword gate only ---------------------------------------------

def strip_marks(c: Column, profile: LanguageProfile = ARABIC) -> Column:
    return F.regexp_replace(c, profile.strip_marks, "") if profile.strip_marks else c


def fold_letters(c: Column, profile: LanguageProfile = ARABIC) -> Column:
    return F.translate(c, profile.fold_from, profile.fold_to) if profile.fold_from else c


def squeeze_runs(c: Column) -> Column:
    """Three or more equal characters in a row become one; line feeds are left alone."""
    return F.regexp_replace(c, r"(?d)(.)\1{2,}+", "$1")


def normalize(c: Column, profile: LanguageProfile = ARABIC) -> Column:
    return squeeze_runs(fold_letters(strip_marks(c, profile), profile))


# -- cleaning ----------------------------------------------------------------------------------

# Second branch of the two cutting rules: a line break that starts no tail is matched as a whole and put
# back, so that the search goes on behind it and a long run of blank lines is read only once.
_OTHER_BREAK = rf"(\n{WS}*+)"


def strip_urls(c: Column) -> Column:
    return F.regexp_replace(c, f"(?:http|www){NWS}++", "")


def strip_emails(c: Column) -> Column:
    """Drop every token with an ``@``, together with one white space after it."""
    # \G continues where the last match ended: the group takes the tokens before the next one with an @.
    return F.regexp_replace(c, rf"\G((?:{_NWS_BUT_AT}*+{WS}++)*+){_NWS_BUT_AT}*+@{NWS}*+{WS}?", "$1")


def cut_number_tail(c: Column) -> Column:
    """Cut from the first line that holds only digits to the end of the text."""
    tail = rf"\n{WS}*+\p{{Nd}}++{_WS_IN_LINE}*+(?:\n.*+)?$"
    return F.regexp_replace(c, f"(?ds){tail}|{_OTHER_BREAK}", "$1")


def cut_signature(c: Column, profile: LanguageProfile = ARABIC) -> Column:
    """Cut from the first line that begins with a signature marker to the end of the text."""
    if not profile.signatures:
        return c
    tail = rf"\n{WS}*+(?:{_any_of(profile.signatures)}).*+"
    return F.regexp_replace(c, f"(?s){tail}|{_OTHER_BREAK}", "$1")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}++", " "))


def clean(c: Column, profile: LanguageProfile = ARABIC) -> Column:
    """URLs, e-mails, number tail, signature, white space - in this order."""
    return collapse_spaces(cut_signature(cut_number_tail(strip_emails(strip_urls(c))), profile))


# -- measures ----------------------------------------------------------------------------------

def words(c: Column) -> Column:
    """White-space separated words as an array; empty for a blank text."""
    return F.regexp_extract_all(c, F.lit(f"({NWS}++)"), 1)


def word_count(c: Column, none_as_text: bool = False) -> Column:
    """Number of words; null for null unless ``none_as_text``, which counts a null as one word."""
    n = F.regexp_count(c, F.lit(f"{NWS}++")).cast("long")
    return F.coalesce(n, F.lit(1).cast("long")) if none_as_text else n


def char_count(c: Column, none_as_text: bool = False) -> Column:
    """Code points; null for null unless ``none_as_text``, which counts a null as the text 'None'."""
    n = F.length(c).cast("long")
    return F.coalesce(n, F.lit(len("None")).cast("long")) if none_as_text else n


def has_words(c: Column, n: int) -> Column:
    """True if the text has at least ``n`` words; stops reading after the n-th one."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return c.rlike(f"^{WS}*+(?:{NWS}++{WS}++){{{n - 1}}}{NWS}")


def has_any(c: Column, keywords, unless=()) -> Column:
    """True if any of the keywords is a substring and none of ``unless`` is; false without keywords.

    One pattern instead of an OR chain of ``contains``: the chain would repeat the (computed)
    argument once per keyword as soon as Catalyst pushes the filter below its projection.
    """
    if not keywords:
        return F.lit(False)
    found = f"(?:{_any_of(keywords)})"
    return c.rlike(f"(?s)^(?!.*(?:{_any_of(unless)})).*{found}" if unless else found)
