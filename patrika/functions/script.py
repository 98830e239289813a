"""Script profiles and predicates as native Column expressions. Null texts count as empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ANY, CORRUPTION, DAMAGE, ISSUES, MARKERS, SCRIPT, SPACE, WORD


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def deleted(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"[{chars}]+", "")


def count_of(c: Column, chars: str) -> Column:
    """How many characters of a class. regexp_count() would make a string of each of them. Of a negated class the others
    are deleted, as Java's large negated classes are several times slower."""
    if chars.startswith("^"):
        return F.length(deleted(c, chars[1:]))
    return F.length(c) - F.length(deleted(c, chars))


def runs_of(c: Column, chars: str) -> Column:
    """How many runs of characters of a class, as long as they go."""
    return F.length(F.regexp_replace(c, f"[{chars}]+", "x")) - F.length(deleted(c, chars))


def strip(c: Column | str) -> Column:
    """Without white space at both ends, as Python's strip()."""
    return F.regexp_replace(F.regexp_replace(text_of(c), f"^[{SPACE}]+", ""), f"[{SPACE}]+$", "")


def is_blank(c: Column | str) -> Column:
    return ~text_of(c).rlike(f"[^{SPACE}]")


def has_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def number_found(c: Column, parts: Sequence[str]) -> Column:
    """How many of the parts occur."""
    return sum((c.contains(p).cast("int") for p in parts), F.lit(0))


def is_script(c: Column | str) -> Column:
    """Over a fifth of the characters that are neither white space nor `.,!?;:()-` belong to the script."""
    t = text_of(c)
    total = F.length(deleted(t, SPACE + r".,!?;:()\-"))  # none of these is of the script
    return F.coalesce(F.try_divide(count_of(t, SCRIPT).cast("double"), total.cast("double")) > 0.2, F.lit(False))


def is_font_encoded(c: Column | str) -> Column:
    """Text meant for a legacy font. Proper script with over three words is not; two markers are, three kinds of damage
    without enough script are, and so are over 20 characters that are mostly neither ASCII nor script."""
    t = text_of(c)
    proper = is_script(t) & (runs_of(t, ANY[1:-1]) > 3)
    total = F.length(deleted(t, SPACE)).cast("double")
    odd = (count_of(t, r"^\x00-\x7F") / total > 0.7) & (count_of(t, ANY[1:-1]) / total < 0.2)
    return (
        F.when((t == "") | proper, False)
        .when(number_found(t, MARKERS) >= 2, True)
        .when((number_found(t, DAMAGE) >= 3) & ~is_script(t), True)
        .when(total > 20, odd)
        .otherwise(False)
    )


def issues(c: Column | str, normal: Column) -> Column:
    """Ordered list of what is wrong with a text; `normal` says whether it is in normal form C (see rewrite.is_nfc)."""
    t = text_of(c)
    n = F.length(t).cast("double")
    odd = count_of(t, rf"^{SCRIPT}{SPACE}{WORD}.,!?;:()\-")
    found = F.array(
        F.when(~is_script(t), ISSUES["script"]),
        F.when(odd > n * 0.1, ISSUES["artifacts"]),
        F.when(count_of(t, ".,!?;:") / n > 0.3, ISSUES["punctuation"]),
        F.when(~normal, ISSUES["form"]),
    )
    return F.when(is_blank(t), F.array(F.lit(ISSUES["blank"]))).otherwise(F.array_compact(found))


def profile(c: Column | str) -> Column:
    """struct: total, script and ASCII characters with percentages to one decimal, ties to even, and a sample of 100."""
    t = text_of(c)
    n, k = F.length(t), count_of(t, "ಀ-೿")
    a = n - count_of(t, r"^\x00-\x7F")
    # format_number rounds the exact value half to even; a percentage has no thousands to group
    share = lambda x: F.when(n > 0, F.format_number(x / n * 100, 1).cast("double")).otherwise(0.0)
    return F.struct(n.alias("total"), k.alias("script"), share(k).alias("script_pct"), a.alias("ascii"), share(a).alias("ascii_pct"), F.when(n > 0, F.substring(t, 1, 100)).otherwise("No text").alias("sample"))


def looks_corrupt(c: Column | str) -> Column:
    return has_any(text_of(c), CORRUPTION)


def is_over_cleaned(raw: Column | str, clean: Column | str) -> Column:
    r, c = F.length(text_of(raw)), F.length(text_of(clean))
    return (r > 0) & (c < r * F.lit(0.1))
