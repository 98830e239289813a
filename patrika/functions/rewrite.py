"""Text rewriting: ordered dictionaries, rules on sequences, cleaning, normal form C, and the fused repairs.

What Spark's expressions say well is native (`apply_rules`, `clean`, `substitute`, `fix_misread`). Normal form C has no
expression, so texts that aren't plain ASCII go to Python. The repairs decide by what earlier steps made of
a text, so those run as one Python function each, built from the same steps.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StringType

from .constants import ANY, DAMAGE, DELETED, DIGIT, LEGACY, LETTER, MARKERS, MARKS, MISREAD, RULES, SCRIPT, SPACE, VOWEL_SIGN, WORD
from .script import deleted, strip, text_of

_KEPT = rf"{SCRIPT}.,!?;:()\-"
_PY_RULES = [(re.compile(p.replace("<", r"\b").replace(">", r"\b")), re.sub(r"([12])", r"\\\1", r)) for p, r in RULES]
_CLEANING = [(re.compile(r"\s+[.,:;!?]\s+"), " "), (re.compile(f"({LETTER})({LETTER}{VOWEL_SIGN})"), r"\1 \2")]
_SPACING = [(re.compile(rf"[^\s\w{_KEPT}]+"), ""), (re.compile(f"({LETTER})({DIGIT})"), r"\1 \2"), (re.compile(f"({DIGIT})({LETTER})"), r"\1 \2")]
_MARKS, _SKIPPED, _WORDS = re.compile(MARKS), re.compile(r"[\s.,!?;:()\-]+"), re.compile(f"{ANY}+")
_DROPPED, _IN_SCRIPT, _ASCII, _SPACES = re.compile(f"[{''.join(DELETED)}]+"), re.compile(f"[{SCRIPT}]+"), re.compile("[\x00-\x7f]+"), re.compile(r"\s+")


# -- steps on a str ---------------------------------------------------------------------------------------------------


def count_of(pattern: re.Pattern, text: str) -> int:
    """How many characters the matches of runs of a class hold; a list of the characters would cost far more."""
    return len(text) - len(pattern.sub("", text))


def replaced(text: str, table: Sequence[tuple[str, str]]) -> str:
    for key, value in table:
        text = text.replace(key, value)
    return text


def by_rules(text: str) -> str:
    for pattern, stays in _PY_RULES:
        text = pattern.sub(stays, text)
    return text


def from_font(text: str) -> str:
    return by_rules(replaced(text, LEGACY))


def cleaned(text: str) -> str:
    text = _SPACES.sub(" ", text)
    for pattern, stays in _CLEANING:
        text = pattern.sub(stays, text)
    text = _DROPPED.sub("", text)
    for pattern, stays in _SPACING:
        text = pattern.sub(stays, text)
    return text.strip()


def normal(text: str) -> str:
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFC", text))


def is_normal(text: str) -> bool:
    return unicodedata.is_normalized("NFC", text)


def collapsed(text: str) -> str:
    return " ".join(text.split())


def in_script(text: str) -> bool:
    counted = _SKIPPED.sub("", text)
    return bool(counted) and count_of(_IN_SCRIPT, counted) / len(counted) > 0.2


def font_encoded(text: str) -> bool:
    script = in_script(text)
    if script and len(_WORDS.findall(text)) > 3:
        return False
    if sum(m in text for m in MARKERS) >= 2 or (not script and sum(d in text for d in DAMAGE) >= 3):
        return True
    total = len("".join(text.split()))
    return total > 20 and (len(text) - count_of(_ASCII, text)) / total > 0.7 and count_of(_WORDS, text) / total < 0.2


def odd_characters(text: str) -> int:
    """Characters that are neither script, white space, word characters nor common punctuation."""
    return count_of(_SPACING[0][0], text)


def _finished(text: str) -> str:
    return collapsed(normal(cleaned(text)))


def repaired(text: str, forced: bool = False) -> str:
    """Misread characters first, then the font dictionary if forced or detected, then cleaning; once more with the
    dictionary if little script came of it."""
    text = replaced(text, MISREAD)
    if forced or font_encoded(text):
        text = by_rules(from_font(text))
    text = _finished(text)
    if not in_script(text) and len(text) > 10:
        text = _finished(by_rules(from_font(text)))
    return text


def repaired_digital(text: str, fonts: bool = False) -> str:
    """Good script is only normalised; font-encoded text is rewritten; so is what is too long and has no script in the end."""
    if not text.strip():
        return ""
    if in_script(text) and not fonts:
        return collapsed(normal(text))
    text = repaired(from_font(text), True) if fonts or font_encoded(text) else collapsed(normal(text))
    # too little script is an issue of its own, so a text without it is never valid
    return repaired(from_font(text), True) if not in_script(text) and len(text) > 20 else text


def recognised(text: str) -> str:
    """Recognised text: the page as it came says whether it is font-encoded, before misread characters are replaced."""
    return repaired(text, font_encoded(text)) if text.strip() else ""


# -- columns ----------------------------------------------------------------------------------------------------------


def python_function(step: Callable[[str], object], kind: DataType = StringType()) -> Callable:
    """A Column function of a step on a str; null stays null. Texts are long and steps slow, so what counts is the memory:
    rows go over by the hundred, while an Arrow batch holds ten thousand texts, and again what is made of them."""
    return F.udf(lambda t: None if t is None else step(t), kind, useArrow=False)


_normal, _is_nfc = python_function(normal), python_function(is_normal, BooleanType())
_from_font = python_function(from_font)
_repaired, _repaired_forced, _recognised = python_function(repaired), python_function(lambda t: repaired(t, True)), python_function(recognised)
_digital = F.udf(lambda t, fonts: repaired_digital(t, bool(fonts)), StringType(), useArrow=False)

def _not_ascii(c: Column | str) -> Column:
    """The text if it is not plain ASCII, which is in normal form C and without marks; else null."""
    t = text_of(c)
    return F.when(F.octet_length(t) != F.length(t), t)


def normalize(c: Column | str) -> Column:
    return F.coalesce(_normal(_not_ascii(c)), text_of(c))


def is_nfc(c: Column | str) -> Column:
    return F.coalesce(_is_nfc(_not_ascii(c)), F.lit(True))


def convert_font(c: Column | str) -> Column:
    """The font dictionary, then the rules on sequences."""
    return _from_font(text_of(c))


def fix_misread(c: Column | str) -> Column:
    """Entries of several characters all hold script and come first; of the others none makes what another replaces."""
    t = text_of(c)
    out = t
    for key, value in (p for p in MISREAD if len(p[0]) > 1):
        out = F.replace(out, F.lit(key), F.lit(value))
    out = F.when(t.rlike(f"[{SCRIPT}]"), out).otherwise(t)
    for key, value in (p for p in MISREAD if len(p[0]) == 1 and len(p[1]) > 1):
        out = F.replace(out, F.lit(key), F.lit(value))
    one = sorted((p for p in MISREAD if len(p[0]) == 1 and len(p[1]) < 2), key=lambda p: not p[1])  # those deleted last
    return F.translate(out, "".join(k for k, _ in one), "".join(v for _, v in one))


def repair(c: Column | str, forced: bool = False) -> Column:
    return (_repaired_forced if forced else _repaired)(text_of(c))


def repair_digital(c: Column | str, fonts: Column | None = None) -> Column:
    return _digital(text_of(c), F.coalesce(fonts, F.lit(False)) if fonts is not None else F.lit(False))


def repair_recognised(c: Column | str, debug: bool = False) -> Column:
    """Recognised text: normal form only when debugging, else the full repair, forced where the text as it came is
    font-encoded; blank texts are empty."""
    t = text_of(c)
    return F.when(t.rlike(f"[^{SPACE}]"), normalize(t)).otherwise("") if debug else _recognised(t)


#: White space that isn't a single blank already.
_WIDE = f"[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+"


def substitute(c: Column | str, table: Sequence[tuple[str, str]]) -> Column:
    """An ordered dictionary as a native fold: each pair works on what the earlier ones left."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table])
    return F.aggregate(pairs, text_of(c), lambda text, p: F.replace(text, p["k"], p["v"]))


def apply_rules(c: Column | str) -> Column:
    """The rules on sequences as chained expressions; a word boundary is a look at the neighbour."""
    out = text_of(c)
    for pattern, stays in RULES:
        java = re.sub("^<(.)", lambda m: f"{m[1]}(?<![{WORD}]{m[1]})", pattern).replace(">", f"(?![{WORD}])")  # the letter first: it is rare
        out = F.regexp_replace(out, java, re.sub(r"([12])", r"$\1", stays))
    return out


def clean(c: Column | str) -> Column:
    out = F.regexp_replace(text_of(c), _WIDE, " ")
    out = F.regexp_replace(out, " [.,:;!?] ", " ")
    out = F.regexp_replace(out, f"({LETTER})({LETTER}{VOWEL_SIGN})", "$1 $2")
    out = deleted(deleted(out, "".join(DELETED)), f"^{_KEPT}{SPACE}{WORD}")
    out = F.regexp_replace(out, f"({LETTER})({DIGIT})", "$1 $2")
    return strip(F.regexp_replace(out, f"({DIGIT})({LETTER})", "$1 $2"))


def collapse(c: Column | str) -> Column:
    return strip(F.regexp_replace(text_of(c), _WIDE, " "))
