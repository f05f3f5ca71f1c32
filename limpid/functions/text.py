"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x{FEFF}]"


def _folding() -> tuple[str, str, dict[str, str]]:
    """What characters decompose to, without marks of U+0300 to U+036F: those that become one character and what that is,
    and those that become several or none. Hangul syllables follow a rule of their own."""
    marked, bare, several = [], [], {}
    for i in (*range(0xA0, 0xAC00), *range(0xF900, 0x30000)):
        parts = unicodedata.normalize("NFD", chr(i))
        left = "".join(x for x in parts if not 0x300 <= ord(x) <= 0x36F)
        if len(left) == 1 and parts != chr(i):
            marked.append(chr(i))
            bare.append(left)
        elif parts != chr(i) and not 0x300 <= i <= 0x36F:
            several[chr(i)] = left
    return "".join(marked), "".join(bare), several


MARKED, BARE, SEVERAL = _folding()
#: Characters that translate() can't replace, and a class of all of them that costs less to look for.
BEYOND = r"[^\x00-\x{5ff}]"
RARE = "[" + "".join(SEVERAL) + "\uac00-\ud7a3]"


def _rare(x: Column) -> Column:
    """One of RARE as what it decomposes to; others as they are."""
    n = F.ascii(x) - 0xAC00
    jamo = lambda first, count, i: F.split(F.lit("".join(map(chr, range(first, first + count)))), "")[i.cast("int")]
    tail = F.when(n % 28 > 0, jamo(0x11A8, 27, n % 28 - 1)).otherwise("")
    hangul = F.concat(jamo(0x1100, 19, F.floor(n / 588)), jamo(0x1161, 21, F.floor(n % 588 / 28)), tail)
    table = F.create_map(*[F.lit(v) for pair in SEVERAL.items() for v in pair])
    return F.when(n.between(0, 11171), hangul).otherwise(F.coalesce(F.try_element_at(table, x), x))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+\z|\A[\s\x{{FEFF}}]+", "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def strip_accents(c: Column) -> Column:
    simple = F.translate(c, MARKED, BARE)
    some = F.when(simple.rlike(BEYOND) & simple.rlike(RARE), F.array_join(F.transform(F.split(simple, ""), _rare), "")).otherwise(simple)
    return F.regexp_replace(some, "[\\x{300}-\\x{36f}]", "")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{P}\p{S}]", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def title(c: Column) -> Column:
    """Each word, a letter and letters, digits, ' and - that follow, with its first letter alone in upper case."""
    pieces = F.regexp_extract_all(c, F.lit(r"\p{L}[\p{L}\p{N}'\-]*|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


STEPS = {"trim": trim, "collapse_spaces": collapse_spaces, "upper": F.upper, "lower": F.lower, "title": title, "strip_accents": strip_accents, "strip_punctuation": strip_punctuation, "digits_only": digits_only}


def normalise(c: Column, steps: list[str]) -> Column:
    if bad := [s for s in steps if s not in STEPS]:
        raise ValueError(f"unknown step {bad[0]!r}")
    return reduce(lambda x, s: STEPS[s](x), steps, c)


def comparison(c: Column) -> Column:
    """The form in which texts are compared: no outer space, accents, case or punctuation."""
    return normalise(c, ["trim", "strip_accents", "upper", "strip_punctuation", "collapse_spaces"])


def date_key(c: Column) -> Column:
    """Day-month-year and year-month-day with / - . as yyyy-MM-dd, unchecked; other texts in comparison form."""
    t = trim(c)
    dmy, ymd = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$", r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
    pad = lambda p, g: F.lpad(F.regexp_extract(t, p, g), 2, "0")
    return (
        F.when(t.rlike(dmy), F.concat_ws("-", F.regexp_extract(t, dmy, 3), pad(dmy, 2), pad(dmy, 1)))
        .when(t.rlike(ymd), F.concat_ws("-", F.regexp_extract(t, ymd, 1), pad(ymd, 2), pad(ymd, 3)))
        .otherwise(comparison(c))
    )


KEYS = {"none": lambda c: c, "raw": lambda c: c, "text": comparison, "date": date_key}


def key(c: Column, mode: str | None) -> Column:
    if (mode or "none") not in KEYS:
        raise ValueError(f"unknown key normalisation {mode!r}")
    return KEYS[mode or "none"](c)


def token_sorted(c: Column) -> Column:
    """The words of the comparison form, sorted."""
    return F.array_join(F.array_sort(F.filter(F.split(comparison(c), " "), lambda t: t != "")), " ")
