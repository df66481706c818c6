"""Scripts of a text's letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import col

#: Code -> the JVM's name of the script.
SCRIPTS = {"Latn": "Latin", "Deva": "Devanagari", "Beng": "Bengali", "Taml": "Tamil", "Telu": "Telugu", "Arab": "Arabic", "Hans": "Han"}


def counts(c: Column | str) -> dict[str, Column]:
    return {code: F.regexp_count(col(c), F.lit(rf"\p{{Is{name}}}")) for code, name in SCRIPTS.items()}


def letters(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"\p{L}"))


def share(c: Column | str, code: str) -> Column:
    """Share of a script in the letters, 0 if there are none."""
    letter = F.regexp_count(col(c), F.lit(rf"[\p{{L}}&&\p{{Is{SCRIPTS[code]}}}]"))
    return F.coalesce(F.try_divide(letter, letters(c)), F.lit(0.0))


def dominant(c: Column | str) -> Column:
    """The commonest script among the letters, of ties the first in SCRIPTS; Zyyy without letters of any."""
    n = [F.regexp_count(col(c), F.lit(rf"[\p{{L}}&&\p{{Is{name}}}]")) for name in SCRIPTS.values()]
    most = F.greatest(*n)
    pick = F.when(F.coalesce(most, F.lit(0)) == 0, "Zyyy")
    for code, k in zip(SCRIPTS, n, strict=True):
        pick = pick.when(k == most, code)
    return pick
