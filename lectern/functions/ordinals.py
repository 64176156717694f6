"""Polish ordinal words of 1 to 999, by gender."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The masculine ordinals of 1 to 19, of the tens from 20, of the hundreds; the cardinals of the hundreds.
_UNITS = "pierwszy drugi trzeci czwarty piąty szósty siódmy ósmy dziewiąty dziesiąty jedenasty dwunasty trzynasty czternasty piętnasty szesnasty siedemnasty osiemnasty dziewiętnasty".split()
_TENS = "dwudziesty trzydziesty czterdziesty pięćdziesiąty sześćdziesiąty siedemdziesiąty osiemdziesiąty dziewięćdziesiąty".split()
_HUNDREDS = "setny dwusetny trzechsetny czterechsetny pięćsetny sześćsetny siedemsetny osiemsetny dziewięćsetny".split()
_CARDINAL = "sto dwieście trzysta czterysta pięćset sześćset siedemset osiemset dziewięćset".split()
#: What the last letter becomes in the other genders.
_ENDINGS = {"m": {"y": "y", "i": "i"}, "f": {"y": "a", "i": "ia"}, "n": {"y": "e", "i": "ie"}}
_IRREGULAR = {("drugi", "f"): "druga"}


def _ended(word: str, gender: str) -> str:
    return _IRREGULAR.get((word, gender)) or word[:-1] + _ENDINGS[gender][word[-1]]


def ordinal_word(n: int, gender: str = "m") -> str | None:
    """The ordinal of ``n``; null outside 1..999; an unknown gender counts as masculine."""
    if not 1 <= n <= 999:
        return None
    gender = gender if gender in _ENDINGS else "m"
    hundreds, rest = divmod(n, 100)
    if not rest:
        return _ended(_HUNDREDS[hundreds - 1], gender)
    words = [_CARDINAL[hundreds - 1]] if hundreds else []
    if rest >= 20:
        words.append(_ended(_TENS[rest // 10 - 2], gender))
        rest %= 10
    if rest:
        words.append(_ended(_UNITS[rest - 1], gender))
    return " ".join(words)


def ordinal(n: Column, gender: str = "m") -> Column:
    """``ordinal_word`` of an int column, as a lookup in one constant array."""
    words = F.array(*(F.lit(ordinal_word(k, gender)) for k in range(1, 1000)))
    return F.get(words, (n - 1).cast("int"))
