"""Ordinals as DuckDB SQL: looked up in lists of all forms, which the operator, that inflects, doesn't use."""

from __future__ import annotations

_BELOW_TWENTY = {
    "m": "pierwszy drugi trzeci czwarty piąty szósty siódmy ósmy dziewiąty dziesiąty jedenasty dwunasty trzynasty czternasty piętnasty szesnasty siedemnasty osiemnasty dziewiętnasty",
    "f": "pierwsza druga trzecia czwarta piąta szósta siódma ósma dziewiąta dziesiąta jedenasta dwunasta trzynasta czternasta piętnasta szesnasta siedemnasta osiemnasta dziewiętnasta",
    "n": "pierwsze drugie trzecie czwarte piąte szóste siódme ósme dziewiąte dziesiąte jedenaste dwunaste trzynaste czternaste piętnaste szesnaste siedemnaste osiemnaste dziewiętnaste",
}
_TENS = {
    "m": "dwudziesty trzydziesty czterdziesty pięćdziesiąty sześćdziesiąty siedemdziesiąty osiemdziesiąty dziewięćdziesiąty",
    "f": "dwudziesta trzydziesta czterdziesta pięćdziesiąta sześćdziesiąta siedemdziesiąta osiemdziesiąta dziewięćdziesiąta",
    "n": "dwudzieste trzydzieste czterdzieste pięćdziesiąte sześćdziesiąte siedemdziesiąte osiemdziesiąte dziewięćdziesiąte",
}
_HUNDREDS = {
    "m": "setny dwusetny trzechsetny czterechsetny pięćsetny sześćsetny siedemsetny osiemsetny dziewięćsetny",
    "f": "setna dwusetna trzechsetna czterechsetna pięćsetna sześćsetna siedemsetna osiemsetna dziewięćsetna",
    "n": "setne dwusetne trzechsetne czterechsetne pięćsetne sześćsetne siedemsetne osiemsetne dziewięćsetne",
}
_BEFORE = "sto dwieście trzysta czterysta pięćset sześćset siedemset osiemset dziewięćset"


def sql_ordinal(n: str, gender: str) -> str:
    """The ordinal of ``n``; null outside 1..999."""
    units, tens, hundreds, before = (f"string_split('{words}', ' ')" for words in (_BELOW_TWENTY[gender], _TENS[gender], _HUNDREDS[gender], _BEFORE))
    n = f"({n})"
    rest = f"({n} % 100)"
    below = f"CASE WHEN {rest} < 20 THEN {units}[{rest}] WHEN {rest} % 10 = 0 THEN {tens}[{rest} // 10 - 1] ELSE {tens}[{rest} // 10 - 1] || ' ' || {units}[{rest} % 10] END"
    return f"(CASE WHEN {n} < 1 OR {n} > 999 THEN NULL WHEN {rest} = 0 THEN {hundreds}[{n} // 100] WHEN {n} >= 100 THEN {before}[{n} // 100] || ' ' || {below} ELSE {below} END)"
