"""Porter's stemming algorithm (1980) as SQL expressions for Spark and DuckDB, from one description of its rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}"
_IS1 = f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL, _CVC = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

# Suffixes and replacements of the published steps 2, 3 and 4.
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _pairs(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(p.split(" ")) for p in text.split(",")), key=lambda p: -len(p[0]))


def _rules(match):
    """The steps as (condition, result) in order; the first whose condition holds applies. ``w`` is the word."""

    def cut(n: int) -> str:
        return f"left(w, length(w) - {n})"

    def ends(s: str) -> str:
        return f"right(w, {len(s)}) = '{s}'"

    def when(suffix: str, pattern: str, result: str) -> tuple[str, str]:
        return ends(suffix), f"CASE WHEN {match(cut(len(suffix)), pattern)} THEN {result} ELSE w END"

    yield [(ends("sses"), cut(2)), (ends("ies"), cut(2)), (ends("ss"), "w"), (ends("s"), cut(1))]
    # A mark shows that ed or ing went, for the step after.
    yield [when("eed", _M0, cut(1)), when("ed", _VOWEL, f"{cut(2)} || '#'"), when("ing", _VOWEL, f"{cut(3)} || '#'")]
    bare = cut(1)
    last = f"right({bare}, 1)"
    yield [
        ("right(w, 1) <> '#'", "w"),
        (f"right({bare}, 2) IN ('at', 'bl', 'iz')", f"{bare} || 'e'"),
        (f"length({bare}) > 1 AND {last} = left(right({bare}, 2), 1) AND {last} NOT IN ('a', 'e', 'i', 'o', 'u', 'y', 'l', 's', 'z')", cut(2)),
        (match(bare, _CVC), f"{bare} || 'e'"),
        ("true", bare),
    ]
    yield [when("y", _VOWEL, f"{cut(1)} || 'i'")]
    yield [when(a, _M0, f"{cut(len(a))} || '{b}'") for a, b in _pairs(STEP2)]
    yield [when(a, _M0, f"{cut(len(a))} || '{b}'") for a, b in _pairs(STEP3)]
    step4 = [when(a, _M1, cut(len(a))) for a in sorted(STEP4.split(), key=len, reverse=True)]
    yield [*step4, (f"{ends('sion')} OR {ends('tion')}", f"CASE WHEN {match(cut(3), _M1)} THEN {cut(3)} ELSE w END")]
    yield [(ends("e"), f"CASE WHEN {match(cut(1), _M1)} OR ({match(cut(1), _IS1)} AND NOT {match(cut(1), _CVC)}) THEN {cut(1)} ELSE w END")]
    yield [(ends("ll"), f"CASE WHEN {match('w', _M1)} THEN {cut(1)} ELSE w END")]


def _steps(match) -> list[str]:
    return ["CASE WHEN length(w) < 3 THEN w " + " ".join(f"WHEN {c} THEN {r}" for c, r in step) + " ELSE w END" for step in _rules(match)]


def stems(words: DataFrame) -> DataFrame:
    """lower and stem of the distinct values of column ``lower``; apostrophes are dropped first."""
    out = words.select("lower").distinct().withColumn("w", F.expr("replace(lower, \"'\", '')"))
    for step in _steps(lambda text, pattern: f"({text} RLIKE '{pattern}')"):
        out = out.withColumn("w", F.expr(step))
    # An aggregate by the same key costs no shuffle, and keeps the optimizer from copying filters into the steps.
    return out.groupBy("lower").agg(F.first("w").alias("stem"))


_PATTERNS = {p: re.compile(p) for p in (_M0, _M1, _IS1, _VOWEL, _CVC)}


def _cut(w: str, suffix: str, pattern: str, tail: str = "") -> str:
    rest = w[: -len(suffix)]
    return rest + tail if _PATTERNS[pattern].search(rest) else w


_SUFFIX4 = re.compile(f"({'|'.join(STEP4.split())})$")


def _step4(w: str) -> str:
    found = _SUFFIX4.search(w)  # the leftmost match is the longest suffix
    if found:
        return _cut(w, found[0], _M1)
    return _cut(w, "ion", _M1) if w.endswith(("sion", "tion")) else w


def _bare(w: str) -> str:
    b = w[:-1]
    if w[-1] != "#":
        return w
    if b.endswith(("at", "bl", "iz")):
        return b + "e"
    if len(b) > 1 and b[-1] == b[-2] and b[-1] not in "aeiouylsz":
        return b[:-1]
    return b + "e" if _PATTERNS[_CVC].search(b) else b


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _participle(w: str) -> str:
    if w.endswith("eed"):
        return _cut(w, "eed", _M0, "ee")
    if w.endswith("ed"):
        return _cut(w, "ed", _VOWEL, "#")
    return _cut(w, "ing", _VOWEL, "#") if w.endswith("ing") else w


def _replaced(pairs: str):
    rules = dict(_pairs(pairs))
    suffix = re.compile(f"({'|'.join(rules)})$")

    def step(w: str) -> str:
        found = suffix.search(w)
        return _cut(w, found[0], _M0, rules[found[0]]) if found else w

    return step


def _last_e(w: str) -> str:
    b = w[:-1]
    good = w.endswith("e") and (_PATTERNS[_M1].search(b) or (_PATTERNS[_IS1].search(b) and not _PATTERNS[_CVC].search(b)))
    return b if good else w


_IN_PYTHON = (
    _plural, _participle, _bare, lambda w: _cut(w, "y", _VOWEL, "i") if w.endswith("y") else w, _replaced(STEP2), _replaced(STEP3), _step4, _last_e,
    lambda w: w[:-1] if w.endswith("ll") and _PATTERNS[_M1].search(w) else w,
)
#: Stems that a Python worker has met; they are forgotten when there are so many.
_KNOWN: dict[str, str] = {}
MOST_KNOWN = 400_000


def stem(word: str) -> str:
    """The stem of one word, by the same rules as the SQL expressions."""
    w = word.replace("'", "")
    for step in _IN_PYTHON:
        if len(w) >= 3:
            w = step(w)
    return w


def known_stem(word: str) -> str:
    """The same, remembered by the worker."""
    found = _KNOWN.get(word)
    if found is None:
        if len(_KNOWN) >= MOST_KNOWN:
            _KNOWN.clear()
        found = _KNOWN[word] = stem(word)
    return found


def stems_sql(source: str = "tokens") -> str:
    """A relation ``stems`` (lower, stem) of the words of another."""
    query = f"SELECT DISTINCT lower, replace(lower, '''', '') AS w FROM {source}"
    for step in _steps(lambda text, pattern: f"regexp_matches({text}, '{pattern}')"):
        query = f"SELECT lower, {step} AS w FROM ({query})"
    return f"stems AS (SELECT lower, w AS stem FROM ({query}))"
