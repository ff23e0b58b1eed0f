"""Suffix stripping for English words as Column expressions (the published Porter algorithm).

Departures are taken from the common toolkit version, since tags stemmed with it show them: ``y`` becomes
``i`` only after a consonant that is not the whole stem (``play``, ``sunday`` stay), a stem of vowel and
consonant counts as short (``use`` stays), four-letter words in ``ies`` and ``ied`` keep their ``ie``
(``dies``, ``tied``), and a few words have stems of their own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word shapes. A consonant run, a vowel run, and stems by their number of
# vowel-consonant changes.
CONSONANTS = "[^aeiou][^aeiouy]*"
VOWELS = "[aeiouy][aeiou]*"
MEASURE_ABOVE_0 = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}"
MEASURE_ABOVE_1 = f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
HAS_VOWEL = f"^({CONSONANTS})?[aeiouy]"
SHORT = f"^({CONSONANTS}[aeiouy][^aeiouwxy]|[aeiou][^aeiouy])$"
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
Y_AFTER_CONSONANT = "^.+[^aeiouy]y$"

# Suffixes and what replaces them, by step; a longer suffix goes before its own ending.
PLURALS = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("alli", "al"), ("ator", "ate"), ("logi", "log"), ("bli", "ble"), ("eli", "e"),
]
STEP_3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP_4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "sion", "tion", "ism", "ate", "iti",
    "ous", "ive", "ize", "al", "er", "ic", "ou",
]

# Words with stems of their own.
IRREGULAR = {
    "sky": ["sky", "skies"], "die": ["dying"], "lie": ["lying"], "tie": ["tying"], "news": ["news"],
    "inning": ["inning", "innings"], "outing": ["outing", "outings"], "canning": ["canning", "cannings"],
    "howe": ["howe"], "proceed": ["proceed"], "exceed": ["exceed"], "succeed": ["succeed"],
}

# Words that no step changes, by how they end: as no suffix and no word above, nor as what other steps look at.
_ENDINGS = {s for s, _ in [*PLURALS, *STEP_2, *STEP_3]} | {*STEP_4, "ed", "ing", "y", "e", "ll"}
_ENDINGS |= {form for forms in IRREGULAR.values() for form in forms}
_SHORTEST = sorted(e for e in _ENDINGS if not any(e.endswith(other) for other in _ENDINGS - {e}))
UNCHANGED = "^[^ ]++$" + "".join(f"(?<!{e})" for e in _SHORTEST)


def _without(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _plural(w: Column) -> Column:
    rule = F.when(F.length(w) <= 2, w).when((F.length(w) == 4) & F.endswith(w, F.lit("ies")), _without(w, 1))
    for suffix, new in PLURALS:
        rule = rule.when(F.endswith(w, F.lit(suffix)), F.concat(_without(w, len(suffix)), F.lit(new)))
    return rule.otherwise(w)


def _tidy(s: Column) -> Column:
    """Repair a stem that has just lost ``ed`` or ``ing``."""
    return (
        F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e")))
        .when(s.rlike(DOUBLED), _without(s, 1))
        .when(s.rlike(SHORT), F.concat(s, F.lit("e")))
        .otherwise(s)
    )


def _past(w: Column) -> Column:
    """Marks a word that lost ``ed`` or ``ing`` with a trailing blank, for the repair that follows."""
    blank = F.lit(" ")
    return (
        F.when(F.length(w) <= 2, w)
        .when(F.endswith(w, F.lit("eed")), F.when(_without(w, 3).rlike(MEASURE_ABOVE_0), _without(w, 1)).otherwise(w))
        .when((F.length(w) == 4) & F.endswith(w, F.lit("ied")), _without(w, 1))
        .when(
            F.endswith(w, F.lit("ed")),
            F.when(_without(w, 2).rlike(HAS_VOWEL), F.concat(_without(w, 2), blank)).otherwise(w),
        )
        .when(
            F.endswith(w, F.lit("ing")),
            F.when(_without(w, 3).rlike(HAS_VOWEL), F.concat(_without(w, 3), blank)).otherwise(w),
        )
        .otherwise(w)
    )


def _repair(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit(" ")), _tidy(_without(w, 1))).otherwise(w)


def _final_y(w: Column) -> Column:
    turns = (F.length(w) > 2) & F.endswith(w, F.lit("y")) & w.rlike(Y_AFTER_CONSONANT)
    return F.when(turns, F.concat(_without(w, 1), F.lit("i"))).otherwise(w)


def _left_alone(w: Column, suffixes: list[str]) -> Column:
    """Short words, and by one look-up of the last two letters most of those that end in none of the suffixes."""
    return (F.length(w) <= 2) | ~F.substring(w, -2, 2).isin(sorted({s[-2:] for s in suffixes}))


def _replace(rules: list[tuple[str, str]]):
    def step(w: Column) -> Column:
        rule = F.when(_left_alone(w, [suffix for suffix, _ in rules]), w)
        for suffix, new in rules:
            stem = _without(w, len(suffix))
            shorter = F.when(stem.rlike(MEASURE_ABOVE_0), F.concat(stem, F.lit(new))).otherwise(w)
            rule = rule.when(F.endswith(w, F.lit(suffix)), shorter)
        return rule.otherwise(w)

    return step


def _drop(w: Column) -> Column:
    rule = F.when(_left_alone(w, STEP_4), w)
    for suffix in STEP_4:
        # the s or t before "ion" belongs to the stem
        stem = _without(w, 3 if suffix in ("sion", "tion") else len(suffix))
        rule = rule.when(F.endswith(w, F.lit(suffix)), F.when(stem.rlike(MEASURE_ABOVE_1), stem).otherwise(w))
    return rule.otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _without(w, 1)
    loses = stem.rlike(MEASURE_ABOVE_1) | (stem.rlike(MEASURE_ABOVE_0) & ~stem.rlike(SHORT))
    return F.when((F.length(w) > 2) & F.endswith(w, F.lit("e")) & loses, stem).otherwise(w)


def _final_l(w: Column) -> Column:
    double = F.endswith(w, F.lit("ll")) & _without(w, 1).rlike(MEASURE_ABOVE_1)
    return F.when(double, _without(w, 1)).otherwise(w)


STEPS = [_plural, _past, _repair, _final_y, _replace(STEP_2), _replace(STEP_3), _drop, _final_e, _final_l]


def _own_stem(word: Column, stem: Column) -> Column:
    own_stem = stem
    for own, forms in IRREGULAR.items():
        own_stem = F.when(word.isin(forms), F.lit(own)).otherwise(own_stem)
    # one look-up for the many words that have none
    return F.when(word.isin([form for forms in IRREGULAR.values() for form in forms]), own_stem).otherwise(stem)


def stem_words(words: Column) -> Column:
    """Stem every word of an array; each step sees the finished result of the one before."""
    stems = words
    for step in STEPS:
        stems = F.transform(stems, step)
    return F.zip_with(words, stems, _own_stem)
