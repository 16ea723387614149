"""Porter's stemmer (1980) as one table of rules, read by Spark expressions, by SQL and by Python alike.

Every rule is (suffix, condition on the stem, replacement). Conditions are patterns without look-around, so that all
three regular-expression engines take them. Words of one or two letters, and words with other than a-z, are left as
they are. A step is a CASE: the first suffix found decides, whether or not its condition holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Measure over 0, measure over 1, measure 1, a vowel in the stem, and consonant-vowel-consonant.
M0, M1, EQ1, VOWEL = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?[aeiouy]"
CVC = f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(" + "|".join(2 * c for c in "bcdfghjkmnpqrtvwx") + ")$"

# Fixed values of the published algorithm.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _steps() -> list[list[tuple[str, str | None, str, str]]]:
    """Steps of (if the word matches, and the word also matches, then replace this pattern, by this)."""
    held = lambda cond, suffix: f"{cond}.*{suffix}$"
    by_length = lambda t: sorted(t, key=len, reverse=True)
    return [
        [("^y", None, "^y", "Y")],
        [("sses$", None, "es$", ""), (".ies$", None, "es$", ""), ("ss$", "^$", "$", ""), ("[^s]s$", "..s$", "s$", "")],
        # -ed and -ing leave a mark where they are cut, which the next step reads and takes away.
        [(".eed$", held(M0, "eed"), "d$", ""), (".ed$", held(VOWEL, "ed"), "ed$", "|"), (".ing$", held(VOWEL, "ing"), "ing$", "|")],
        [(r"(at|bl|iz)\|$", None, r"\|$", "e"), (DOUBLE.replace("$", r"\|$"), None, r".\|$", ""), (CVC.replace("$", r"\|$"), None, r"\|$", "e"), (r"\|$", None, r"\|$", "")],
        [(".y$", held(VOWEL, "y"), "y$", "i")],
        [(f"{s}$", held(M0, s), f"{s}$", STEP2[s]) for s in by_length(STEP2)],
        [(f"{s}$", held(M0, s), f"{s}$", STEP3[s]) for s in by_length(STEP3)],
        [(f"{s}$", held(M1, s), f"{s}$", "") for s in by_length(STEP4)[:4]] + [("[st]ion$", f"{M1}.*ion$", "ion$", ""), ("ion$", "^$", "$", "")] + [(f"{s}$", held(M1, s), f"{s}$", "") for s in by_length(STEP4)[4:]],
        [("e$", held(M1, "e"), "e$", "")],  # or a stem of measure 1 that doesn't end in consonant-vowel-consonant; see FINAL_E
        [("ll$", held(M1, "l"), "l$", "")],
        [("^Y", None, "^Y", "y")],
    ]


STEPS = _steps()
#: The step of the final e, whose second condition is that one pattern holds and another doesn't.
FINAL_E, E_ONE, E_CVC = 8, EQ1.replace("$", "e$"), CVC.replace("$", "e$")
WORDS = "^[a-z]{3,}$"


def _tail(seen: str) -> str:
    """The letters that a word ends in wherever the pattern is found."""
    return re.search(r"([A-Za-z|]*)\$$|$", seen.replace("\\|", "|")).group(1) or ""


#: The steps as Python runs them: all tails, then of each rule its tail and its patterns, compiled.
_COMPILED = [
    (tuple({_tail(seen) for seen, *_ in step}), [(_tail(seen), re.compile(seen).search, cond and re.compile(cond).search, re.compile(cut).sub, put) for seen, cond, cut, put in step])
    for step in STEPS
]
_IS_WORD, _IS_E_ONE, _IS_E_CVC = (re.compile(p).search for p in (WORDS, E_ONE, E_CVC))


def stem_word(word: str) -> str:
    """The stem of one word, in Python: for texts, for query terms and as a check."""
    if not _IS_WORD(word):
        return word
    for n, (tails, rules) in enumerate(_COMPILED):
        if not word.endswith(tails):
            continue
        if n == FINAL_E:
            if rules[0][2](word) or (_IS_E_ONE(word) and not _IS_E_CVC(word)):
                word = word[:-1]
            continue
        for tail, seen, cond, cut, put in rules:
            if word.endswith(tail) and seen(word):
                if cond is None or cond(word):
                    word = cut(put, word)
                break
    return word


def _case(word: Column, n: int) -> Column:
    step = STEPS[n]
    if n == FINAL_E:
        return F.when(word.endswith("e") & (word.rlike(step[0][1]) | (word.rlike(E_ONE) & ~word.rlike(E_CVC))), F.regexp_replace(word, "e$", "")).otherwise(word)
    out = None
    for seen, cond, cut, put in step:
        done = F.regexp_replace(word, cut, put)
        value = done if cond is None else F.when(word.rlike(cond), done).otherwise(word)
        test = word.rlike(seen)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(word)


def _step(n: int):
    return lambda word: _case(word, n)


def stem(word: Column) -> Column:
    """The stem, as one expression: each step is a lambda over an array of one word, so no step's text is repeated in the next."""
    steps = F.array(word)
    for n in range(len(STEPS)):
        steps = F.transform(steps, _step(n))
    return F.when(word.rlike(WORDS), F.element_at(steps, 1)).otherwise(word)


def with_stem(words: DataFrame, column: str = "word", to: str = "term") -> DataFrame:
    return words.withColumn(to, stem(F.col(column)))


def stem_sql(source: str, column: str = "word", to: str = "term") -> str:
    """A sub-select of DuckDB SQL that adds the stem to `source`."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    has = lambda p: f"regexp_matches({to}, {q(p)})"
    sql = f"(SELECT *, {column} AS {to} FROM {source})"
    for n, step in enumerate(STEPS):
        if n == FINAL_E:
            case = f"CASE WHEN {has('e$')} AND ({has(step[0][1])} OR ({has(E_ONE)} AND NOT {has(E_CVC)})) THEN regexp_replace({to}, 'e$', '')"
        else:
            whens = []
            for seen, cond, cut, put in step:
                done = f"regexp_replace({to}, {q(cut)}, {q(put)})"
                whens.append(f"WHEN {has(seen)} THEN " + (done if cond is None else f"CASE WHEN {has(cond)} THEN {done} ELSE {to} END"))
            case = "CASE " + " ".join(whens)
        sql = f"(SELECT * REPLACE ({case} ELSE {to} END AS {to}) FROM {sql})"
    return f"(SELECT * REPLACE (CASE WHEN regexp_matches({column}, {q(WORDS)}) THEN {to} ELSE {column} END AS {to}) FROM {sql})"
