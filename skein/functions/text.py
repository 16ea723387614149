"""Text to tokens: preprocessing, tokenizing, stop words.

A token is a run of Unicode letters and digits. (A Treebank tokenizer would also keep some punctuation as tokens and
split contractions; hyphenated words are two tokens here.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN, BETWEEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"

#: Symbols that are no terms even where a tokenizer yields them.
SYMBOLS = ["!", "@", "#", "?", ",", ".", "(", ")", "/", "<", ">", "_", "-"]

#: English function words, without apostrophes as preprocessing leaves them.
STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here there when where why how all any
both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()


def doc_preprocess(text: Column) -> Column:
    """Lower case, without apostrophes."""
    return F.lower(F.replace(text, F.lit("'"), F.lit("")))


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(doc_preprocess(text), F.lit(TOKEN), 0)


def spaced_tokens(text: Column) -> Column:
    """The tokens of raw_tokens() as one text, with single spaces between them, and maybe around."""
    return F.regexp_replace(doc_preprocess(text), BETWEEN, " ")


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS, *SYMBOLS))


def tokens(text: Column, remove_stopwords: bool = True) -> Column:
    """Tokens in order, repeats kept, unstemmed."""
    return without_stopwords(raw_tokens(text)) if remove_stopwords else raw_tokens(text)


def whitespace_words(text: Column) -> Column:
    """Words between runs of white space, as they are; an empty text has none."""
    return F.array_remove(F.split(text, r"\s+"), "")
