"""Words, tokens, filters and cleaning steps as Column expressions (no Python in the rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.lexicon import (
    CONTENT_RUN, FILLERS, NOT_WS, STOP_WORDS, VOWELS, WORD2, WS,
)


# words ---------------------------------------------------------------------------------------

def words(text: Column) -> Column:
    """Pieces between runs of white space, none of them empty."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_WS}+"), F.lit(0))


def has_min_words(text: Column, least: int) -> Column:
    """At least so many words; the search ends at the last word it needs, however long the text."""
    return text.rlike(f"^{WS}*+(?:{NOT_WS}++{WS}++){{{least - 1}}}{NOT_WS}")


def has_min_fields(text: Column, more_than: int = 3) -> Column:
    """More than so many pieces between single blanks, so double and trailing blanks count too."""
    return text.rlike(f"^(?:[^ ]*+ ){{{more_than}}}")


def truncate_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def edit_words(text: Column) -> Column:
    """Words for edit distance: runs of two or more blanks become one, then cut at blanks only."""
    squeezed = F.regexp_replace(text, f"{WS}{WS}+", " ")
    return F.filter(F.split(strip(squeezed), " ", -1), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD2), F.lit(0))


def detach_contractions(text: Column) -> Column:
    spaced = F.regexp_replace(text, r"'(s|m|d|ll|re|ve)([^\p{L}]|$)", " $2")
    return F.regexp_replace(spaced, r"n't([^\p{L}]|$)", " $1")


def alphabetic_tokens(text: Column) -> Column:
    runs = F.regexp_extract_all(detach_contractions(F.lower(text)), F.lit(CONTENT_RUN), F.lit(0))
    return F.filter(runs, lambda w: w.rlike(r"^\p{L}+$"))


def content_tokens(text: Column, stop_words=STOP_WORDS) -> Column:
    """Alphabetic lower-case tokens without stop words; repeats stay."""
    return F.filter(alphabetic_tokens(text), lambda w: ~w.isin(*stop_words))


def ngrams(items: Column, n: int) -> Column:
    """Array of n-grams, each one string of items joined by a blank.

    Built by shifting the array n - 1 times. (A lambda that slices ``items`` would work out an
    ``items`` that is an expression anew for every element.)
    """
    grams = items
    for shift in range(2, n + 1):
        after = F.slice(items, shift, F.greatest(F.size(items), F.lit(1)))
        grams = F.zip_with(grams, after, lambda g, w: F.concat(g, F.lit(" "), w))
    return F.filter(grams, lambda g: g.isNotNull()) if n > 1 else grams


# sentences -----------------------------------------------------------------------------------

MARK = "\u0001"


def sentences(text: Column) -> Column:
    """Cut after a full stop, exclamation or question mark that white space follows."""
    marked = F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1" + MARK)
    return F.split(marked, MARK, -1)


def mean_sentence_length(text: Column) -> Column:
    """Words per sentence. Cuts lie in white space, so the words of the text are those of its sentences."""
    filled = F.filter(sentences(text), lambda s: s.rlike(NOT_WS))
    return F.try_divide(F.size(words(text)).cast("double"), F.size(filled))


def mean_syllables(text: Column) -> Column:
    """Vowel groups per token."""
    found = tokens(text)
    groups = F.regexp_extract_all(F.array_join(found, " "), F.lit(VOWELS), F.lit(0))
    return F.try_divide(F.size(groups).cast("double"), F.size(found))


# cleaning ------------------------------------------------------------------------------------

# A blank run at the end, tried only where a run begins: a long run inside a text is passed over once.
TAIL = rf"(?<!{WS}){WS}++\z"


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, TAIL, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}++|{TAIL}", "")


def strip_markup(text: Column) -> Column:
    """Quotes out, right trim, bracketed parts, stars and line ends out, in this order."""
    bare = rstrip(F.translate(text, '"', ""))
    # The two bracket patterns; the second has the first one's inner class.
    no_round = F.regexp_replace(bare, r"\([^)]*\)", "")
    no_square = F.regexp_replace(no_round, r"\[[^)]*\]", "")
    return F.translate(no_square, "*\n", "")


def first_sentence(text: Column) -> Column:
    """Up to and with the blank after the first sentence mark; else the right-trimmed text."""
    return F.regexp_extract(text, rf"^((?s:.*?)(?:[.!?]{WS}|(?<!{WS})(?={WS}*+\z)))", 1)


def balance_quote(text: Column) -> Column:
    return F.when(text.startswith("'") & ~text.endswith("'"), F.concat(text, F.lit("'"))).otherwise(text)


def after_last_sep(text: Column, sep: str = "<sep>") -> Column:
    return F.split_part(text, F.lit(sep), F.lit(-1))


def drop_turn_marks(text: Column, mark: str = "[SEP]") -> Column:
    return F.replace(text, F.lit(mark), F.lit(""))


def knob_key(setting: Column) -> Column:
    """A JSON setting as a plain string key: the JSON text without its quotes."""
    return F.translate(setting, '"', "")


# deterministic rewriter ----------------------------------------------------------------------

def _stem(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, ",+$", ""))


def _join_stutter(word: Column) -> Column:
    """``I-I`` becomes ``I``: a hyphenated word whose parts are all the same."""
    parts = F.array_distinct(F.split(F.lower(word), "-", -1))
    stutter = word.contains("-") & (F.size(parts) == 1) & (F.element_at(parts, 1) != "")
    return F.when(stutter, F.split_part(word, F.lit("-"), F.lit(1))).otherwise(word)


def disfluency_rewrite(text: Column) -> Column:
    """Fillers out, stutters and immediate repeats collapsed (the last word of a run stays)."""
    joined = F.transform(words(text), _join_stutter)
    spoken = F.filter(joined, lambda w: ~F.regexp_replace(F.lower(w), "[.,!?]+$", "").isin(*FILLERS))

    def collapsed(spoken: Column) -> Column:
        paired = F.zip_with(
            spoken, F.slice(spoken, 2, F.greatest(F.size(spoken), F.lit(1))),
            lambda w, after: F.when(after.isNull() | (_stem(w) != _stem(after)), w))
        return F.array_join(F.filter(paired, lambda w: w.isNotNull()), " ")
    return F.transform(F.array(spoken), collapsed)[0]   # as a lambda's argument, the words are worked out once
