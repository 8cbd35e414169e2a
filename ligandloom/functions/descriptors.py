"""Named numeric features of a structure text, missing as null."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def _hits(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern)).cast("double")


def text_descriptors(col: Column) -> dict[str, Column]:
    """Counts and ratios read off the text; ratios of nothing are missing."""
    length = F.length(col).cast("double")
    upper, lower, digit = (_hits(col, p) for p in ("[A-Z]", "[a-z]", "[0-9]"))
    letters = upper + lower
    words = F.regexp_extract_all(col, F.lit(r"\S+"), F.lit(0))
    n_words = F.size(words).cast("double")
    return {
        "n_chars": length,
        "n_upper": upper,
        "n_lower": lower,
        "n_digits": digit,
        "n_blanks": _hits(col, r"\s"),
        "n_bonds": _hits(col, "[=#]"),
        "n_branches": _hits(col, r"\("),
        "n_brackets": _hits(col, r"\["),
        "n_plus": _hits(col, r"\+"),
        "n_minus": _hits(col, "-"),
        "n_fragments": _hits(col, r"\.") + 1,
        "n_words": n_words,
        "n_distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "lower_share": F.try_divide(lower, letters),
        "digit_share": F.try_divide(digit, length),
        "word_length": F.try_divide(length, n_words),
    }


# ---- fixed values (classes of words, the first that fits counts) ----
WORD_CLASSES = {
    "number": r"^[0-9]+$",
    "lower": r"^[a-z]+$",
    "upper": r"^[A-Z]+$",
    "capital": r"^[A-Z][a-z]+$",
    "mixed": r"^[A-Za-z0-9]+$",
    "other": "",
}


def class_histogram(words: Column) -> Column:
    """map of word class -> how many of the words; each word is classed once, classes without a word are 0."""

    def of(word: Column) -> Column:
        found = F.lit("other")
        for name, pattern in reversed([*WORD_CLASSES.items()][:-1]):
            found = F.when(word.rlike(pattern), name).otherwise(found)
        return found

    def is_class(name: str) -> Callable[[Column], Column]:
        return lambda x: x == name

    def counts(classes: Column) -> Column:
        number = [(F.lit(c), F.size(F.filter(classes, is_class(c))).cast("double")) for c in WORD_CLASSES]
        return F.create_map(*[x for pair in number for x in pair])

    return F.get(F.transform(F.array(F.transform(words, of)), counts), F.lit(0))


def histogram_descriptors(histogram: str) -> dict[str, Column]:
    """Shares of the classes, their entropy in nats and the largest share; missing where there is no word."""
    counts = [F.element_at(histogram, c) for c in WORD_CLASSES]
    total = F.nullif(sum(counts[1:], counts[0]), F.lit(0.0))
    shares = [n / total for n in counts]
    parts = [F.when(s > 0, -s * F.log(s)).otherwise(F.when(total.isNotNull(), 0.0)) for s in shares]
    out = {f"{c}_words": n for c, n in zip(WORD_CLASSES, shares)}
    return {**out, "word_entropy": sum(parts[1:], parts[0]), "top_share": F.greatest(*shares)}


def with_descriptors(df: DataFrame, features: Mapping[str, Column]) -> DataFrame:
    return df.select("*", *[c.cast("double").alias(n) for n, c in features.items()])
