"""Language detection by function words, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import let

#: Frequent function words that tell the languages apart.
FUNCTION_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "von", "mit", "für", "den", "zu", "ein", "sich", "dem", "auf"),
    "en": ("the", "and", "of", "to", "is", "that", "for", "with", "was", "this", "are", "be", "from", "on", "by"),
    "es": ("el", "los", "las", "que", "y", "una", "por", "para", "con", "del", "se", "su", "al", "es", "como"),
    "fr": ("le", "les", "des", "et", "est", "une", "que", "pour", "dans", "du", "qui", "sur", "au", "pas", "avec"),
}


def scores(text: Column) -> Column:
    """map of language to the number of its function words in a text."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def count(w: Column, known: tuple[str, ...]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(*known)))

    return let(words, lambda w: F.struct(*[count(w, known).alias(lang) for lang, known in FUNCTION_WORDS.items()]))


def detect(text: Column) -> Column:
    """The language with most function words, null if there are none; ties go to the first by code."""

    def choose(s: Column) -> Column:
        best = F.greatest(*[s[k] for k in FUNCTION_WORDS])
        out = F.lit(None).cast("string")
        for lang in sorted(FUNCTION_WORDS, reverse=True):
            out = F.when(s[lang] == best, F.lit(lang)).otherwise(out)
        return F.when(best > 0, out)

    return let(scores(text), choose)


def asserted_or_detected(asserted: str | None, column: Column | None, text: Column) -> Column:
    """A caller's language wins over a column's, and both over detection, which then isn't run."""
    if asserted:
        return F.lit(asserted)
    return F.coalesce(column, detect(text)) if column is not None else detect(text)
