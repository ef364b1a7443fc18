"""Row-local n-gram expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from torquelog.functions import lexicons, text


def keyword_tokens(value: Column) -> Column:
    """Word tokens without keyword stop words: the tokens n-grams are formed from."""
    return text.each(
        "filter", text.words(value), f"t NOT IN {text.literals(lexicons.STOP_KEYWORDS)}"
    )


def ngrams(tokens: Column, n: int) -> Column:
    """n-grams joined by a space, in text order. ``tokens`` should be a plain column."""
    if n == 1:
        return tokens
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, 1, count)
    for offset in range(1, n):
        grams = F.zip_with(
            grams, F.slice(tokens, offset + 1, count), lambda a, b: F.concat_ws(" ", a, b)
        )
    return grams


def distinct_sorted(grams: Column) -> Column:
    """All different n-grams of the row, alphabetically, joined by a comma."""
    return F.array_join(F.sort_array(F.array_distinct(grams)), ", ")


def all_ngrams(tokens: Column, sizes: tuple[int, ...]) -> Column:
    """Array of (n, grams) structs, one per size, for ``inline``."""
    return F.array(
        *[F.struct(F.lit(n).alias("n"), ngrams(tokens, n).alias("grams")) for n in sizes]
    )


def matched_phrases(tokens: Column, phrases: list[str], scan: int = 200) -> Column:
    """Phrases that occur as whole tokens in the token array, sorted.

    A short phrase list is searched in the joined text; a long one is intersected with the n-grams,
    whose cost does not depend on the number of phrases.
    """
    ordered = sorted({p for p in phrases if p})  # an empty phrase is in no text
    if len(ordered) <= scan:
        wanted = F.split(F.lit("\n".join(ordered)), "\n")

        def search(padded: Column) -> Column:
            return F.filter(wanted, lambda p: F.contains(padded, F.concat(F.lit(" "), p, F.lit(" "))))

        return text.let(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), search)
    sizes = sorted({len(p.split(" ")) for p in ordered})
    grams = F.flatten(F.array(*[ngrams(tokens, n) for n in sizes]))
    wanted = F.split(F.lit("\n".join(ordered)), "\n")
    return F.sort_array(F.array_intersect(wanted, grams))
