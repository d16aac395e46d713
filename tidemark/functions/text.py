"""Tokenisers of the text signals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that carry no topic.
STOPWORDS = (
    "a about after all also an and any are as at be because been before being between both but by can could did do does for from further had has have how if in into is it its may more most no nor not "
    "of on one only or other our out over same should so some such than that the their them then there these they this those through to under up use used using very was we were what when where which "
    "while who will with would"
).split()


def is_stopword(word: Column) -> Column:
    return word.isin(*STOPWORDS)  # a hash set, whose look-up doesn't grow with the list


def terms(text: Column, phrases: tuple[str, ...] = (), formulas: tuple[str, ...] = ()) -> Column:
    """Lower-case terms of letters, digits, _ and - (of any script) of more than two characters without function words.

    phrases count as one term each, joined by _. formulas are patterns (of lower-case text) of chemical or mathematical terms: what
    they match is a term as it stands, whatever its characters.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    for p in phrases:
        t = F.replace(t, F.lit(p), F.lit(p.replace(" ", "_")))
    pattern = "(" + "|".join([*(f"(?:{f})" for f in formulas), r"[\p{L}\p{N}_\-]+"]) + ")"
    found = F.regexp_extract_all(t, F.lit(pattern), 1)
    return F.filter(found, lambda w: (F.length(w) > 2) & ~is_stopword(w))


def title_words(text: Column) -> Column:
    """The set of lower-case words of three or more of a-z, 0-9 and - that begin with a letter, without function words; words with other letters don't count."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+(?:-+[\p{L}\p{N}_]+)*)"), 1)
    return F.array_distinct(F.filter(found, lambda w: w.rlike(r"^[a-z][a-z0-9\-]{2,}$") & ~is_stopword(w)))


def spaced_words(text: Column) -> Column:
    """White-space separated words of more than two characters without function words, joined by spaces again."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: (F.length(w) > 2) & ~is_stopword(F.lower(w)))
    return F.array_join(words, " ")


def is_junk(term: Column, junk: tuple[str, ...] = ("et", "al", "fig", "ref", "vol"), fine: tuple[str, ...] = ("p53", "cas9")) -> Column:
    """Numbers, listed junk, and mixtures of letters and digits that are not listed as fine."""
    mixed = term.rlike("[a-z]") & term.rlike("[0-9]") & ~term.isin(*fine)
    return term.rlike("^[0-9]+$") | term.isin(*junk) | mixed


def normal_doi(doi: Column) -> Column:
    """A DOI in lower case without its resolver."""
    return F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(dx\.)?doi\.org/", "")
