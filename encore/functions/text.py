"""Normal forms of titles, artists and lyrics; tokens; string similarity."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

HANGUL = "[가-힣]"
#: Characters without width that titles carry along.
INVISIBLE = "[​‌‍⁠﻿­]"

#: What artists' names carry along.
UNSEEN = r"[\x{200B}-\x{200F}\x{2028}-\x{202F}\x{FEFF}]"


def squeeze(s: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(F.trim(s)), r"\s+", " ")


def lower_trim(s: Column) -> Column:
    return F.lower(F.trim(s))


def strip_topic(artist: Column) -> Column:
    """A channel's artist; unknown artists are empty."""
    return F.replace(F.coalesce(artist, F.lit("")), F.lit(" - Topic"), F.lit(""))


def normalize_title(s: Column) -> Column:
    """Without brackets, guests and punctuation. `feat` cuts wherever it stands, also inside words."""
    s = F.lower(F.regexp_replace(s, INVISIBLE, ""))
    s = F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")
    s = F.regexp_replace(s, r"feat.*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def in_parens(s: Column) -> Column:
    """What stands in parentheses, in order."""
    return F.regexp_extract_all(s, F.lit(r"\(([^)]+)\)"), F.lit(1))


def normalize_artist(s: Column) -> Column:
    """An artist as the library's matcher knows it: without invisible characters and a channel's ending."""
    return F.lower(F.trim(F.replace(F.regexp_replace(s, UNSEEN, ""), F.lit(" - Topic"), F.lit(""))))


def artist_base(s: Column) -> Column:
    """What spellings of one channel have in common: without the endings of its kinds."""
    return F.lower(F.trim(F.regexp_replace(F.replace(s, F.lit(" - Topic"), F.lit("")), r"(?i)vevo$", "")))


def lyrics_title(s: Column) -> Column:
    """A title as a search for lyrics takes it: without brackets, round or square."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s*\([^)]*\)", ""), r"\s*\[[^\]]*\]", ""))


def lyrics_artist(s: Column) -> Column:
    return F.trim(F.replace(F.replace(s, F.lit(" - Topic"), F.lit("")), F.lit("VEVO"), F.lit("")))


def display(title: Column, artist: Column) -> Column:
    """`title — artist`, the artist without a channel's ending."""
    return F.concat(title, F.lit(" — "), F.regexp_replace(artist, r" - Topic$", ""))


def has_hangul(s: Column) -> Column:
    return s.rlike(HANGUL)


def clean_lyrics(s: Column, least: int = 50) -> Column:
    """Lyrics without the site's header and footer; null if no more than `least` characters."""
    body = F.trim(F.regexp_replace(F.regexp_replace(s, r"(?s)^\d+\s*Contributors.*?Lyrics\s*", ""), r"\d*Embed$", ""))
    return F.when(F.length(body) > least, body)


def head(s: Column, most: int = 2000) -> Column:
    """The first characters, as many as the text model of lyrics takes."""
    return F.substring(s, 1, most)


def quoted(s: Column) -> Column:
    """Percent-encoded for a URL; a slash stays."""
    for code, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        s = F.replace(F.url_encode(s) if code == "+" else s, F.lit(code), F.lit(plain))
    return s


def year_of(s: Column) -> Column:
    """The year a date in text form starts with; null if it starts with none."""
    return F.substring(s, 1, 4).try_cast("int")


def before_dash(s: Column) -> Column:
    return F.substring_index(s, " - ", 1)


def tokens(s: Column, least: int = 1) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(s), F.lit(rf"([\p{{L}}\p{{N}}_]{{{least},}})"), F.lit(1))


def display_title(kr: Column, en: Column, artist: Column) -> Column:
    return F.concat(F.when(kr.isNotNull() & en.isNotNull(), F.concat(kr, F.lit(" ("), en, F.lit(")"))).otherwise(F.coalesce(kr, en)), F.lit(" — "), artist)


@F.pandas_udf(DoubleType())
def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity. No built-in expression; filter pairs before (`may_reach`)."""
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone allow a ratio of `least`: an exact test that costs nothing."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


def same_artist(a: Column, b: Column, least: float = 0.5) -> Column:
    """Equal, one within the other, a shared word, or similar enough."""
    a, b = normalize_artist(a), normalize_artist(b)
    exact = (a == b) | F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(F.split(a, " "), F.split(b, " "))
    return F.when(exact, True).when(may_reach(a, b, least), ratio(a, b) >= least).otherwise(False)
