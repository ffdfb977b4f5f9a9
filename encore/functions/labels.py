"""Case distinctions that name a state, a zone or a kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genre families; the first with a part in the lower-cased genre counts. The first
#: family takes whole names only.
GENRE_FAMILIES = [
    ("k-pop", ["k-pop", "kpop"]),
    ("indie", ["indie rock", "indie", "alternative"]),
    ("rock", ["rock", "punk", "metal"]),
    ("ballad", ["ballad", "adult contemporary"]),
    ("rnb", ["r&b", "soul", "r&b/soul"]),
    ("pop", ["pop"]),
    ("hiphop", ["hip-hop", "rap", "hip hop"]),
    ("electronic", ["electronic", "edm", "house", "techno"]),
    ("singer-songwriter", ["singer/songwriter", "folk"]),
]
#: Groups of close genres; other genres are groups of their own, in lower case.
GENRE_GROUPS = {
    "K-Pop": "korean_pop", "Korean Pop": "korean_pop", "K-Hip-Hop": "korean_hiphop", "Korean Hip-Hop": "korean_hiphop", "Pop": "pop", "J-Pop": "jpop", "Rock": "rock",
    "Alternative": "rock", "Indie Rock": "rock", "Korean Indie": "korean_indie", "R&B/Soul": "rnb", "R&B": "rnb", "Soul": "rnb", "Hip-Hop/Rap": "hiphop", "Hip-Hop": "hiphop",
    "Electronic": "electronic", "Dance": "electronic", "Singer/Songwriter": "singer_songwriter", "Ballad": "ballad", "Korean Ballad": "ballad", "Metal": "metal", "Hard Rock": "metal",
    "Classical": "classical", "Jazz": "jazz", "Blues": "blues", "Country": "country", "Soundtrack": "soundtrack", "Anime": "anime",
}


def state_label(cur: Column, fut: Column) -> Column:
    """What becomes of a song from one window to the next."""
    return F.when(cur == 0, F.when(fut == 0, "dead/dormant").otherwise("revived")).when(fut > cur * 1.5, "heating").when(fut < cur * 0.5, "cooling").otherwise("stable")


def zone_label(first: Column, second: Column, skip_rate: Column, plays: Column) -> Column:
    """How a song's skips developed from its first half of plays to its second."""
    return (
        F.when((plays < 3) | first.isNull(), "N/A").when((first <= 0.33) & (skip_rate <= 0.3), "liked at once")
        .when(first > second + 0.10, "grew on me").when(second > first + 0.10, "wore off").otherwise("so so")
    )


def time_of_day(hour: Column) -> Column:
    return F.when(hour < 6, "Night").when(hour < 12, "Morning").when(hour < 18, "Afternoon").otherwise("Evening")


def genre_family(genre: Column) -> Column:
    """The first family with a part in the genre; null and empty stay null."""
    low = F.lower(genre)
    out = F.when(genre.isNull() | (genre == ""), None)
    for k, (family, parts) in enumerate(GENRE_FAMILIES):
        for part in parts:
            out = out.when(low == part if k == 0 else F.contains(low, F.lit(part)), family)
    return out.otherwise("other")


def genre_group(genre: Column) -> Column:
    groups = F.create_map(*(F.lit(x) for kv in GENRE_GROUPS.items() for x in kv))
    return F.coalesce(F.try_element_at(groups, genre), F.lower(genre))


def severity(ratio: Column, slope: Column) -> Column:
    """How badly a weekly series falls off; null if it does not."""
    return F.when((ratio <= 0.3) & (slope < -0.3), "critical").when((ratio <= 0.4) & (slope < -0.2), "severe").when((ratio <= 0.5) & (slope < -0.1), "mild")


def familiarity_tier(known: Column) -> Column:
    """By how many songs of the artist are known; 30 and more is no discovery."""
    return F.when(known >= 30, None).when(known >= 11, "deep_dive").when(known >= 3, "expand").otherwise("explore")


def playlist_tag(is_new: Column, level28: Column, dsl: Column) -> Column:
    return F.when(is_new, "new").when(level28 >= 3, "now").when(dsl >= 30, "dormant").otherwise("")


def icon(affinity: Column, momentum: Column) -> Column:
    return F.when(momentum > 0.8, "fire").when(affinity > 0.8, "heart").when(momentum < 0.2, "snow").otherwise("note")
