"""Songs by name: search, aliases, and whether a song is in the library already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.text import artist_base, in_parens, lower_trim, normalize_artist, normalize_title, ratio
from encore.operators.grams import contained, may_be_similar
from encore.staging import stage

#: Other names of artists, one way each as listed.
ALIASES = {
    "the black skirts": "검정치마", "검정치마": "the black skirts",
    "jannabi": "잔나비", "잔나비": "jannabi",
    "hyukoh": "혁오", "혁오": "hyukoh",
    "car, the garden": "카더가든", "카더가든": "car, the garden", "car the garden": "카더가든",
    "damons year": "데이먼스 이어", "데이먼스 이어": "damons year", "데이먼스 이어 damons year": "damons year",
    "band nah": "밴드나", "밴드나": "band nah",
    "nerd connection": "너드커넥션", "너드커넥션": "nerd connection",
    "the volunteers": "더 볼런티어스", "더 볼런티어스": "the volunteers",
    "daybreak": "데이브레이크", "데이브레이크": "daybreak",
    "standing egg": "스탠딩 에그", "스탠딩 에그": "standing egg",
    "nell": "넬", "넬": "nell",
    "busker busker": "버스커 버스커", "버스커 버스커": "busker busker",
    "o3ohn": "오존",
    "silica gel": "실리카겔", "실리카겔": "silica gel",
    "10cm": "10cm", "십센치": "10cm",
    "mc the max": "mc the max", "m.c the max": "mc the max",
    "park hyo shin": "박효신", "박효신": "park hyo shin",
    "iu": "아이유", "아이유": "iu",
}


#: channels' names of artists that no rule brings together.
CHANNELS = {
    "잔나비": "JANNABI - Topic", "검정치마": "The Black Skirts - Topic", "한로로 HANRORO": "HANRORO - Topic", "카더가든 (Car, the garden)": "Car, the Garden - Topic", "장범준": "Jang Beom June - Topic",
    "로이킴 Roy Kim": "Roy Kim - Topic", "쏜애플 / THORNAPPLE": "Thornapple - Topic", "노을Noel": "Noel - Topic", "웅키": "Ungki - Topic",
}


def search(catalogue: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Songs whose title or artist holds the query; an empty one gives the first 50 by title."""
    if not query.strip():
        return catalogue.orderBy("title", "song_id").limit(50)
    q = F.lit(query.strip().lower())
    return catalogue.filter(F.contains(F.lower("title"), q) | F.contains(F.lower("artist"), q)).orderBy("title", "song_id").limit(limit)


def resolve_seed(catalogue: DataFrame, title: str, artist: str) -> DataFrame:
    """The first song, by title, that holds the title and the artist's first four characters."""
    found = F.contains(F.lower("title"), F.lit(title.lower())) & F.contains(F.lower("artist"), F.lit(artist.lower()[:4]))
    return catalogue.filter(found).orderBy("title", "song_id").limit(1)


def artist_aliases(artist: Column, table: dict[str, str] | None = None) -> Column:
    """All names of an artist, over two steps of the alias table."""
    names = F.create_map(*(F.lit(x.lower()) for kv in (table or ALIASES).items() for x in kv))
    one = normalize_artist(artist)
    two = F.try_element_at(names, one)
    return F.array_distinct(F.array_compact(F.array(one, two, F.try_element_at(names, two))))


def library_index(songs: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """(alias, song_id, norm_title, parens, plays): a song under each name of its artist."""
    named = songs.filter(F.col("artist").isNotNull())
    return named.select(F.explode(artist_aliases(F.col("artist"), table)).alias("alias"), "song_id", normalize_title(F.col("title")).alias("norm_title"), F.transform(in_parens(F.col("title")), normalize_title).alias("parens"), "plays")


def matches(external: DataFrame, index: DataFrame, least: float | None = 0.85, key: str = "ext_id", table: dict[str, str] | None = None) -> DataFrame:
    """Keys of external tracks that the library has: some name of the artist is equal, and titles
    are equal, or one is a bracketed part of the other, or lies in one (over 3 characters), or they
    are similar enough (`least`; None leaves that test out).

    Every test is a join on what it asks for: equal titles and brackets on the name and the title,
    containment on runs of characters, similarity on rare pairs of characters (`grams`). Tests are
    made once for each name and text, however many tracks have it, and tracks look their texts up at
    the end. Texts that many rows share look small in files, so no side is left to be broadcast by
    that size. Only pairs that may be similar reach the Python function."""
    ext = stage(external.select(key, F.explode(artist_aliases(F.col("artist"), table)).alias("alias"), normalize_title(F.col("title")).alias("t"), F.transform(in_parens(F.col("title")), normalize_title).alias("p")), "tracks")
    index = stage(index.select("alias", "norm_title", "parens").distinct(), "library")
    titles = index.select("alias", F.col("norm_title").alias("x")).distinct()
    brackets = index.select("alias", F.explode("parens").alias("x")).distinct()
    own = ext.select(key, "alias", F.explode("p").alias("x"))
    mine, inner = ext.select("alias", F.col("t").alias("x")).distinct(), own.select("alias", "x").distinct()
    equal = lambda one, two: one.join(two.hint("merge"), ["alias", "x"], "left_semi")
    long = lambda df, c: df.filter(F.length("x") > 3).withColumnRenamed("x", c)
    within = lambda one, two: contained(long(one, "s"), long(two, "l"), ["alias"])
    holding = lambda one, two: [within(one, two).select("alias", F.col("s").alias("x")), within(two, one).select("alias", F.col("l").alias("x"))]
    by_title = [equal(mine, titles), equal(mine, brackets), *holding(mine, brackets)]
    by_bracket = [equal(inner, titles), *holding(inner, titles)]
    if least is not None:
        near = may_be_similar(mine, titles.withColumnRenamed("x", "y"), least, ["alias"])
        by_title.append(near.filter(ratio("x", "y") >= least).select("alias", "x"))
    hits = lambda parts: reduce(DataFrame.unionByName, parts).distinct()
    found = equal(ext.select(key, "alias", F.col("t").alias("x")), hits(by_title)).select(key)
    return found.unionByName(equal(own, hits(by_bracket)).select(key)).distinct()


def not_in_library(external: DataFrame, index: DataFrame, least: float | None = 0.85, key: str = "ext_id", table: dict[str, str] | None = None) -> DataFrame:
    return external.join(matches(external, index, least, key, table).hint("merge"), key, "left_anti")


def known_songs(index: DataFrame, least: int = 5) -> DataFrame:
    """Songs of `least` plays by alias: entries, and distinct songs."""
    return index.filter(F.col("plays") >= least).groupBy("alias").agg(F.count("*").alias("entries"), F.count_distinct("song_id").alias("songs"))


def merge_artists(plays: DataFrame, manual: dict[str, str] | None = None) -> DataFrame:
    """`plays` with `artist_key`: names that are equal without a channel's ending, in lower case,
    take the most played spelling. `manual` (CHANNELS if None) maps spellings before."""
    name = F.col("artist")
    manual = CHANNELS if manual is None else manual
    if manual:
        name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in manual.items() for x in kv)), name), name)
    rows = plays.withColumn("__name", name).withColumn("__base", artist_base(name))
    counts = rows.filter("__base is not null").groupBy("__base", "__name").agg(F.count("*").alias("n"))
    best = counts.groupBy("__base").agg(F.min_by("__name", F.struct(-F.col("n"), "__name")).alias("artist_key"))
    return rows.join(best, "__base", "left").drop("__base", "__name")


def reverse_aliases(aliases: DataFrame) -> DataFrame:
    """(alias, song_id) from (song_id, aliases, ord): the last writer of an alias has it."""
    rows = aliases.select("song_id", "ord", F.explode("aliases").alias("alias")).select("song_id", "ord", lower_trim(F.col("alias")).alias("alias"))
    return rows.groupBy("alias").agg(F.max_by("song_id", F.struct("ord", "song_id")).alias("song_id"))


def labels_by_name(songs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """`songs` (title, artist) with the `label` of their normalised names; a label of `second` goes
    before one of `first`. Names are trimmed and in lower case; of several rows of one name in a file
    the last by `place` counts."""
    keys = {"__t": lower_trim(F.col("title")), "__a": lower_trim(F.col("artist"))}
    rows = first.withColumns(keys).select("__t", "__a", "label", F.lit(0).alias("file"), "place")
    rows = rows.unionByName(second.withColumns(keys).select("__t", "__a", "label", F.lit(1).alias("file"), "place")).filter("label is not null")
    best = rows.groupBy("__t", "__a").agg(F.max_by("label", F.struct("file", "place")).alias("label"))
    return songs.withColumns(keys).join(best, ["__t", "__a"], "left").drop("__t", "__a")
