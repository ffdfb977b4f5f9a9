"""Korean and English names of songs: how they are found, kept by name, and searched.

An alias row is (song_id, ord, title_en, title_kr, artist, aliases): the title as the log has it, the
Korean one if any is known, and all other names. `ord` is the order of the catalogue, which decides
where two songs have one name (the last one has it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.text import has_hangul, lower_trim
from encore.operators.grams import contained
from encore.staging import stage

#: Korean titles of songs whose English title does not tell them, by artist.
TITLES = {
    "the black skirts": {"Holiday": "빨간 나를", "Antifreeze": "부동액", "My Little Lambs": "어린양", "My shadow": "그늘은 그림자로"},
    "jannabi": {
        "for lovers who hesitate": "주저하는 연인들을 위해", "Summer": "뜨거운 여름밤은 가고 남은 건 볼품없지만", "A thought on an autumn night": "가을밤에 든 생각",
        "dreams, books, power and walls": "꿈과 책과 힘과 벽", "Good Luck to You": "행운을 빌어요", "Tell me": "꿈나라 별나라", "Baby I need you": "사랑하긴 했었나요",
        "See Your Eyes": "너의 눈을 봐", "November Rain": "11월의 비", "Step": "한걸음", "Good Good Night": "나의 기쁨 나의 노래", "Sweet memories": "그 밤 그 밤", "Blue spring": "작전명 청-춘!",
        "bad dreams": "나쁜 꿈", "The Land of Fantasy": "환상의 나라", "land of night": "새 어둠 새 눈", "The King of Romance": "로맨스의 왕", "Confession Show": "고백극장",
        "Come Back Home": "컴백홈", "mirror": "거울", "about a boy": "우리 애는요", "LEGEND": "전설", "TOGETHER!": "투게더!", "pony": "포니",
        "Like when we first met": "처음 만났을 때처럼", "LADYBIRD": "레이디버드", "Beautiful": "너 같아", "Goodbye Dreamin' Old Stars": "굿바이 환상의 나라", "Pole Dance": "봉춤을 추네",
        "Winter is Coming": "누구나 겨울이 오면", "Clay Pigeon Boy": "소년 클레이 피전", "Sunshine comedy club": "선샤인코메디클럽", "Good Boy Twist": "굿보이 트위스트", "Old dog": "늙은 개",
        "Time": "누구를 위한 노래였던가", "waltz": "왕눈이 왈츠", "ASTEARSGOBY": "슬픔이여안녕",
    },
    "hanroro": {"To. __": "나에게", "Light or Rain": "빛 혹은 비", "H O M E": "홈"},
    "car, the garden": {"Romantic Sunday": "로맨틱 선데이", "Dreamed a dream": "꿈을 꿨어", "TEAM 401": "팀 401"},
    "day6": {"Shoot Me": "슛미", "Congratulations": "콩그레츄레이션스", "You Were Beautiful": "예뻤어", "I Loved You": "아이 러브드 유"},
    "hyukoh": {"TOMBOY": "톰보이", "Leather Jacket": "가죽자켓"},
    "nerd connection": {"Silently Completely Eternally": "조용히 완전히 영원히"},
}
#: English names of artists asked for in Korean.
ARTISTS = {
    "검정치마": "the black skirts", "잔나비": "jannabi", "한로로": "hanroro", "카더가든": "car, the garden", "혁오": "hyukoh", "널": "nell", "버즈": "buzz", "데이식스": "day6",
    "아이유": "iu", "방탄소년단": "bts", "엑소": "exo", "샤이니": "shinee", "에스파": "aespa", "엠씨더맥스": "m.c the max", "먼데이키즈": "monday kiz", "다비치": "davichi",
    "쏜애플": "thornapple", "볼빨간사춘기": "bol4", "장범준": "jang beom june",
}
_BRACKETS = r"\s*\([^)]*\)"


def build_aliases(songs: DataFrame, meta: DataFrame | None = None, titles: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Alias rows of `songs` (song_id, title, artist, optional ord; one row a song).

    Other names come from brackets that hold Hangul (with them what stands outside), from the title
    `meta` (song_id, found_title, place; the last place counts) has, and from `titles` by artist. The
    Korean title is the last Hangul bracket, else the title if it holds Hangul, else meta's if it
    does; an entry of `titles` goes before all. A null title or artist is empty."""
    rows = songs if "ord" in songs.columns else songs.withColumn("ord", F.col("song_id"))
    title = F.coalesce("title", F.lit(""))
    artist = F.trim(F.replace(F.coalesce(F.col("artist").cast("string"), F.lit("")), F.lit(" - Topic"), F.lit("")))
    rows = rows.select("song_id", "ord", title.alias("title_en"), artist.alias("artist"))
    if meta is None:
        rows = rows.withColumn("found", F.lit(None).cast("string"))
    else:
        rows = rows.join(meta.filter("found_title is not null").groupBy("song_id").agg(F.max_by("found_title", "place").alias("found")), "song_id", "left")
    t, found = F.col("title_en"), F.col("found")
    outside = F.trim(F.regexp_replace(t, _BRACKETS, ""))
    inside = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\(([^)]+)\)"), F.lit(1)), F.trim), has_hangul)
    known = {f"{a}|{k}": v for a, own in (TITLES if titles is None else titles).items() for k, v in own.items()}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else F.lit(None).cast("map<string,string>")
    of = lambda name: F.try_element_at(table, F.concat(F.lower("artist"), F.lit("|"), name))
    rows = rows.withColumns({"__in": inside, "__out": outside, "__known": F.coalesce(of(t), of(outside))})
    other = F.when((found != t) & (found != ""), found)
    korean = F.coalesce("__known", F.try_element_at("__in", F.lit(-1)), F.when(has_hangul(t), t), F.when(has_hangul(other), other))
    beside = F.when((F.size("__in") > 0) & (F.col("__out") != "") & (F.col("__out") != t), F.col("__out"))
    names = F.array_sort(F.array_distinct(F.array_compact(F.concat("__in", F.array(beside, other, F.col("__known"))))))
    return rows.select("song_id", "ord", "title_en", korean.alias("title_kr"), "artist", names.alias("aliases"))


def names_of(aliases: DataFrame) -> DataFrame:
    """(name, song_id): every name in lower case without outer white space; of the songs of one name
    the last in order has it."""
    names = F.array_distinct(F.array_compact(F.concat("aliases", F.array("title_en", "title_kr"))))
    rows = aliases.select("song_id", "ord", F.explode(F.transform(names, lower_trim)).alias("name")).filter("name != ''")
    return rows.groupBy("name").agg(F.max_by("song_id", F.struct("ord", "song_id")).alias("song_id"))


def _artist_fits(artist: Column, asked: str) -> Column:
    """Whether the asked artist, or its English name, lies in the song's artist or the other way."""
    a, own, english = F.lower(artist), F.lit(asked), F.lit(ARTISTS.get(asked, asked))
    return F.contains(a, english) | F.contains(english, a) | F.contains(a, own)


def display_name(kr: Column, en: Column, artist: Column) -> Column:
    """`Korean (English) — artist`, or the one title there is."""
    return F.concat(F.when(kr.isNotNull() & (kr != en), F.concat(kr, F.lit(" ("), en, F.lit(")"))).otherwise(en), F.lit(" — "), artist)


def find_song(aliases: DataFrame, query: str, artist: str | None = None, limit: int = 10) -> DataFrame:
    """(song_id, display, score) by score, then catalogue order. A song that has the query as a name
    stands alone with 1; else parts count: of the Korean title .9, of an alias .85, of the title .8.
    With an `artist` (Korean or English) only its songs count; if the name's owner is another's, the
    parts decide. One pass; names are compared where the songs are."""
    q = F.lit(query.strip().lower())
    names = F.array_compact(F.concat("aliases", F.array("title_en", "title_kr")))
    fits = _artist_fits(F.col("artist"), artist.strip().lower()) if artist else F.lit(True)
    part = F.greatest(
        F.when(F.contains(F.lower("title_en"), q), 0.8).otherwise(0.0), F.when(F.exists("aliases", lambda x: F.contains(F.lower(x), q)), 0.85).otherwise(0.0),
        F.when(F.contains(F.lower(F.coalesce("title_kr", F.lit(""))), q) & F.col("title_kr").isNotNull(), 0.9).otherwise(0.0),
    )
    rows = aliases.select("song_id", "ord", display_name(F.col("title_kr"), F.col("title_en"), F.col("artist")).alias("display"), part.alias("part"), fits.alias("fits"), (F.exists(names, lambda x: lower_trim(x) == q) & (q != "")).alias("exact"))
    hit = rows.filter("exact or (fits and part > 0)")
    owner = hit.filter("exact").agg(F.max_by(F.struct("song_id", "fits"), F.struct("ord", "song_id")).alias("owner"))
    kept = hit.crossJoin(F.broadcast(owner)).filter("case when owner.fits then song_id = owner.song_id and exact else fits and part > 0 end")
    return kept.withColumn("score", F.when(F.col("owner.fits"), 1.0).otherwise(F.col("part"))).orderBy(F.desc("score"), "ord", "song_id").limit(limit).select("song_id", "display", "score")


def resolve_seeds(songs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, song_id): for each seed (seed_id, title, artist) the first song, by id, whose title
    is, holds or is held by the seed's, and whose artist is or holds the seed's; null without one.
    Null and empty titles are found by nothing; a null artist fits nothing, an empty one all. Names
    meet once each, however many seeds and songs have them."""
    lib = songs.select("song_id", F.lower("title").alias("t"), F.lower(F.col("artist").cast("string")).alias("a")).filter("a is not null")
    asked = stage(seeds.select("seed_id", F.lower("title").alias("t"), F.lower(F.col("artist").cast("string")).alias("sa")), "seeds")
    lib = stage(lib.groupBy("t", "a").agg(F.min("song_id").alias("song_id")), "songs")  # of one name the first song wins
    names = asked.filter("sa is not null").select("t", "sa").distinct()
    held = contained(names.withColumnRenamed("t", "s"), lib.withColumnRenamed("t", "l")).select(F.col("s").alias("t"), "sa", "a", "song_id")
    holds = contained(lib.withColumnRenamed("t", "s"), names.withColumnRenamed("t", "l")).select(F.col("l").alias("t"), "sa", "a", "song_id")
    first = held.unionByName(holds).filter(F.contains("a", "sa")).groupBy("t", "sa").agg(F.min("song_id").alias("song_id"))
    return asked.join(first.hint("merge"), ["t", "sa"], "left").select("seed_id", "song_id")
