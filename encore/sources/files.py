"""Readers and writers of the files a listening history comes in, and lookups with a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(fields: str) -> T.StructType:
    """A schema that needs no session yet."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


PLAY_LOG = _schema(
    "song_id string, title string, artist string, timestamp string, skip_type int, is_skipped int, is_proactive int, proactive_score double, "
    "is_session_start int, is_artist_deep_dive int, familiarity int, hour int"
)
METADATA = _schema("song_id string, query_artist string, query_title string, itunes_artist string, itunes_title string, release_date string, release_year int, genre string, matched boolean")


def _unmarked(raw: DataFrame) -> DataFrame:
    return raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    raw = _unmarked(raw)
    return raw.select(*((F.col(f"`{f.name}`").cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def read_play_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A CSV log by its header's names; a byte order mark is dropped, missing optional columns are
    null, `timestamp` becomes `ts`. Without `strict`, what is no time becomes null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return _typed(raw, PLAY_LOG).withColumn("ts", parse("timestamp")).drop("timestamp")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, v) from JSON objects of id to numbers; several objects or files are one table."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("song_id", "v"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(song_id, A) from JSON objects of id to {A}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,struct<A:double>>")).alias("song_id", "s")).select("song_id", "s.A")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Matched rows of a metadata CSV, its columns by name; a byte order mark is dropped, columns it
    lacks are null."""
    return _typed(spark.read.option("header", True).csv(path), METADATA).filter("matched")


def read_labels(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """(title, artist, label) of a label CSV whose header names are mapped; labels that are no
    number become null."""
    raw = _unmarked(spark.read.option("header", True).csv(path)).withColumnsRenamed(names)
    return raw.select("title", "artist", F.try_to_number("label", F.lit("9999.99")).cast("double").alias("label"))


def label_column(df: DataFrame, least: int = 5, most: float = 5.5) -> str | None:
    """The last column with over `least` numbers, none above `most`; one pass over the rows."""
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in df.columns}
    found = df.agg(*(x for c in df.columns for x in (F.count(number[c]).alias(f"n_{c}"), F.max(number[c]).alias(f"x_{c}")))).first()
    good = [c for c in df.columns if found[f"n_{c}"] > least and found[f"x_{c}"] <= most]
    return good[-1] if good else None


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether steps of a crawl were written below `path`; what a broken step left is no file of it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/step=*/part-*")
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Scores, vectors, caches and crawls: a written table; partitions are replaced one by one."""
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic") if by else writer).save(path)


def pending(catalogue: DataFrame, cache: DataFrame, key: str = "song_id") -> DataFrame:
    """Rows still to look up: those without a matched row in the cache."""
    return catalogue.join(cache.filter("matched").select(key), key, "left_anti")


def crawl(catalogue: DataFrame, cache: DataFrame, fetch: Callable[[dict], dict | None], schema: str, requests: int = 4, key: str = "song_id") -> DataFrame:
    """The cache brought up to date: matched rows stay, the rest is looked up again.

    `fetch` runs in `requests` tasks, so a service sees so many callers at most; it gets a row as a
    dict and gives the row of the cache, or None if the call failed (such rows are left out and
    tried next time). It paces its own calls."""
    fields = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [r for r in map(fetch, pdf.to_dict("records")) if r is not None]
            yield pd.DataFrame(rows, columns=fields)

    fresh = pending(catalogue, cache, key).repartition(requests, key).mapInPandas(run, schema)
    return cache.filter("matched").unionByName(fresh)


def crawl_in_steps(catalogue: DataFrame, path: str, fetch: Callable[[dict], dict | None], schema: str, every: int = 20, requests: int = 4, key: str = "song_id", again: bool = False) -> DataFrame:
    """A crawl that survives a stop: rows go in steps of about `every` for each of `requests` tasks,
    each step a folder below `path` that is written whole or not at all. A new call leaves out what
    earlier steps found, and what they found missing unless `again`.

    `fetch` gets a row as a dict and gives the row of the cache (`schema`, which has the key and a
    boolean `matched`); None, or an error of its own, is kept as a row that is not matched, so a
    service isn't asked twice for what it lacks. Which step a row is in is a hash of its key, so the
    same call asks for the same steps. Returns all rows found so far, the last answer of each key."""
    spark = catalogue.sparkSession
    fields = [f.name for f in T._parse_datatype_string(schema)]
    kept = lambda: spark.read.schema(f"{schema}, step long").parquet(path) if _has_rows(spark, path) else None
    last = lambda df: df.groupBy(key).agg(F.max_by(F.struct(*fields), "step").alias("r")).select("r.*")
    known = kept()
    todo = catalogue if known is None else catalogue.join(last(known).filter("matched" if again else "true").select(key), key, "left_anti")
    first = 0 if known is None else 1 + (known.agg(F.max("step")).first()[0] or 0)
    steps = -(-todo.count() // (every * requests))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        def one(row: dict) -> dict:
            try:
                found = fetch(row)
            except Exception:  # noqa: BLE001  a service's failure is an answer: not matched
                found = None
            return found if found is not None else dict.fromkeys(fields) | {key: row[key], "matched": False}

        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.to_dict("records")], columns=fields)

    for k in range(steps):  # a step that breaks off leaves no file: its folder is replaced as a whole
        part = todo.filter(F.pmod(F.xxhash64(key), F.lit(steps)) == k).repartition(requests, key)
        part.mapInPandas(run, schema).write.mode("overwrite").parquet(f"{path}/step={first + k}")
    found = kept()
    return spark.createDataFrame([], schema) if found is None else last(found)


def push(playlist: DataFrame, send: Callable[[list[dict]], None]) -> None:
    """Hands the rows of a playlist, in order, to a service. A playlist is a few dozen rows."""

    def all_rows(rows: Iterator) -> None:
        send([r.asDict() for r in rows])

    playlist.coalesce(1).sortWithinPartitions("pos").foreachPartition(all_rows)


def vectors_from_audio(files: DataFrame, extract: Callable[[bytes], list[float] | None]) -> DataFrame:
    """(song_id, v) from `spark.read.format('binaryFile')`; the id is the file's name without its
    ending. `extract` decodes one file and gives its vector, or None if it is too short."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["v"] = [extract(x) for x in pdf["content"]]
            yield pdf.loc[pdf["v"].notna(), ["song_id", "v"]]

    named = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("song_id"), "content")
    return named.mapInPandas(run, "song_id string, v array<double>")

