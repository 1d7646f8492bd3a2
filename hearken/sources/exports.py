"""Readers of the exports, lists and logs, each with a declared schema. A missing file is an empty relation."""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.functions.names import unescape_udf

KINDS = {"string": T.StringType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType}


def schema(columns: str) -> T.StructType:
    """Schema of plain columns, given as in DDL; needs no session."""
    return T.StructType([T.StructField(n, KINDS[k]()) for n, k in (c.split() for c in columns.split(","))])


LISTENS = schema(
    "ts string, ms_played bigint, master_metadata_track_name string, master_metadata_album_artist_name string, master_metadata_album_album_name string, spotify_track_uri string, platform string, reason_start string, reason_end string, shuffle boolean, skipped boolean, service string"
)
LEDGER = schema("ts string, artist string, title string, uri string, recipe string, playlist string")


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with their place: file after file by name, rows in file order.

    Files are read in any order and large ones in parts, so the reader's own running number only orders rows within a file;
    the number of rows in the files before is added to it. Files are few, so one task may add them up.
    """
    rows = df.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__n": F.monotonically_increasing_id()})
    parts = rows.groupBy("__file", "__start").agg(F.count(F.lit(1)).alias("rows"), F.min("__n").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("__file", "__start", (before - F.col("first")).alias("__shift"))
    return rows.join(starts, ["__file", "__start"]).withColumn("ord", F.col("__n") + F.col("__shift")).drop("__file", "__start", "__n", "__shift")


def _exists(path: str) -> bool:
    return bool(glob.glob(path.removeprefix("file://"))) or "://" in path.removeprefix("file://")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def listens(spark: SparkSession, folder: str) -> DataFrame:
    """Listens of the first service: JSON arrays, rows with uri and act, tagged with the service and their place."""
    pattern = f"{folder}/Streaming_History_Audio_*.json"
    if not _exists(pattern):
        return empty(spark, T.StructType([*LISTENS, *schema("file string, ord bigint")]))
    raw = spark.read.schema(LISTENS).option("multiLine", True).json(pattern)
    rows = _numbered(raw.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))
    return rows.where("spotify_track_uri <> '' and master_metadata_album_artist_name <> ''").withColumn("service", F.lit("spotify"))


def table_file(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header and quoted line breaks, all text; a byte-order mark before the first name is dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return _numbered(raw.toDF(*[c.removeprefix("﻿").strip('"') for c in raw.columns]))


def companion_events(spark: SparkSession, path: str) -> DataFrame:
    """Normalised listens of the second service from its events file."""
    if not _exists(path):
        return empty(spark, LISTENS)
    doc = spark.read.schema(T.StructType([T.StructField("events", T.ArrayType(LISTENS))])).option("multiLine", True).json(path)
    return doc.select(F.explode("events").alias("e")).select("e.*")


def sibling(folder: str, name: str = "apple_history_events.json") -> str:
    """Path of a file beside a folder."""
    return os.path.join(os.path.dirname(folder.rstrip("/")), name)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text list without blanks and comments."""
    if not _exists(path):
        return empty(spark, schema("value string"))
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and value not like '#%'")


def ordered_map(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a small JSON object in file order: ``ord, key, bucket``."""
    with open(path.removeprefix("file://"), encoding="utf-8") as f:
        pairs = list(json.load(f).items())
    return spark.createDataFrame([(i, str(k), str(v)) for i, (k, v) in enumerate(pairs)], "ord int, key string, bucket string")


def canon(spark: SparkSession, path: str) -> DataFrame:
    """Ranked records of a list file; a list without any raises."""
    layout = "source string, url string, albums array<struct<rank:bigint,artist:string,album:string,year:int>>"
    rows = spark.read.schema(layout).option("multiLine", True).json(path).select(F.explode("albums").alias("a")).select("a.*")
    if rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def ledger(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines log in the order written; a malformed line raises, or is left out if not ``strict``."""
    if not _exists(path):
        return empty(spark, T.StructType([*LEDGER, *schema("ord bigint")]))
    raw = spark.read.schema(LEDGER).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return _numbered(raw)


def picks(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated picks of one to three columns; blanks are null."""
    raw = spark.read.option("sep", "\t").schema("artist string, title string, uri string").csv(path)
    return raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns]).where("artist is not null")


def newest(spark: SparkSession, folder: str, pattern: str = r"taste_\d{8}T\d{6}Z\.json$") -> str | None:
    """Path of the newest file whose name matches, by modification time."""
    if not os.path.isdir(folder.removeprefix("file://")):
        return None
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime").where(F.col("path").rlike(pattern))
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return row[0] if row else None


_NODE = r'(?s)<div[^>]*class="genre[^"]*"[^>]*>.*?</div>(?:(?!<div[^>]*class="genre).){0,400}'


def genre_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Positioned nodes of a genre map: name, place, colour, size, preview, example and link (looked for shortly behind the node)."""
    page = spark.read.text(path, wholetext=True)
    nodes = page.select(F.posexplode(F.regexp_extract_all("value", F.lit(_NODE), 0)).alias("ord", "node"))
    one = lambda p: F.nullif(F.regexp_extract("node", p, 1), F.lit(""))
    return nodes.select(
        "ord",
        F.trim(unescape_udf(F.regexp_replace(one(r"(?s)<div[^>]*>(.*?)</div>"), r"(?s)<a.*$|<[^>]+>", ""))).alias("name"),
        one(r"top:\s*(-?\d+)px").try_cast("int").alias("top"),
        one(r"left:\s*(-?\d+)px").try_cast("int").alias("left"),
        one(r"color:\s*(#[0-9a-fA-F]{3,6})").alias("color"),
        one(r"font-size:\s*(\d+)%").try_cast("int").alias("size"),
        one(r'preview_url="([^"]*)"').alias("preview"),
        unescape_udf(one(r'title="e\.g\.\s*([^"]*)"')).alias("example"),
        one(r'href="([^"]+)"').alias("link"),
    )


def genre_neighbors(nodes: DataFrame, seed: str, *, n: int = 15) -> DataFrame:
    """Other genres of a page in page order, each once, the seed left out."""
    w = Window.partitionBy("name").orderBy("ord")
    once = nodes.where((F.col("name") != seed) & (F.col("name") != "")).withColumn("k", F.row_number().over(w)).where("k = 1")
    return once.orderBy("ord").limit(n).select("ord", "name", "link")


def find_genres(nodes: DataFrame, text: str) -> DataFrame:
    """Genres that contain a text, the exact one first."""
    q = text.strip().lower()
    return nodes.where(F.lower("name").contains(q)).orderBy(F.lower("name") != q, "ord")


def one_or_many(column: str, item: str):
    """Array from a JSON text that holds one object or an array of them."""
    value = F.trim(column)
    return F.when(value.startswith("["), F.from_json(value, f"array<{item}>")).when(value.startswith("{"), F.array(F.from_json(value, item)))


def neighbor_feed(raw: DataFrame) -> DataFrame:
    """Neighbours (``artist, pos, name, match``) of raw feed rows (``artist, json``): one or many, unreadable matches null."""
    items = raw.select("artist", F.posexplode(one_or_many("json", "struct<name:string,match:string>")).alias("pos", "x"))
    return items.select("artist", "pos", F.col("x.name").alias("name"), F.col("x.match").try_cast("double").alias("match")).where("name <> ''")


def tag_feed(raw: DataFrame) -> DataFrame:
    """Tags (``artist, rank, tag, count``) of raw feed rows, in feed order."""
    items = raw.select("artist", F.posexplode(one_or_many("json", "struct<name:string,count:string>")).alias("rank", "x"))
    return items.select("artist", "rank", F.lower("x.name").alias("tag"), F.coalesce(F.col("x.count").try_cast("double").cast("int"), F.lit(0)).alias("count")).where("tag <> ''")


def fill_cache(cache: DataFrame, wanted: DataFrame, fetch, *, key: str, batch: int = 50) -> DataFrame:
    """Cached records plus those fetched for ids that aren't cached, ``batch`` ids at a call.

    ``fetch`` maps a list of ids to records (dicts in the cache's schema); it runs in the workers.
    """
    missing = wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    names = cache.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = list(b[key])
            for i in range(0, len(ids), batch):
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in fetch(ids[i : i + batch])], columns=names)

    return cache.unionByName(missing.mapInPandas(run, cache.schema))


_TRACK = "struct<name:string,id:string,uri:string,popularity:int,duration_ms:bigint,artists:array<struct<name:string,id:string>>,album:struct<name:string,id:string,release_date:string>,genres:array<string>>"


def _pulled(item: str, *more: str) -> list:
    """Columns of an artist or track record as the account service writes it."""
    x = F.col(item)
    return [*[x[c].alias(c) for c in ("name", "id", "uri", "popularity", "duration_ms", "genres")], x["artists"]["name"].alias("artists"), x["album"]["name"].alias("album"), x["album"]["release_date"].alias("release_date"), *[F.col(c) for c in more]]


def top_items(pages: DataFrame) -> DataFrame:
    """Top acts or tracks of an account by time range, in order, from stored answers (``kind, range, json``)."""
    items = pages.select("kind", "range", F.posexplode(F.from_json("json", f"items array<{_TRACK}>")["items"]).alias("pos", "x"))
    return items.select("kind", "range", "pos", *_pulled("x"))


def library_items(pages: DataFrame, *, stamp: str, cap: int) -> DataFrame:
    """Saved (``stamp`` added_at, cap 500) or recent (played_at, cap 50) tracks of an account from stored answers (``page, json``), in order, the first ``cap``."""
    layout = f"items array<struct<track:{_TRACK},{stamp}:string>>"
    items = pages.select("page", F.posexplode(F.from_json("json", layout)["items"]).alias("pos", "x"))
    return items.select("page", "pos", F.col("x.track").alias("t"), F.col(f"x.{stamp}").alias(stamp)).orderBy("page", "pos").limit(cap).select("page", "pos", *_pulled("t", stamp))


def now_playing(answers: DataFrame) -> DataFrame:
    """What an account plays, from stored answers (``json``); answers without a track give no row."""
    x = answers.select(F.from_json("json", f"is_playing boolean, progress_ms bigint, item {_TRACK}").alias("a")).where("a.item.name is not null")
    return x.select(F.col("a.item").alias("t"), F.coalesce("a.is_playing", F.lit(False)).alias("is_playing"), F.col("a.progress_ms").alias("progress_ms")).select("is_playing", "progress_ms", *_pulled("t"))


def optional(spark: SparkSession, path: str, columns: str) -> tuple[DataFrame, bool]:
    """A parquet dimension and whether it is there; an absent one is an empty relation of the schema."""
    if _exists(path):
        return spark.read.schema(columns).parquet(path), True
    return empty(spark, schema(columns)), False


def library(df: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` rows of a library in its order."""
    return df.orderBy("pos").limit(cap)


def dump_names(folder: str, pattern: str = r"taste_\d{8}T\d{6}Z\.json$") -> list[str]:
    """Matching file names of a local folder, newest first."""
    found = [p for p in glob.glob(f"{folder}/*") if re.search(pattern, p)]
    return sorted(found, key=lambda p: (os.path.getmtime(p), p), reverse=True)
