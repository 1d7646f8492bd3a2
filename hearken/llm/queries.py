"""Queries of the operators of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm.abuse import best_threshold, score_texts
from hearken.llm.encode import encode_texts
from hearken.llm.entities import match_records
from hearken.llm.hidden import collapsed, copy_classes, copy_pairs
from hearken.llm.leaks import leaked
from hearken.llm.listmatch import map_to_list
from hearken.session import cut
from hearken.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return match_records(
        table(spark, folder, "streaming_history"),
        table(spark, folder, "paste300_albums"),
        key="row_no",
        act="master_metadata_album_artist_name",
        album="master_metadata_album_album_name",
        record_key="list_rank",
        record_act="artist",
        record_album="album",
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listens of each listed record."""
    return _records(spark, folder).select("list_rank", "row_no")


def p1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Listens of each listed record with the rule that matched them and its confidence."""
    return _records(spark, folder)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The entry of the tag list that each freely typed tag means, or -1."""
    entries = table(spark, folder, "tag_buckets")
    return map_to_list(table(spark, folder, "lastfm"), entries, key="feed_no", value="tag", entry_key="entry_no", entry="entry").select("feed_no", "entry_no")


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    listens = table(spark, folder, "streaming_history")
    return copy_classes(listens, key="row_no", name="master_metadata_album_artist_name", ignore=["received_at"], required=["ts"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of listens that are copies but for the writing of the act."""
    return copy_pairs(_copies(spark, folder), key="row_no")


def p7_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Each listen once, with its number of copies."""
    return collapsed(table(spark, folder, "streaming_history"), _copies(spark, folder), key="row_no")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, folder, "documents"), key="doc_id", text="text", vocabulary="byte_bpe_50k")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a held-out item or a passage of one."""
    items = table(spark, folder, "eval_items")
    return leaked(table(spark, folder, "documents"), items, key="doc_id", text="text", item_key="item_id", item_text="text").select("doc_id", "item_id")


def _rated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The hand labels: one half, by hash, for the label model and classifier, the other, held out, for the threshold."""
    labels = table(spark, folder, "labels")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    return labels.where(half == 0), labels.where(half == 1)


def _scores(spark: SparkSession, folder: str) -> tuple[DataFrame, float]:
    fitted, held_out = _rated(spark, folder)
    scores = cut(score_texts(table(spark, folder, "documents"), key="doc_id", text="text", labels=fitted, label="toxic"))
    return scores, best_threshold(scores, held_out, key="doc_id", label="toxic")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    scores, threshold = _scores(spark, folder)
    return scores.where(F.col("score") >= threshold).select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, and the share of such ones, of each source."""
    scores, threshold = _scores(spark, folder)
    docs = table(spark, folder, "documents").select("doc_id", "source").join(scores.groupBy("doc_id").agg(F.max("score").alias("score")), "doc_id")
    hit = (F.col("score") >= threshold).cast("int")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_found"), F.avg(hit).alias("rate"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document."""
    return score_texts(table(spark, folder, "documents"), key="doc_id", text="text", labels=_rated(spark, folder)[0], label="toxic")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_confidence": p1_confidence, "p3_found": p3_found, "p7_found": p7_found, "p7_collapsed": p7_collapsed, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_rates": p10_rates, "p10_scores": p10_scores}
ORACLES: dict[str, str] = {}
