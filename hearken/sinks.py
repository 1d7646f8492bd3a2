"""Documents, logs and reports written from result tables. Only these act; they take results of bounded size."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.session import sized
from hearken.sources.exports import dump_names


def section(df: DataFrame, order: Sequence[Column | str] = (), *, most: int = 100_000) -> DataFrame:
    """A table of at most ``most`` rows (more raise) as one row with a JSON array of its rows, nulls kept, in an order."""
    df = sized(df, most)
    row = F.struct(*df.columns)
    key = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]).alias("o") if order else F.lit(0).alias("o")
    listed = df.select(key, row.alias("r")).agg(F.sort_array(F.collect_list(F.struct("o", "r"))).alias("x"))
    return listed.select(F.to_json(F.transform("x", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("json"))


def write_document(path: str, sections: Mapping[str, DataFrame], *, compact: bool = True) -> int:
    """Write sections (each a one-row table with JSON text) as one document; its size in bytes."""
    doc = {name: json.loads(df.first()["json"]) for name, df in sections.items()}
    text = json.dumps(doc, ensure_ascii=False, separators=(",", ":")) if compact else json.dumps(doc, ensure_ascii=False, indent=1)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return len(text.encode())


def write_proposals(path: str, proposals: DataFrame, *, now: str, min_ratio: float, tiers: Sequence[str] = ("high",), most: int = 100_000) -> int:
    """Proposals (``tier, plays`` and more; at most ``most``) with the number of songs and plays in all and by tier, as one file to review; its size in bytes."""
    by = proposals.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("plays"), F.lit(0)).alias("plays")).orderBy(F.desc("n"), "tier").collect()
    doc = {
        "generated_at": now,
        "min_ratio": min_ratio,
        "applied_tiers": list(tiers),
        "stats": {"songs": sum(r["n"] for r in by), "plays": sum(r["plays"] for r in by), "by_tier": {r["tier"]: r["n"] for r in by}, "plays_by_tier": {r["tier"]: r["plays"] for r in by}},
        "proposals": json.loads(section(proposals, [F.col("tier"), -F.col("plays"), F.col("title")], most=most).first()["json"]),
    }
    text = json.dumps(doc, ensure_ascii=False, indent=1)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return len(text.encode())


def inject(page: str, data: str, marker: str) -> str:
    """A page with JSON in place of the first marker, closing tags in it escaped; a page without marker raises."""
    if marker not in page:
        raise ValueError(f"no {marker} in the page")
    return page.replace(marker, data.replace("</", "<\\/"), 1)


def ledger_rows(records: DataFrame, *, now: str, recipe: str | None = None, playlist: str | None = None) -> DataFrame:
    """Records to append: rows with an act, stamped; a record's own recipe and playlist come before the shared ones."""
    have = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    return records.where("artist is not null and trim(artist) <> ''").select(
        F.lit(now).alias("ts"), "artist", have("title").alias("title"), have("uri").alias("uri"), F.coalesce(have("recipe"), F.lit(recipe)).alias("recipe"), F.coalesce(have("playlist"), F.lit(playlist)).alias("playlist")
    )


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def unresolved_report(songs: DataFrame) -> DataFrame:
    """Markdown lines of unresolved songs: title line, totals, table with pipes escaped, by plays."""
    esc = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|")
    years = F.when(F.col("year_min") == F.col("year_max"), F.col("year_min").cast("string")).otherwise(F.concat_ws("-", "year_min", "year_max"))
    body = songs.select(F.lit(2).alias("part"), (-F.col("plays")).alias("a"), F.col("title").alias("b"), F.concat(F.lit("| "), F.concat_ws(" | ", esc("title"), esc("album"), "plays", "minutes", F.coalesce(years, F.lit(""))), F.lit(" |")).alias("line"))
    sums = songs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("plays"), F.lit(0)).alias("p"))
    head = sums.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("a"), F.lit("").alias("b"), F.format_string("%d songs, %d plays without act", "n", "p").alias("line"))
    cols = sums.select(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("a"), F.lit("").alias("b"), F.lit("| title | album | plays | minutes | years |\n|---|---|---|---|---|").alias("line"))
    return head.unionByName(cols).unionByName(body).orderBy("part", "a", "b").select("line")


def accepted(overrides: DataFrame, proposals: DataFrame, *, tiers: Sequence[str] = ("high",)) -> DataFrame:
    """Overrides with the accepted proposals of new titles; titles that are there keep their act."""
    from pyspark.sql import Window

    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    new = proposals.where(F.col("tier").isin(*tiers) & F.col("artist").isNotNull()).select("title", "artist", key("title").alias("k"))
    once = new.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("title", "artist"))).where("n = 1").drop("n")
    return overrides.select("title", "artist").unionByName(once.join(overrides.select(key("title").alias("k")), "k", "left_anti").select("title", "artist"))


def prune(folder: str, keep: int = 5) -> list[str]:
    """Delete all but the newest dumps of a local folder; the names deleted."""
    old = dump_names(folder)[keep:]
    for p in old:
        os.remove(p)
    return old


def digest(df: DataFrame, name: str = "artist", n: int = 30) -> DataFrame:
    """Lines such as ``name (12 plays, 3.4 h)`` of a ranked table."""
    return df.limit(n).select(F.format_string("%s (%d plays, %.1f h)", F.col(name), F.col("plays"), F.col("ms") / 3_600_000.0).alias("line"))


__all__ = ["accepted", "append_ledger", "digest", "inject", "ledger_rows", "prune", "section", "unresolved_report", "write_document", "write_proposals"]
