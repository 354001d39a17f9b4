"""Readers for every input: corpora, lists, logs, feeds, places, knowledge tables, vocabularies. Writers for the outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import geo
from tessera.functions import text as X
from tessera.functions import urls as U
from tessera.functions.columns import in_turn, strip
from tessera.operators.ordering import first_per_group, top_per_group


# ---------------------------------------------------------------- corpora and lists
def read_posts(spark: SparkSession, folder: str) -> DataFrame:
    """All *.jsonl and *.csv below a folder as raw posts; only the known columns are read, so names and handles never enter.

    `ord` follows the file path and the place in the file. A missing source becomes the file name.
    """
    opts = {"recursiveFileLookup": "true"}
    js = spark.read.options(**opts, pathGlobFilter="*.jsonl").schema(S.RAW_POSTS).json(folder)
    cs = spark.read.options(**opts, pathGlobFilter="*.csv", header="true", multiLine="true", escape='"', enforceSchema="false")
    # CSV columns go by name, whatever their order: read as they are, then take the known ones
    cs = cs.csv(folder)
    known = [c.split()[0] for c in S.RAW_POSTS.split(", ")]

    def shape(d):
        cols = [(F.col(c) if c in d.columns else F.lit(None)).cast("string").alias(c) for c in known]
        # the id grows with the place in the file as files are split in order
        return d.select(*cols, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"),
                        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    d = shape(js).unionByName(shape(cs))
    return d.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.col("_file"))).withColumn(
        "ord", F.struct("_path", "_block", "_line")).drop("_path", "_block", "_line", "_file")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A term list, one per line, lower-cased; lines starting with # are comments."""
    t = strip(F.col("value"))
    return spark.read.text(path).filter((t != "") & ~t.startswith("#")).select(F.lower(t).alias("term"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The feature vocabulary from JSON lines, or from a YAML file (a small contract file, read on the driver)."""
    if not path.endswith((".yaml", ".yml")):
        return spark.read.schema(S.FEATURES).json(path)
    import yaml
    with open(path, encoding="utf-8") as f:
        feats = (yaml.safe_load(f) or {}).get("features", {})
    rows = [(k, v.get("label"), [str(x) for x in v.get("values", [])], v.get("ask"), v.get("question"), v.get("stage"), v.get("sources"), v.get("denom_field"),
             bool(v.get("sensitive")), bool(v.get("observed")), i) for i, (k, v) in enumerate(feats.items())]
    return spark.createDataFrame(rows, S.FEATURES)


def questions_at(features: DataFrame, level: str) -> DataFrame:
    """Features asked at a level that have a question, in file order."""
    return features.filter((F.col("ask") == level) & (F.coalesce("question", F.lit("")) != "")).orderBy("ord")


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CALL_LOG).json(path)


def read_step_log(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    d = spark.read.schema(S.STEP_LOG).json(path)
    return d.filter(F.col("session_id") == session) if session else d


def read_review_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Review sheets named review_<reviewer>.csv, with the reviewer taken from the name."""
    d = spark.read.schema(S.REVIEW_SHEET).csv(folder, header=True, multiLine=True, escape='"', pathGlobFilter="review_*.csv", recursiveFileLookup=True)
    return d.withColumn("reviewer", F.regexp_extract(F.col("_metadata.file_name"), r"review_(.*)\.csv$", 1))


def read_proposal_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PROPOSAL_SHEET).csv(path, header=True, multiLine=True, escape='"')


# ---------------------------------------------------------------- places
def read_places(spark: SparkSession, path: str, lat: float, lng: float, max_results: int = 60) -> DataFrame:
    """Place search pages (JSON) -> places: closed ones out, last page wins per id, nearest first, at most `max_results`."""
    raw = spark.read.schema(S.PLACES_PAGE).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("_f"), F.posexplode("places").alias("_p", "p"))
    ok = ~F.coalesce("p.businessStatus", F.lit("")).startswith("CLOSED") & (F.coalesce("p.id", F.lit("")) != "")
    d = raw.filter(ok).select(
        F.col("p.id").alias("church_id"), F.coalesce("p.displayName.text", F.lit("")).alias("name"), F.coalesce("p.formattedAddress", F.lit("")).alias("address"),
        F.coalesce("p.location.latitude", F.lit(0.0)).alias("lat"), F.coalesce("p.location.longitude", F.lit(0.0)).alias("lng"), F.col("p.websiteUri").alias("website"),
        F.col("p.nationalPhoneNumber").alias("phone"), F.coalesce("p.types", F.array().cast("array<string>")).alias("types"),
        F.coalesce("p.businessStatus", F.lit("")).alias("business_status"), F.lit("places").alias("source"), "_f", "_p")
    last = d.groupBy("church_id").agg(F.max_by(F.struct(*[c for c in d.columns if c != "church_id"]), F.struct("_f", "_p")).alias("r")).select("church_id", "r.*")
    return last.drop("_f", "_p").withColumn("distance_miles", F.round(geo.miles(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")), 2)).orderBy("distance_miles", "church_id").limit(max_results)


def read_map_elements(spark: SparkSession, path: str, lat: float, lng: float) -> DataFrame:
    """Map API elements (nodes, ways) -> places in the same shape, nearest first."""
    e = spark.read.schema(S.MAP_ELEMENTS).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    tag = lambda *ks: F.coalesce(*[F.try_element_at("e.tags", F.lit(k)) for k in ks])
    addr = F.concat_ws(" ", *[F.nullif(tag(k), F.lit("")) for k in ("addr:housenumber", "addr:street", "addr:city", "addr:state")])
    site = tag("website", "contact:website")
    d = e.select(
        F.concat(F.lit("osm:"), F.col("e.id").cast("string")).alias("church_id"), F.coalesce(tag("name", "operator"), F.lit("Unknown Church")).alias("name"), addr.alias("address"),
        F.coalesce("e.lat", "e.center.lat", F.lit(0.0)).alias("lat"), F.coalesce("e.lon", "e.center.lon", F.lit(0.0)).alias("lng"),
        F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), site)).alias("website"), tag("phone", "contact:phone").alias("phone"),
        F.array(F.lit("place_of_worship")).alias("types"), F.lit("OPERATIONAL").alias("business_status"), tag("denomination").alias("osm_denomination"), F.lit("osm").alias("source"))
    return d.withColumn("distance_miles", F.round(geo.miles(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")), 2)).orderBy("distance_miles", "church_id")


# ---------------------------------------------------------------- feeds and transcripts
_OFFSET = r" ([+-]\d{4}|GMT|UT|UTC|Z)$"


def feed_date(c: Column) -> Column:
    """RFC 822 feed dates as UTC timestamps; unreadable ones are null."""
    t = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},?\s*", "")
    t = F.regexp_replace(t, r" (GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(t, F.lit("d MMM yyyy HH:mm Z")))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items -> episodes: title, guid, audio, length, duration, type, date, transcripts. One row per item, in file order."""
    d = spark.read.format("xml").option("rowTag", "item").schema(S.EPISODE_ITEM).load(path)
    enc = F.get("enclosure", F.lit(0))
    tr = F.filter(F.coalesce("`podcast:transcript`", F.array().cast("array<struct<_url:string,_type:string>>")), lambda t: t["_url"].isNotNull())
    title = F.trim(F.coalesce("title", F.lit("")))
    return d.select(
        F.col("_metadata.file_path").alias("feed"), title.alias("title"), F.coalesce(F.nullif(F.trim("guid"), F.lit("")), enc["_url"], title).alias("guid"), enc["_url"].alias("audio"),
        F.coalesce(enc["_length"].try_cast("long"), F.lit(0)).alias("length"), X.duration_seconds(F.col("`itunes:duration`")).alias("duration"),
        F.lower(F.trim(F.coalesce("`itunes:episodeType`", F.lit("full")))).alias("type"), F.date_format(feed_date(F.col("pubDate")), "yyyy-MM-dd").alias("date"),
        F.transform(tr, lambda t: F.struct(t["_url"].alias("url"), F.lower(F.coalesce(t["_type"], F.lit(""))).alias("type"))).alias("transcripts"),
        (enc["_url"].isNotNull() | (F.size(tr) > 0)).alias("has_media"))


def read_sermons(spark: SparkSession, path: str, limit: int = 25) -> DataFrame:
    """Feed items for listening: newest first per feed, speaker and links by fallback, at most `limit`."""
    d = spark.read.format("xml").option("rowTag", "item").schema(S.EPISODE_ITEM).load(path)
    enc = F.coalesce("enclosure", F.array().cast("array<struct<_url:string,_type:string,_length:string>>"))
    of = lambda cond: F.get(F.filter(enc, lambda e: e["_url"].isNotNull() & cond(F.lower(F.coalesce(e["_type"], F.lit(""))))), F.lit(0))["_url"]
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = d.select(
        F.col("_metadata.file_path").alias("feed"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), feed_date(F.col("pubDate")).alias("date"),
        F.coalesce(blank(F.col("`itunes:author`")), blank(F.col("author")), blank(F.col("`dc:creator`")), F.lit("")).alias("speaker"),
        of(lambda t: ~t.startswith("video/") & ~t.contains("transcript")).alias("audio_url"), of(lambda t: t.startswith("video/")).alias("video_url"),
        F.coalesce(of(lambda t: t.contains("transcript")), F.get("`podcast:transcript`", F.lit(0))["_url"], F.get("`itunes:transcript`", F.lit(0))["_url"]).alias("transcript_url"),
        F.coalesce("link", F.lit("")).alias("page_url"))
    return top_per_group(rows, ["feed"], [F.desc_nulls_last("date"), F.col("title")], limit, "item_no")


def read_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole transcript files -> (path, kind, text); the kind is the file extension."""
    d = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return d.select("path", kind.alias("kind"), X.transcript_text(F.col("value"), kind).alias("text"))


# ---------------------------------------------------------------- knowledge tables
def read_kb(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nested knowledge document -> long tables: groups, fields (with evidence arrays), evidence."""
    g = spark.read.schema(S.KB_DOCUMENT).json(path, multiLine=True).select(F.explode("groups").alias("g"))
    groups = g.select(F.col("g.id").alias("group_id"), "g.census_name", "g.name", "g.processed", "g.census_2020.congregations", "g.census_2020.adherents", "g.census_2020.share")
    fields = g.select(F.col("g.id").alias("group_id"), F.explode("g.fields").alias("field_id", "f")).select("group_id", "field_id", "f.value", "f.status", "f.evidence")
    ev = fields.select("group_id", "field_id", F.posexplode("evidence").alias("pos", "e")).select("group_id", "field_id", "pos", "e.*")
    return {"groups": groups, "fields": fields, "evidence": ev}


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """One wide layer sheet with its own headers, all columns as text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


# ---------------------------------------------------------------- outputs
def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A stage table; the commit protocol swaps it in as a whole, and only touched partitions are replaced when partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A review sheet as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
