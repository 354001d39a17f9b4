"""Term list as hints: migrated feature values, terms found in free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import text as X
from tessera.functions.columns import let
from tessera.operators.ordering import first_per_group, top_per_group


def migration_table(spark) -> DataFrame:
    return spark.createDataFrame(V.FEATURE_MIGRATION, "feature string, value string, new_feature string, new_value string")


def glossary(spark, vocabulary: DataFrame) -> DataFrame:
    """(term, gloss, pos, feature, value): the built-in glossary as far as its values are in the vocabulary."""
    rows = [(term, gloss, i, f, v) for term, gloss, features in V.GLOSSARY for i, (f, v) in enumerate(features)]
    d = spark.createDataFrame(rows, "term string, gloss string, pos int, feature string, value string")
    return d.join(_listed(vocabulary), ["feature", "value"], "left_semi").select("term", "gloss", "pos", "feature", "value")


def _listed(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.select("feature", F.explode("values").alias("value")).filter(~F.col("value").isin(V.PLACEHOLDER_VALUES))


def all_entries(entries: DataFrame, vocabulary: DataFrame, migration: DataFrame | None = None) -> DataFrame:
    """The glossary, then the usable entries of the lexicon whose term it doesn't have."""
    own = glossary(entries.sparkSession, vocabulary)
    return own.unionByName(usable_entries(entries, vocabulary, migration).join(own.select("term").distinct(), "term", "left_anti"))


def usable_entries(entries: DataFrame, vocabulary: DataFrame, migration: DataFrame | None = None, max_senses: int = 2) -> DataFrame:
    """(term, gloss, feature, value): features of the first sense of each entry that maps to the current vocabulary.

    `entries`: (term, senses array<struct<gloss, features array<struct<feature,value>>>>), and perhaps relevance.
    Generic words, blank terms and entries that are no church vocabulary are left out.
    """
    entries = entries.filter((F.trim("term") != "") & ~F.lower(F.trim("term")).isin(V.GENERIC_TERMS))
    if "relevance" in entries.columns:
        entries = entries.filter(F.coalesce("relevance", F.lit("church_vocabulary")) == "church_vocabulary")
    m = migration if migration is not None else migration_table(entries.sparkSession)
    s = entries.select(F.lower(F.trim("term")).alias("term"), F.posexplode(F.slice("senses", 1, max_senses)).alias("sense", "s"))
    f = s.select("term", "sense", F.col("s.gloss").alias("gloss"), F.posexplode("s.features").alias("pos", "f")).select(
        "term", "sense", "gloss", "pos", F.col("f.feature").alias("feature"), F.col("f.value").cast("string").alias("value"))
    listed = _listed(vocabulary)
    current = f.join(vocabulary.select("feature"), "feature", "left_semi")
    older = f.join(vocabulary.select("feature"), "feature", "left_anti").join(m, ["feature", "value"]).select(
        "term", "sense", "gloss", "pos", F.col("new_feature").alias("feature"), F.col("new_value").alias("value"))
    ok = current.select(*older.columns).unionByName(older).join(listed, ["feature", "value"], "left_semi")
    first = ok.groupBy("term").agg(F.min("sense").alias("sense"))
    return ok.join(first, ["term", "sense"]).select("term", F.substring("gloss", 1, 200).alias("gloss"), "pos", "feature", "value")


def hints(messages: DataFrame, terms: DataFrame, limit: int = 8) -> DataFrame:
    """Terms found as whole words in a message, longest term first, at most `limit`.

    `messages`: (message_id, text); `terms`: (term, alias) with the term itself as one of its aliases. Word runs
    are the join key, the exact whole-word test runs on the joined pairs.
    """
    letters = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    t = terms.withColumn("run", F.array_join(letters(F.col("alias")), " ")).filter("run <> ''")
    lengths = X.run_lengths(terms, letters(F.col("alias")))
    runs = let(letters(F.col("text")), lambda w: X.runs_of(w, lengths))
    d = messages.select("message_id", F.col("text"), F.explode(runs).alias("run")).join(t, "run")
    whole = F.concat(F.lit(r"(?<![a-z])\Q"), F.lower("alias"), F.lit(r"\E(?![a-z])"))
    d = d.filter(F.regexp_like(F.lower("text"), whole)).groupBy("message_id", "term").agg(F.min("alias").alias("found"))
    return top_per_group(d, ["message_id"], [F.desc(F.length("term")), F.col("term")], limit, "rank")
