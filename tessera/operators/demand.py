"""What people ask for, and how much of it a term list recognises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.shortlist import sub_phrases


def mine_requests(docs: DataFrame, patterns=None) -> DataFrame:
    """(doc, req_no, request): request sentences of seeker documents."""
    return docs.filter("side = 'seeker'").select(
        F.col("id").alias("doc"), F.posexplode(X.request_chunks(F.col("text"), patterns)).alias("req_no", "request"))


def attributes(requests: DataFrame, filler=None, limit: int = 8) -> DataFrame:
    """(doc, req_no, pos, phrase, polarity, category) with stop words trimmed from the phrase ends."""
    d = requests.select("doc", "req_no", F.posexplode(X.wanted_phrases(F.col("request"), limit, filler)).alias("pos", "a"))
    return d.select("doc", "req_no", "pos", X.trim_stopwords(F.col("a.phrase")).alias("phrase"), "a.polarity",
                    "a.category").filter("phrase <> ''")


def phrase_demand(attrs: DataFrame) -> DataFrame:
    """Per phrase: uses, wants, avoids and the commonest category (ties: the one met first)."""
    per_cat = attrs.groupBy("phrase", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("polarity") == "want").alias("want"),
        F.count_if(F.col("polarity") == "avoid").alias("avoid"),
        F.min(F.struct("doc", "req_no", "pos")).alias("first"))
    return per_cat.groupBy("phrase").agg(
        F.sum("n").alias("count"), F.sum("want").alias("want"), F.sum("avoid").alias("avoid"),
        F.min_by("category", F.struct(-F.col("n"), F.col("first"))).alias("category"))


def covered_phrases(phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct phrases that contain a term or are contained in one, token-wise.

    Two equi-joins on token runs instead of a containment test over all pairs.
    `phrases`: (phrase); `terms`: (term) with all aliases as rows. Runs of every length count.
    """
    p = phrases.select("phrase", F.array_join(X.tokens(F.col("phrase")), " ").alias("p")).filter("p <> ''").distinct()
    t = terms.select(F.array_join(X.tokens(F.col("term")), " ").alias("t")).filter("t <> ''").distinct()
    runs = lambda c: F.array_append(sub_phrases(c), c)
    holds = p.select("phrase", F.explode(runs(F.col("p"))).alias("t")).join(t, "t", "left_semi").select("phrase")
    inside = p.join(t.select(F.explode(runs(F.col("t"))).alias("p")).distinct(), "p", "left_semi").select("phrase")
    return holds.union(inside).distinct()


def coverage(attrs: DataFrame, terms: DataFrame) -> DataFrame:
    """Hit rate by category and overall (category null), in one rollup."""
    hit = covered_phrases(attrs.select("phrase").distinct(), terms).withColumn("hit", F.lit(1.0))
    d = attrs.join(hit, "phrase", "left")
    return d.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("coverage"))


def top_uncovered(attrs: DataFrame, terms: DataFrame, n: int = 50) -> DataFrame:
    hit = covered_phrases(attrs.select("phrase").distinct(), terms)
    return (attrs.join(hit, "phrase", "left_anti").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "phrase").limit(n))
