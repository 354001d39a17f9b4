"""Registered queries: corpus and term mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.columns import rounded
from tessera.operators import contexts, corpus, demand, grams, ranking, senses, shortlist, signals
from tessera.queries import derive as D
from tessera.queries.derive import Mining
from tessera.queries.registry import cte, query, table


@query("corpus_clean", """
SELECT id, side, tradition, source, length(text)::BIGINT AS n_chars, len(toks)::BIGINT AS n_tokens, hash, holdout FROM docs""", ("docs",))
def corpus_clean(spark, sf):
    return D.docs(spark, sf).select("id", "side", "tradition", "source", F.length("text").cast("long").alias("n_chars"),
                                    F.size("toks").cast("long").alias("n_tokens"), "hash", "holdout")


@query("corpus_stats", """
SELECT 'read' AS stat, count(*) AS n FROM labelled
UNION ALL SELECT 'dropped_bad_row', count(*) FROM labelled WHERE fate = 'bad_row'
UNION ALL SELECT 'dropped_short', count(*) FROM labelled WHERE fate = 'short'
UNION ALL SELECT 'dropped_duplicate', (SELECT count(*) FROM labelled WHERE fate = 'kept') - (SELECT count(*) FROM docs)
UNION ALL SELECT 'kept_' || s, (SELECT count(*) FROM docs WHERE side = s) FROM (VALUES ('seeker'), ('church')) v(s)
UNION ALL SELECT 'seeker_holdout', count(*) FROM docs WHERE holdout
UNION ALL SELECT 'synthetic_docs', count(*) FROM docs WHERE source = 'synthetic'
UNION ALL SELECT 'tradition:' || tradition, count(*) FROM docs WHERE tradition IS NOT NULL GROUP BY tradition""", ("labelled", "docs"))
def corpus_stats(spark, sf):
    return corpus.ingest_stats(D.posts(spark, sf)).select("stat", F.col("n").cast("long").alias("n"))


@query("contact_scrub", r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[email redacted]', 'g'),
  '(^|[^0-9])(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}($|[^0-9])', '\1[phone redacted]\2', 'g') AS text FROM documents""")
def contact_scrub(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.scrub_contacts_apart(F.col("text")).alias("text"))


@query("sentence_split", f"""
SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS digest
FROM (SELECT doc_id, {D.sql_sentences('text')} AS s FROM documents)""")
def sentence_split(spark, sf):
    s = X.sentences(F.col("text"))
    return table(spark, sf, "documents").withColumn("s", s).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("gram_totals", "SELECT scope, tokens::BIGINT AS tokens, docs FROM doc_totals", ("doc_totals",))
def gram_totals(spark, sf):
    return grams.totals(D.docs(spark, sf))


@query("gram_order_totals", "SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, n3::BIGINT AS n3 FROM order_totals", ("order_totals",))
def gram_order_totals(spark, sf):
    return grams.order_totals(D.docs(spark, sf))


@query("gram_counts", """
SELECT gram, count, seeker, church, doc_freq, n_sources, round(top_source_share, 6) AS top_source_share FROM gram_totals""", ("gram_totals",))
def gram_counts(spark, sf):
    g = grams.gram_counts(grams.source_grams(D.staged_docs(spark, sf, text=False)))
    return g.withColumn("top_source_share", rounded(F.col("top_source_share"), 6))


@query("term_sources", """
SELECT gram, tradition, count, n_sources, round(top_share, 6) AS top_share FROM gram_traditions""", ("gram_traditions",))
def term_sources(spark, sf):
    d = D.staged_docs(spark, sf, text=False)
    t = grams.tradition_counts(grams.source_grams(d), grams.source_traditions(d))      # of all grams
    return t.withColumn("top_share", rounded(F.col("top_share"), 6))


@query("candidates_npmi", """
SELECT term, n::BIGINT AS n, count, round(npmi, 4) AS npmi, seeker, church, doc_freq, n_sources, round(top_source_share, 3) AS top_source_share, seed
FROM candidates""", ("candidates",))
def candidates_npmi(spark, sf):
    c = Mining(spark, sf).candidates
    return c.select("term", F.col("n").cast("long").alias("n"), "count", rounded(F.col("npmi"), 4).alias("npmi"), "seeker", "church", "doc_freq", "n_sources",
                    rounded(F.col("top_source_share"), 3).alias("top_source_share"), "seed")


@query("keyness_reference", "SELECT term, ref_freq, round(z_english, 6) AS z_english FROM z_reference", ("z_reference",))
def keyness_reference(spark, sf):
    return Mining(spark, sf).ref_z.withColumn("z_english", rounded(F.col("z_english"), 6))


@query("keyness_by_lang", "SELECT term, tradition, round(z, 6) AS z, n_sources, round(top_share, 6) AS top_share FROM z_tradition", ("z_tradition",))
def keyness_by_lang(spark, sf):
    return Mining(spark, sf).tradition_z.select("term", "tradition", rounded(F.col("z"), 6).alias("z"), F.col("n_sources").cast("long").alias("n_sources"),
                                                rounded(F.col("top_share"), 6).alias("top_share"))


@query("tradition_markers", "SELECT * FROM markers", ("markers",))
def tradition_markers(spark, sf):
    return Mining(spark, sf).markers


@query("subsumed_terms", "SELECT term, longer FROM subsumed", ("subsumed",))
def subsumed_terms(spark, sf):
    return Mining(spark, sf).subsumed


@query("shortlist_exclusions", "SELECT excluded, count(*) AS n FROM judged WHERE excluded IS NOT NULL GROUP BY excluded", ("judged",))
def shortlist_exclusions(spark, sf):
    return shortlist.exclusion_counts(Mining(spark, sf).judged)


@query("shortlist", "SELECT term, reason FROM shortlist", ("shortlist",))
def shortlist_query(spark, sf):
    return Mining(spark, sf).shortlist


@query("requests_mined", "SELECT doc, req_no::BIGINT AS req_no, request FROM requests", ("requests",))
def requests_mined(spark, sf):
    return Mining(spark, sf).requests.select("doc", F.col("req_no").cast("long").alias("req_no"), "request")


@query("request_attributes", "SELECT doc, request, pos::BIGINT AS pos, phrase, polarity FROM attributes", ("attributes",))
def request_attributes(spark, sf):
    m = Mining(spark, sf)
    return m.attributes.join(m.requests, ["doc", "req_no"]).select("doc", "request", F.col("pos").cast("long").alias("pos"), "phrase", "polarity")


@query("phrase_demand", "SELECT phrase, count, want, avoid, category FROM phrases", ("phrases",))
def phrase_demand(spark, sf):
    return Mining(spark, sf).phrases


cte("holdout_requests", rf"""
SELECT id AS doc, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS req_no, substr(s[i] || CASE WHEN i < len(s) THEN ' ' || s[i + 1] ELSE '' END, 1, 600) AS request
FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, {D.sql_sentences('text')} AS s FROM docs WHERE holdout))
WHERE regexp_matches(s[i], '(?i){D.REQUESTS_SQL}')
""", "docs")
cte("holdout_attributes", D._attribute_sql("holdout_requests"), "holdout_requests")
cte("covered", """
WITH p AS (SELECT DISTINCT phrase, string_split(phrase, ' ') AS t FROM holdout_attributes),
 s AS (SELECT DISTINCT term, string_split(term, ' ') AS t FROM shortlist),
 runs AS (SELECT phrase, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN [array_to_string(t[1:2], ' ')] ELSE [] END)) AS r FROM p),
 sruns AS (SELECT term, unnest(list_concat(list_concat(t, [term]), CASE WHEN len(t) = 3 THEN [array_to_string(t[1:2], ' '), array_to_string(t[2:3], ' ')] ELSE [] END)) AS r FROM s)
SELECT DISTINCT phrase FROM (SELECT phrase FROM runs JOIN s ON s.term = r UNION ALL SELECT p.phrase FROM p JOIN sruns ON r = p.phrase)
""", "holdout_attributes", "shortlist")


def _coverage_inputs(spark, sf):
    m = Mining(spark, sf)
    attrs = demand.attributes(demand.mine_requests(m.docs.filter("holdout"), D.REQUESTS), D.FILLER)
    return attrs, m.shortlist.select("term")


@query("coverage_holdout", """
SELECT category, count(*) AS n, round(avg(hit), 6) AS coverage FROM (
  SELECT 'culture' AS category, CASE WHEN c.phrase IS NULL THEN 0.0 ELSE 1.0 END AS hit FROM holdout_attributes a LEFT JOIN covered c USING (phrase))
GROUP BY ROLLUP (category)""", ("holdout_attributes", "covered"))
def coverage_holdout(spark, sf):
    attrs, terms = _coverage_inputs(spark, sf)
    return demand.coverage(attrs, terms).select("category", "n", rounded(F.col("coverage"), 6).alias("coverage"))


@query("coverage_misses", """
SELECT phrase, count(*) AS n FROM holdout_attributes WHERE phrase NOT IN (SELECT phrase FROM covered) GROUP BY phrase ORDER BY n DESC, phrase LIMIT 50""",
       ("holdout_attributes", "covered"))
def coverage_misses(spark, sf):
    attrs, terms = _coverage_inputs(spark, sf)
    return demand.top_uncovered(attrs, terms, 50)


# ---------------------------------------------------------------- contexts
cte("hits", f"""
SELECT term, id, i - 1 AS pos, side, tradition, CASE WHEN side = 'seeker' THEN 'seeker' ELSE 'church:' || coalesce(tradition, 'unlabeled') END AS grp,
  len([x FOR x IN toks[greatest(1, i - 3):i - 1] IF x IN ({D.NEG_SQL}) OR x LIKE '%n''t']) > 0 AS negated,
  array_to_string(toks[greatest(1, i - 12):i + n + 11], ' ') AS text,
  list_distinct(list_concat(toks[greatest(1, i - 10):i - 1], toks[i + n:i + n + 9])) AS around
FROM (SELECT d.id, d.side, d.tradition, d.toks, d.i, s.term, s.n FROM (
   SELECT id, side, tradition, toks, unnest(range(1, len(toks) + 1)) AS i FROM docs WHERE NOT holdout) d
  JOIN (SELECT term, len(string_split(term, ' ')) AS n, string_split(term, ' ') AS t FROM shortlist) s
  ON s.t[1] = d.toks[d.i] AND array_to_string(d.toks[d.i:d.i + s.n - 1], ' ') = s.term)
""", "docs", "shortlist")
cte("occurrences", """
SELECT s.term, coalesce(h.count, 0) AS count, coalesce(h.seeker, 0) AS seeker, coalesce(h.church, 0) AS church, coalesce(h.docs, 0) AS docs,
       coalesce(h.negated, 0) AS negated, coalesce(h.negated / h.count, 0.0) AS negation_rate
FROM shortlist s LEFT JOIN (SELECT term, count(*) AS count, count(*) FILTER (side = 'seeker') AS seeker, count(*) FILTER (side = 'church') AS church,
  count(DISTINCT id) AS docs, count(*) FILTER (negated) AS negated FROM hits GROUP BY term) h USING (term)
""", "hits", "shortlist")
cte("sampled", """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY term ORDER BY pass_no, grp) AS pick_no FROM (
    SELECT *, row_number() OVER (PARTITION BY term, grp ORDER BY sha1('13|' || id || '|' || pos), id, pos) AS pass_no FROM hits)
  WHERE pass_no <= 40) WHERE pick_no <= 40
""", "hits")
cte("cooc", "SELECT term, o AS observable, count(*) AS cooc FROM (SELECT term, unnest(around) AS o FROM hits) WHERE o IN (SELECT observable FROM observables) GROUP BY ALL",
    "hits", "observables")
cte("observable_totals", """
SELECT t AS observable, count(*) AS total FROM (SELECT unnest(toks) AS t FROM docs WHERE NOT holdout) WHERE t IN (SELECT observable FROM observables) GROUP BY t
""", "docs", "observables")
cte("grounded", """
SELECT term, rank, observable, cooc, log2_lift FROM (
 SELECT *, row_number() OVER (PARTITION BY term ORDER BY log2_lift DESC, cooc DESC, observable) AS rank FROM (
  SELECT term, observable, cooc, round(log2(lift), 3) AS log2_lift FROM (
   SELECT c.term, c.observable, c.cooc, (c.cooc / o.count) / least(1.0, 2 * 10 * t.total / (SELECT sum(len(toks)) FROM docs WHERE NOT holdout)) AS lift
   FROM cooc c JOIN observable_totals t USING (observable) JOIN occurrences o ON o.term = c.term WHERE c.cooc >= 3 AND o.count > 0) WHERE lift > 1)) WHERE rank <= 8
""", "cooc", "observable_totals", "occurrences", "docs")


def _hits(m):
    return contexts.phrase_hits(m.docs, m.shortlist)


def _sample(m, hits=None):
    return contexts.context_sample(_hits(m) if hits is None else hits, docs=m.docs)


@query("term_occurrences", "SELECT term, count, seeker, church, docs, negated, round(negation_rate, 4) AS negation_rate FROM occurrences", ("occurrences",))
def term_occurrences(spark, sf):
    m = Mining(spark, sf)
    return contexts.occurrences(_hits(m), m.shortlist).withColumn("negation_rate", rounded(F.col("negation_rate"), 4))


@query("term_traditions", """
SELECT term, tradition, count(*) AS count FROM hits WHERE side = 'church' AND tradition IS NOT NULL GROUP BY ALL""", ("hits",))
def term_traditions(spark, sf):
    return contexts.term_traditions(_hits(Mining(spark, sf)))


@query("kwic_contexts", "SELECT term, pick_no, grp, tradition, side, negated, text, id, pos::BIGINT AS pos FROM sampled", ("sampled",))
def kwic_contexts(spark, sf):
    s = _sample(Mining(spark, sf))
    return s.select("term", F.col("pick_no").cast("long").alias("pick_no"), "grp", "tradition", "side", "negated", "text", "id", F.col("pos").cast("long").alias("pos"))


@query("cooccurrence", "SELECT term, observable, cooc FROM cooc", ("cooc",))
def cooccurrence(spark, sf):
    return contexts.cooccurrence(_hits(Mining(spark, sf)), D.observables(spark, sf))


@query("observable_totals", "SELECT observable, total FROM observable_totals", ("observable_totals",))
def observable_totals(spark, sf):
    return contexts.observable_totals(D.docs(spark, sf), D.observables(spark, sf))


def _grounding(m, hits):
    """`hits` are counted; the words around are read from the documents."""
    occ = contexts.occurrences(hits, m.shortlist)
    obs = D.observables(m.spark, m.sf)
    return contexts.grounding(occ, contexts.cooccurrence(_hits(m), obs), contexts.observable_totals(m.docs, obs), m.docs)


@query("grounding_lift", "SELECT term, rank, observable, cooc, log2_lift FROM grounded", ("grounded",))
def grounding_lift(spark, sf):
    m = Mining(spark, sf)
    return _grounding(m, _hits(m)).withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- stance and rank
cte("stances", """
SELECT term, grp, CASE WHEN negated THEN 'critical' WHEN
  (('0x' || substr(md5(text), 1, 8))::UBIGINT % 3 + ('0x' || substr(md5(text), 9, 8))::UBIGINT % 3 + ('0x' || substr(md5(text), 17, 8))::UBIGINT % 3
   + ('0x' || substr(md5(text), 25, 8))::UBIGINT % 3) % 3 = 1 THEN 'neutral' ELSE 'approving' END AS stance FROM sampled
""", "sampled")
cte("stance_scores", """
SELECT term, sum(n)::BIGINT AS n, sum(app)::BIGINT AS approving, sum(cri)::BIGINT AS critical,
  CASE WHEN sum(n) >= 4 THEN 2 * least(sum(app) / sum(n), sum(cri) / sum(n)) END AS contestedness,
  CASE WHEN sum(n) >= 4 THEN CASE WHEN count(*) FILTER (n >= 3) >= 2 THEN max(app / n) FILTER (n >= 3) - min(app / n) FILTER (n >= 3) ELSE 0.0 END END AS tradition_split
FROM (SELECT term, grp, count(*) AS n, count(*) FILTER (stance = 'approving') AS app, count(*) FILTER (stance = 'critical') AS cri FROM stances GROUP BY ALL) GROUP BY term
""", "stances")


def _stance(sample):
    from tessera.operators.responses import stand_in_stance
    return signals.stance(sample.select("term", "grp", stand_in_stance(F.col("text"), F.col("negated")).alias("stance")))


@query("term_stance", """
SELECT term, n, approving, critical, round(contestedness, 4) AS contestedness, round(tradition_split, 4) AS tradition_split FROM stance_scores""", ("stance_scores",))
def term_stance(spark, sf):
    s = _stance(_sample(Mining(spark, sf)))
    return s.select("term", "n", "approving", "critical", rounded(F.col("contestedness"), 4).alias("contestedness"),
                    rounded(F.col("tradition_split"), 4).alias("tradition_split"))


# ---------------------------------------------------------------- senses
SENSE_DIMS, LEAST_CONTEXTS = 64, 12
cte("sense_sample", "SELECT term, pick_no AS item, CASE WHEN side = 'church' AND tradition IS NOT NULL THEN grp END AS grp, text FROM sampled", "sampled")
cte("sense_many", f"SELECT term FROM sense_sample GROUP BY term HAVING count(*) >= {LEAST_CONTEXTS}", "sense_sample")
cte("sense_texts", "SELECT term, item, text FROM sense_sample WHERE term IN (SELECT term FROM sense_many)", "sense_sample", "sense_many")
cte("sense_points", senses.sql_hashed("string_split(text, ' ')", "term, item", "sense_texts", SENSE_DIMS), "sense_texts")
for _name, _body, _needs in [*senses.sql_clusters("sense", "sense_points", [2, 3, 4]), *senses.sql_senses("sense", "sense_sample", LEAST_CONTEXTS)]:
    cte(_name, _body, *_needs)
cte("sense_means", """
SELECT term, grp, list(v ORDER BY i) AS v FROM (SELECT term, grp, i, avg(v) AS v, count(*) AS n FROM (
 SELECT term, grp, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM sense_points JOIN sense_sample USING (term, item) WHERE grp IS NOT NULL) GROUP BY ALL) WHERE n >= 5 GROUP BY ALL""",
    "sense_points", "sense_sample")
cte("sense_drift", """
SELECT term, round(round(greatest(0.0, max(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9))), 9), 4) AS drift
FROM sense_means a JOIN sense_means b USING (term) GROUP BY term""", "sense_means")


def _sense_vectors(sample):
    church = (F.col("side") == "church") & F.col("tradition").isNotNull()
    return sample.select("term", F.col("pick_no").alias("item"), F.when(church, F.col("grp")).alias("grp"), signals.hash_embedding(X.tokens(F.col("text")), SENSE_DIMS).alias("embedding"))


def _senses(sample):
    """Sampled vectors, sense clusters and drift; drift of terms with enough contexts only."""
    from tessera.session import stage
    vectors = stage(_sense_vectors(sample), "vectors")
    found = stage(senses.sense_clusters(vectors, 2, 4, LEAST_CONTEXTS), "senses")
    many = found.filter(F.col("n") >= LEAST_CONTEXTS).select("term")
    fixed = vectors.join(many, "term", "left_semi").withColumn("x", senses.fixed_point(F.col("embedding")))
    drift = signals.group_drift(fixed, "term", "grp", "x")
    return vectors, found, drift.select("term", rounded(F.col("drift"), 4).alias("drift"))


@query("sense_agreement", """
WITH m AS (SELECT term, grp AS a, cluster AS b FROM sense_labels JOIN sense_best USING (term) JOIN sense_sample USING (term, item) WHERE k = best_k AND grp IS NOT NULL),
 j AS (SELECT term, a, b, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT term, sum(n) AS nn FROM j GROUP BY term),
 ha AS (SELECT term, sum(-(n / nn) * ln(n / nn)) AS h, count(*) AS k FROM (SELECT term, a, sum(n) AS n FROM j GROUP BY ALL) JOIN t USING (term) GROUP BY term),
 hb AS (SELECT term, sum(-(n / nn) * ln(n / nn)) AS h FROM (SELECT term, b, sum(n) AS n FROM j GROUP BY ALL) JOIN t USING (term) GROUP BY term),
 hab AS (SELECT term, sum(-(n / nn) * ln(n / nn)) AS h FROM j JOIN t USING (term) GROUP BY term)
SELECT term, nn::BIGINT AS n, round(abs(CASE WHEN ha.k >= 2 AND nn >= 6 AND ha.h + hb.h > 0 THEN (ha.h + hb.h - hab.h) / ((ha.h + hb.h) / 2) ELSE 0.0 END), 6) AS nmi
FROM t JOIN ha USING (term) JOIN hb USING (term) JOIN hab USING (term)""", ("sense_labels", "sense_best", "sense_sample"))
def sense_agreement(spark, sf):
    """Agreement of sense clusters and traditions per term."""
    vectors, found, _ = _senses(_sample(Mining(spark, sf)))
    own = found.select("term", F.inline("members")).select("term", F.col("item").cast("int").alias("item"), F.col("cluster").alias("b"))
    d = vectors.select("term", "item", F.col("grp").alias("a")).join(own, ["term", "item"])
    return signals.normalized_mutual_information(d, ["term"], "a", "b").select("term", F.col("n").cast("long").alias("n"), F.abs(rounded(F.col("nmi"), 6)).alias("nmi"))


@query("kmeans_senses", "SELECT term, n, polysemy, best_k FROM sense_best", ("sense_best",))
def kmeans_senses(spark, sf):
    """Sense clusters per term over a capped sample of hashed contexts."""
    sample = _sample(Mining(spark, sf))
    found = senses.sense_clusters(_sense_vectors(sample), 2, 4, LEAST_CONTEXTS)
    return found.select("term", F.col("n").cast("long").alias("n"), "polysemy", F.col("best_k").cast("long").alias("best_k"))


cte("merged", """
SELECT s.term, s.reason, s.reason = 'seed' OR coalesce(c.seed, FALSE) AS seed, coalesce(o.count, 0) AS count, coalesce(o.seeker, 0) AS seeker_count,
  coalesce(o.church, 0) AS church_count, coalesce(p.count, 0) AS requests, coalesce(p.want, 0) AS want, coalesce(p.avoid, 0) AS avoid,
  coalesce(m.z_english, 0.0) AS z_english, m.top_tradition, coalesce(m.top_tradition_z, 0.0) AS top_tradition_z, st.contestedness, o.negation_rate,
  sb.polysemy, sd.drift, floor((0.35 * coalesce(sb.polysemy, 0) + 0.25 * coalesce(sd.drift, 0) + 0.25 * coalesce(st.contestedness, 0) + 0.15 * coalesce(o.negation_rate, 0)) * 10000 + 0.5 + 1e-6) / 10000 AS ambiguity_raw
FROM shortlist s LEFT JOIN candidates c USING (term) LEFT JOIN occurrences o USING (term) LEFT JOIN markers m USING (term)
LEFT JOIN phrases p ON p.phrase = s.term LEFT JOIN stance_scores st USING (term) LEFT JOIN sense_best sb USING (term) LEFT JOIN sense_drift sd USING (term)
""", "shortlist", "candidates", "occurrences", "markers", "phrases", "stance_scores", "sense_best", "sense_drift")
cte("ranked", """
SELECT *, row_number() OVER (ORDER BY score DESC, term) AS rank FROM (
 SELECT *, round((d - avg(d) OVER ()) / stddev_pop(d) OVER () + 0.6 * (z_english - avg(z_english) OVER ()) / stddev_pop(z_english) OVER ()
   + CASE WHEN stddev_pop(ambiguity_raw) OVER () > 1e-12 THEN (ambiguity_raw - avg(ambiguity_raw) OVER ()) / stddev_pop(ambiguity_raw) OVER () ELSE 0 END
   + 0.5 * seed::INT, 4) AS score FROM (SELECT *, ln(1 + requests + seeker_count) AS d FROM merged))
""", "merged")


def ranked(m: Mining):
    """Ranked terms, hits and sample."""
    from tessera.session import stage
    hits = stage(_hits(m).drop("text", "around"), "hits")
    sample = stage(_sample(m, hits), "sample")
    occ = contexts.occurrences(hits, m.shortlist)
    _, found, drift = _senses(sample)
    merged = ranking.merge_signals(m.shortlist, m.candidates, m.markers, occ, m.phrases, found, drift, _stance(sample))
    return ranking.rank_terms(stage(merged, "merged")), hits, sample


@query("ranked_terms", """
SELECT rank, term, reason, seed, count, requests AS seeker_requests, want AS seeker_want, avoid AS seeker_avoid, z_english, top_tradition,
  round(contestedness, 4) AS contestedness, ambiguity_raw, score FROM ranked""", ("ranked",))
def ranked_terms(spark, sf):
    r, _, _ = ranked(Mining(spark, sf))
    return r.select("rank", "term", "reason", "seed", "count", "seeker_requests", "seeker_want", "seeker_avoid", "z_english", "top_tradition",
                    rounded(F.col("contestedness"), 4).alias("contestedness"), "ambiguity_raw", "score")


@query("ranked_terms_whole", """
SELECT rank, term, reason, seed, count, z_english, polysemy, drift, round(contestedness, 4) AS contestedness, round(negation_rate, 4) AS negation_rate, ambiguity_raw, score FROM ranked""", ("ranked",))
def ranked_terms_whole(spark, sf):
    """The signals of the ambiguity beside the rank."""
    r, _, _ = ranked(Mining(spark, sf))
    return r.select("rank", "term", "reason", "seed", "count", "z_english", "polysemy", "drift", rounded(F.col("contestedness"), 4).alias("contestedness"),
                    rounded(F.col("negation_rate"), 4).alias("negation_rate"), "ambiguity_raw", "score")


@query("draft_list", "SELECT term, rank, seed, count FROM ranked WHERE rank <= 150 OR (seed AND count >= 3)", ("ranked",))
def draft_list(spark, sf):
    r, _, _ = ranked(Mining(spark, sf))
    return ranking.draft_list(r).select("term", "rank", "seed", "count")


@query("report_top_terms", """
SELECT 'contestedness' AS metric, term, round(contestedness, 4) AS value FROM (SELECT * FROM ranked WHERE contestedness IS NOT NULL ORDER BY contestedness DESC, rank LIMIT 15)
UNION ALL SELECT 'negation_rate', term, round(negation_rate, 4) FROM (SELECT * FROM ranked ORDER BY negation_rate DESC, rank LIMIT 15)
UNION ALL SELECT 'top_tradition_z', term, top_tradition_z FROM (SELECT * FROM ranked WHERE top_tradition IS NOT NULL ORDER BY top_tradition_z DESC, rank LIMIT 20)""", ("ranked",))
def report_top_terms(spark, sf):
    from tessera.session import stage
    r = stage(ranked(Mining(spark, sf))[0], "ranked")
    long = lambda d, m: d.select(F.lit(m).alias("metric"), "term", rounded(F.col(m), 4).alias("value"))
    return (long(ranking.top_by(r, "contestedness"), "contestedness").unionByName(long(ranking.top_by(r, "negation_rate"), "negation_rate"))
            .unionByName(long(ranking.top_by(r.filter("top_tradition is not null"), "top_tradition_z", 20), "top_tradition_z")))


cte("trad_text", """SELECT term, string_agg(tradition || ':' || c, ', ' ORDER BY c DESC, tradition) AS trad FROM (
 SELECT term, tradition, count(*) AS c FROM hits WHERE side = 'church' AND tradition IS NOT NULL GROUP BY ALL) GROUP BY term""", "hits")
cte("obs_text", "SELECT term, string_agg(observable || ' (x' || cooc || ')', ', ' ORDER BY rank) AS obs FROM grounded GROUP BY term", "grounded")
cte("ctx_text", "SELECT term, string_agg('[' || grp || '] ...' || text || '...', chr(10) ORDER BY pick_no) AS ctx FROM sampled WHERE pick_no <= 8 GROUP BY term", "sampled")


@query("evidence_blocks", """
SELECT r.term, concat_ws(chr(10), 'TERM: "' || r.term || '"',
 'Corpus count: ' || count || ' (seeker-side ' || seeker_count || ', church-side ' || church_count || ')',
 'Seekers asked for it ' || want || 'x and asked to avoid it ' || avoid || 'x',
 'Church-side use by tradition: ' || coalesce(trad, 'none'),
 'Most distinctive of tradition: ' || coalesce(top_tradition, 'None') || ' (z=' || top_tradition_z || ')',
 'Co-occurring observable words: ' || coalesce(obs, 'none measured'), '', 'SAMPLE CONTEXTS:', coalesce(ctx, '(none in corpus)')) AS text
FROM ranked r LEFT JOIN trad_text USING (term) LEFT JOIN obs_text USING (term) LEFT JOIN ctx_text USING (term)""", ("ranked", "trad_text", "obs_text", "ctx_text"))
def evidence_blocks(spark, sf):
    m = Mining(spark, sf)
    r, hits, sample = ranked(m)
    return ranking.evidence_blocks(r, contexts.term_traditions(hits), _grounding(m, hits), sample)


@query("top_keywords", """
SELECT term, n::BIGINT AS n, count, round(npmi, 4) AS npmi, seeker, church, doc_freq, n_sources FROM candidates ORDER BY count DESC, term LIMIT 50""", ("candidates",))
def top_keywords(spark, sf):
    c = Mining(spark, sf).candidates.orderBy(F.desc("count"), "term").limit(50)
    return c.select("term", F.col("n").cast("long").alias("n"), "count", rounded(F.col("npmi"), 4).alias("npmi"), "seeker", "church", "doc_freq", "n_sources")
