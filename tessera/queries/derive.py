"""Domain tables derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as V
from tessera.functions import text as X
from tessera.functions.columns import stable_fraction
from tessera.operators import corpus, demand, grams, keyness, ranking, shortlist
from tessera.queries.registry import cte, table
from tessera.session import stage, unstage

# ---------------------------------------------------------------- SQL pieces
quote = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
STOP_SQL = quote(V.STOPWORDS)
NEG_SQL = quote(V.NEGATORS)


def sql_normalize(x):
    return f"""translate(replace({x}, '—', ' - '), '’‘“”–', '''''""-')"""


def sql_tokens(x):
    return f"""regexp_extract_all(lower({sql_normalize(x)}), '[a-z0-9]+(?:[''-][a-z0-9]+)*')"""


def sql_strip(x):
    return rf"""regexp_replace({x}, '^\s+|\s+$', '', 'g')"""


def sql_scrub(x):
    x = rf"""regexp_replace({x}, '(?i)https?://\S+|www\.\S+', ' [url] ', 'g')"""
    x = rf"""regexp_replace({x}, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b', ' [email] ', 'g')"""
    x = rf"""regexp_replace({x}, '(^|[^\pL\pN_@])@[\pL\pN_]{{2,}}', '\1 [user] ', 'g')"""
    x = rf"""regexp_replace({x}, '(?:\+?1[\s.-]?)?\(?\d{{3}}\)?[\s.-]?\d{{3}}[\s.-]?\d{{4}}\b', ' [phone] ', 'g')"""
    return sql_strip(rf"""regexp_replace({x}, '[ \t]+', ' ', 'g')""")


def sql_fraction(x):
    return f"('0x' || substr(sha1({x}), 1, 8))::UBIGINT::DOUBLE / 4294967295.0"


def sql_grams(toks, n):
    return f"[array_to_string({toks}[i:i + {n - 1}], ' ') for i in range(1, len({toks}) - {n} + 2)]" if n > 1 else toks


def sql_content(g):
    return (f"(split_part({g}, ' ', 1) NOT IN ({STOP_SQL}) AND string_split({g}, ' ')[-1] NOT IN ({STOP_SQL}) "
            f"AND NOT regexp_matches({g}, '^[0-9]+( [0-9]+)*$') AND NOT (instr({g}, ' ') = 0 AND length({g}) < 3))")


def sql_sentences(x):
    broken = rf"regexp_replace({sql_normalize(x)}, '([.!?])\s+|\n+', '\1' || chr(1), 'g')"
    return rf"[s FOR s IN [regexp_replace(p, '^\s+|\s+$', '', 'g') FOR p IN string_split({broken}, chr(1))] IF s <> '']"


# ---------------------------------------------------------------- corpus
SEEKER_SHARE = 0.3


def posts(spark, sf) -> DataFrame:
    """Documents (side by stable hash, language as tradition) and conversation turns (side by role)."""
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.when(stable_fraction(F.col("text")) < SEEKER_SHARE, "seeker").otherwise("church").alias("side"),
        F.col("lang").alias("tradition"), "source", F.lit(None).cast("string").alias("date"), "text", F.col("doc_id").alias("ord"))
    c = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.when(F.col("role") == "user", "seeker").when(F.col("role") == "assistant", "church").otherwise(F.col("role")).alias("side"),
        F.lit(None).cast("string").alias("tradition"), F.lit("conversations").alias("source"), F.lit(None).cast("string").alias("date"), "text",
        (F.lit(1_000_000_000_000) + F.col("conv_id") * 10000 + F.col("turn")).alias("ord"))
    return d.unionByName(c)


cte("posts", f"""
SELECT 'd' || doc_id AS id, CASE WHEN {sql_fraction('text')} < {SEEKER_SHARE} THEN 'seeker' ELSE 'church' END AS side,
       lang AS tradition, source, text, doc_id AS ord FROM documents
UNION ALL
SELECT 'c' || conv_id || '-' || turn, CASE role WHEN 'user' THEN 'seeker' WHEN 'assistant' THEN 'church' ELSE role END,
       NULL, 'conversations', text, 1000000000000 + conv_id * 10000 + turn FROM conversations
""")
cte("labelled", f"""
SELECT id, side, tradition, source, ord, text, toks,
       CASE WHEN text IS NULL THEN 'bad_row' WHEN len(toks) < 5 THEN 'short' ELSE 'kept' END AS fate,
       sha1(array_to_string(toks, ' ')) AS hash
FROM (SELECT *, {sql_tokens('text')} AS toks FROM (
  SELECT id, side, tradition, source, ord,
         CASE WHEN side IN ('seeker', 'church') AND trim(text) <> '' THEN {sql_scrub('trim(text)')} END AS text FROM posts))
""", "posts")
cte("docs", """
SELECT id, side, tradition, source, ord, text, toks, hash,
       side = 'seeker' AND ('0x' || substr(hash, 1, 8))::UBIGINT::DOUBLE / 4294967295.0 < 0.2 AS holdout
FROM labelled WHERE fate = 'kept' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ord) = 1
""", "labelled")


def docs(spark, sf) -> DataFrame:
    return corpus.clean_posts(posts(spark, sf))


def staged_docs(spark, sf, text: bool = True) -> DataFrame:
    """Clean documents as a stage table: text work is done once, later steps read tokens, and the text where it is kept."""
    labelled = corpus.labelled_rows(posts(spark, sf), text=text)
    out = stage(corpus.documents_of(labelled).select("id", "hash", "side", "tradition", "source", "ord", *(["text"] if text else []), "toks", "holdout"), "docs")
    unstage(labelled)
    return out


# ---------------------------------------------------------------- small word tables, from the texts of other tables
def seeds(spark, sf) -> DataFrame:
    """Long words of the benchmark passages."""
    return table(spark, sf, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 13).distinct()


cte("seeds", f"""SELECT DISTINCT term FROM (SELECT unnest({sql_tokens('text')}) AS term FROM benchmark) WHERE length(term) >= 13""")


def generic(spark, sf) -> DataFrame:
    """Words of system turns."""
    return table(spark, sf, "conversations").filter("role = 'system'").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()


cte("generic", f"""SELECT DISTINCT unnest({sql_tokens('text')}) AS term FROM conversations WHERE role = 'system'""")


def observables(spark, sf) -> DataFrame:
    """Middle-length words of the benchmark passages."""
    return table(spark, sf, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("observable")).filter(
        F.length("observable").between(5, 8)).distinct()


cte("observables", f"""SELECT DISTINCT observable FROM (SELECT unnest({sql_tokens('text')}) AS observable FROM benchmark)
WHERE length(observable) BETWEEN 5 AND 8""")


def reference_freq(spark, sf) -> DataFrame:
    """Word and word-pair shares in the stored pages, as the reference frequencies."""
    t = X.tokens(F.regexp_replace("html", "<[^>]*>", " "))
    d = table(spark, sf, "pages").select(t.alias("toks"))
    g = d.select(F.inline(F.concat(X.term_counts(F.col("toks")), X.term_counts(X.ngrams(F.col("toks"), 2)))))
    n = d.agg(F.sum(F.size("toks").cast("long"))).scalar().cast("double")
    return g.groupBy(F.col("gram").alias("term")).agg(F.sum("tf").alias("n")).select("term", (F.col("n") / n).alias("freq"))


cte("page_tokens", f"""SELECT {sql_tokens("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS toks FROM pages""")
cte("reference_freq", f"""
SELECT term, count(*)::DOUBLE / (SELECT sum(len(toks)) FROM page_tokens)::DOUBLE AS freq
FROM (SELECT unnest(toks) AS term FROM page_tokens UNION ALL SELECT unnest({sql_grams('toks', 2)}) FROM page_tokens) GROUP BY term
""", "page_tokens")

# ---------------------------------------------------------------- term mining chain
MAX_REF = 1e-3
cte("all_grams", f"""
SELECT coalesce(source, 'unknown') AS source, side, tradition, id, unnest(list_concat(list_concat(toks, {sql_grams('toks', 2)}), {sql_grams('toks', 3)})) AS gram
FROM docs WHERE NOT holdout
""", "docs")
cte("order_totals", """
SELECT sum(len(toks)) AS n1, sum(greatest(len(toks) - 1, 0)) AS n2, sum(greatest(len(toks) - 2, 0)) AS n3 FROM docs WHERE NOT holdout
""", "docs")
cte("doc_totals", """
SELECT 'all' AS scope, sum(len(toks))::BIGINT AS tokens, count(*) AS docs FROM docs WHERE NOT holdout
UNION ALL SELECT side, sum(len(toks))::BIGINT, count(*) FROM docs WHERE NOT holdout GROUP BY side
UNION ALL SELECT 't:' || tradition, sum(len(toks))::BIGINT, count(*) FROM docs
  WHERE NOT holdout AND side = 'church' AND tradition IS NOT NULL GROUP BY tradition
""", "docs")
cte("gram_sources", "SELECT gram, source, count(*) AS c FROM all_grams GROUP BY gram, source", "all_grams")
cte("gram_totals", """
SELECT g.gram, g.count, g.seeker, g.church, g.doc_freq, s.n_sources, s.top_source_share FROM
 (SELECT gram, count(*) AS count, count(*) FILTER (side = 'seeker') AS seeker, count(*) FILTER (side = 'church') AS church,
         count(DISTINCT id) AS doc_freq FROM all_grams GROUP BY gram) g
 JOIN (SELECT gram, count(*) AS n_sources, max(c)::DOUBLE / sum(c)::DOUBLE AS top_source_share FROM gram_sources GROUP BY gram) s USING (gram)
""", "all_grams", "gram_sources")
cte("scored_grams", f"""
SELECT t.*, len(string_split(t.gram, ' ')) AS n, s.term IS NOT NULL AS seed,
  CASE WHEN len(string_split(t.gram, ' ')) = 1 THEN 1.0 ELSE
   (SELECT CASE WHEN ln(t.count / tot) >= 0 THEN -1.0 ELSE (ln(t.count / tot) - lw) / (-ln(t.count / tot)) END) END AS npmi
FROM gram_totals t LEFT JOIN seeds s ON s.term = t.gram
LEFT JOIN (SELECT k.gram, sum(ln(u.count / (SELECT n1 FROM order_totals))) AS lw
           FROM (SELECT gram, unnest(string_split(gram, ' ')) AS word FROM gram_totals WHERE instr(gram, ' ') > 0 AND count >= 5) k
           JOIN gram_totals u ON u.gram = k.word GROUP BY k.gram) w ON w.gram = t.gram
LEFT JOIN (SELECT 1 AS n, n1 AS tot FROM order_totals UNION ALL SELECT 2, n2 FROM order_totals UNION ALL SELECT 3, n3 FROM order_totals) o
  ON o.n = len(string_split(t.gram, ' '))
WHERE s.term IS NOT NULL OR (t.count >= 5 AND {sql_content('t.gram')} AND t.n_sources >= 2)
""", "gram_totals", "order_totals", "seeds")
cte("candidates", """
SELECT gram AS term, n, count, npmi, seeker, church, doc_freq, n_sources, top_source_share, seed FROM scored_grams
WHERE seed OR n = 1 OR npmi >= 0.25
UNION ALL
SELECT term, 1, 0, 0.0, 0, 0, 0, 0, 0.0, TRUE FROM seeds WHERE term NOT IN (SELECT gram FROM gram_totals)
""", "scored_grams", "seeds", "gram_totals")
cte("source_tradition", """
SELECT coalesce(source, 'unknown') AS source, arg_min(tradition, ord) AS tradition FROM docs
WHERE NOT holdout AND tradition IS NOT NULL GROUP BY 1
""", "docs")
cte("gram_traditions", """
SELECT coalesce(a.gram, b.gram) AS gram, coalesce(a.tradition, b.tradition) AS tradition, coalesce(a.c, 0) AS count,
       coalesce(b.n, 0) AS n_sources, coalesce(b.top_share, 0.0) AS top_share
FROM (SELECT gram, tradition, count(*) AS c FROM all_grams WHERE side = 'church' AND tradition IS NOT NULL GROUP BY 1, 2) a
FULL JOIN (SELECT gram, t.tradition, count(*) AS n, max(c)::DOUBLE / sum(c)::DOUBLE AS top_share
           FROM gram_sources JOIN source_tradition t USING (source) GROUP BY 1, 2) b
ON a.gram = b.gram AND a.tradition = b.tradition
""", "all_grams", "gram_sources", "source_tradition")
cte("z_reference", """
SELECT term, f AS ref_freq, CASE WHEN y > 0 THEN
   (ln((y + a) / greatest(n + 500 - y - a, 1e-9)) - ln((r + a) / greatest(1e7 + 500 - r - a, 1e-9))) / sqrt(1 / (y + a) + 1 / (r + a))
   ELSE 0.0 END AS z_english
FROM (SELECT *, greatest(500 * (y + r) / (n + 1e7), 1e-6) AS a FROM (
  SELECT c.term, greatest(coalesce(rf.freq, 0), 1e-9) AS f, c.count::DOUBLE AS y, greatest(coalesce(rf.freq, 0), 1e-9) * 1e7 AS r,
         (SELECT tokens FROM doc_totals WHERE scope = 'all')::DOUBLE AS n
  FROM candidates c LEFT JOIN reference_freq rf USING (term)))
""", "candidates", "reference_freq", "doc_totals")
cte("z_tradition", """
SELECT term, tradition, n_sources, top_share,
  (ln((yi + a) / greatest(ni + 500 - yi - a, 1e-9)) - ln((yj + a) / greatest(nj + 500 - yj - a, 1e-9))) / sqrt(1 / (yi + a) + 1 / (yj + a)) AS z
FROM (SELECT *, greatest(500 * greatest(yall, 0.5) / nc, 1e-6) AS a, yall - yi AS yj, greatest(nc - ni, 1) AS nj FROM (
  SELECT c.term, t.tradition, t.ni, coalesce(g.count, 0)::DOUBLE AS yi, c.church::DOUBLE AS yall, coalesce(g.n_sources, 0) AS n_sources,
         coalesce(g.top_share, 0.0) AS top_share, (SELECT tokens FROM doc_totals WHERE scope = 'church')::DOUBLE AS nc
  FROM candidates c
  CROSS JOIN (SELECT substr(scope, 3) AS tradition, tokens::DOUBLE AS ni FROM doc_totals WHERE scope LIKE 't:%' AND docs >= 20) t
  LEFT JOIN gram_traditions g ON g.gram = c.term AND g.tradition = t.tradition))
""", "candidates", "doc_totals", "gram_traditions")
cte("markers", f"""
SELECT c.term, round(z.z_english, 3) AS z_english, z.ref_freq,
  CASE WHEN NOT (NOT c.seed AND (g.term IS NOT NULL OR z.ref_freq > {MAX_REF})) THEN b.top END AS top_tradition,
  CASE WHEN NOT (NOT c.seed AND (g.term IS NOT NULL OR z.ref_freq > {MAX_REF})) THEN coalesce(b.z, 0.0) ELSE 0.0 END AS top_tradition_z
FROM candidates c LEFT JOIN z_reference z USING (term) LEFT JOIN generic g USING (term)
LEFT JOIN (SELECT term, tradition AS top, round(z, 3) AS z FROM z_tradition WHERE n_sources >= 2 AND top_share <= 0.6
           QUALIFY row_number() OVER (PARTITION BY term ORDER BY round(z, 3) DESC, tradition DESC) = 1) b USING (term)
""", "candidates", "z_reference", "z_tradition", "generic")
cte("subsumed", """
SELECT s.term, l.term AS longer FROM candidates s JOIN
 (SELECT term, count, unnest(list_distinct(list_concat(string_split(term, ' '),
    CASE WHEN n = 3 THEN [array_to_string(string_split(term, ' ')[1:2], ' '), array_to_string(string_split(term, ' ')[2:3], ' ')] ELSE [] END))) AS part
  FROM candidates WHERE n > 1) l ON l.part = s.term
WHERE s.count > 0 AND l.count >= 0.8 * s.count
QUALIFY row_number() OVER (PARTITION BY s.term ORDER BY l.count DESC, l.term) = 1
""", "candidates")
cte("judged", f"""
SELECT c.*, z.z_english AS z_ref, CASE WHEN c.seed THEN NULL WHEN g.term IS NOT NULL THEN 'generic' WHEN z.ref_freq > {MAX_REF} THEN 'common_english'
  WHEN s.term IS NOT NULL THEN 'subsumed' WHEN c.top_source_share > 0.8 THEN 'one_source' END AS excluded
FROM candidates c LEFT JOIN generic g USING (term) LEFT JOIN z_reference z USING (term) LEFT JOIN subsumed s USING (term)
""", "candidates", "generic", "z_reference", "subsumed")
REQUESTS = [r"\b(?:for|with|from) the\b", r"\bnot\b", r"\bwithout\b", r"\bpara\b", r"\bpour\b", r"\bmit\b"]
# RE2 knows only ASCII word borders, so the SQL spells them out
REQUESTS_SQL = r"(^|[^\pL\pN_])((for|with|from) the|not|without|para|pour|mit)($|[^\pL\pN_])"
FILLER = ["the", "for"]
cte("requests", rf"""
SELECT id AS doc, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS req_no, substr(s[i] || CASE WHEN i < len(s) THEN ' ' || s[i + 1] ELSE '' END, 1, 600) AS request
FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, {sql_sentences('text')} AS s FROM docs WHERE side = 'seeker' AND holdout = FALSE))
WHERE regexp_matches(s[i], '(?i){REQUESTS_SQL}')
""", "docs")


def _attribute_sql(src):
    def grams(n):
        return (f"SELECT doc, request, {n} AS n, i, array_to_string(t[i:i + {n - 1}], ' ') AS g, "
                f"len([x FOR x IN t[greatest(1, i - 3):i - 1] IF x IN ({NEG_SQL}) OR x LIKE '%n''t']) > 0 AS neg "
                f"FROM (SELECT doc, req_no, request, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM toks)")
    return f"""
SELECT doc, request, pos, g AS phrase, CASE WHEN neg THEN 'avoid' ELSE 'want' END AS polarity FROM (
  SELECT doc, request, g, neg, row_number() OVER (PARTITION BY doc, request_no ORDER BY n DESC, i) - 1 AS pos FROM (
    SELECT doc, request, req_no AS request_no, n, i, g, neg FROM (
      SELECT *, 2 AS n, array_to_string(t[i:i + 1], ' ') AS g, len([x FOR x IN t[greatest(1, i - 3):i - 1] IF x IN ({NEG_SQL}) OR x LIKE '%n''t']) > 0 AS neg
      FROM (SELECT doc, req_no, request, t, unnest(range(1, len(t))) AS i FROM (SELECT *, {sql_tokens('request')} AS t FROM {src}))
      UNION ALL
      SELECT *, 1 AS n, t[i] AS g, len([x FOR x IN t[greatest(1, i - 3):i - 1] IF x IN ({NEG_SQL}) OR x LIKE '%n''t']) > 0 AS neg
      FROM (SELECT doc, req_no, request, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT *, {sql_tokens('request')} AS t FROM {src})))
    WHERE {sql_content('g')} AND g NOT IN ({quote(FILLER)}))) WHERE pos < 8
"""


cte("attributes", _attribute_sql("requests"), "requests")
cte("phrases", """
SELECT phrase, count(*) AS count, count(*) FILTER (polarity = 'want') AS want, count(*) FILTER (polarity = 'avoid') AS avoid, 'culture' AS category
FROM attributes GROUP BY phrase
""", "attributes")
SHORTLIST = 200
cte("shortlist_scores", """
SELECT term, seed, round((d - avg(d) OVER ()) / stddev_pop(d) OVER () + (z - avg(z) OVER ()) / stddev_pop(z) OVER () + seed::INT, 9) AS score FROM (
  SELECT j.term, j.seed, ln(1 + coalesce(p.count, 0) + j.seeker) AS d, coalesce(j.z_ref, 0) AS z
  FROM judged j LEFT JOIN phrases p ON p.phrase = j.term WHERE excluded IS NULL)
""", "judged", "phrases")
cte("shortlist", f"""
SELECT term, CASE prio WHEN 1 THEN 'seed' WHEN 2 THEN 'seeker_phrase' ELSE 'score' END AS reason FROM (
  SELECT term, min(prio) AS prio, max(score) AS score FROM (
    SELECT term, CASE WHEN seed THEN 1 ELSE 3 END AS prio, score FROM shortlist_scores
    UNION ALL
    SELECT phrase, 2, 0.0 FROM phrases WHERE count >= 2 AND phrase NOT IN (SELECT term FROM generic) AND phrase NOT IN (SELECT term FROM subsumed)
      AND phrase NOT IN (SELECT term FROM reference_freq WHERE freq > {MAX_REF})) GROUP BY term)
QUALIFY prio < 3 OR row_number() OVER (ORDER BY prio, score DESC, term DESC) <= {SHORTLIST}
""", "shortlist_scores", "phrases", "generic", "subsumed", "reference_freq")


class Mining:
    """The steps of term mining over one data folder, each built once and on demand."""

    def __init__(self, spark, sf):
        self.spark, self.sf, self._done = spark, sf, {}

    def _once(self, name, make):
        if name not in self._done:
            self._done[name] = make()
        return self._done[name]

    @property
    def docs(self):
        return self._once("docs", lambda: staged_docs(self.spark, self.sf))

    def _content_seeds(self) -> bool:
        """Whether no seed opens or ends on a stop word, so that such grams need not be counted."""
        return seeds(self.spark, self.sf).filter(~X.is_content(F.array_join(X.tokens(F.col("term")), " "))).isEmpty()

    @property
    def counts(self):
        return self._once("counts", lambda: stage(grams.possible_terms(grams.gram_counts(
            grams.source_grams(self.docs, 3, content_only=self._content_seeds())), seeds(self.spark, self.sf)), "counts"))

    @property
    def totals(self):
        return self._once("totals", lambda: grams.totals(self.docs))

    @property
    def candidates(self):
        return self._once("candidates", lambda: stage(grams.candidates(
            self.docs, seeds(self.spark, self.sf), min_sources=2, counts=self.counts), "candidates"))

    @property
    def reference(self):
        return self._once("reference", lambda: stage(reference_freq(self.spark, self.sf), "reference"))

    @property
    def ref_z(self):
        return self._once("ref_z", lambda: stage(keyness.reference_z(self.candidates, self.reference, self.totals), "reference_z"))

    @property
    def tradition_z(self):
        def make():
            by_trad = grams.tradition_counts(grams.source_grams(self.docs, 3, only=self.candidates), grams.source_traditions(self.docs))
            return keyness.tradition_z(self.candidates, by_trad, self.totals)
        return self._once("tradition_z", make)

    @property
    def markers(self):
        return self._once("markers", lambda: keyness.markers(
            self.candidates, self.ref_z, self.tradition_z, generic(self.spark, self.sf), MAX_REF, 2, 0.6))

    @property
    def subsumed(self):
        return self._once("subsumed", lambda: stage(shortlist.subsumed_terms(self.candidates), "subsumed"))

    @property
    def judged(self):
        return self._once("judged", lambda: shortlist.exclusions(
            self.candidates, generic(self.spark, self.sf), self.ref_z, self.subsumed, MAX_REF, 0.8))

    @property
    def requests(self):
        return self._once("requests", lambda: demand.mine_requests(self.docs.filter(~F.col("holdout")), REQUESTS))

    @property
    def attributes(self):
        return self._once("attributes", lambda: demand.attributes(self.requests, FILLER))

    @property
    def phrases(self):
        return self._once("phrases", lambda: stage(demand.phrase_demand(self.attributes), "phrases"))

    @property
    def shortlist(self):
        return self._once("shortlist", lambda: stage(shortlist.shortlist(
            self.judged, self.phrases, generic(self.spark, self.sf), self.reference, self.subsumed, SHORTLIST, MAX_REF), "shortlist"))
