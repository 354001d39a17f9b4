"""Whole pipelines: each step is a stage table, so a run can be stopped, inspected and resumed from its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import (contexts, corpus, demand, evidence, grams, keyness, knowledge, matching, names, profiles, ranking,
                               responses, retrieval, senses, shortlist, signals)
from tessera.session import stage

MINING = {"holdout": 0.2, "max_n": 3, "min_count": 5, "min_npmi": 0.25, "min_sources": 0, "max_source_share": 1.0, "n_ref": 1e7, "a0": 500.0,
          "min_docs": 20, "max_ref_freq": 1.5e-4, "subsume_ratio": 0.8, "shortlist": 300, "snippet": 12, "window": 10, "per_term": 40,
          "dims": 256, "top_n": 150}


def mine_terms(posts: DataFrame, seeds: DataFrame, reference: DataFrame, generic: DataFrame, observables: DataFrame,
               order=("ord",), config: dict | None = None, patterns=None) -> dict[str, DataFrame]:
    """Labelled posts -> ranked terms with every signal, plus the tables on the way.

    `reference`: (term, freq) general frequencies; `observables`: (observable).
    """
    c = {**MINING, **(config or {})}
    docs = stage(corpus.clean_posts(posts, c["holdout"], order=order), "docs")
    counts = stage(grams.possible_terms(grams.gram_counts(grams.source_grams(docs, c["max_n"])), seeds, c["min_count"]), "counts")
    cands = stage(grams.candidates(docs, seeds, c["max_n"], c["min_count"], c["min_npmi"], c["min_sources"], counts), "candidates")
    tot = stage(grams.totals(docs), "totals")
    ref = stage(keyness.reference_z(cands, reference, tot, c["n_ref"], c["a0"]), "reference_z")
    by_trad = grams.tradition_counts(grams.source_grams(docs, c["max_n"], only=cands), grams.source_traditions(docs, order[0]))
    tz = keyness.tradition_z(cands, by_trad, tot, c["min_docs"], c["a0"])
    marks = stage(keyness.markers(cands, ref, tz, generic, c["max_ref_freq"], c["min_sources"], c["max_source_share"]), "markers")
    requests = demand.mine_requests(docs.filter(~F.col("holdout")), patterns)
    phrases = stage(demand.phrase_demand(demand.attributes(requests)), "phrases")
    sub = stage(shortlist.subsumed_terms(cands, c["subsume_ratio"]), "subsumed")
    judged = shortlist.exclusions(cands, generic, ref, sub, c["max_ref_freq"], c["max_source_share"])
    short = stage(shortlist.shortlist(judged, phrases, generic, reference, sub, c["shortlist"], c["max_ref_freq"]), "shortlist")
    places = contexts.phrase_hits(docs, short, c["snippet"], c["window"])
    hits = stage(places.drop("text", "around"), "hits")
    occ = stage(contexts.occurrences(hits, short), "occurrences")
    sample = stage(contexts.context_sample(hits, c["per_term"], c["per_term"], docs=docs, snippet=c["snippet"]), "contexts")
    ground = stage(contexts.grounding(occ, contexts.cooccurrence(places, observables), contexts.observable_totals(docs, observables), docs, c["window"]), "grounding")
    labels = sample.select("term", "grp", responses.stand_in_stance(F.col("text"), F.col("negated")).alias("stance"))
    st = stage(signals.stance(labels), "stance")
    vectors = stage(sample.select("term", F.col("pick_no").alias("item"), F.when((F.col("side") == "church") & F.col("tradition").isNotNull(), F.col("grp")).alias("grp"),
                                  signals.hash_embedding(X.tokens(F.col("text")), c["dims"]).alias("embedding")), "vectors")
    clusters = stage(senses.sense_clusters(vectors), "senses")
    drift = signals.group_drift(vectors, "term", "grp")
    merged = stage(ranking.merge_signals(short, cands, marks, occ, phrases, clusters, drift, st), "merged")
    ranked = stage(ranking.rank_terms(merged), "ranked")
    held = demand.attributes(demand.mine_requests(docs.filter("holdout"), patterns))
    drafts = ranking.draft_list(ranked, c["top_n"])
    blocks = ranking.evidence_blocks(drafts, contexts.term_traditions(hits), ground, sample)
    return {"docs": docs, "candidates": cands, "markers": marks, "phrases": phrases, "shortlist": short, "occurrences": occ, "contexts": sample,
            "grounding": ground, "stance": st, "senses": clusters, "ranked": ranked, "drafts": drafts, "requests": blocks,
            "coverage": demand.coverage(held, drafts.select("term")), "uncovered": demand.top_uncovered(held, drafts.select("term"))}


def fill_knowledge(groups: DataFrame, cells: DataFrame, specs: DataFrame, docs: DataFrame, facts: DataFrame | None = None,
                   per_field: int = 4, fields_per_call: int = 5, max_excerpts: int = 8) -> dict[str, DataFrame]:
    """Source documents and a knowledge table -> passages, work list and request texts for every group at once.

    `docs`: (group_id, url, title, source_type, text).
    """
    chunks = stage(retrieval.chunk_documents(docs), "chunks")
    members = knowledge.member_flags(groups, cells)
    done = knowledge.graph_fills(facts, cells) if facts is not None else None
    work = stage(knowledge.work_list(cells, specs, members, done), "work")
    asked = work.filter(F.col("route").isin("extract", "validate")).join(specs.select("field_id", "keywords", "description"), "field_id")
    queries = asked.select("group_id", F.col("field_id").alias("query_id"), F.concat_ws(" ", "keywords", "description").alias("query"))
    hits = stage(retrieval.bm25(chunks, queries, per_field), "hits")
    batches = stage(retrieval.in_batches(asked, ["group_id", "route"], [F.col("field_id")], fields_per_call, F.ascii("field_id")).select(
        "group_id", "field_id", "route", F.concat_ws("-", "route", F.col("batch").cast("string")).alias("batch"), "pos"), "batches")
    found = hits.join(batches.select("group_id", F.col("field_id").alias("query_id"), "batch", "pos"), ["group_id", "query_id"])
    ex = found.groupBy("group_id", "batch", "url", "chunk_no").agg(F.min(F.struct("rank", "pos")).alias("o"))
    from tessera.operators.ordering import top_per_group
    ex = top_per_group(ex, ["group_id", "batch"], [F.col("o"), F.col("url"), F.col("chunk_no")], max_excerpts, "excerpt").drop("o")
    ex = stage(ex.join(chunks, ["group_id", "url", "chunk_no"]), "excerpts")
    na = work.filter("route = 'not_applicable'").select("group_id", "field_id", F.lit("not_applicable").alias("action"), F.lit("Not applicable").alias("new_value"))
    return {"chunks": chunks, "work": work, "hits": hits, "batches": batches, "excerpts": ex, "requests": responses.excerpt_blocks(ex), "not_applicable": na,
            "deterministic": done if done is not None else na.limit(0)}


def match_sessions(log: DataFrame, vocabulary: DataFrame, candidates: DataFrame, ev: DataFrame, denom: DataFrame | None = None,
                   priors: DataFrame | None = None, radius: float = 15.0, page_size: int = 10) -> dict[str, DataFrame]:
    """Preference logs, gathered candidates and evidence -> profiles, scores and the first table page, for all sessions at once.

    `candidates`: (session_id, church_id, name, distance_miles, ...); `denom`: (church_id, denomination_id).
    """
    prefs = stage(profiles.profiles(profiles.valid_ops(log, vocabulary), vocabulary), "preferences")
    best = evidence.best_evidence(ev)
    scored = stage(matching.score_pairs(candidates, matching.profile_arrays(prefs, vocabulary), matching.evidence_maps(best, "church_id", denom, priors)), "scored")
    return {"preferences": prefs, "scored": scored, "table": matching.ranked_table(scored, radius, 1, page_size),
            "settled": evidence.settled_features(ev)}


def resolve_places(places: DataFrame, aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """Affiliation of every place from its name and map tag, without places that the screens of candidates leave out."""
    by_name = stage(names.find_groups(places.select("name"), aliases, groups), "found")
    tags = places.filter("tag is not null").select(F.col("tag").alias("name"))
    found = names.resolve(places, by_name, names.find_groups(tags, aliases, groups))
    kept = names.without_non_members(found.join(places.select("church_id", "name"), "church_id"))
    return kept.select(*found.columns)
