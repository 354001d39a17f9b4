import random

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions.fuzzy import indel_ratio, lcs_length, partial_reaches
from tessera.operators import names


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_against_the_table_method():
    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choice("abcd ") for _ in range(r.randint(0, 20)))
        b = "".join(r.choice("abcd ") for _ in range(r.randint(0, 20)))
        assert lcs_length(a, b) == slow_lcs(a, b)


def test_partial_against_all_stretches():
    r = random.Random(2)
    for _ in range(150):
        q = "".join(r.choice("abc ") for _ in range(r.randint(1, 12)))
        t = "".join(r.choice("abc ") for _ in range(r.randint(12, 40)))
        m = len(q)
        stretches = [t[max(0, i):i + m] for i in range(-(m - 1), len(t))]
        assert partial_reaches(q, t, 90) == any(indel_ratio(q, s) >= 90 for s in stretches if s)


def test_near_pairs_lose_nothing(spark):
    r = random.Random(3)
    words = ["baptist", "grace", "covenant", "lutheran", "synod", "free", "bible", "hope", "trinity"]

    def name():
        n = " ".join(r.choice(words) for _ in range(r.randint(2, 3)))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(n))
            n = n[:i] + r.choice(["", "x", n[i] + "e"]) + n[i + 1:]
        return " ".join(n.split())
    left, right = sorted({name() for _ in range(60)}), sorted({name() for _ in range(60)})
    got = {(x["a"], x["b"]) for x in names.near_pairs(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string")).collect()}
    s = lambda x: " ".join(sorted(x.split()))
    want = {(a, b) for a in left for b in right if indel_ratio(s(a), s(b)) >= 85}
    assert want and want <= got
    assert len(got) < len(left) * len(right) / 2


GROUPS = [("elca", "Evangelical Lutheran Church in America", 3_000_000.0), ("lcms", "Lutheran Church Missouri Synod", 1_800_000.0), ("wels", "Wisconsin Evangelical Lutheran Synod", 300_000.0),
          ("els", "Evangelical Lutheran Synod", 20_000.0), ("ag", "Assemblies of God", 3_000_000.0), ("free", "Evangelical Free Bible Covenant", 10_000.0)]
ALIASES = [("ELCA", "elca"), ("AG", "ag"), ("Missouri Synod", "lcms"), ("Assemblies of God", "ag"), ("Assembly of God", "ag")]


def tables(spark):
    g = spark.createDataFrame(GROUPS, "group_id string, known_name string, adherents double")
    a = spark.createDataFrame(ALIASES, "alias string, group_id string").unionByName(g.select(F.col("known_name").alias("alias"), "group_id"))
    return a, g


def found(spark, *texts):
    a, g = tables(spark)
    rows = names.find_groups(spark.createDataFrame([(t,) for t in texts], "name string"), a, g).orderBy("name", "rn").collect()
    out = {}
    for r in rows:
        out.setdefault(r["name"], []).append((r["group_id"], r["score"]))
    return out


def test_find_scores(spark):
    got = found(spark, "St. Paul ELCA", "AGAPE Chapel", "Hope Assembly of God", "assemblies of god", "Trinity Lutheran Church", "Evangelical Free Bible Covenent", "nothing here")
    assert got["St. Paul ELCA"][0] == ("elca", 100.0)
    assert "AGAPE Chapel" not in got                    # an abbreviation is a whole token
    assert got["Hope Assembly of God"][0] == ("ag", 93.0)
    assert got["assemblies of god"][0] == ("ag", 100.0)
    assert [g for g, _ in got["Trinity Lutheran Church"]] == ["elca", "lcms", "wels"] and got["Trinity Lutheran Church"][0][1] == 70.0
    g, s = got["Evangelical Free Bible Covenent"][0]
    assert g == "free" and 76.5 <= s <= 90
    assert "nothing here" not in got


def test_resolve_cascade(spark):
    a, g = tables(spark)
    places = spark.createDataFrame([(1, "Hope ELCA", None), (2, "Trinity Lutheran", "ELCA"), (3, "City Independent Church", None), (4, "Plain House", None), (5, "Zion Lutheran", None)],
                                   "church_id int, name string, tag string")
    f = names.find_groups(places.select("name"), a, g)
    t = names.find_groups(places.filter("tag is not null").select(F.col("tag").alias("name")), a, g)
    site = spark.createDataFrame([(5, None, "Non-denominational", 0.85)], "church_id int, group_id string, label string, confidence double")
    got = {r["church_id"]: (r["group_id"], r["confidence"], r["method"]) for r in names.resolve(places, f, t, site).collect()}
    assert got[1] == ("elca", 0.9, "name") and got[2] == ("elca", 0.6, "name") and got[3] == (None, 0.8, "name")
    assert got[4] == (None, 0.4, "unknown") and got[5] == (None, 0.85, "website")


def test_place_reference_needs_one_hit(spark):
    p = spark.createDataFrame([(1, "a", "First Presbyterian Church"), (1, "b", "Grace Presbyterian"), (1, "c", "Hope Chapel")], "session_id int, church_id string, name string")
    r = spark.createDataFrame([(1, "first pres"), (1, "presbyterian"), (1, "hope")], "session_id int, ref string")
    assert {(x["ref"], x["church_id"]) for x in names.place_references(r, p).collect()} == {("first pres", "a"), ("hope", "c")}


def test_a_reference_lies_in_one_name(spark):
    """Words of two names of a place don't add up, and a place met twice is one."""
    p = spark.createDataFrame([(1, "a", "First House"), (1, "a", "Grace Hall"), (1, "b", "Hope Chapel"), (1, "b", "Hope Chapel")], "session_id int, church_id string, name string")
    r = spark.createDataFrame([(1, "first hall"), (1, "hope chapel"), (1, "hope chapel"), (1, "")], "session_id int, ref string")
    assert [tuple(x) for x in names.place_references(r, p).collect()] == [(1, "hope chapel", "b")]


def test_site_wording_and_labels(spark):
    pages = spark.createDataFrame([(1, "u1", "We are a non-denominational family of faith."), (2, "u2", "A Lutheran parish of the synod in town.")], "church_id int, url string, text string")
    r = names.site_affiliation(pages).collect()
    assert len(r) == 1 and r[0]["confidence"] == 0.85 and "non-denominational" in r[0]["quote"]
    ans = spark.createDataFrame([(2, "u2", "lcms", "x", 0.95, False, "Lutheran parish of the synod"), (1, "u1", "ag", "x", 0.9, False, "never said here at all")],
                                "church_id int, url string, group_id string, label string, confidence double, independent boolean, quote string")
    got = {x["church_id"]: (x["group_id"], x["confidence"]) for x in names.labelled_site_guess(ans, pages, tables(spark)[1]).collect()}
    assert got == {2: ("lcms", 0.9), 1: ("ag", 0.5)}


def test_bracketed_abbreviations_and_long_aliases(spark):
    long = "the united holy church of the living god and of all saints"
    a = spark.createDataFrame([("PC(USA)", "pcusa"), (long, "long"), ("AG", "ag"), ("C(", "open")], "alias string, group_id string")
    n = spark.createDataFrame([("First Presbyterian PC(USA)",), ("MyPC(USA)x",), (f"Old {long.upper()} Chapel",), ("AGAPE",), ("AG",), ("X C(Y)",)], "name string")
    got = {(r["name"], r["group_id"]): r["score"] for r in names.alias_matches(n, a).collect()}
    assert got == {("First Presbyterian PC(USA)", "pcusa"): 100.0, ("MyPC(USA)x", "pcusa"): 100.0, (f"Old {long.upper()} Chapel", "long"): 98.0, ("AG", "ag"): 100.0,
                   ("X C(Y)", "open"): 100.0, **({("First Presbyterian PC(USA)", "open"): 100.0, ("MyPC(USA)x", "open"): 100.0})}


def test_non_members_are_screened(spark):
    a = spark.createDataFrame([("Grace Hall", "g"), ("Kingdom Hall", "k"), ("JW", "jw")], "alias string, group_id string")
    g = spark.createDataFrame([("g", "Grace Hall", 10), ("k", "Kingdom Hall", 10), ("jw", "Witnesses", 10)], "group_id string, known_name string, adherents int")
    n = spark.createDataFrame([("Grace Hall",), ("Kingdom Hall",), ("JW",)], "name string")
    assert {r["group_id"] for r in names.find_groups(n, a, g, fuzzy=False).collect()} == {"g"}
    p = spark.createDataFrame([(1, "Kingdom Hall", None), (2, "Hope", "jw"), (3, "Hope", None), (4, None, "g")], "id int, name string, group_id string")
    assert {r["id"] for r in names.without_non_members(p).collect()} == {3, 4}
