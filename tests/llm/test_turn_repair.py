"""Against a search over whole audits, row by row, without tables of costs."""

import hashlib
import heapq
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries as Q
from tessera.llm import turn_repair as R

WORD = re.compile("[^\x20\x09-\x0D]")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def plain_repair(rows):
    """rows: role and text in order. Cheapest first, then least audit: a queue of whole audits, so the first end is the answer."""
    kinds, seen = [], set()
    for role, text in rows:
        chars = WORD.findall(text)
        kinds.append("blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, closed = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, made = heapq.heappop(queue)
        state = roles[-1:]
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, made, kinds
        if (i, state) in closed:
            continue
        closed.add((i, state))
        step = lambda c, letter, j, add, row: heapq.heappush(queue, (cost + c, audit + letter, j, roles + add, made + row))
        fits = lambda x: x == "s" and not roles or x == "u" and state in ("", "s", "a") or x == "a" and state == "u"
        for name in ("user", "assistant"):
            if fits(name[0]):
                step(2, "I", i, name[0], (f"{name}:",))
        if i < len(rows):
            role, text = rows[i]
            step(3, "D", i + 1, "", ())
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                if fits(role[:1]):
                    step(more, "K", i + 1, role[:1], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    if fits(name[0]):
                        step(2 + more, "R", i + 1, name[0], (f"{name}:{text}",))


def plain_row(rows):
    """Digest columns of the rows (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, made, kinds = plain_repair([r[1:] for r in rows])
    firsts = [r[1][:1] for r in rows]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:])), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def compare(got, rows):
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    got = {r[0]: tuple(r)[1:] for r in got}
    assert got.keys() == by_conv.keys()
    for c, own in by_conv.items():
        assert got[c] == plain_row(plain_damage(own)), c


def test_query_equals_the_search(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = Q.QUERIES["op12_turn_repair"](spark, d)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    compare(df.collect(), rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", "a.", "b", "c!", "d?", " "])), max_size=9))
def test_costs_and_paths_of_small_conversations(rows):
    cost, audit, made, kinds = plain_repair(rows)
    marks = np.array([{"blank": R.BLANK, "duplicate": R.REPEATED, "truncated": R.CUT_OFF, "": 0}[k] for k in kinds], np.int64)
    initials = np.array([R.INITIALS.get(r[:1], 0) for r, _ in rows], np.int64)
    sizes = np.array([0, len(rows)], np.int64)
    left = R.costs(initials, marks, sizes)
    path, letters = R.least_paths(R.optimal_arcs(left, initials, marks, sizes), np.array([4]))
    assert left[1, 0] == cost and "".join(R.LETTERS[x] for x in letters) == audit


def test_random_conversations_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "BUCKET_ROWS", 100)
    rng, rows = np.random.default_rng(8), []
    for conv in range(120):
        for turn in range(int(rng.integers(1, 40)) if conv else 1500):
            rows.append((conv - 50, turn + 2 * int(rng.integers(0, 2)) * (turn % 7 == 0) * 100, ["system", "user", "assistant", "tool", None][rng.choice(5, p=[.05, .45, .45, .03, .02])],
                         [f"line {turn}.", "again!", "no end", "", None][rng.choice(5, p=[.6, .1, .2, .05, .05])]))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    compare(R.audits(R.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))).collect(), rows)


def test_repaired_turns_are_what_the_digest_covers(spark):
    t = spark.createDataFrame([(1, 0, "assistant", "hi."), (1, 1, "assistant", "you."), (1, 2, "user", "x"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    made = {}
    for r in sorted(R.repaired_turns(t).collect()):
        made.setdefault(r.conv_id, []).append((r.nr, r.role, r.text))
    digests = {r.conv_id: r for r in R.audits(t).collect()}
    assert [n for n, _, _ in made[1]] == list(range(len(made[1]))) and 2 not in made
    for c, d in digests.items():
        assert d.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in made.get(c, [])).encode()).hexdigest()
    assert digests[2].audit == "D" and digests[2].cost == 3


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (5, None, "user", "b."), (5, None, "user", "b."), (5, 1, "assistant", "c" * 300000 + "."), (6, 2, "", "x"), (7, 0, "user", "ñ?  \n")]
    rows += [(c, 0, "user", "z") for c in range(1000, 1100)]       # one in twenty is left without rows
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn int, role string, text string, mark string")
    compare(R.audits(R.damaged(df)).collect(), rows)
    assert R.audits(R.damaged(df.limit(0))).collect() == []
