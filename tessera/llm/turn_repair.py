"""Conversation structure repair: the cheapest edits that give system? (user assistant)+, least audit first.

An edit keeps a row (K, 0), gives it the role user or assistant (R, 2), deletes it (D, 3)
or inserts an empty row (I, 2); a truncated row that stays costs 1 more, blank and
repeated rows must go. A node is a place in a conversation and the state of the
grammar there. The cost DP runs from the last row to the first and knows what every
node still costs; arcs that meet this cost are optimal. One arc at most per letter
leaves a node, as the state decides which role comes next.

Among the optimal paths the audit, the letters of the edits in order, shall be least.
Nodes are ranked by the first letter of their least audit, then by the first 2, 4, 8 ...
letters: the rank for twice the length is the pair of the node's rank and that of
the node to which its doubled pointer leads. The ranks choose the arc of each node,
and the doubled pointers unfold the paths of all conversations at once.

Conversations are dealt into buckets of about `BUCKET_ROWS` rows. Every row is sent
twice in one shuffle: first the facts of all rows of a bucket, 40 bytes a turn, for
the DP; after them the texts in the same order, which stream through and are
never held. So a conversation of any length costs the memory of its facts.

Edge cases: a null role or text is one space; turns are ordered nulls first, ties by role, then
by a hash of the text; a null conv_id is a conversation; rows marked lost only name their
conversation; an empty table gives no rows; other columns are not read. A role is judged by its
first letter; an empty role has none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000
DAMAGES = 20

# Costs and roles.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"

LETTERS = "DIKR"                              # ascending, so arcs in this order are in the order of audits
START, SYSTEM, ASKED, ANSWERED = range(4)     # states: nothing, a system row, a user row, an assistant row came last
NEXT = np.array([ASKED, ASKED, ANSWERED, ASKED])          # by inserting or by a new role
KEPT = np.full((4, 4), -1)                                # by a kept row whose role starts with nothing known, s, u, a
KEPT[1, START], KEPT[2, [START, SYSTEM, ANSWERED]], KEPT[3, ASKED] = SYSTEM, ASKED, ANSWERED
INITIALS = {"s": 1, "u": 2, "a": 3}
BLANK, REPEATED, CUT_OFF, LOST = 1, 2, 3, 4
_FAR = 1 << 40


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage by the checksum of `conv_id:turn`, and of dropped ones the conversation alone, marked lost."""
    space = F.lit(" ")
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    t = t.withColumn("_d", F.crc32(name.cast("binary")) % DAMAGES)
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    t = t.select("conv_id", "turn", F.when(F.col("_d") == 4, USER).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_d") == 0).alias("lost"), "_d")
    return t.select("conv_id", "turn", "role", "text", "lost", F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _sent(turns: DataFrame) -> DataFrame:
    """Facts and texts of all rows, dealt into buckets and in order."""
    space, gap = F.lit(" "), "[^\\x20\\x09-\\x0D]"
    lost = F.col("lost") if "lost" in turns.columns else F.lit(False)
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                     F.coalesce(F.col("text").cast("string"), space).alias("text"), lost.alias("lost"))
    buckets = -(-turns.count() // BUCKET_ROWS) or 1
    mark = F.when(F.col("lost"), LOST).when(~F.col("text").rlike(gap), BLANK).when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), CUT_OFF).otherwise(0)
    t = t.select(F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).alias("bucket"), "conv_id", "turn", "role", "text", F.xxhash64("text").alias("tie"), mark.alias("mark"),
                 F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))).alias("same"))
    t = t.withColumn("phase", F.explode(F.when(F.col("mark") == LOST, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    facts = F.col("phase") == 0
    t = t.select("bucket", "phase", "conv_id", "turn", "role", "mark", F.when(facts, F.col("same")).alias("same"), F.when(~facts, F.col("text")).alias("text"), "tie")
    return t.repartition("bucket").sortWithinPartitions("bucket", "phase", "conv_id", "turn", "role", "tie").drop("tie")


def costs(initials: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What every node of all conversations still costs: a row of four states before each turn and after the last one.

    initials and marks of all turns, conversation after conversation; sizes: turns of each.
    """
    ends = np.cumsum(sizes + 1) - 1
    out = np.full((int((sizes + 1).sum()), 4), _FAR, np.int64)
    order = np.argsort(-sizes, kind="stable")
    for k in range(int(sizes.max(initial=0)) + 1):
        own = order[:np.searchsorted(-sizes[order], -k, "right")]
        at = ends[own] - k
        if k == 0:
            d = np.full((len(own), 4), _FAR, np.int64)
            d[:, [START, ANSWERED]] = 0
        else:
            rest, turn = out[at + 1], at - own
            d = rest + DELETE
            free = (marks[turn] == 0) | (marks[turn] == CUT_OFF)
            more = np.where(marks[turn] == CUT_OFF, TRUNCATED, 0)[:, None]
            goes = KEPT[initials[turn]]
            keep = np.where(goes >= 0, np.take_along_axis(rest, np.maximum(goes, 0), 1) + more + KEEP, _FAR)
            d = np.where(free[:, None], np.minimum(d, np.minimum(keep, rest[:, NEXT] + more + REROLE)), d)
        asked, answered = np.minimum(d[:, ASKED], d[:, ANSWERED] + INSERT), np.minimum(d[:, ANSWERED], d[:, ASKED] + INSERT)
        d[:, ASKED], d[:, ANSWERED] = asked, answered
        d[:, START], d[:, SYSTEM] = np.minimum(d[:, START], asked + INSERT), np.minimum(d[:, SYSTEM], asked + INSERT)
        out[at] = d
    return out


def optimal_arcs(left: np.ndarray, initials: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The node to which each letter leads from each node on an optimal path, or -1. Columns are the letters in order."""
    n = len(left)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    last = np.zeros(n, bool)
    last[np.cumsum(sizes + 1) - 1] = True
    turn = np.where(last, 0, np.arange(n) - owner)
    fact = (lambda x: x[turn] if len(x) else np.zeros(n, np.int64))
    free = ~last & np.isin(fact(marks), (0, CUT_OFF))
    more = np.where(fact(marks) == CUT_OFF, TRUNCATED, 0)
    below = np.vstack([left[1:], np.full((1, 4), _FAR)])
    node = np.arange(4 * n).reshape(n, 4)
    arcs = np.full((n, 4, 4), -1, np.int64)
    meets = lambda cost, where: (cost == left) & (left < _FAR) & where[:, None]
    arcs[:, :, 0] = np.where(meets(below + DELETE, ~last), node + 4, -1)
    arcs[:, :, 1] = np.where(meets(left[:, NEXT] + INSERT, np.ones(n, bool)), node[:, :1] + NEXT, -1)
    goes = KEPT[fact(initials)]
    kept = np.take_along_axis(below, np.maximum(goes, 0), 1) + more[:, None] + KEEP
    arcs[:, :, 2] = np.where(meets(kept, free) & (goes >= 0), node[:, :1] + 4 + np.maximum(goes, 0), -1)
    arcs[:, :, 3] = np.where(meets(below[:, NEXT] + more[:, None] + REROLE, free), node[:, :1] + 4 + NEXT, -1)
    return arcs.reshape(4 * n, 4)


def least_paths(arcs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the least paths from all starts, path after path, and the letter with which each is left.

    Node n is the end of everything: an audit that ends there is less than any that goes on.
    """
    n = len(arcs)
    have = np.vstack([arcs >= 0, np.zeros((1, 4), bool)])
    to = np.vstack([np.where(arcs >= 0, arcs, n), np.full((1, 4), n)])
    letter = np.where(have.any(1), have.argmax(1), -1)
    rank = letter + 1
    pointers = [np.where(letter >= 0, to[np.arange(n + 1), letter], n)]
    while (pointers[-1] != n).any():
        ahead = pointers[-1]
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[ahead], return_inverse=True)[1]
        pointers.append(ahead[ahead])
    # the arc of a node: least letter, then least rank of what follows
    chosen = np.where(have, np.arange(4) * (int(rank.max()) + 2) + rank[to], np.iinfo(np.int64).max).argmin(1)
    path = starts
    for p in reversed(pointers):
        both = np.empty(2 * len(path), np.int64)
        both[0::2], both[1::2] = path, p[path]
        path = both[both != n]
    path = path[letter[path] >= 0]
    return path, chosen[path]


class _Plan:
    """What is known of a conversation before its texts come: the digest columns, and its edits."""
    __slots__ = ("conv", "facts", "audit", "states", "rows")


def plans(facts: pa.Table) -> list[_Plan]:
    """Cost DP and ranking for all conversations of a bucket."""
    convs, turns, roles, marks, same = (facts.column(c).to_pylist() for c in ("conv_id", "turn", "role", "mark", "same"))
    out, sizes, initials, kinds, none = [], [], [], [], object()
    last = none
    for conv, turn, role, mark, digest in zip(convs, turns, roles, marks, same, strict=True):
        if last is none or conv != last:
            last, seen, known = conv, set(), set()
            p = _Plan()
            p.conv, p.facts = conv, {"low": None, "high": None, "turns": known, BLANK: 0, REPEATED: 0, CUT_OFF: 0, "illegal": 0, "role": None}
            out.append(p)
            sizes.append(0)
        if mark == LOST:
            continue
        f = out[-1].facts
        if turn is not None:
            f["low"], f["high"] = min(turn, turn if f["low"] is None else f["low"]), max(turn, turn if f["high"] is None else f["high"])
            known.add(turn)
        if mark != BLANK and digest in seen:
            mark = REPEATED
        seen.add(digest)
        if mark:
            f[mark] += 1
        if f["role"] is not None and f["role"] + role[:1] not in ("su", "ua", "au"):
            f["illegal"] += 1
        f["role"] = role[:1]
        sizes[-1] += 1
        initials.append(INITIALS.get(role[:1], 0))
        kinds.append(mark)
    sizes, initials, kinds = np.array(sizes, np.int64), np.array(initials, np.int64), np.array(kinds, np.int64)
    left = costs(initials, kinds, sizes)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    path, letters = least_paths(optimal_arcs(left, initials, kinds, sizes), 4 * first + START)
    cuts = np.searchsorted(path, 4 * np.append(first, len(left)))      # nodes of one conversation lie together, and paths come in their order
    text = np.frombuffer(LETTERS.encode(), np.uint8)[letters].tobytes().decode() if len(path) else ""
    for i, p in enumerate(out):
        f, a, b = p.facts, int(cuts[i]), int(cuts[i + 1])
        gaps = 0 if f["low"] is None else f["high"] - f["low"] + 1 - len(f["turns"])
        p.audit, p.states, p.rows = text[a:b], path[a:b] % 4, int(sizes[i])
        p.facts = (gaps, f[BLANK], f[REPEATED], f[CUT_OFF], f["illegal"], int(left[first[i], START]))
    return out


def _repairs(rows: DataFrame, digest: bool):
    """Streams buckets: facts, then texts. Yields digests of conversations, or the repaired turns themselves."""
    def columns(done, id_type):
        if digest:
            kinds, names = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        else:
            kinds, names = [id_type, pa.int64(), pa.string(), pa.string()], ["conv_id", "nr", "role", "text"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True) if done else [()] * len(kinds), kinds, strict=True)], names=names)

    def run(batches):
        facts, todo, bucket, done, id_type = [], iter(()), None, [], None
        plan = sha = at = nr = None

        def put(role, text):
            nonlocal nr
            if digest:
                sha.update(f"{chr(10) if nr else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            else:
                done.append((plan.conv, nr, role, text))
            nr += 1

        def inserts():
            nonlocal at
            while at < len(plan.audit) and plan.audit[at] == "I":
                put(ASSISTANT if plan.states[at] == ASKED else USER, "")
                at += 1

        def begin():
            """The next conversation with rows; those without are done at once."""
            nonlocal plan, sha, at, nr
            for plan in todo:
                sha, at, nr = hashlib.sha256(), 0, 0
                if plan.rows:
                    return
                end()
            plan = None

        def end():
            if digest:
                done.append((plan.conv, *plan.facts, plan.audit, sha.hexdigest()))

        def solve():
            nonlocal todo, facts
            if facts:
                todo, facts = iter(plans(pa.Table.from_batches(facts))), []
                begin()
        for b in batches:
            id_type = b.schema.field("conv_id").type
            key = np.stack([b.column("bucket").to_numpy(zero_copy_only=False), b.column("phase").to_numpy(zero_copy_only=False)])
            ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), b.num_rows] if b.num_rows else []
            first = 0
            for stop in ends:
                piece, phase, own = b.slice(first, stop - first), key[1, first], key[0, first]
                first = stop
                if phase == 0:
                    if own != bucket:
                        solve()          # a bucket of lost rows only has no texts
                        bucket = own
                    facts.append(piece)
                    continue
                solve()
                for role, text in zip(piece.column("role").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    if at == 0 and nr == 0:
                        inserts()
                    letter = plan.audit[at]
                    if letter != "D":
                        put(role if letter == "K" else ASSISTANT if plan.states[at] == ASKED else USER, text)
                    at += 1
                    inserts()
                    plan.rows -= 1
                    if not plan.rows:
                        end()
                        begin()
            if len(done) > 5000:
                yield columns(done, id_type)
                done = []
        solve()
        if done:
            yield columns(done, id_type)
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" if digest else f"conv_id {kind}, nr long, role string, text string"
    return rows.mapInArrow(run, out)


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation: faults, the least cost, the least audit and a digest of the repaired turns."""
    return _repairs(_sent(turns), True)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, nr from 0, role, text."""
    return _repairs(_sent(turns), False)
