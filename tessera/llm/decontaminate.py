"""Benchmark decontamination: BM25 over test items with block-max WAND, then an overlap test.

Test items are cut into units of at most `UNIT` words and indexed: word -> units
with their BM25 impact, divided by the score of the unit against itself, so one
threshold means the same for all. Postings are kept in blocks with their largest
impact. Every passage of every document (windows of two units, one unit apart, so
that a whole unit always lies within one) is a query:

1. Words in many units are set apart: a unit gets at most the share of its own score
   that it holds in them. The other words, however often they come, add their
   impacts by unit, for all passages of a batch at once; passages in which no unit
   reaches the threshold by this bound are skipped, then those in which none does
   when each word counts once.
2. The rest run block-max WAND: the pivot comes from whole-list maxima, is confirmed
   by block maxima, else the search leaps to the next block border.
3. Units above the threshold name their item. Its question (all but the last
   sentence) and answer (the last sentence) must each be covered by word triples
   that the passages found for it hold.

The index is broadcast. Items are dealt to parts of a bounded size, each
searched in turn; with word statistics of all items, so parts change no score.

A word is a run of letters and digits of any script; runs of scripts written without spaces give pairs of
neighbouring characters. Items of fewer than `LEAST_WORDS` words have no score: a document holds them if it has
their words in a row.

Edge cases: null and empty texts hold nothing, and items without words are held by nothing; repeated items count once, of texts under one item_id the best
counts; a null item_id or doc_id is reported as it is; repeated documents are
each searched; an empty table on either side gives no pairs; other columns are left alone.
"""

from __future__ import annotations

import math
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes
from tessera.session import stage

K1, B = 1.2, 0.75
UNIT = 64
BLOCK = 8
THRESHOLD = 0.5
COVERED = 0.5
GRAM = 3
LEAST_WORDS = 5
COMMON_SHARE = 0.04
PART_BYTES = 16 << 20
GROUP_WORDS = 1 << 18

_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
# bytes of ASCII and of Latin letters beyond it: a text of these only is split by ASCII separators
_LATIN = bytes([*range(0xC0), *range(0xC3, 0xC9)])
_UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_RUNS = re.compile(f"([{_UNSPACED}]+)|[^\\W_{_UNSPACED}]+")
_END = re.compile(r"[.!?]+\s|[\u3002\uff01\uff1f]+|\n")


def words_of(text: str | None) -> list[bytes]:
    if not text:
        return []
    raw = text.lower().encode("utf-8", "surrogatepass")
    if not raw.translate(None, _LATIN) and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw:
        return raw.translate(_PLAIN).split()
    out = []
    for m in _RUNS.finditer(text.lower()):
        run = m[0]
        if m[1] is None or len(run) == 1:
            out.append(run.encode("utf-8", "surrogatepass"))
        else:
            out += [run[i:i + 2].encode("utf-8", "surrogatepass") for i in range(len(run) - 1)]
    return out


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of all but the last sentence, and of the last; one sentence is both."""
    for m in reversed(list(_END.finditer(text.rstrip()))):
        question, answer = words_of(text[:m.end()]), words_of(text[m.end():])
        if question and answer:
            return question, answer
    return words_of(text), words_of(text)


def coverage(part: list[bytes], grams: set, n: int = GRAM) -> float:
    """Share of the words of `part` that lie in a run of n words (all, if fewer) found in `grams`."""
    n = min(n, len(part))
    held = np.zeros(len(part), bool)
    for i in range(len(part) - n + 1):
        if tuple(part[i:i + n]) in grams:
            held[i:i + n] = True
    return float(held.mean()) if len(part) else 0.0


class Index:
    """Inverted index of the units of some items. `df`, `n`, `mean`: word statistics of the units of all items."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[bytes, int], n: int, mean: float):
        self.items = [(i, *question_and_answer(t)) for i, t in items]
        self.unit_item: list[int] = []
        self.short: dict[bytes, list[tuple[list[bytes], int | None]]] = {}         # first word -> items without a score
        for i, text in items:
            words = words_of(text)
            if 0 < len(words) < LEAST_WORDS:
                self.short.setdefault(words[0], []).append((words, i))
        weights: list[dict[bytes, float]] = []
        for at, (_, text) in enumerate(items):
            for unit in units_of(text):
                tf: dict[bytes, int] = {}
                for w in unit:
                    tf[w] = tf.get(w, 0) + 1
                norm = K1 * (1 - B + B * len(unit) / mean)
                score = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
                total = sum(score.values())
                weights.append({w: s / total for w, s in score.items()})
                self.unit_item.append(at)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for u, unit in enumerate(weights):
            for w, s in unit.items():
                postings.setdefault(w, []).append((u, s))
        self.word = {w: i for i, w in enumerate(postings)}
        self.units = [[u for u, _ in p] for p in postings.values()]
        self.impacts = [[s for _, s in p] for p in postings.values()]
        self.most = [max(s) for s in self.impacts]
        self.block_most = [[max(s[i:i + BLOCK]) for i in range(0, len(s), BLOCK)] for s in self.impacts]
        common = {w for w, c in df.items() if c > COMMON_SHARE * n and w in self.word}
        self.common_share = np.zeros(len(weights))                     # by unit; 0 where it would do alone: there all words count as rare
        rare: dict[bytes, list[tuple[int, float]]] = {w: [] for w in postings}
        for u, unit in enumerate(weights):
            share = sum(s for w, s in unit.items() if w in common)
            self.common_share[u] = share if share < THRESHOLD else 0.0
            for w, s in unit.items():
                if w not in common or not self.common_share[u]:
                    rare[w].append((u, s))
        self.rare_len = np.array([len(p) for p in rare.values()] + [0], np.int64)
        self.rare_from = np.cumsum(self.rare_len) - self.rare_len
        self.rare_unit = np.array([u for p in rare.values() for u, _ in p], np.int64)
        self.rare_impact = np.array([s for p in rare.values() for _, s in p])

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Units whose score for the distinct `terms` reaches the threshold, by block-max WAND."""
        lists = [[self.units[t], self.impacts[t], self.block_most[t], self.most[t], 0] for t in terms]     # units, impacts, block maxima, maximum, place
        found = []
        while True:
            lists = [x for x in lists if x[4] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[4]])
            total = 0.0
            for p, x in enumerate(lists):
                total += x[3]
                if total >= threshold:
                    break
            else:
                return found
            pivot = lists[p][0][lists[p][4]]
            while p + 1 < len(lists) and lists[p + 1][0][lists[p + 1][4]] == pivot:
                p += 1
            bound, border = 0.0, None
            for x in lists[:p + 1]:
                i = x[4]
                while (end := min((i // BLOCK + 1) * BLOCK, len(x[0]))) < len(x[0]) and x[0][end - 1] < pivot:
                    i = end
                bound += x[2][i // BLOCK] if x[0][end - 1] >= pivot else 0.0
                last = x[0][end - 1]
                if last >= pivot:
                    border = last if border is None else min(border, last)
            if bound < threshold:                          # no unit up to the next block border, or the next list's place
                go = border + 1
                if p + 1 < len(lists):
                    go = min(go, lists[p + 1][0][lists[p + 1][4]])
                for x in lists[:p + 1]:
                    _seek(x, max(go, pivot + 1) if go <= pivot else go)
                continue
            if lists[0][0][lists[0][4]] == pivot:
                score = sum(x[1][x[4]] for x in lists[:p + 1])
                if score >= threshold:
                    found.append((pivot, score))
                for x in lists[:p + 1]:
                    x[4] += 1
            else:
                for x in lists[:p + 1]:
                    _seek(x, pivot)

    def search(self, texts: list[str | None]) -> list[list[tuple[int | None, float, float, float]]]:
        """For each document (item_id, score, question and answer coverage) of the items that it holds."""
        out, group, size = [], [], 0
        for t in texts:
            words = words_of(t)
            group.append(words)
            size += len(words)
            if size > GROUP_WORDS:
                out += self._search(group)
                group, size = [], 0
        return out + self._search(group)

    def _search(self, texts: list[list[bytes]]) -> list[list[tuple[int | None, float, float, float]]]:
        out = self._scored(texts) if self.word else [[] for _ in texts]
        for words, found in zip(texts, out, strict=True):
            if self.short and not self.short.keys().isdisjoint(words):
                held = {item for i, w in enumerate(words) for run, item in self.short.get(w, ()) if words[i:i + len(run)] == run}
                found += [(item, 1.0, 1.0, 1.0) for item in held - {x[0] for x in found}]
        return out

    def _scored(self, texts: list[list[bytes]]) -> list[list[tuple[int | None, float, float, float]]]:
        none, lens = len(self.word), np.array([len(w) for w in texts], np.int64)
        ids = np.fromiter(map(self.word.get, chain.from_iterable(texts), repeat(none)), np.int64, int(lens.sum()))
        runs = np.maximum(-(-lens // UNIT), 1)                         # a passage is a run of UNIT words and the next one of its document
        first_run, first_word = np.cumsum(runs) - runs, np.cumsum(lens) - lens
        at = np.flatnonzero(self.rare_len[ids])
        doc = np.searchsorted(first_word, at, side="right") - 1
        run = first_run[doc] + (at - first_word[doc]) // UNIT
        n = self.rare_len[ids[at]]
        entry = np.repeat(self.rare_from[ids[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        run, unit, impact = np.repeat(run, n), self.rare_unit[entry], self.rare_impact[entry]
        doc = np.repeat(doc, n)
        final = first_run[doc] + runs[doc] - 1
        one, two = (run < final) | (runs[doc] == 1), run > first_run[doc]       # the passages that a word lies in: that of its run and the one before
        key = np.concatenate([run[one], run[two] - 1]) * len(self.common_share) + np.concatenate([unit[one], unit[two]])
        order = np.argsort(key, kind="stable")
        key, new = key[order], np.flatnonzero(np.diff(key[order], prepend=-1))
        reach = np.add.reduceat(np.concatenate([impact[one], impact[two]])[order], new) if len(new) else np.zeros(0)
        likely = reach + self.common_share[key[new] % len(self.common_share)] >= THRESHOLD - 1e-9
        out = [[] for _ in texts]
        found = np.unique(key[new][likely] // len(self.common_share))
        doc = np.searchsorted(first_run, found, side="right") - 1
        for d in np.unique(doc).tolist():
            out[d] = self._verified(texts[d], ids[first_word[d]:first_word[d] + lens[d]], ((found[doc == d] - first_run[d]) * UNIT).tolist())
        return out

    def _reachable(self, terms: np.ndarray) -> bool:
        """Whether distinct words can bring a unit to the threshold."""
        n = self.rare_len[terms]
        entry = np.repeat(self.rare_from[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
        unit, of = np.unique(self.rare_unit[entry], return_inverse=True)
        return bool((np.bincount(of, self.rare_impact[entry], len(unit)) + self.common_share[unit] >= THRESHOLD - 1e-9).any())

    def _verified(self, words: list[bytes], ids: np.ndarray, starts: list[int]) -> list[tuple[int | None, float, float, float]]:
        none = len(self.word)
        held: dict[int, tuple[float, set]] = {}
        for a in starts:
            b = min(a + 2 * UNIT, len(words))
            terms = np.unique(ids[a:b])
            if not self._reachable(terms):
                continue
            for unit, score in self.above(terms[terms != none].tolist(), THRESHOLD - 1e-9):
                at = self.unit_item[unit]
                best, spans = held.get(at, (0.0, set()))
                held[at] = max(best, score), spans | {(a, b)}
        out = []
        for at, (score, spans) in held.items():
            item, question, answer = self.items[at]
            grams = {tuple(words[i:i + n]) for n in {min(GRAM, len(question)), min(GRAM, len(answer))} for a, b in spans for i in range(a, b - n + 1)}
            q, r = coverage(question, grams), coverage(answer, grams)
            if q >= COVERED and r >= COVERED:
                out.append((item, score, q, r))
        best: dict = {}
        for x in out:
            best[x[0]] = max(best.get(x[0], x), x, key=lambda y: y[1:])
        return list(best.values())


def _seek(x: list, unit: int) -> None:
    while x[4] < len(x[0]) and x[0][x[4]] < unit:
        x[4] += 1


def units_of(text: str | None) -> list[list[bytes]]:
    """Units of an item: runs of at most UNIT words of about equal length; none below LEAST_WORDS words."""
    words = words_of(text)
    if len(words) < LEAST_WORDS:
        return []
    n = -(-len(words) // UNIT)
    return [words[len(words) * i // n:len(words) * (i + 1) // n] for i in range(n)]


def indexes(items: DataFrame):
    """Indexes of the items, part by part; each part is bounded by PART_BYTES of text (or one item)."""
    def statistics(batches):
        for b in batches:
            rows = [(w, 1, 0) for t in b.column(0).to_pylist() for u in units_of(t) for w in set(u)]
            rows += [(b"", 1, len(u)) for t in b.column(0).to_pylist() for u in units_of(t)]
            w, n, k = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n, pa.int64()), pa.array(k, pa.int64())], names=["word", "units", "words"])
    items = stage(items.select("item_id", F.col("text").cast("string")).filter("text IS NOT NULL").distinct(), "leak-items")
    stats = stage(items.select("text").mapInArrow(statistics, "word binary, units long, words long").groupBy("word").agg(F.sum("units").alias("units"), F.sum("words").alias("words")), "leak-words")
    total = stats.filter(F.length("word") == 0).first()
    units, words = (total.units, total.words) if total is not None else (0, 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-int(size) // PART_BYTES)
    dealt = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for p in range(parts):
        part = [(r.item_id, r.text) for r in dealt.filter(F.col("_part") == p).orderBy("item_id", "text").collect()]
        own = {w for _, t in part for u in units_of(t) for w in u}
        known = stats if parts == 1 else stats.join(F.broadcast(items.sparkSession.createDataFrame([(bytearray(w),) for w in own], "word binary")), "word")
        df = {bytes(r.word): r.units for r in known.collect() if r.word}
        yield Index(part, df, units, words / max(units, 1))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question and answer coverage of every item that a document holds."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                found = shared.value.search(as_text(b.column(1)))
                rows = [(i, *x) for i, f in zip(b.column(0).to_pylist(), found, strict=True) for x in f]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                item = pa.array(cols[1]) if any(x is not None for x in cols[1]) else pa.array(cols[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), item, *(pa.array(c, pa.float64()) for c in cols[2:])],
                                                 names=["doc_id", "item_id", "score", "question", "answer"])
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def as_text(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "surrogatepass") for b in as_bytes(column)]


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns."""
    at = docs.columns.index("text")
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not f for f in shared.value.search(as_text(b.column(at)))], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
