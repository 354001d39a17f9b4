"""Secret scan: keyword automaton, anchored expressions at its hits only, checksum or structure tests.

One pass of an Aho-Corasick automaton over the lower-cased bytes of a text finds
every place where a secret could begin; an expression is tried only there. Runs
of hex digits have no keyword: bytes are mapped to hex or not, and sixteen hex
marks in a row are the keyword. Token kinds that carry a checksum or a header
are kept only if it holds.

Edge cases: a null text is empty and has no spans; a null id stays null; repeated
rows are scanned each on their own; other columns are left alone by `redact`
(except `n_chars`, which follows the text) and are not read by `secret_spans`.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes

# Kinds in the order of the digest, patterns and least lengths.
KINDS = ("assign", "access", "hex", "forge", "package", "jwt", "pem")
BASE = 3
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
FORGE = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
PACKAGE = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{2,})\.[A-Za-z0-9_-]{16,}")
PEM = re.compile(rb"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
PEM_END = re.compile(rb"-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----")
LEAST = (12, 18, 16)
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_PEM_STARTS = re.compile(rb"(?=" + PEM_END.pattern + rb")")
_PART = re.compile(rb"[A-Za-z0-9_-]*")
_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN = b"\x01" * LEAST[2]


@lru_cache(1)
def _automaton():
    import ahocorasick
    a = ahocorasick.Automaton()
    for word, kind in [*((w, "assign") for w in ASSIGN_WORDS), ("akia", "access"), *((f"gh{c}_", "forge") for c in "pousr"),
                       ("npm_", "package"), ("eyj", "jwt"), ("-----begin ", "pem")]:
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def _crc_holds(body: bytes, check: bytes) -> bool:
    n, out = zlib.crc32(body), ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(6, "0").encode() == check


def _header_holds(part: bytes) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except ValueError:
        return False
    return isinstance(head, dict) and "alg" in head


class _PemEnds:
    """Ends of private keys in a text, looked up once, so that many headers before a foreign end cost no more than one."""

    def __init__(self, raw: bytes):
        self.raw, self.starts = raw, None

    def after(self, at: int) -> int | None:
        if self.starts is None:
            self.starts = [m.start() for m in _PEM_STARTS.finditer(self.raw)]
        i = bisect_left(self.starts, at)
        return PEM_END.match(self.raw, self.starts[i]).end() if i < len(self.starts) else None


def _anchored(kind: str, raw: bytes, at: int, pem_ends: _PemEnds) -> tuple[int, bool] | None:
    """End of the match at `at` and whether it passes, or nothing. A token with a header whose parts don't follow fails for its whole first part."""
    if kind == "pem":
        m = PEM.match(raw, at)
        end = pem_ends.after(m.end()) if m else None
        return (end, True) if end else None
    m = {"assign": ASSIGN, "access": ACCESS, "forge": FORGE, "package": PACKAGE, "jwt": JWT}[kind].match(raw, at)
    if not m:
        return (_PART.match(raw, at).end(), False) if kind == "jwt" and raw.startswith(b"eyJ", at) else None
    if kind == "assign":
        return m.end(), len(m[2]) >= LEAST[0]
    if kind == "access":
        return m.end(), m.end() - m.start() >= LEAST[1]
    return m.end(), _header_holds(m[1]) if kind == "jwt" else _crc_holds(m[1], m[2])


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all secrets in UTF-8 bytes, in code points, ordered."""
    found, ends = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (n, kind) in _automaton().iter(raw.lower().decode("latin-1")))
    pem_from, pem_ends = raw.rfind(b"-----END "), _PemEnds(raw)
    for at, kind in hits:
        if at < ends[kind] or (kind == "pem" and at > pem_from):
            continue
        if m := _anchored(kind, raw, at, pem_ends):
            ends[kind] = m[0]
            if m[1]:
                found.append((at, m[0], KINDS.index(kind)))
    marks, at = raw.translate(_HEX), 0
    while (at := marks.find(_RUN, at)) >= 0:
        end = marks.find(b"\x00", at)
        end = len(raw) if end < 0 else end
        found.append((at, end, 2))
        at = end
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    if found and not raw.isascii():
        done, chars, at_char = 0, 0, {}
        for p in sorted({p for s, e, _ in found for p in (s, e)}):
            chars += len(raw[done:p].decode())
            done, at_char[p] = p, chars
        found = [(at_char[s], at_char[e], k) for s, e, k in found]
    return found


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts of the three base kinds, digest of base spans, list of all spans."""
    def run(batches):
        for b in batches:
            found = [scan(t) for t in as_bytes(b.column(1))]
            base = [[s for s in f if s[2] < BASE] for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([sum(s[2] == k for s in f) for f in base], pa.int64()) for k in range(BASE)),
                 pa.array([hashlib.sha256(_listed(f).encode()).hexdigest() for f in base], pa.string()),
                 pa.array([_listed(f) for f in found], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"))


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans are replaced together."""
    if not text:
        return text
    out, done = [], 0
    for s, e, _ in scan(text.encode("utf-8", "surrogatepass")):
        if s >= done:
            out += [text[done:s], mark]
        done = max(done, e)
    return "".join([*out, text[done:]]) if done else text


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Same rows and columns, secrets replaced by a mark. `chars_col`, if there, becomes the new length."""
    names = docs.columns

    def run(batches):
        for b in batches:
            old = b.column(names.index(text_col)).to_pylist()
            new, cols = [masked(t) for t in old], list(b.columns)
            i = names.index(text_col)
            cols[i] = pa.array(new, b.schema.field(i).type)
            if chars_col in names:
                j = names.index(chars_col)
                kept = cols[j].to_pylist()
                cols[j] = pa.array([c if n == o else len(n) for c, n, o in zip(kept, new, old, strict=True)], b.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)
    return docs.mapInArrow(run, docs.schema)
