"""Secret scans by grammar inference.

A plain scanner finds labelled credentials (three kinds). From a bounded sample of them prefix trees are built whose statistically
compatible states are merged (Hoeffding bound) into probabilistic automata. The background automaton has the last two characters as its states and
is counted over every candidate string of the corpus. Every candidate of every text is then scored by its format likelihood under the
credential automata against the background, and likely ones are reported as further spans of kind ``grammar``.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, add_blocks, bounded_batches, chunks, materialise, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: any run of the labelled kinds' alphabet from their least length on; full stops at its end are not part of it
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{5,}[A-Za-z0-9+/_=-]")
LEAST = 6
ORDER = {k: i for i, k in enumerate((*KINDS, "grammar"))}
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SAMPLE_PER_KIND = 600
#: least advantage over the background, in bits per character and in all (a string is a secret once in 2 ** PRIOR_BITS)
MARGIN, PRIOR_BITS = 0.35, 20.0
KNOWN = 200_000

#: codes of the candidates' characters; 0 is any other, the border of a run
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIGMA = len(ALPHABET) + 1
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, SIGMA)
_CODES = {c: i + 1 for i, c in enumerate(ALPHABET)}
CELLS = -(-(SIGMA**3) // BLOCK) * BLOCK


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the labelled kinds, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def without(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """The text with its base spans blanked out, so that no candidate touches them."""
    out, at = [], 0
    for s, e, *_ in spans:
        if e > at:
            out += [text[at:s], " " * (e - max(s, at))]
            at = e
    return "".join(out) + text[at:]


def transitions(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of (before last, last, next) over all candidates of a slice of texts, the borders of a run being 0."""
    codes = np.zeros(len(data) + len(offs) + 2, np.int64)
    codes[np.arange(len(data)) + 2 + np.repeat(np.arange(len(offs) - 1), np.diff(offs))] = _CODE[data]
    inside = codes > 0
    edges = np.flatnonzero(np.diff(inside.astype(np.int8)))
    begin, end = edges[::2] + 1, edges[1::2] + 1
    stop = codes[end - 1] == _CODES["."]
    while stop.any():  # full stops at the end of a run
        end = end - stop
        stop &= (end > begin) & (codes[end - 1] == _CODES["."])
    keep = end - begin >= LEAST
    mark = np.zeros(len(codes) + 1, np.int64)
    np.add.at(mark, begin[keep], 1)
    np.add.at(mark, end[keep], -1)
    codes = np.where(np.cumsum(mark[:-1]) > 0, codes, 0)
    last, nxt = codes[1:-1], codes[2:]
    two = np.where(last > 0, codes[:-2], 0)
    live = (last > 0) | (nxt > 0)
    return np.bincount(((two * SIGMA + last) * SIGMA + nxt)[live], minlength=CELLS)


class Background:
    """Two automata of all candidates: one of a single state, and one whose states are the last two characters, smoothed by shorter histories.

    The second leaves the scored string itself out of its counts, as the corpus it was counted over holds it.
    """

    def __init__(self, counts: np.ndarray):
        self.tri = counts[: SIGMA**3].astype(np.int64)
        self.bi = self.tri.reshape(SIGMA, SIGMA * SIGMA).sum(0)
        self.after_two, self.after_one = self.tri.reshape(-1, SIGMA).sum(1), self.bi.reshape(-1, SIGMA).sum(1)
        self.one = (self.bi.reshape(-1, SIGMA).sum(0) + 1) / (self.bi.sum() + SIGMA)
        bits = np.log2(self.one).tolist()
        self.single = dict(zip(ALPHABET, bits[1:]))
        self.end = bits[0]

    def plain(self, s: str) -> float:
        return sum(map(self.single.__getitem__, s)) + self.end

    def log2(self, s: str) -> float:
        codes = np.array([0, 0, *(_CODES[c] for c in s), 0])
        two = codes[:-2] * SIGMA + codes[1:-1]
        three, pair = two * SIGMA + codes[2:], codes[1:-1] * SIGMA + codes[2:]

        def left(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
            _, place, times = np.unique(at, return_inverse=True, return_counts=True)
            return np.maximum(counts[at] - times[place], 0)

        p2 = (left(self.bi, pair) + 4 * self.one[codes[2:]]) / (np.maximum(left(self.after_one, codes[1:-1]), left(self.bi, pair)) + 4)
        p3 = (left(self.tri, three) + 4 * p2) / (np.maximum(left(self.after_two, two), left(self.tri, three)) + 4)
        return float(np.log2(p3).sum())


class Automaton:
    """A probabilistic automaton inferred by state merging; ``log2(s)`` is its log-likelihood of a string and its end."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        count, ends, nxt, passed = [0], [0], [{}], [{}]
        for s in strings:
            q = 0
            count[0] += 1
            for ch in s:
                passed[q][ch] = passed[q].get(ch, 0) + 1
                if ch not in nxt[q]:
                    nxt[q][ch] = len(count)
                    count.append(0), ends.append(0), nxt.append({}), passed.append({})
                q = nxt[q][ch]
                count[q] += 1
            ends[q] += 1
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(a, n, b, m):
            return n and m and abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

        def compatible(p, q):
            todo = [(p, q)]
            while todo:
                p, q = todo.pop()
                if differ(ends[p], count[p], ends[q], count[q]):
                    return False
                for ch in passed[p].keys() | passed[q].keys():
                    if differ(passed[p].get(ch, 0), count[p], passed[q].get(ch, 0), count[q]):
                        return False
                    if ch in nxt[p] and ch in nxt[q]:
                        todo.append((nxt[p][ch], nxt[q][ch]))
            return True

        def fold(p, q):  # q, the root of a tree, goes into p
            todo = [(p, q)]
            while todo:
                p, q = todo.pop()
                count[p] += count[q]
                ends[p] += ends[q]
                for ch, n in passed[q].items():
                    passed[p][ch] = passed[p].get(ch, 0) + n
                    if ch in nxt[p]:
                        todo.append((nxt[p][ch], nxt[q][ch]))
                    else:
                        nxt[p][ch] = nxt[q][ch]

        red = [0]
        blue = [(0, ch) for ch in sorted(nxt[0])]
        while blue:
            p, ch = blue.pop(0)
            q = nxt[p][ch]
            if q in red:
                continue
            for r in red:
                if compatible(r, q):
                    nxt[p][ch] = r
                    known = set(nxt[r])
                    fold(r, q)
                    blue += [(r, c) for c in sorted(set(nxt[r]) - known)]
                    break
            else:
                red.append(q)
                blue += [(q, c) for c in sorted(nxt[q])]
        number = {q: i for i, q in enumerate(red)}
        seen = len({ch for q in red for ch in passed[q]}) + 2
        self.empty = not strings
        self.floor = -math.log2(max(len(strings), 1) + seen) - 6
        self.rows = []
        for q in red:
            whole = count[q] + 0.01 * seen
            self.rows.append(({ch: (math.log2((passed[q][ch] + 0.01) / whole), number.get(nxt[q][ch], 0)) for ch in passed[q]}, math.log2((ends[q] + 0.01) / whole)))

    def log2(self, s: str) -> float:
        if self.empty:
            return -math.inf
        q, total = 0, 0.0
        for ch in s:
            step = self.rows[q][0].get(ch)
            if step is None:
                total += self.floor
                continue
            total += step[0]
            q = step[1]
        return total + self.rows[q][1]


class Grammars:
    """One automaton per credential kind and one for the background."""

    def __init__(self, labelled: dict[str, list[str]], background: np.ndarray):
        self.kinds = {k: Automaton(labelled[k]) for k in KINDS if labelled.get(k)}
        self.background = Background(background)
        self.known: dict[str, float] = {}

    def bits(self, s: str) -> float:
        """Bits by which the likeliest credential format beats both background automata (the second is asked only if the first leaves a chance)."""
        got = self.known.get(s)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = -math.inf
            if self.kinds:
                best = max(a.log2(s) for a in self.kinds.values())
                got = best - self.background.plain(s)
                if got >= PRIOR_BITS:
                    got = min(got, best - self.background.log2(s))
            self.known[s] = got
        return got

    def likely(self, text: str, margin: float) -> list[tuple[int, int, float]]:
        """(start, end, bits per character) of the likely candidates of a text without its base spans."""
        found = CANDIDATE.findall(text)
        if not any(self.bits(s) >= max(PRIOR_BITS, margin * (len(s) + 1)) for s in set(found)):
            return []
        spans = ((m.start(), m.end(), self.bits(m[0]), len(m[0]) + 1) for m in CANDIDATE.finditer(text))
        return [(s, e, bits / n) for s, e, bits, n in spans if bits >= max(PRIOR_BITS, margin * n)]


def learn(docs: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> Grammars:
    """Infer the credential automata from at most ``per_kind`` distinct labelled strings of each kind, those with the smallest hashes, and count the background over all candidates.

    The bound is on labelled training strings only; the background, scanning and scoring cover every text.
    """

    def found(batches):
        total = np.zeros(CELLS, np.uint32)
        for _, data, offs in chunks(batches, "text"):
            body, values, plain, any_spans = data.tobytes(), set(), [], False
            for a, b in zip(offs[:-1], offs[1:]):
                text = body[a:b].decode()
                spans = base_spans(text)
                if spans:
                    any_spans = True
                    values.update((kind, value) for *_, kind, value in spans)
                    plain.append(without(text, spans).encode())
                else:
                    plain.append(body[a:b])
            if any_spans:
                data, offs = np.frombuffer(b"".join(plain), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in plain])))
            total += transitions(data, offs).astype(np.uint32)
            # the smallest hashes of this slice are enough: a bounded union of them holds the smallest of all
            rows, seen = [], dict.fromkeys(KINDS, 0)
            for k, h, v in sorted((k, hashlib.md5(v.encode()).hexdigest(), v) for k, v in values):
                if seen[k] < per_kind:
                    seen[k] += 1
                    rows.append((k, h, v.encode()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "h", "value"])
        blocks = total.reshape(-1, BLOCK)
        live = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(["background"] * len(live), pa.string()), pa.array([str(i) for i in live], pa.string()), pa.array([zstandard.compress(blocks[i].tobytes(), 1) for i in live], pa.binary())], names=["kind", "h", "value"])

    rows = materialise(docs.mapInArrow(found, "kind string, h string, value binary"), "strings")
    counts = np.zeros((CELLS // BLOCK, BLOCK), np.uint64)
    for r in rows.filter("kind = 'background'").select(F.col("h").cast("int").alias("block"), F.col("value").alias("counts")).repartition("block").mapInArrow(add_blocks, "block int, counts binary").collect():
        counts[r.block] = np.frombuffer(zstandard.decompress(r.counts), np.uint64)
    labelled = {}
    for k in KINDS:  # equal strings are merged before the shuffle; each task then keeps its smallest
        labelled[k] = [bytes(r.value).decode() for r in rows.filter(F.col("kind") == k).select("h", "value").distinct().orderBy("h").limit(per_kind).collect()]
    return Grammars(labelled, counts.ravel())


def secret_scan(docs: DataFrame, per_kind: int = SAMPLE_PER_KIND, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of every text: doc_id, found array of (kind, start, end, bits), by start and then kind; bits is null for the labelled kinds.

    Offsets are code points, end exclusive. ``margin`` is the least advantage, in bits per character, of a candidate's format
    over the background. Edge cases: null and empty texts, and an empty table, have no spans; a corpus without labelled
    credentials adds no grammar spans; ids may be null or repeated, each row is scanned by itself; very long texts and credentials are taken whole;
    equal strings count once in learning; other columns are not read.

    Scale: two scans without a shuffle of texts; the automata are learned from a bounded sample of labelled strings and from counts of
    a fixed size, and are broadcast.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(source.select("text"), per_kind))
    kind = dict(source.dtypes)["doc_id"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])

    def scan(batches):
        grammars = sent.value
        for rows, data, offs in chunks(batches, "text"):
            body, out = data.tobytes(), []
            for a, b in zip(offs[:-1], offs[1:]):
                text = body[a:b].decode()
                spans = base_spans(text)
                found = [(k, s, e, None) for s, e, k, _ in spans]
                found += [("grammar", s, e, bits) for s, e, bits in grammars.likely(without(text, spans) if spans else text, margin)]
                found.sort(key=lambda f: (f[1], ORDER[f[0]]))
                out.append([dict(zip(("kind", "start", "end", "bits"), f)) for f in found])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out, pa.list_(span))], names=["doc_id", "found"])

    return source.mapInArrow(scan, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long,bits:double>>")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "grammar")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
