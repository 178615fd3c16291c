"""Detection of periodic runs of words, after Kolpakov and Kucherov.

A run is a stretch of words with a smallest period, not extendable on either side. A suffix automaton gives the Lempel-Ziv factors of a word sequence,
each the longest one seen before. Runs that touch a border between factors are found by Main's algorithm from extension lengths on both sides of the
border; a run that lies strictly inside a factor is a copy of one inside the factor's earlier occurrence, and is copied from there.

Documents are independent, so they are spread over tasks as they are read and nothing is shuffled. The method runs on the stretches of a document that can hold
a run at all: every eight words of a run of 24 words or more and three periods or more occur once more in it, one period away.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, mix, table, with_fields

MIN_LENGTH, MIN_EXPONENT = 24, 3
GRAM = 8
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

# ---------------------------------------------------------------- one sequence


def factors(s: list[int]) -> list[tuple[int, int]]:
    """Lempel-Ziv factors as (start, start of an earlier occurrence, -1 for a new word): the longest ones that began before; they may overlap themselves.

    From a suffix automaton of the whole sequence that knows where each state's strings end first. A state's first transition is in flat arrays, further
    ones are in a dictionary, so that a word costs some fifty bytes.
    """
    link, length, first, char, to = (array("q", [x]) for x in (-1, 0, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}

    def go(p: int, c: int) -> int:
        return to[p] if char[p] == c else more[p].get(c, -1) if p in more else -1

    def put(p: int, c: int, q: int) -> None:
        if char[p] in (-1, c):
            char[p], to[p] = c, q
        else:
            more.setdefault(p, {})[c] = q

    def state(*values: int) -> int:
        for column, v in zip((link, length, first, char, to), values):
            column.append(v)
        return len(link) - 1

    last = 0
    for i, c in enumerate(s):
        new, p = state(0, i + 1, i, -1, -1), last
        while p != -1 and (q := go(p, c)) == -1:
            put(p, c, new)
            p = link[p]
        if p != -1:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = state(link[q], length[p] + 1, first[q], char[q], to[q])
                if q in more:
                    more[clone] = dict(more[q])
                while p != -1 and go(p, c) == q:
                    put(p, c, clone)
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out, b, n = [], 0, len(s)
    while b < n:
        at, j = 0, b
        while j < n and (q := go(at, s[j])) != -1 and first[q] < j:
            at, j = q, j + 1
        out.append((b, first[at] - (j - b) + 1 if j > b else -1))
        b = max(j, b + 1)
    return out


def extensions(pattern: list[int], text: list[int]) -> list[int]:
    """How far each suffix of pattern, a mark, text agrees with pattern."""
    s = [*pattern, -1, *text]
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(s: list[int], b: int, before: int, e: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: (start, end, period) of the runs that touch the border ``b`` and end by ``e``, the end of the factor that starts there.

    ``before`` is the length of the factor that ends at the border. A run that touches no later border starts less than 2 * before + (e - b) words in front of this one.
    """
    m = e - b
    lo, hi = max(0, b - 2 * before - m - 1), min(len(s), e + 1)
    if e - lo < least:
        return
    tail, head = s[b:hi], s[lo:b][::-1]
    ahead = extensions(tail, s[lo:hi])
    behind = extensions(head, s[lo:e][::-1])
    found = []
    for q in range(1, min(m, (e - lo) // times) + 1):  # the run has a whole period right of the border
        found.append((b - behind[len(head) + 1 + m - q], b + q + (ahead[q] if q < len(tail) else 0), q))
    for q in range(1, min(before + m, b - lo, (e - lo) // times) + 1):  # ... or left of it
        found.append((b - q - (behind[q] if q < len(head) else 0), b + ahead[len(tail) + 1 + b - q - lo], q))
    for start, end, q in found:
        if end <= e and (start > lo or not lo) and end - start >= max(least, times * q):
            yield start, end, q


def runs_of(s: list[int], least: int = MIN_LENGTH, times: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``least`` words and ``times`` (2 or more) periods, by start and period."""
    parts = factors(s)
    ends = [*[b for b, _ in parts[1:]], len(s)]
    period: dict[tuple[int, int], int] = {}
    before = 0
    for (b, _), e in zip([*parts, (len(s), -1)], [*ends, len(s)]):
        for start, end, q in at_border(s, b, before, e, least, times) if b else ():
            period[start, end] = min(q, period.get((start, end), q))  # a multiple of the smallest period gives the same stretch
        before = e - b
    starting: dict[int, list[tuple[int, int]]] = {}
    for (start, end), q in period.items():
        starting.setdefault(start, []).append((end, q))
    for (b, source), e in zip(parts, ends):
        if source >= 0 and e - b > least:
            shift = b - source
            for at in range(b + 1, e):
                for end, q in starting.get(at - shift, ()):
                    if end + shift < e:
                        starting.setdefault(at, []).append((end + shift, q))
    return sorted((start, end - start, q) for start, ends_ in starting.items() for end, q in ends_)


# ---------------------------------------------------------------- documents


def stretches(ids: np.ndarray, bounds: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The stretches of ``least`` words or more, each in one document, in which every word is part of GRAM words that occur twice in the document.

    Equal words have equal ids; grams are compared by hash, so that a collision can only add a stretch.
    """
    n = len(ids) - GRAM + 1
    if n < 1:
        return []
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    value, h = mix(ids.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + value[k : k + n]
    h = mix(h ^ mix(doc[:n].astype(np.uint64) + np.uint64(77)))
    whole = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, np.flatnonzero(again), 1)
    np.add.at(depth, np.flatnonzero(again) + GRAM, -1)
    inside = np.cumsum(depth[:-1]) > 0
    edge = np.ones(len(ids), bool)
    edge[1:] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(ids))
    keep = inside[starts] & (ends - starts >= least)
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, times: int = MIN_EXPONENT) -> DataFrame:
    """The runs of words (``[^\\x20\\x09-\\x0D]+``) of every text with at least ``least`` words and ``times`` periods.

    Returns one row per input row: doc_id, n_words, runs (start, length, period; by start, then period), best (the run with most periods, exactly; ties by start, then
    period; null without runs) and collapsed: the words that no run contains after its first period, joined by one space.

    Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed text. Null and repeated ids are rows like any other; repeated rows give equal results.
    An empty table gives an empty result; other columns are not read. A text is one row and its words must fit in a worker, at some hundred bytes a word where it is periodic.
    """
    if times < 3 or least < 3 * GRAM:
        raise ValueError(f"runs need 3 periods and {3 * GRAM} words at least")
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches, "text"):
            text = data.tobytes()
            words = [text[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]  # bytes are split at the six ASCII blanks
            number: dict[bytes, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for own in words for w in own], np.int64)
            bounds = np.concatenate(([0], np.cumsum([len(own) for own in words])))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for a, b in stretches(ids, bounds, least):
                k = int(np.searchsorted(bounds, a, "right")) - 1
                runs[k] += [(a - int(bounds[k]) + s, n, q) for s, n, q in runs_of(ids[a:b].tolist(), least, times)]
            best, kept = [], []
            for own, found in zip(words, runs):
                top = None
                for r in sorted(found):
                    if top is None or r[1] * top[2] > top[1] * r[2]:
                        top = r
                best.append(top)
                if found:
                    gone = np.zeros(len(own), bool)
                    for s, n, q in found:
                        gone[s + q : s + n] = True
                    own = [w for w, g in zip(own, gone.tolist()) if not g]
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    schema = with_fields(d.select("doc_id").schema, "n_words long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string")
    return d.mapInArrow(find, schema)


def with_planted_tails(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The query's texts: with h the crc32 of the decimal id and g = h div 10, where 10 divides h the words from a = g mod n on repeat the first p of them."""
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    w = F.regexp_extract_all(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    # one row of lambdas binds the words, then a and then p, so that each is computed once
    bind = lambda value, f: F.transform(F.array(value), f)[0]
    g = F.floor(h / 10)
    tail = lambda ws, a: bind(F.lit(1) + F.floor((F.size(ws) - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(ws) - F.lit(1).cast("long")), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "))
    planted = bind(w, lambda ws: F.when(F.size(ws) > 0, bind(g % F.size(ws), lambda a: tail(ws, a))).otherwise(F.lit("")))
    return F.when((h % 10 == 0) & F.col(text_col).isNotNull(), planted).otherwise(F.col(text_col))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_tails().alias("text"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    b = F.col("best")
    return periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR i IN range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS h
  FROM documents),
planted AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split),
tails AS (SELECT doc_id, n, w, a, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM planted),
words AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM tails)),
pairs AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i AND (y.i - x.i) * 3 <= x.n),
islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g),
runs AS (SELECT doc_id, s, length, min(q) AS q FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, s, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
best AS (
  SELECT * FROM runs r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length * 1000000000000::HUGEINT // q DESC, s, q) = 1),
dropped AS (SELECT DISTINCT w.doc_id, w.i FROM words w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.length),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w LEFT JOIN dropped d ON d.doc_id = w.doc_id AND d.i = w.i WHERE d.i IS NULL GROUP BY w.doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.length AS length, b.q AS period, b.length * 1000 // b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
