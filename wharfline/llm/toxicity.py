"""Toxicity by noisy-channel deobfuscation.

Suspicious spans (letters mixed with digits or symbols, spelled-out words, stretched letters) become character lattices: each
written character offers the letters it may stand for, a word border or nothing. A Viterbi search under a character trigram model of the whole
corpus, with a channel cost for every change, restores the likeliest text. The restored text is scored by a lexicon of words and
word beginnings whose log-odds are learned from labelled documents, restored in the same way.
"""

from __future__ import annotations

import functools
import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BLOCK, bounded_batches, carried, chunks, counted, crc_mod, materialise, mix, table, with_fields, word_hashes, word_spans

#: At most so many labelled rows of each class train the lexicon (those with the smallest hashes of their id).
TRAIN_ROWS = 4000
MIN_ODDS = 3.0
#: about so many features of a lexicon may be there by chance, however many are tried
CHANCE_FEATURES = 50
#: minima of hashed word sequences by which copies and near copies are recognised; these share half of them
SKETCH, SHINGLE = 8, 5
STEMS = (4, 5)

#: fixed values: the letters that leetspeak characters may stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou", "&": "aeiou",
}
#: fixed values: marks that may stand between the letters of a word
SPACING = " .-_*~·/\\,'|"
_LETTER = r"[^\W\d_]"
_SIGN = r"(?:[^\W_]|[@$!])"
_MARK = r"[0-9@$!|+(€£*#%&]"
SUSPECT = re.compile(
    rf"(?<!\w){_SIGN}(?:[ .\-_*~·/\\]{_SIGN}){{2,}}(?!\w)"  # s p 3 l l e d
    rf"|(?:{_MARK}*{_LETTER}+{_MARK}+(?={_LETTER}|[0-9@$!]))(?:{_LETTER}|{_MARK})*"  # m1xed
    rf"|{_MARK}+{_LETTER}(?:{_LETTER}|{_MARK})*"  # 1dle
    rf"|{_LETTER}+(?:[.\-_~·]{_LETTER}+){{2,}}"  # w.o.r.d or wo-r-d
    rf"|{_LETTER}*({_LETTER})\1\1{_LETTER}*"  # streeetched
)
WORD = re.compile(rf"{_LETTER}+")
#: so many characters are decoded before the part all surviving paths share is written out
FLUSH = 256

#: characters of the language model: a-z, Latin letters with marks, one for all others; 0 is the word border
ALPHABET = {chr(c): i + 1 for i, c in enumerate([*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100), 0x153])}
SIGMA = len(ALPHABET) + 2
_OTHER = SIGMA - 1


def _codes() -> np.ndarray:
    codes = np.zeros(0x250, np.int64)
    for c in range(0x250):
        low = chr(c).lower()
        codes[c] = ALPHABET.get(low, _OTHER if low.isalpha() else 0)
    return codes


_CODE = _codes()


class CharModel:
    """Character trigrams with add-one smoothing over backed-off counts, as negative logarithms."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SIGMA, SIGMA, SIGMA).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + SIGMA)
        p2 = (bi + 8 * p1) / (bi.sum(1, keepdims=True) + 8)
        p3 = (tri + 8 * p2[None]) / (tri.sum(2, keepdims=True) + 8)
        self.cost = -np.log(p3)


def char_counts(source: DataFrame) -> np.ndarray:
    """Trigram counts of the lower-cased characters of all texts (SIGMA cubed, whatever the corpus)."""
    cells = -(-(SIGMA**3) // BLOCK) * BLOCK

    def places(data, offs):
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        codes = _CODE[np.minimum(chars, 0x24F)]
        codes[chars > 0x24F] = _OTHER
        return (codes[:-2] * SIGMA + codes[1:-1]) * SIGMA + codes[2:]

    return counted(source, cells, places)[: SIGMA**3].astype(np.int64)


class Restorer:
    """Viterbi decoding of suspicious spans."""

    CHANGE, DROP_MARK, DROP_REPEAT, DROP_LETTER = 0.6, 0.4, 0.7, 14.0

    def __init__(self, model: CharModel):
        self.cost = model.cost.tolist()
        self.known: dict[str, str] = {}
        self.single: dict[str, str | None] = {}

    def span(self, written: str) -> str:
        got = self.known.get(written)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[written] = self._decode(written)
        return got

    def _options(self, text: str, i: int) -> list[tuple[str, float]]:
        """What the character at ``i`` may stand for (a letter, a blank for a word border, nothing) and at which cost."""
        ch = text[i]
        repeat = [("", self.DROP_REPEAT)] if i and text[i - 1] == ch else []
        if ch.isalpha():
            return [(ch, 0.0), *repeat]
        out = [(c, self.CHANGE) for c in LEET.get(ch, "")] + repeat
        if ch in SPACING:
            out.append((" ", 0.0))
        if ch in SPACING or not ch.isdigit():
            out.append(("", self.DROP_MARK))
        return out or [("", self.DROP_LETTER)]

    def _decode(self, written: str) -> str:
        """The likeliest reading of the span, of any length: words, with blanks between where the span has borders."""
        text = written.lower()
        done: list[str] = []
        # a state is the last two codes; its path is a chain (earlier, character) since the last flush
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(text)):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self._options(text, i)
            for (p, q), (cost, path) in states.items():
                for c, extra in options:
                    if c:
                        code = ALPHABET.get(c, 0 if c == " " else _OTHER)
                        key, total, now = (q, code), cost + extra + self.cost[p][q][code], (path, c)
                    else:
                        key, total, now = (p, q), cost + extra, path
                    if key not in after or total < after[key][0]:
                        after[key] = (total, now)
            states = after
            if i % FLUSH == FLUSH - 1:
                paths = [_unroll(path) for _, path in states.values()]
                same = len(os.path.commonprefix(paths))
                done.append(paths[0][:same])
                states = {k: (cost, _roll(path[same:])) for (k, (cost, _)), path in zip(states.items(), paths)}
        end = min((cost + self.cost[p][q][0], _unroll(path)) for (p, q), (cost, path) in states.items())
        return "".join(done) + end[1]

    def restored(self, data: np.ndarray, offs: np.ndarray) -> Iterator[str]:
        """The texts of a slice with every suspicious span as the likeliest reading restores it."""
        body, bounds = data.tobytes(), offs.tolist()
        texts = [body[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])]
        starts, ends = suspicious("\n".join(texts))
        k = begin = 0
        for text in texts:
            pieces, done = [], 0
            while k < len(starts) and starts[k] < begin + len(text):
                low, high = starts[k] - begin, ends[k] - begin
                pieces += [text[done:low], SUSPECT.sub(lambda m: " " + self.span(m[0]) + " ", text[low:high])]
                done, k = high, k + 1
            yield "".join([*pieces, text[done:]]) if pieces else text
            begin += len(text) + 1

    def features(self, data: np.ndarray, offs: np.ndarray) -> Iterator[set[str]]:
        """Of each text the distinct words of the restored text, and of them those with doubled letters also without."""
        for text in self.restored(data, offs):
            words = set(WORD.findall(text.lower()))
            yield words | {s for w in words if (s := self.squeezed(w))}

    def squeezed(self, word: str) -> str | None:
        """The word without doubled letters, if it has any."""
        if word not in self.single:
            if len(self.single) > 200_000:
                self.single.clear()
            self.single[word] = _RUN.sub(r"\1", word) if _DOUBLE.search(word) else None
        return self.single[word]


# what a character may be in a suspicious span
_WORD, _LET, _MK, _SG, _SEP, _DOT = 1, 2, 4, 8, 16, 32


@functools.cache
def _classes() -> np.ndarray:
    """The classes of all code points, as the parts of SUSPECT have them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for pattern, bit in ((r"\w", _WORD), (_LETTER, _LET), (_MARK, _MK), (_SIGN, _SG), (r"[ .\-_*~·/\\]", _SEP), (r"[.\-_~·]", _DOT)):
        at = np.frombuffer("".join(re.findall(pattern, every)).encode("utf-32-le"), np.uint32)
        out[at] |= bit
    return out


def suspicious(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches of the text that can hold a match of SUSPECT; no match crosses their ends.

    A stretch has no characters that no match has, and a blank only between single signs.
    """
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(chars)
    if n < 2:
        return [], []
    kind = _classes()[chars]
    padded = np.concatenate((np.zeros(2, np.uint8), kind, np.zeros(4, np.uint8)))
    is_ = lambda k, bit: (padded[2 + k : 2 + k + n] & bit) > 0
    alone = lambda at: padded[at] & (_WORD | _SEP) != _WORD
    blank = np.flatnonzero(chars == 32)
    soft = (padded[blank + 1] & _SG > 0) & (padded[blank + 3] & _SG > 0) & alone(blank) & alone(blank + 4)
    inside = (kind & (_LET | _MK | _SG | _SEP)) > 0
    inside[blank[~soft]] = False
    letter, mark, sign, sep = (is_(0, b) for b in (_LET, _MK, _SG, _SEP))
    letter1, sep1, sign2 = is_(1, _LET), is_(1, _SEP), is_(2, _SG)
    hit = (letter & is_(1, _MK)) | (mark & letter1) | (letter & is_(1, _DOT) & is_(2, _LET))
    same = np.zeros(n, bool)
    same[:-2] = (chars[:-2] == chars[1:-1]) & (chars[1:-1] == chars[2:])
    hit |= letter & same
    hit |= sign & sep1 & sign2 & is_(3, _SEP) & is_(4, _SG)
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    found = np.unique(np.searchsorted(starts, np.flatnonzero(hit & inside), "right") - 1)
    return starts[found].tolist(), ends[found].tolist()


def _unroll(path: tuple | None) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def _roll(chars: str) -> tuple | None:
    path = None
    for c in chars:
        path = (path, c)
    return path


_RUN = re.compile(r"(.)\1+")
_DOUBLE = re.compile(r"(.)\1")


def stems(words: set[str]) -> set[str]:
    return {"^" + w[:k] for k in STEMS for w in words if len(w) > k}


class Lexicon:
    def __init__(self, odds: dict[str, float], prior: float):
        self.words = {w: o for w, o in odds.items() if w[0] != "^"}
        self.starts = {k: {w[1:]: o for w, o in odds.items() if w[0] == "^" and len(w) == k + 1} for k in STEMS}
        self.keys = set(self.words)
        self.prior = prior

    def score(self, words: set[str]) -> tuple[float, list[str]]:
        """Probability of the label given the strongest evidence (further pieces add a little), and the evidence."""
        hits = [(self.words[w], w) for w in words & self.keys]
        for k, table_ in self.starts.items():
            if table_:
                hits += [(table_[w[:k]], w) for w in words if w[:k] in table_ and len(w) > k]
        if not hits:
            return 1 / (1 + math.exp(-(self.prior - 3.0))), []
        hits.sort(reverse=True)
        z = self.prior + hits[0][0] + 0.5 * math.log(len(hits))
        return 1 / (1 + math.exp(-min(z, 30.0))), [w for _, w in hits]


def sketched(sample: DataFrame) -> DataFrame:
    """Rows (key, toxic, text) with a sketch of each text: SKETCH minima over its hashed sequences of SHINGLE words. Near copies share most of them."""

    def sketch(batches):
        for part, data, offs in chunks(batches, "text"):
            starts, ends, first = word_spans(data, offs, ALNUM)
            h = word_hashes(data, starts, ends)
            run = np.zeros(len(h), np.uint64)
            for k in range(SHINGLE):  # shorter at the end of the chunk
                run[: len(h) - k] = run[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]
            out = []
            for a, b in zip(first[:-1], first[1:]):
                own = run[a : max(a + 1, b - SHINGLE + 1)] if b - a >= SHINGLE else np.array([h[a:b].sum()], np.uint64)
                out.append([int(mix(own ^ np.uint64(0xA24BAED4963EE407 * (k + 1) & (1 << 64) - 1)).min().view(np.int64)) for k in range(SKETCH)])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "toxic", "text")), pa.array(out, pa.list_(pa.int64()))], names=["key", "toxic", "text", "sketch"])

    return sample.mapInArrow(sketch, "key long, toxic int, text string, sketch array<long>")


def weighted(sample: DataFrame) -> DataFrame:
    """Rows (toxic, text, weight): a family of copies and near copies weighs about one.

    A row weighs one over the number of rows that share a minimum with it, the median of its minima deciding: a few word sequences in common make no family.
    """
    rows = sketched(sample.select(F.xxhash64("text").alias("key"), F.col("toxic").cast("int").alias("toxic"), "text"))
    minima = rows.select("key", F.posexplode("sketch").alias("k", "h"))
    of_row = minima.distinct().join(minima.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")), ["k", "h"]).groupBy("key").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"))
    shared = of_row.select("key", (1.0 / F.col("n")[(SKETCH - 1) // 2]).alias("weight"))
    return rows.join(shared, "key").select("toxic", "text", "weight")


def evidence(found: DataFrame) -> DataFrame:
    """Features (w, n0, n1: weighted documents of either class) that the toxic class holds beyond chance, with their log odds.

    Chance is the bound exp(-n * KL(share of toxic among the feature's documents, share of toxic in the sample)) on drawing them at random, times the number of
    features tried; it adapts to the size and balance of the sample.
    """
    whole = found.filter("w = ''").first()
    n0, n1 = (whole.n0, whole.n1) if whole else (0.0, 0.0)
    if not n1 or not n0:
        return found.limit(0).withColumn("odds", F.lit(0.0))
    tried = found.filter("w != ''").count()
    n, share = F.col("n0") + F.col("n1"), n1 / (n0 + n1)
    part = lambda x, y: F.when(x > 0, x * F.log(x / n / y)).otherwise(0.0)
    surprise = part(F.col("n1"), share) + part(F.col("n0"), 1 - share)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    return found.filter("w != ''").withColumn("odds", odds).filter((F.col("odds") >= MIN_ODDS) & (surprise >= math.log(max(tried, 1)) - math.log(CHANCE_FEATURES)))


def train(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[Restorer, Lexicon]:
    """Character model from all texts; lexicon from at most ``rows`` labelled training documents of each class."""
    restorer = Restorer(CharModel(char_counts(docs)))
    seen = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc_mod("doc_id", 3) != 1)
    pick = lambda y: seen.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "toxic")
    chosen = pick(0).unionByName(pick(1))
    sample = materialise(weighted(docs.join(F.broadcast(chosen), "doc_id")), "toxicity")

    sent = docs.sparkSession.sparkContext.broadcast(restorer)

    def count(batches):
        restorer = sent.value
        total: dict[str, list[float]] = {}
        size = [0.0, 0.0]
        for part, data, offs in chunks(batches, "text"):
            for words, y, weight in zip(restorer.features(data, offs), part.column("toxic").to_pylist(), part.column("weight").to_pylist()):
                size[y] += weight
                for w in words | stems(words):
                    total.setdefault(w, [0.0, 0.0])[y] += weight
        total[""] = size
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k][0] for k in keys], pa.float64()), pa.array([total[k][1] for k in keys], pa.float64())], names=["w", "n0", "n1"])

    counts = sample.repartition(max(1, min(64, docs.sparkSession.sparkContext.defaultParallelism))).mapInArrow(count, "w string, n0 double, n1 double")
    found = materialise(counts.groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "features")
    share = {r["toxic"]: r["count"] for r in seen.groupBy("toxic").count().collect()}
    prior = math.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))
    return restorer, Lexicon({r.w: r.odds for r in evidence(found).collect()}, prior)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Score every text: doc_id, score (0 to 1), evidence (the restored words that count, strongest first); with ``carry`` also text and carried, a struct of those columns.

    ``labels`` has doc_id and toxic; rows whose crc32(doc_id as text) mod 3 is 1 are never learned from, repeated labels count once
    (the largest), other values than 0 and 1 and null ids are ignored. Edge cases: null and empty texts get the score of a text
    without evidence; without labels the prior alone decides; ids may be null or repeated; an empty table gives an empty result;
    other columns are not read. Very long texts are scored whole.

    Copies and near copies among the labelled rows count about once. A feature is evidence if its odds are high and if so many toxic documents are beyond chance.

    Scale: one scan for the character model (its counts are bounded), one for the training sample, one to score; no shuffle of texts but the sample's.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried(carry))
    restorer, lexicon = train(source.select("doc_id", "text"), labels.select("doc_id", "toxic"), train_rows)
    kept = ["doc_id"] if carry is None else ["doc_id", "text", "carried"]
    sent = docs.sparkSession.sparkContext.broadcast((restorer, lexicon))

    def score(batches):
        restorer, lexicon = sent.value
        for part, data, offs in chunks(batches, "text"):
            scores, why = [], []
            for words in restorer.features(data, offs):
                s, hits = lexicon.score(words)
                scores.append(s), why.append(hits)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array(why, pa.list_(pa.string()))], names=[*kept, "score", "evidence"])

    return source.mapInArrow(score, with_fields(source.select(*kept).schema, "score double, evidence array<string>"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    got = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
