"""Benchmark decontamination with an FM-index per training shard.

Each shard's texts become one sequence of symbols: words that occur in the benchmark are symbols, every stretch of other words
and every document border is a separator. The shard's suffix array gives its Burrows-Wheeler transform, held in a wavelet matrix;
test phrases (windows of benchmark words) are found by backward search through its ranks, occurrences are located by sampled
suffix positions, and their word ranges are merged into removal spans.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Numbering, bounded_batches, carried, chunks, materialise, raw, table, with_fields, word_hashes, word_spans

WINDOW = 10
SAMPLE_EVERY = 8
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 2 << 20
LOCATE_BLOCK = 1 << 20


class BitRank:
    """A bit sequence with ranks by blocks of 64."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, width: int):
        self.width, self.levels, self.zeros = width, [], []
        for level in range(width - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            self.levels.append(BitRank(bits))
            self.zeros.append(int(len(bits) - np.count_nonzero(bits)))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``i`` (arrays of equal length)."""
        start = np.zeros_like(i)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (self.width - 1 - k)) & 1 == 1
            a, b = level.rank1(start), level.rank1(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions ``i`` and how often each occurs before."""
        symbol, start, at = np.zeros_like(i), np.zeros_like(i), i
        for level, zeros in zip(self.levels, self.zeros):
            one = level.get(at) == 1
            a, b = level.rank1(start), level.rank1(at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
            symbol = symbol * 2 + one
        return symbol, at - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; every 0 is a separator of its own, smaller than the symbols and ordered by place."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    order = np.argsort(rank, kind="stable")
    step = 1

    def renumber(keys: np.ndarray) -> np.ndarray:
        fresh = np.ones(n, bool)
        fresh[1:] = keys[1:] != keys[:-1]
        heads = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[order] = heads
        return heads

    heads = renumber(rank[order])
    while True:
        sizes = np.diff(np.append(np.flatnonzero(heads == np.arange(n)), n))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))  # only suffixes that share their rank are sorted again
        if not len(tied):
            return order
        at = order[tied]
        follow = np.full(len(at), -1, np.int64)
        inside = at + step < n
        follow[inside] = rank[at[inside] + step]
        again = np.lexsort((follow, heads[tied]))
        order[tied] = at[again]
        keys, follow = heads[tied], follow[again]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (follow[1:] != follow[:-1])
        heads[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = heads[tied]
        step *= 2


class FMIndex:
    """Backward search and location over a symbol sequence (0 separates and is never searched)."""

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        text = np.append(symbols, 0)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n = len(text)
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), max(1, int(sigma).bit_length()))
        self.first = np.zeros(sigma + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.first[1:])
        sampled = (order % every == 0) | (bwt == 0)  # no walk back crosses a separator
        self.marks = BitRank(sampled)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the patterns (rows of a matrix, left-aligned, all lengths over 0)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - back]
            lo[live], hi[live] = self.first[symbol] + self.wavelet.rank(symbol, lo[live]), self.first[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows."""
        steps, at = np.zeros(len(rows), np.int64), rows.copy()
        walking = np.flatnonzero(self.marks.get(at) == 0)
        while len(walking):
            symbol, before = self.wavelet.access_rank(at[walking])
            at[walking] = self.first[symbol] + before
            steps[walking] += 1
            walking = walking[self.marks.get(at[walking]) == 0]
        return self.samples[self.marks.rank1(at)] + steps


class Phrases:
    """The distinct windows of a block of benchmark items, over the numbered words of that block."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        data, offs = raw(pa.array(texts, pa.string()))
        starts, ends, first = word_spans(data, offs, ALNUM)
        self.ids = [str(i) for i in ids]
        self.vocabulary, number = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        number = number.astype(np.int64) + 1
        rows, lengths, items = [], [], []
        for k in range(len(texts)):
            own = number[first[k] : first[k + 1]]
            if len(own):
                width = min(window, len(own))
                grams = np.lib.stride_tricks.sliding_window_view(own, width)
                full = np.zeros((len(grams), window), np.int64)
                full[:, :width] = grams
                rows.append(full), lengths.append(np.full(len(grams), width)), items.append(np.full(len(grams), k))
        if rows:
            self.patterns, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            self.lengths = np.zeros(len(self.patterns), np.int64)
            of = of.ravel()
            self.lengths[of] = np.concatenate(lengths)
            pairs = np.unique(np.stack((of, np.concatenate(items)), 1), axis=0)
            self.items = pairs[:, 1]
            self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        else:
            self.patterns, self.lengths, self.items, self.item_from = np.zeros((0, window), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.numbering = Numbering(self.vocabulary)


def search_shard(phrases: Phrases, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]], np.ndarray, np.ndarray]:
    """For each document: words, removal spans (word ranges), ids of the items found; and the byte starts and ends of all words."""
    starts, ends, first = word_spans(data, offs, ALNUM)
    docs = len(offs) - 1
    n_words = np.diff(first)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    items: list[list[str]] = [[] for _ in range(docs)]
    if len(starts) and len(phrases.patterns):
        symbol = phrases.numbering.of(word_hashes(data, starts, ends))
        border = np.zeros(len(starts), bool)
        border[first[:-1][n_words > 0]] = True
        known = symbol > 0
        head = known.copy()  # a separator stands before each stretch of known words within one document
        head[1:] &= ~known[:-1] | border[1:]
        keep = np.flatnonzero(known)
        slots = np.arange(len(keep)) + np.cumsum(head[keep])
        if len(keep):
            text = np.zeros(slots[-1] + 1, np.int64)
            text[slots] = symbol[keep]
            word_at = np.zeros(len(text), np.int64)
            word_at[slots] = keep
            index = FMIndex(text, len(phrases.vocabulary))
            lo, hi = index.search(phrases.patterns, phrases.lengths)
            found = np.flatnonzero(hi > lo)
            edge = np.zeros(len(starts) + 1, np.int32)
            pairs: list[np.ndarray] = []
            sizes = (hi - lo)[found]
            upto = np.cumsum(sizes)
            at = 0
            while at < len(found):  # patterns with at most LOCATE_BLOCK occurrences together (or one pattern) at a time
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOCATE_BLOCK, "right")))
                which, many = found[at:to], sizes[at:to]
                of = np.repeat(which, many)
                rows = np.repeat(lo[which], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                word = word_at[index.locate(rows)]
                np.add.at(edge, word, 1)
                np.add.at(edge, word + phrases.lengths[of], -1)
                doc = np.searchsorted(first, word, "right") - 1
                seen = np.unique(doc * len(phrases.patterns) + of)
                doc, of = np.divmod(seen, len(phrases.patterns))
                many = phrases.item_from[of + 1] - phrases.item_from[of]
                item = phrases.items[np.repeat(phrases.item_from[of], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                pairs.append(np.unique(np.repeat(doc, many) * len(phrases.ids) + item))
                at = to
            hit = np.zeros(len(starts) + 2, bool)
            hit[1:-1] = np.cumsum(edge[:-1]) > 0
            rise = np.flatnonzero(hit[1:-1] & (~hit[:-2] | border))
            fall = np.flatnonzero(hit[1:-1] & (~hit[2:] | np.append(border[1:], True))) + 1
            for s, e, d in zip(rise.tolist(), fall.tolist(), (np.searchsorted(first, rise, "right") - 1).tolist()):
                spans[d].append((s - int(first[d]), e - int(first[d])))
            if pairs:
                for d, i in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(pairs)), len(phrases.ids)))):
                    items[d].append(phrases.ids[i])
    return n_words, spans, items, starts, ends


def _blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark in blocks of at most ``block_bytes`` of text (a longer item alone), one at a time on the driver."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        n = len(r.t.encode())
        if ids and size + n > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i or ""), texts.append(r.t)
        size += n
    yield ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """Find benchmark windows in every text.

    Returns doc_id, n_words, spans array of (start, end) in words, byte_spans array of (start, end) in UTF-8 bytes of the text,
    items array of the ids (as strings, sorted) whose windows occur; with ``carry`` also text and carried, a struct of those columns.

    Edge cases: null and empty texts, and texts or items without words, have no hits; an empty benchmark or table gives no hits;
    an item with fewer words than a window is one window; ids may be null or repeated (one row per input row); a null item id
    counts as the empty string; items with equal ids count once. Other columns are not read.

    Scale: no shuffle. Each task builds and drops one index per shard of about ``shard_bytes`` of text (a longer text is a shard
    of its own). The benchmark passes through the driver in blocks of ``block_bytes``, of which one at a time is held and broadcast; with several
    blocks the texts are written once with row numbers, each block's results are written before the next block goes out, and they are merged by row.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried(carry))
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    sc = docs.sparkSession.sparkContext
    blocks = _blocks(docs.sparkSession, benchmark, item_col, item_text_col, block_bytes)
    block, following = next(blocks), next(blocks, None)
    single = following is None
    source = source.withColumn("row", F.lit(0).cast("long") if single else F.monotonically_increasing_id())
    if not single:  # the scans must agree on the rows
        source = materialise(source, "rows")
    kept = ["doc_id", "row"] if carry is None or not single else ["doc_id", "row", "text", "carried"]

    def found(sent) -> DataFrame:
        def search(batches):
            for rows, data, offs in chunks(batches, "text", shard_bytes):
                n_words, spans, items, starts, ends = search_shard(sent.value, data, offs)
                first = np.concatenate(([0], np.cumsum(n_words)))
                places = [[{"start": int(starts[first[d] + s] - offs[d]), "end": int(ends[first[d] + e - 1] - offs[d])} for s, e in own] for d, own in enumerate(spans)]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in kept), pa.array(n_words, pa.int64()),
                     pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], pa.list_(pair)), pa.array(places, pa.list_(pair)), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                    names=[*kept, "n_words", "spans", "byte_spans", "items"],
                )

        return source.mapInArrow(search, with_fields(source.select(*kept).schema, "n_words long, spans array<struct<start:long,end:long>>, byte_spans array<struct<start:long,end:long>>, items array<string>"))

    if single:
        return found(sc.broadcast(Phrases(*block, window))).drop("row")
    union = None
    while block:
        sent = sc.broadcast(Phrases(*block, window))
        part = materialise(found(sent), "hits")
        sent.destroy()
        union = part if union is None else union.unionByName(part)
        block, following = following, next(blocks, None) if following else None
    both = F.transform(F.arrays_zip("spans", "byte_spans"), lambda z: F.struct(z["spans"]["start"].alias("start"), z["spans"]["end"].alias("end"), z["byte_spans"]["start"].alias("first"), z["byte_spans"]["end"].alias("last")))
    merged = union.select("row", "doc_id", "n_words", both.alias("spans"), "items").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")])
    merged = merged.withColumn("spans", merge_spans("spans"))
    pair_of = lambda a, b: F.transform("spans", lambda s: F.struct(s[a].alias("start"), s[b].alias("end")))
    merged = merged.select("row", "doc_id", "n_words", pair_of("start", "end").alias("spans"), pair_of("first", "last").alias("byte_spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    return merged.drop("row") if carry is None else source.select("row", "text", "carried").join(merged, "row").drop("row")


def merge_spans(column: str):
    """Spans (start, end in words, first, last in bytes) in order, those that overlap or adjoin in words joined."""
    last = lambda done: F.element_at(done, -1)
    joined = lambda p, s: F.struct(p["start"].alias("start"), F.greatest(p["end"], s["end"]).alias("end"), p["first"].alias("first"), F.greatest(p["last"], s["last"]).alias("last"))
    return F.aggregate(
        F.array_sort(column), F.expr("cast(array() as array<struct<start:long,end:long,first:long,last:long>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (last(done)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last(done), s)))).otherwise(F.concat(done, F.array(s))),
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM k)),
dg AS (SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM (SELECT d.*, ks.k, unnest(range(len(w) - ks.k + 1)) AS i FROM d JOIN (SELECT DISTINCT k FROM win) ks ON len(w) >= ks.k)),
hit AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN win ON win.k = dg.k AND win.g = dg.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
