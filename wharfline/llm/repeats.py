"""Removal of long repeated byte strings by an enhanced suffix array and its tree of common-prefix intervals.

Sampling. Every window of ``length`` bytes has an anchor, the place in it whose next GRAM bytes hash lowest; equal windows have equal anchors at equal offsets. So two
equal windows meet if the suffixes that begin at anchors are compared, one in some 150 suffixes, forwards up to ``length`` bytes and backwards up to ``length`` - GRAM.

Classes. Anchors with equal bytes at both sides (their context) form a class. A class of two or more repeats as a whole. Only where one gram has several contexts, and one
of them stands alone, are the bytes themselves compared, once per class, however many copies there are.

Array and tree. Those contexts are sorted by what follows the anchor (the suffix array), neighbours give the lengths of common prefixes, and one scan with a stack yields
every interval of suffixes with a common prefix. In an interval, left extensions are compared among all occurrences: those whose prefix and left
extension together reach ``length`` bytes are a repeat group, if they extend differently to the left and not all to one same longer prefix (then the deeper interval has it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import bounded_batches, chunks, materialise, mix, release, table, with_fields

LENGTH = 400
GRAM = 100
#: a gram with more contexts than this is split by longer strings before its array is built
GROUP = 20_000
STEP = 25
_VALUE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ANCHOR = "key long, size int, pos int, x long, c long"
CONTEXT = "x long, c long, n long, m long, ahead binary, behind binary"


def sliding(v: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        v, span = best(v[:-span], v[span:]), span * 2
    return best(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


def anchors_of(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, places, gram hashes and context hashes of all anchors of texts that stand one after another."""
    n, width = len(data), length - gram + 1
    empty = np.empty(0, np.int64)
    starts = np.flatnonzero(np.diff(offs) >= length)
    if not len(starts):
        return empty, empty, empty, empty
    power, inverse = common._power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1]) | np.uint64(1)
    lowest = np.array(sliding(h, width, np.minimum))  # of the window that starts here
    valid = np.zeros(len(lowest) + 1, np.int8)
    valid[offs[starts]] = 1
    valid[offs[starts + 1] - length + 1] -= 1
    lowest[np.cumsum(valid[:-1]) == 0] = 0  # a window ends in its document
    # a place is an anchor if it has the lowest hash of one of the windows it lies in
    around = np.concatenate((np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)))
    at = np.flatnonzero(sliding(around, width, np.maximum)[: len(h)] == h)
    doc = np.searchsorted(offs, at, "right") - 1
    low, high = np.maximum(offs[doc], at - (length - gram)), np.minimum(offs[doc + 1], at + length)
    context = (sums[high] - sums[low]) * inverse[low]
    c = mix(context + mix(((at - low) << 32 | (high - at)).astype(np.uint64)))
    return doc, at - offs[doc], h[at].view(np.int64), c.view(np.int64)


def text_key(text: Column) -> list[Column]:
    """What tells texts apart: a hash and the number of bytes."""
    return [F.xxhash64(text).alias("key"), F.octet_length(text).alias("size")]


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs (text, key, size) to anchors: text, place, gram and context."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches, "text"):
            doc, pos, x, c = anchors_of(data, offs, length, gram)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column("key").take(rows), part.column("size").take(rows), pa.array(pos.astype(np.int32)), pa.array(x), pa.array(c)], names=["key", "size", "pos", "x", "c"])

    return docs.mapInArrow(find, ANCHOR)


def contexts(wanted: DataFrame, docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes after and (backwards) before the anchors ``wanted`` (key, size, pos, x, c, n, m), read from one copy of their text."""
    places = wanted.groupBy("key", "size").agg(F.collect_list(F.struct("pos", "x", "c", "n", "m")).alias("places"))
    texts = docs.groupBy("key", "size").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches, "text"):
            text, places = data.tobytes(), part.column("places")
            inner, ends = places.flatten(), places.offsets.to_numpy()
            start = np.repeat(offs[:-1], np.diff(ends))
            end = np.repeat(offs[1:], np.diff(ends))
            at = start + inner.field("pos").to_numpy()
            ahead = [text[a:b] for a, b in zip(at.tolist(), np.minimum(end, at + length).tolist())]
            behind = [text[a:b][::-1] for a, b in zip(np.maximum(start, at - (length - gram)).tolist(), at.tolist())]
            whole = pa.RecordBatch.from_arrays([*[inner.field(k) for k in ("x", "c", "n", "m")], pa.array(ahead, pa.binary()), pa.array(behind, pa.binary())], names=["x", "c", "n", "m", "ahead", "behind"])
            for i in range(0, whole.num_rows, 2048):
                yield whole.slice(i, 2048)

    return places.join(texts, ["key", "size"]).select("text", "places").mapInArrow(cut, CONTEXT)


# ---------------------------------------------------------------- arrays and trees


def agreement(rows: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """How many first bytes each row shares with the one before it; 0 across groups."""
    n = len(rows)
    lens = np.fromiter(map(len, rows), np.int64, n)
    cells = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
    out = np.zeros(n, np.int64)
    differ = cells[1:] != cells[:-1]
    first = np.where(differ.any(1), differ.argmax(1), width)
    out[1:] = np.where(group[1:] == group[:-1], np.minimum(first, np.minimum(lens[1:], lens[:-1])), 0)
    return out


def intervals(shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The tree of common-prefix intervals (length, first, last), children before parents: one scan with a stack."""
    stack: list[tuple[int, int]] = []
    for i, now in enumerate([*shared.tolist(), 0]):
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield length, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


class Array:
    """The enhanced suffix array of rows that are sorted by group and ``ahead``: common prefixes, and the rows' order by what precedes the anchor with common extensions there."""

    def __init__(self, group: np.ndarray, ahead: list[bytes], behind: list[bytes], length: int, gram: int):
        self.length, self.gram = length, gram
        self.shared = agreement(ahead, group, length)
        numbers = group.tolist()
        order = sorted(range(len(behind)), key=lambda i: (numbers[i], behind[i]))
        self.order = np.array(order, np.int64)
        self.rank = np.empty(len(order), np.int64)
        self.rank[self.order] = np.arange(len(order))
        self.left = agreement([behind[i] for i in order], group[self.order], max(length - gram, 1))

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of every common-prefix interval the prefix's length, its rows by left extension, and what each shares to the left with the one before (0 for the first)."""
        for prefix, first, last in intervals(self.shared, self.gram):
            places = np.sort(self.rank[first : last + 1])
            near = np.zeros(len(places), np.int64)
            near[1:] = np.minimum.reduceat(self.left[: places[-1] + 1], places[:-1] + 1)
            yield prefix, self.order[places], near

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes before and from the anchor on each row repeats, in repeats of ``length`` bytes or more that hold the anchor; 0 and 0 if it has none.

        Within an interval a row's longest left extension is the one it shares with a neighbour by left extension.
        """
        before, after = np.zeros(len(self.order), np.int64), np.zeros(len(self.order), np.int64)
        for prefix, rows, near in self.nodes():
            if near.max() + prefix >= self.length:
                best = np.maximum(near, np.append(near[1:], 0))
                hit = best + prefix >= self.length
                before[rows[hit]] = np.maximum(before[rows[hit]], best[hit])
                after[rows[hit]] = np.maximum(after[rows[hit]], prefix)
        return before, after

    def repeats(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Maximal repeats of ``length`` bytes or more that hold the anchor: bytes before it, bytes from it on, and all rows that have them.

        The left extensions of an interval give a tree of their own: its nodes extend differently to the left, and rows that share more than the interval's prefix
        belong to a deeper interval.
        """
        for prefix, rows, near in self.nodes():
            least = self.length - prefix
            if near.max() < least:
                continue
            found = list(intervals(near, max(least, 1)))
            if least <= 0 and near[1:].min() == 0:
                found.append((0, 0, len(rows) - 1))
            for extension, a, b in found:
                own = np.sort(rows[a : b + 1])
                if self.shared[own[0] + 1 : own[-1] + 1].min() == prefix:
                    yield extension, prefix, own


def in_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with equal ``key``, from rows that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held)
            keys = t.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left")) if (keys[1:] >= keys[:-1]).all() else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches() if cut < t.num_rows else []
    if held:
        yield pa.Table.from_batches(held)
    release()


def trees(bounded: DataFrame, length: int, gram: int, whole: bool = False) -> DataFrame:
    """The repeats of rows (g, x, c, n, ahead, behind) whose groups g are bounded; Spark's sort makes the suffix array of each group.

    Returns how far the repeats of each lone context reach (x, c, before, after), or with ``whole`` every repeat with every context: g, nth, x, c, before, after.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_groups(batches, "g"):
            group, x, c = (t.column(k).to_numpy() for k in ("g", "x", "c"))
            made = Array(group, t.column("ahead").to_pylist(), t.column("behind").to_pylist(), length, gram)
            if whole:
                for nth, (b, a, rows) in enumerate(made.repeats()):
                    of = np.full(len(rows), 1, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (group[rows], of.astype(np.int64) * nth, x[rows], c[rows], of * b, of * a)], names=["g", "nth", "x", "c", "before", "after"])
                continue
            before, after = (v.astype(np.int32) for v in made.reach())
            hit = (after > 0) & (t.column("n").to_numpy() == 1)
            yield pa.RecordBatch.from_arrays([pa.array(v[hit]) for v in (x, c, before, after)], names=["x", "c", "before", "after"])

    schema = ("g long, nth long, " if whole else "") + "x long, c long, before int, after int"
    return bounded.repartition("g").sortWithinPartitions("g", "ahead").mapInArrow(scan, schema)


def pieces(hot: DataFrame, length: int, gram: int, step: int, width: int | None = None) -> DataFrame:
    """The contexts of hot grams by longer strings: j, h, x, c for every ``step`` offsets j of the anchor in a window, h being a hash of what all windows at these offsets share.

    Equal windows have equal j and h. With a step of 1, equal j and h are equal windows. ``hot`` may have a column j of wider steps (``width``) to stay within.
    """
    back = length - gram

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ahead, behind = batch.column("ahead").to_pylist(), batch.column("behind").to_pylist()
            within = batch.column("j").to_pylist() if width else [None] * len(ahead)
            row, js, hs = [], [], []
            for k, (a, b, w) in enumerate(zip(ahead, behind, within)):
                for j in range(w or 0, back + 1 if w is None else min(back + 1, w + width), step):
                    need = length - min(j + step - 1, back)  # bytes from the anchor on that all these windows have
                    if j <= len(b) and need <= len(a) and len(a) + len(b) >= length:
                        row.append(k)
                        js.append(j)
                        hs.append(int.from_bytes(hashlib.blake2b(b[:j] + b"|" + a[:need], digest_size=8).digest(), "little", signed=True))
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x").take(rows), batch.column("c").take(rows), batch.column("n").take(rows), pa.array(js, pa.int32()), pa.array(hs, pa.int64())], names=["x", "c", "n", "j", "h"])

    return hot.select("x", "c", "n", "ahead", "behind", *(["j"] if width else [])).mapInArrow(split, "x long, c long, n long, j int, h long")


class Repeats:
    """The stored tables of one search: anchors, their classes, and the contexts that were compared. ``docs`` has text, key and size."""

    def __init__(self, docs: DataFrame, length: int, gram: int, group: int):
        self.length, self.gram, self.group = length, gram, group
        self.anchors = materialise(anchors(docs, length, gram), "anchors")
        at = F.shiftleft(F.col("size").cast("long"), 32) + F.col("pos")
        self.classes = materialise(self.anchors.groupBy("x", "c").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first(at).alias("at")), "classes")
        mixed = self.classes.groupBy("x").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("lone")).filter("m > 1 and lone > 0").select("x", "m")
        wanted = self.classes.join(mixed, "x").select("key", F.shiftright("at", 32).cast("int").alias("size"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"), "x", "c", "n", "m")
        seen = materialise(contexts(wanted, docs, length, gram), "contexts")
        self.small = seen.filter(F.col("m") <= group).select(F.col("x").alias("g"), "x", "c", "n", "ahead", "behind")
        # a hot gram: groups of what STEP neighbouring windows share, which are smaller; if they are not, windows are compared one by one
        hot = seen.filter(F.col("m") > group)
        coarse = pieces(hot, length, gram, STEP)
        sizes = coarse.groupBy("x", "j", "h").agg(F.count(F.lit(1)).alias("p")).filter("p > 1")
        split = materialise(coarse.join(sizes, ["x", "j", "h"]).select("x", "c", "j", "p", F.xxhash64("x", "j", "h").alias("g")), "split").join(hot, ["x", "c"])
        self.split = split.filter(F.col("p") <= group).select("g", "x", "c", "n", "ahead", "behind")
        windows = pieces(split.filter(F.col("p") > group), length, gram, 1, STEP)
        equal = windows.groupBy("x", "j", "h").agg(F.count(F.lit(1)).alias("p")).filter("p > 1").select("x", "j", "h")
        self.windows = windows.join(equal, ["x", "j", "h"]).select("x", "c", "n", F.xxhash64("x", "j", "h").alias("g"), F.col("j").alias("before"), (F.lit(length) - F.col("j")).cast("int").alias("after"))

    def whole(self) -> DataFrame:
        """Classes of several anchors: their whole context repeats."""
        return self.classes.filter("n > 1").select("x", "c", F.lit(self.length - self.gram).alias("before"), F.lit(self.length).alias("after"))

    def reach(self) -> DataFrame:
        """x, c, before, after: how far around the anchors of a class repeats reach."""
        alone = trees(self.small, self.length, self.gram).unionByName(trees(self.split, self.length, self.gram)).unionByName(self.windows.filter("n = 1").select("x", "c", "before", "after"))
        return self.whole().unionByName(alone.groupBy("x", "c").agg(F.max("before").alias("before"), F.max("after").alias("after")))

    def groups(self) -> DataFrame:
        """repeat, x, c, before, after: every repeat with the classes that have it."""
        found = trees(self.small, self.length, self.gram, True).unionByName(trees(self.split, self.length, self.gram, True))
        return (
            self.whole().select(F.concat_ws(":", F.lit("class"), "x", "c").alias("repeat"), "x", "c", "before", "after")
            .unionByName(found.select(F.concat_ws(":", F.lit("tree"), "g", "nth").alias("repeat"), "x", "c", "before", "after"))
            .unionByName(self.windows.select(F.concat_ws(":", F.lit("window"), "g").alias("repeat"), "x", "c", "before", "after"))
        )


def prepared(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int | None, group: int) -> tuple[DataFrame, Repeats]:
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *text_key(text))
    return rows, Repeats(rows.drop("doc_id"), length, min(GRAM, max(1, length // 4)) if gram is None else gram, group)


def bounds() -> tuple[Column, Column]:
    """Where the repeat around an anchor starts and ends in its text; contexts are cut at the text's ends."""
    return F.greatest(F.lit(0), F.col("pos") - F.col("before")), F.least(F.col("size"), F.col("pos") + F.col("after"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """Groups of equal strings of ``length`` bytes or more, with all their occurrences: repeat, n_bytes, doc_id, start.

    A longer repeat than fits around one anchor shows as a chain of overlapping groups, one per anchor in it. Edge cases as in ``remove_repeats``.
    """
    rows, found = prepared(docs, id_col, text_col, length, gram, group)
    start, end = bounds()
    places = found.anchors.distinct().join(found.groups(), ["x", "c"]).select("repeat", "key", "size", start.alias("start"), (end - start).alias("n_bytes"))
    return places.join(rows.select("doc_id", "key", "size"), ["key", "size"]).select("repeat", "n_bytes", "doc_id", "start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """Marks every byte of every text that is covered by a string of ``length`` bytes that also starts anywhere else, in the same text or another.

    Returns one row per input row: doc_id, n_bytes, spans (start, length of the maximal removed runs) and kept (the remaining bytes, which may cut characters).

    Edge cases: texts are UTF-8 bytes; null counts as empty; matches never cross texts. Strings may overlap themselves. All copies go, the first one too. Rows with equal texts repeat each
    other; null and repeated ids are rows like any other. An empty table gives an empty result; other columns are not read. Texts shorter than ``length`` are kept.

    Scale: texts are read once for the anchors and shuffled twice, for contexts and for the result. Contexts are gathered per distinct class. An array holds ``group``
    contexts at most; grams with more are split exactly by longer strings.
    """
    rows, found = prepared(docs, id_col, text_col, length, gram, group)
    around, (start, end) = materialise(found.reach(), "reach"), bounds()
    spans = found.anchors.join(around, ["x", "c"]).select("key", "size", (F.shiftleft(start.cast("long"), 32) + end).alias("span")).groupBy("key", "size").agg(F.collect_set("span").alias("marks"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in chunks(batches, "text"):
            out, kept = [], []
            marks = part.column("marks")
            for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                own = data[a:b].tobytes()
                runs: list[tuple[int, int]] = []
                if marks[k].is_valid:
                    cells = np.sort(marks[k].values.to_numpy())
                    lo, hi = cells >> 32, np.maximum.accumulate(cells & 0xFFFFFFFF)
                    new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                    runs = list(zip(lo[new].tolist(), hi[np.append(new[1:], len(hi)) - 1].tolist()))
                if runs:
                    own = b"".join(own[i:j] for i, j in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], len(own)]))
                out.append([(s, e - s) for s, e in runs])
                kept.append(own)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs)), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = rows.join(spans, ["key", "size"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(drop, with_fields(joined.select("doc_id").schema, "n_bytes long, spans array<struct<start:long,length:long>>, kept binary"))


def op11_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return d.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
blocks AS (SELECT doc_id, n, b, substr(h, b * 2000 + 1, 2800) AS s FROM (SELECT *, unnest(range((n + 999) // 1000)) AS b FROM docs)),
starts AS (
  SELECT doc_id, b * 1000 + j AS i, md5(substr(s, 2 * j + 1, 800)) AS m
  FROM (SELECT *, unnest(range(least(1000, n - 399 - b * 1000))) AS j FROM blocks WHERE n - 399 - b * 1000 > 0)),
again AS (SELECT m FROM starts GROUP BY m HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM starts SEMI JOIN again USING (m)),
marks AS (SELECT doc_id, i, sum(edge) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS edge FROM hits)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM marks GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM (SELECT * FROM runs UNION ALL SELECT doc_id, n, n FROM docs)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS h FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id),
told AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs LEFT JOIN told USING (doc_id) JOIN kept k USING (doc_id)
"""
