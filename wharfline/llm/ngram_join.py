"""N-gram Jaccard join by grouped prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles reaches the threshold. Shingles are ordered by
corpus frequency (rare first; a fixed-size sketch of counts over all documents decides, ties by hash), so two linking documents
share a shingle within their prefixes; prefixes are a little longer, so that they share several and documents with too few go. Documents with identical prefix and size are collapsed into one group. Groups meet in the
buckets of their prefix shingles, pairs of groups are filtered by size and position, and only the pairs that are left are
expanded to their members and verified on whole texts.

Components need no pairs within what is already connected, so no bucket emits all pairs of its groups. In a bucket, each band of
sizes (STEPS bands per doubling) has a hub: of the groups that can be the smaller side of a link there, the one with the smallest size, then id.
Groups are paired with the hubs of their bands only, so there are at most a few pairs for each prefix shingle.

What those links leave apart is found exactly by this fact: let s and m link, |m| <= |s|, and let h be the hub of m's band in the
bucket of their first common shingle, so |h| <= |m|. If s and m share nothing outside h, then |s and m| is at most |s and h| and at most
|m and h|; as |h| is no larger than either, both link with h and are connected already. Otherwise they share a shingle
outside h. So members of one hub that differ in component meet by (hub, shingle outside the hub): again with a prefix only, and with
filters by size, by position and by the overlaps with the hub. Before that, a hub's list is tried against its
most central member and against neighbours, which connects most of what is one component; and rings of distance around the hub are compared: the Jaccard distance is a metric,
so members whose distances from the hub differ by more than the threshold cannot link, and rings whose reachable members are all connected need nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, bounded_batches, carried, chunks, counted, materialise, mix, release, table, with_fields, word_hashes, word_spans

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 22
EDGES_PER_FILE = 1_000_000
#: Prefixes are this percentage of the set longer than one common shingle needs; in return linking sets share as many shingles there.
SHARE = 5
#: Size bands per doubling of the set size.
STEPS = 8
#: Passes over the hubs' lists before the exact step, and the members of a list that are sorted in one piece.
TURNS, LIST_PART = 2, 20_000
#: At most so many cells of the sketch are hot (each other cell then holds less than 1 / HOT_CELLS of all shingles), and the parts of each.
HOT_CELLS, HOT_PARTS, HOT_MIN = 1000, 32, 4096
_Q = np.uint64(0xA24BAED4963EE407)


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and each document's offset among them; a document with fewer words has its whole sequence as one."""
    starts, ends, first = word_spans(data, offs, NON_SPACE)
    h = word_hashes(data, starts, ends)
    n = np.diff(first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_from = np.concatenate(([0], np.cumsum(counts)))
    out = np.empty(out_from[-1], np.uint64)
    if len(h) >= k:
        s = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            s *= _Q
            s += h[j : len(h) - k + 1 + j]
        long = n >= k
        at = np.repeat(first[:-1][long] - out_from[:-1][long], counts[long])
        places = np.flatnonzero(np.repeat(long, counts))
        out[places] = mix(s[places + at])
    for d in np.flatnonzero((n > 0) & (n < k)):
        s = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for x in h[first[d] : first[d + 1]]:
                s = s * _Q + x
        out[out_from[d]] = mix(np.array([s ^ np.uint64(0x5851F42D4C957F2D)]))[0]
    return out, out_from


def frequency_sketch(source: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all shingles by the top bits of their hash; ``bits`` bounds its size whatever the corpus."""
    return counted(source, 1 << bits, lambda data, offs: (shingles(data, offs, k)[0] >> np.uint64(64 - bits)).astype(np.int64))


def rank_of(sketch: np.ndarray) -> np.ndarray:
    """The order of shingles by sketched frequency, in 16 bits (monotone); ties go by hash."""
    return np.round(512 * np.log2(1.0 + sketch)).astype(np.uint16)


def shared_prefix(size: int) -> int:
    """How many shingles any two linking sets, the smaller of this size, share within their prefixes (which are that much longer)."""
    return max(1, size * SHARE // 100)


def hot_cells(sketch: np.ndarray, hot_min: int) -> list[int]:
    """The sketch cells (at most HOT_CELLS) far above the mean; their shingles are salted, as one of them may be in a third of all documents."""
    most = np.argsort(sketch)[-HOT_CELLS:]
    return most[sketch[most] > max(hot_min, 4 * sketch.mean())].tolist()


def by_rank(own: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A sorted set in the common order, rare shingles first."""
    return own[np.argsort(rank[own >> np.uint64(65 - len(rank).bit_length())], kind="stable")]


def signatures(source: DataFrame, order, k: int, percent: int) -> DataFrame:
    """Every row of ``source`` with its set size n, keys of its set (s1, s2) and of its prefix and size (g1, g2), and the prefix."""

    def sign(batches):
        rank = order.value
        for rows, data, offs in chunks(batches, "text"):
            values, at = shingles(data, offs, k)
            n, keys, prefixes = [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = np.unique(values[a:b])
                size = len(own)
                n.append(size)
                if not size:
                    keys.append((0, 0, 0, 0)), prefixes.append(own)
                    continue
                want = size - (percent * size + 99) // 100 + shared_prefix(size)
                prefix = by_rank(own, rank)[:want]
                tag = np.uint64(size * 0x632BE59BD9B4E019 & (1 << 64) - 1)
                keys.append((own.sum(), mix(own).sum(), mix(prefix ^ tag).sum(), mix(prefix + tag).sum()))
                prefixes.append(prefix)
            signed = np.array(keys, np.uint64).view(np.int64).reshape(-1, 4)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))), pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n, pa.int64()), *[pa.array(signed[:, i]) for i in range(4)], lists], names=[*rows.schema.names, "n", "s1", "s2", "g1", "g2", "prefix"])

    return source.mapInArrow(sign, with_fields(source.schema, "n long, s1 long, s2 long, g1 long, g2 long, prefix array<long>"))


class Sets:
    """Shingle sets of compressed texts, with a small cache."""

    def __init__(self, k: int):
        self.k, self.known, self.unpack = k, {}, zstandard.ZstdDecompressor()

    def of(self, i: int, z: bytes) -> np.ndarray:
        got = self.known.get(i)
        if got is None:
            if len(self.known) > 200:
                self.known.clear()
            data = np.frombuffer(self.unpack.decompress(z), np.uint8)
            got = self.known[i] = np.unique(shingles(data, np.array([0, len(data)]), self.k)[0])
        return got


def with_texts(pairs: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """Pairs (a, b) with both compressed texts."""
    left = texts.select(F.col("key").alias("a"), F.col("z").alias("za"))
    right = texts.select(F.col("key").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", *more, "za", "zb")


def overlaps(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """For pairs (a, b) the sizes of both whole sets and of their intersection: a, b, n, hn, both."""

    def count(batches):
        sets = Sets(k)
        for batch in batches:
            a, b, za, zb = (batch.column(c) for c in ("a", "b", "za", "zb"))
            found = []
            for i in range(batch.num_rows):
                x, y = sets.of(a[i].as_py(), za[i].as_py()), sets.of(b[i].as_py(), zb[i].as_py())
                found.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            sizes = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([a, b, *(pa.array(sizes[:, j]) for j in range(3))], names=["a", "b", "n", "hn", "both"])
        release()

    return with_texts(pairs, texts).mapInArrow(count, "a long, b long, n long, hn long, both long")


def outside(wanted: DataFrame, texts: DataFrame, order, k: int, percent: int) -> DataFrame:
    """For members a and hubs b the shingles of a outside b that a link may need: (hub, v, pos, rep, n, hn, both).

    The other side of a link is no smaller than the hub and than ``percent`` of a, so the overlap it must have is known; at most
    ``held`` of it lies in the hub, the rest outside, and a prefix of the shingles there is enough.
    """

    def differences(batches):
        sets, rank = Sets(k), order.value
        for batch in batches:
            a, b, za, zb, held = (batch.column(c) for c in ("a", "b", "za", "zb", "held"))
            found: list[tuple[np.ndarray, int, int, int, int, int]] = []
            for i in range(batch.num_rows):
                rep, hub = a[i].as_py(), b[i].as_py()
                x, y = sets.of(rep, za[i].as_py()), sets.of(hub, zb[i].as_py())
                rest = np.setdiff1d(x, y, assume_unique=True)
                both = len(x) - len(rest)
                other = max(len(y), -(-percent * len(x) // 100))
                need = -(-percent * (len(x) + other) // (100 + percent)) - held[i].as_py()
                found.append((by_rank(rest, rank)[: max(len(rest) - max(need, 1) + 1, 0)], hub, rep, len(x), len(y), both))
            many = [len(f[0]) for f in found]
            if sum(many):
                spread = lambda k: pa.array(np.repeat(np.array([f[k] for f in found], np.int64), many))
                at = np.arange(sum(many)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([spread(1), pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(at), spread(2), spread(3), spread(4), spread(5)], names=["hub", "v", "pos", "rep", "n", "hn", "both"])
        release()

    return with_texts(wanted, texts, "held").mapInArrow(differences, "hub long, v long, pos long, rep long, n long, hn long, both long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every vertex of the edges (a, b) but the roots, the smallest vertex it is connected with.

    Alternates large-star and small-star steps until every vertex has one parent and every parent is a root (a vertex between
    two parents still joins their components); logarithmically many rounds, each written to the shared folder in files of about EDGES_PER_FILE rows (not one for every shuffle partition). ``edges`` is a written table.
    """
    files = max(4, edges.count() // EDGES_PER_FILE + 1)
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct().coalesce(files), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u")
        small = down.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small.coalesce(files), "edges")
        single = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        if single and e.select(F.col("v").alias("u")).join(e, "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def ngram_join(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, hot_min: int = HOT_MIN, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more, and find the components.

    Returns one row per input row: doc_id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id reachable by
    links), kept (true for one row of every component, one with the smallest id). With ``carry`` also text and carried, a struct of those columns.

    Edge cases: words are runs of non-blanks with A-Z lower-cased; a text with fewer words than a shingle has its word
    sequence as its only shingle; null texts and texts without words are empty, link with nothing and are kept. Every row is a
    document of its own by its own text, so ids may be null or repeated; classes and components of null ids alone have a null id.
    Very long texts are compared whole. An empty table gives an empty result. Other columns are read only to be carried.

    Scale: the texts are scanned twice, written once with their signatures, and shuffled (compressed, only those in some pair) for verification; the
    largest shuffle is one row per prefix shingle of a group, with shingles of hot sketch cells salted. Only the count sketch, of fixed
    size, is broadcast. Hashes of 64 bits stand for shingles. Members of one hub that differ in component and pass all filters are paired;
    nothing bounds their number in the worst case, but they are all similar to the hub, and alike beyond it, without being linked.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *carried(carry), F.monotonically_increasing_id().alias("key"))
    sketch = frequency_sketch(source, shingle, sketch_bits)
    order = spark.sparkContext.broadcast(rank_of(sketch))
    signed = materialise(signatures(source, order, shingle, percent), "signatures")
    real = signed.filter("n > 0")
    classes = real.groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.first("g1").alias("g1"), F.first("g2").alias("g2"))
    groups = real.groupBy("g1", "g2").agg(F.min("key").alias("gid"), F.first("n").cast("int").alias("n"), F.first("prefix").alias("prefix"))

    # buckets of prefix shingles with more than one group
    is_hot = F.shiftrightunsigned("token", 64 - sketch_bits).isin(hot_cells(sketch, hot_min))
    rows = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("part", F.when(is_hot, 1 + F.pmod(F.xxhash64("gid"), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int"))
    along = Window.partitionBy("token", "part").orderBy("gid")
    shared = rows.select("token", "part", "gid", "n", "pos", F.lag("gid").over(along).alias("prev"), F.lead("gid").over(along).alias("next"))
    entries = materialise(shared.filter("part > 0 or prev is not null or next is not null").select("token", "gid", "n", "pos"), "entries")
    # the smaller side of a link has at least ``percent`` of n shingles, and so many of the prefix must be shared
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * SHARE / 100))
    rich = entries.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("e")).filter(F.col("e") >= least).select("gid")
    entries = materialise(entries.join(rich, "gid", "left_semi"), "entries")

    # pairs of groups: each with the hubs of its bands
    members = materialise(classes.join(real.groupBy("g1", "g2").agg(F.min("key").alias("gid")), ["g1", "g2"]).select("gid", "rep"), "members")
    several = members.filter("rep != gid").select("gid").distinct()
    band = F.floor(STEPS * F.log2("n")).alias("band")
    index = entries.filter(F.expr(f"{100 + percent} * (n - pos) >= {2 * percent} * n"))
    hubs = index.groupBy("token", band).agg(F.min(F.struct("n", "gid")).alias("h"), F.max("n").alias("top"), F.count(F.lit(1)).alias("crowd"))
    hubs = hubs.select("token", F.col("h.n").alias("hn"), F.col("h.gid").alias("hub"), "top", (F.col("crowd") > 1).alias("crowded"))
    met = entries.join(hubs, "token").filter(F.expr(f"hn <= n and 100 * top >= {percent} * n and {100 + percent} * (n - pos) >= {percent} * (n + greatest(hn, ceil({percent} * n / 100)))"))
    pairs = met.filter("gid != hub").groupBy("gid", "hub").agg(F.max("crowded").alias("crowded"), F.min("pos").alias("pos"))
    pairs = pairs.join(several.select(F.col("gid").alias("hub"), F.lit(True).alias("wide")), "hub", "left").select("gid", "hub", F.coalesce("wide", "crowded").alias("crowded"), "pos")
    pairs = pairs.unionByName(several.select("gid", F.col("gid").alias("hub"), F.lit(True).alias("crowded"), F.lit(0).alias("pos")))

    # pairs expand to members, which are verified
    first = materialise(pairs.join(members, "gid").filter("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"), "crowded", "pos"), "pairs")

    def packed(batches):
        for part, data, offs in chunks(batches, "text"):
            z, body = zstandard.ZstdCompressor(level=1), data.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([z.compress(body[a:b]) for a, b in zip(offs[:-1], offs[1:])], pa.binary())], names=["key", "z"])

    need = first.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = materialise(signed.select("key", "text").join(need, "key", "left_semi").mapInArrow(packed, "key long, z binary"), "texts")
    links = lambda v: v.filter(F.expr(f"100 * both >= {percent} * (n + hn - both)")).select("a", "b")
    seen = materialise(overlaps(first.select("a", "b"), texts, shingle), "overlaps")
    roots = components(links(seen))

    # what the hubs left apart: members of one hub in different components, by rings around the hub
    near, middle = (F.expr(f"100 * both >= {x} * (n + hn - both)") for x in (percent, max(2 * percent - 100, 0)))
    ring = F.when(near, 0).when(middle, 1).otherwise(2).alias("ring")
    lists = materialise(first.filter("crowded").join(seen, ["a", "b"]).select("a", "b", ring, "both", "n", "pos"), "lists")

    def divided() -> DataFrame:
        """The members of hubs that a link between components may still concern: a, b, ring, label, both, held (least overlap with the hub on either side of a link), size."""
        named = lists.join(roots.select(F.col("id").alias("a"), "root"), "a", "left").withColumn("label", F.coalesce("root", "a")).drop("root")
        best = named.groupBy("b", "label").agg(F.max("both").alias("most"), F.count(F.lit(1)).alias("k"), *[F.max(F.when(F.col("ring").isin(*x), True)).alias(y) for x, y in (((0, 1), "i"), ((1, 2), "o"))])
        apart = best.groupBy("b").agg((F.min(F.when(F.col("i"), F.col("label"))) < F.max(F.when(F.col("i"), F.col("label")))).alias("inner"), (F.min(F.when(F.col("o"), F.col("label"))) < F.max(F.when(F.col("o"), F.col("label")))).alias("outer"),
            F.max(F.struct("most", "label")).alias("top"), F.sum("k").alias("size")).filter("inner or outer")
        second_most = best.join(apart.select("b", "top"), "b").filter("label != top.label").groupBy("b").agg(F.max("most").alias("next"))
        apart = apart.join(second_most, "b")
        held = F.least("both", F.when(F.col("label") == F.col("top.label"), F.col("next")).otherwise(F.col("top.most")))
        return named.join(apart, "b").filter("(ring < 2 and inner) or (ring > 0 and outer)").select("a", "b", "ring", "label", "both", held.alias("held"), "size", "n", "pos")

    # most of what is one component is connected by the centre of each list (the member with the fewest rarer shingles of its own), then by neighbours in hash orders
    def central() -> DataFrame:
        own = divided().filter("ring < 2")
        centre = own.groupBy("b").agg(F.min(F.struct("pos", "n", "a", "label")).alias("c"))
        return own.join(centre, "b").filter("label != c.label").select("a", F.col("c.a").alias("p"))

    def beside(turn: int) -> DataFrame:
        order_ = F.xxhash64("a", F.lit(turn))
        along = Window.partitionBy("b", F.pmod(order_, F.ceil(F.col("size") / LIST_PART))).orderBy(order_, "a")
        return divided().filter("ring < 2").select("a", "label", F.lag("a").over(along).alias("p"), F.lag("label").over(along).alias("q")).filter("label != q").select("a", "p")

    def connect(trial: DataFrame) -> DataFrame:
        trial = trial.select(F.greatest("a", "p").alias("a"), F.least("a", "p").alias("b")).distinct()
        more = materialise(links(overlaps(trial, texts, shingle)), "links")
        return roots if more.isEmpty() else components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))

    for turn in range(TURNS):
        roots = connect(beside(turn) if turn else central())

    wanted = divided().select("a", "b", "held")
    rest = materialise(outside(wanted, texts, order, shingle, percent).join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root"), "outside")
    split = rest.groupBy("hub", "v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("hub", "v")
    rest = materialise(rest.join(split, ["hub", "v"], "left_semi").withColumn("rest", F.col("n") - F.col("both") - F.col("pos")), "split")
    other = rest.select("hub", "v", *[F.col(c).alias(c + "2") for c in ("rep", "n", "label", "both", "rest")])
    fits = f"label != label2 and n2 >= n and 100 * n >= {percent} * n2 and (n < n2 or rep < rep2) and {100 + percent} * (least(both, both2) + least(rest, rest2)) >= {percent} * (n + n2)"
    second = rest.join(other, ["hub", "v"]).filter(F.expr(fits)).select(F.col("rep2").alias("a"), F.col("rep").alias("p"))
    roots = connect(second)

    slim = signed.select("key", "doc_id", "n", "s1", "s2")
    named = slim.join(classes.select("s1", "s2", "rep"), ["s1", "s2"], "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("key", "doc_id", "n", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("rep")).alias("rep"), F.when(F.col("n") == 0, F.col("key")).otherwise(F.coalesce("root", "rep")).alias("root"))
    first_row = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    by_class = named.groupBy("rep", "root").agg(first_row.alias("c"))
    by_root = by_class.groupBy("root").agg(F.min("c").alias("r"))
    best = materialise(by_class.join(by_root, "root").select("rep", F.col("c.doc_id").alias("class_id"), F.col("r.doc_id").alias("component_id"), F.col("r.key").alias("keeper")), "classes")
    out = named.join(best, "rep").select("key", "doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", (F.col("key") == F.col("keeper")).alias("kept"))
    if carry is None:
        return out.drop("key")
    return signed.select("key", "text", "carried").join(out, "key").drop("key")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", F.col("component_id").cast("long").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(5, len(w))], ' ') AS g FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS x FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(x) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id
"""
