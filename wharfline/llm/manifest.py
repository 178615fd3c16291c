"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf. Leaves are indexed within their tree; buckets of fanout^k consecutive leaves collapse k levels at once in a pandas
group, which leaves one root per bucket. The bucket roots are nodes of the next, smaller round, until every tree is one bucket. What remains are
subroots, which form one more tree over the names of the trees. A leaf's proof is its bucket's lower part followed by the upper part of its bucket's root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

FANOUT, LEVELS = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, idx long, bucket long, siblings string, shape binary, top string"


def field(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def indexed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with idx, their place from 0 among the rows of their tree.

    Range partitions are sorted and stored with each row's place; a row adds what its tree has before its partition. Counts are by partition
    and tree, so that no tree's rows meet in one task.
    """
    keys = [F.col(tree), *[F.col(o).asc_nulls_first() for o in order]]
    placed = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), "placed")
    local = placed.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    before = Window.partitionBy(tree).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = local.groupBy("_p", tree).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return local.join(counts, ["_p", tree]).withColumn("idx", F.col("_r") - F.col("_first") + F.col("_before")).drop("_p", "_r", "_first", "_before")


def height(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(fanout: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Collapses ``levels`` levels of one bucket: each node's siblings from the bottom up, how many stand left and right of it, and the bucket's root.

    A bucket that is short and the first of its tree is the whole tree: it collapses to its root, however few levels that takes.
    """

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("idx", ignore_index=True)
        nodes, m = bucket["digest"].tolist(), len(bucket)
        alone = bucket["bucket"].iat[0] == 0 and m < fanout**levels
        siblings, shape, span = [""] * m, [b""] * m, 1
        for _ in range(height(m, fanout) if alone else levels):
            above, others, marks = [], [], []
            for at in range(0, len(nodes), fanout):
                near = nodes[at : at + fanout]
                above.append(hashlib.sha256("".join(near).encode()).hexdigest())
                for i in range(len(near)):
                    others.append("".join(near[:i] + near[i + 1 :]))
                    marks.append(bytes((i, len(near) - 1 - i)))
            for j in range(m):
                siblings[j] += others[j // span]
                shape[j] += marks[j // span]
            nodes, span = above, span * fanout
        return bucket.drop(columns="digest").assign(siblings=siblings, shape=shape, top=nodes[0])

    return run


def prove(nodes: DataFrame, fanout: int, levels: int, top: Callable[[DataFrame], DataFrame], carry: str = "") -> DataFrame:
    """Nodes (tree, idx, digest, and string columns named in ``carry``) with siblings and shape up to the root, subroot and root.

    ``top`` gets one row (tree, digest) per tree and returns tree, siblings, shape, subroot, root of what lies above it.
    """
    extra = [c.split()[0] for c in carry.split(",") if c.strip()]
    keyed = nodes.select("tree", "idx", F.floor(F.col("idx") / fanout**levels).alias("bucket"), "digest", *extra)
    low = materialise(keyed.groupBy("tree", "bucket").applyInPandas(collapse(fanout, levels), f"{NODE.replace(', siblings', (', ' + carry if carry else '') + ', siblings')}"), "level")
    roots = low.filter(F.col("idx") == F.col("bucket") * fanout**levels).select("tree", F.col("bucket").alias("idx"), F.col("top").alias("digest"))
    if roots.filter("idx > 0").isEmpty():
        high, keys = top(roots.select("tree", "digest")), ["tree"]
    else:
        high, keys = prove(roots, fanout, levels, top).withColumnRenamed("idx", "bucket"), ["tree", "bucket"]
    high = high.select(*keys, F.col("siblings").alias("_s"), F.col("shape").alias("_h"), "subroot", "root")
    return low.join(high, keys).select("tree", "idx", *extra, F.concat("siblings", "_s").alias("siblings"), F.concat("shape", "_h").alias("shape"), "subroot", "root")


def forest(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, carry: str = "") -> DataFrame:
    """Proofs of all nodes (tree, idx, digest): siblings, shape, subroot of their tree and root over the subroots in the order of the trees' names."""

    def lone(roots: DataFrame) -> DataFrame:
        return roots.select("tree", F.lit("").alias("siblings"), F.lit(b"").alias("shape"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def over_trees(roots: DataFrame) -> DataFrame:
        names = materialise(indexed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"]), "names")
        proofs = prove(names, fanout, levels, lone, "name string")
        return roots.join(proofs.select(F.col("name").alias("tree"), "siblings", "shape", "root"), "tree").select("tree", "siblings", "shape", F.col("digest").alias("subroot"), "root")

    return prove(nodes, fanout, levels, over_trees, carry)


def folded(leaf: pd.Series, siblings: pd.Series, shape: pd.Series) -> pd.Series:
    """The root that a leaf and its siblings give; ``shape`` has, level by level, how many siblings stand left and right."""
    out = []
    for digest, s, h in zip(leaf, siblings, shape):
        at = 0
        for i in range(0, len(h), 2):
            mid, end = at + 64 * h[i], at + 64 * (h[i] + h[i + 1])
            digest, at = hashlib.sha256((s[at:mid] + digest + s[mid:end]).encode()).hexdigest(), end
        out.append(digest)
    return pd.Series(out, dtype=object)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", id_col: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS, check: dict[str, Column] | None = None) -> DataFrame:
    """A Merkle tree per value of ``tree`` and one over their roots; per row its leaf, siblings, shape, subroot and root, and what its leaf folds to.

    ``check`` gives other values for some fields: a second reading of the row, whose leaf is folded with the manifest's siblings (checked_leaf, folded_root).

    Edge cases: null fields count as ``-``; null trees come first, empty ones next; rows of a tree ascend by id (null ids first, and as ``-``), rows of equal ids by leaf. Repeated rows are
    leaves of their own. A tree of one row is its leaf. An empty table gives an empty result. Other columns are not read. ``fanout`` is at most 128.

    Scale: texts are hashed in the scan and go no further. A group has fanout^levels rows at most whatever the size of a tree, a round has fanout^levels times fewer
    rows than the one before, and every join of proofs is by tree and bucket, so that a tree with a third of all rows is spread like any other. Every round is stored.
    """
    if not 2 <= fanout <= 128 or levels < 1:
        raise ValueError("fanout must be 2 to 128 and levels at least 1")
    column = lambda c: F.col(f"`{c}`")
    checked = {**{c: column(c) for c in fields}, **(check or {})}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), column(tree).cast("string")), F.lit("")).alias("tree"), column(id_col).alias("id"),
        leaf_hash([column(c) for c in fields]).alias("digest"), leaf_hash([checked[c] for c in fields]).alias("checked_leaf") if check else F.lit(None).cast("string").alias("checked_leaf"),
    )
    placed = indexed(leaves, "tree", ["id", "digest"])
    nodes = placed.select("tree", "idx", "digest", F.col("id").cast("string").alias("id"), F.col("digest").alias("leaf"), F.coalesce("checked_leaf", "digest").alias("checked_leaf"))
    proofs = forest(nodes, fanout, levels, "id string, leaf string, checked_leaf string")
    return proofs.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumn("folded_root", F.pandas_udf(folded, "string")("checked_leaf", "siblings", "shape")).withColumnRenamed("id", id_col)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents by lang. Where 7 divides crc32 of the decimal doc_id (null: empty text), the row read again has one more in n_chars."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    d = manifest(docs, check={"n_chars": F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)")).cast("decimal(20,0)")})
    return d.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_BODY = "sha256(" + " || ".join(_FIELD.format(c) if c != "n_chars" else "{n}" for c in FIELDS) + ")"
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR i IN range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0 AS hit
  FROM (SELECT DISTINCT doc_id FROM documents)),
leaves AS (
  SELECT d.doc_id, coalesce('=' || lang, '') AS tree, {_BODY.format(n=_FIELD.format("n_chars"))} AS leaf, {_BODY.format(n=_FIELD.format("(n_chars + CASE WHEN hit THEN 1 ELSE 0 END)"))} AS checked
  FROM documents d JOIN crc USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (
  SELECT tree, 0 AS lev, idx, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, lev + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, lev, idx // 2, n),
subroots AS (
  SELECT tree, lev, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lev, idx, n, digest FROM subroots
  UNION ALL SELECT lev + 1, idx // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lev, idx // 2, n),
nodes AS (
  SELECT tree, lev, idx, n, digest FROM low WHERE n > 1
  UNION ALL SELECT s.tree, s.lev + h.lev, h.idx, h.n, h.digest FROM subroots s, high h WHERE h.n > 1),
climb AS (
  SELECT p.doc_id, p.leaf, p.tree, s.lev AS turn, 0 AS lev, CASE WHEN s.lev = 0 THEN s.idx ELSE p.idx END AS idx, s.idx AS branch, checked AS digest, '' AS proof FROM placed p JOIN subroots s USING (tree)
  UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.turn, c.lev + 1, CASE WHEN c.lev + 1 = c.turn THEN c.branch ELSE c.idx // 2 END, c.branch,
    sha256(CASE WHEN c.idx % 2 = 1 THEN coalesce(o.digest, '') || c.digest ELSE c.digest || coalesce(o.digest, '') END), c.proof || coalesce(o.digest, '')
  FROM climb c JOIN nodes me ON me.tree = c.tree AND me.lev = c.lev AND me.idx = c.idx LEFT JOIN nodes o ON o.tree = c.tree AND o.lev = c.lev AND o.idx = xor(c.idx, 1)),
done AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY doc_id, leaf, tree ORDER BY lev DESC) = 1)
SELECT d.doc_id, d.leaf, s.digest AS subroot, r.digest AS root, sha256(d.proof) AS proof_sha256, d.digest AS folded_root, d.digest = r.digest AS verified
FROM done d JOIN subroots s USING (tree) CROSS JOIN (SELECT digest FROM high WHERE n = 1) r
"""
