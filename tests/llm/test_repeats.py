"""Operators 11 to 13 against brute force: suffix-array dedup, Merkle manifest, periodic runs."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x long, key string, idx long, tree string, runs string, span long"


def frame(spark, rows):
    """rows: (doc_id, text[, lang]); other columns clash with names that the operators use inside."""
    full = [(r[0], r[1], (r[2] if len(r) > 2 else "en"), "s", len(r[1]) if r[1] else None, 1, "k", 1, "t", "r", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def tables(tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# ---------------------------------------------------------------- suffix-array dedup


def covered(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


def messy(rng):
    """Texts that share passages, with copies, near copies, self overlaps and characters of several bytes."""
    word = lambda: "".join(rng.choice("abcdeé🙂") for _ in range(rng.randint(1, 5)))
    passage = [" ".join(word() for _ in range(rng.randint(3, 30))) for _ in range(6)]
    texts = [None, "", " ", "ab" * 40, "a" * 90, "ab" * 37 + "c"]
    for _ in range(40):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]
        texts.append(" ".join(parts))
    near = list(texts[10])
    near[len(near) // 2] = "#"
    return [*texts, texts[9], texts[9], "".join(near)]


@pytest.mark.parametrize("length, gram, group", [(20, None, 2000), (40, 10, 2), (33, 33, 1)])
def test_remove_repeats(spark, length, gram, group):
    from wharfline.llm.repeats import maximal_repeats, remove_repeats

    texts = messy(random.Random(length))
    rows = list(enumerate(texts)) + [(None, texts[12]), (3, texts[13])]
    df = frame(spark, rows)
    raw = [(i, (t or "").encode()) for i, t in rows]
    masks = covered([t for _, t in raw], length)
    want = collections.Counter()
    for (i, t), m in zip(raw, masks):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], m.astype(np.int8), [0]))))
        want[i, len(t), tuple((int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])), np.frombuffer(t, np.uint8)[~m].tobytes()] += 1
    got = collections.Counter((r.doc_id, r.n_bytes, tuple((s.start, s.length) for s in r.spans), bytes(r.kept)) for r in remove_repeats(df, length=length, gram=gram, group=group).collect())
    assert got == want
    groups = collections.defaultdict(set)
    for r in maximal_repeats(frame(spark, list(enumerate(texts))), length=length, gram=gram, group=group).collect():
        groups[r.repeat].add((r.doc_id, r.start, r.n_bytes))
    once = {i: (t or "").encode() for i, t in enumerate(texts)}
    marked = {i: np.zeros(len(t), bool) for i, t in once.items()}
    for places in groups.values():
        assert len(places) > 1 and len({once[i][a : a + n] for i, a, n in places}) == 1 and all(n >= length for _, _, n in places)
        for i, a, n in places:
            marked[i][a : a + n] = True
    assert all((m == marked[i]).all() for i, m in zip(once, covered(list(once.values()), length)))


def test_remove_repeats_of_nothing_and_of_a_long_text(spark):
    from wharfline.llm.repeats import remove_repeats

    none = frame(spark, [(1, "x")]).limit(0)
    assert remove_repeats(none).collect() == []
    rng = random.Random(2)
    own = ["".join(rng.choice("abcdefgh ") for _ in range(700_000)) for _ in range(2)]
    shared = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    got = {r.doc_id: r for r in remove_repeats(frame(spark, [(1, own[0] + shared + own[1]), (2, "z" + shared)])).collect()}
    assert [(s.start, s.length) for s in got[1].spans] == [(700_000, 1000)] and [(s.start, s.length) for s in got[2].spans] == [(1, 1000)]


def test_op11(spark, tmp_path):
    from wharfline.llm.repeats import op11_suffix_dedup

    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = line(450)
    rows = [(1, line(50) + shared + line(30)), (2, shared[:399] + "#" + line(20)), (3, "é" + shared[25:425]), (4, None), (5, "a" * 401)]
    got = {r.doc_id: r for r in op11_suffix_dedup(spark, tables(tmp_path, frame(spark, rows))).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans) for i in range(1, 6)] == [(530, 400, 1), (420, 0, 0), (402, 400, 1), (0, 0, 0), (401, 401, 1)]
    assert got[3].kept_sha256 == hashlib.sha256("é".encode()).hexdigest()


# ---------------------------------------------------------------- Merkle manifest

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        low = at // fanout * fanout
        out.append((nodes[low:at], nodes[at + 1 : low + fanout]))
        at //= fanout
    return out


def manifest_of(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text); per row (doc_id, leaf, subroot, root, proof, folded, verified)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H("".join(map(field, r)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    own = {v: sorted(by[v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for v in langs}
    trees = {v: tree([leaf(r) for r in own[v]], fanout) for v in langs}
    top = tree([trees[v][-1][0] for v in langs], fanout)
    out = []
    for k, v in enumerate(langs):
        for i, r in enumerate(own[v]):
            path = siblings(trees[v], i, fanout) + siblings(top, k, fanout)
            hit = zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 0 and r[3] is not None
            digest = leaf((r[0], r[1], r[2], r[3] + 1, r[4]) if hit else r)
            for a, b in path:
                digest = H("".join(a) + digest + "".join(b))
            out.append((r[0], leaf(r), trees[v][-1][0], top[-1][0], H("".join("".join(a + b) for a, b in path)), digest, digest == top[-1][0]))
    return out


def test_op12(spark, tmp_path):
    from wharfline.llm.manifest import op12_merkle_manifest

    rng = random.Random(4)
    rows = [(i, f"text {i} é" if i % 9 else None, rng.choice(["en", "en", "en", "de", "", None, "ü", "z"]) if i != 50 else "lone") for i in range(60)] + [(7, "again", "en"), (7, "again", "en"), (None, "no id", "en"), (8, "x" * 1_200_000, "fr")]
    df = frame(spark, rows)
    want = manifest_of([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()], 2)
    assert collections.Counter(map(tuple, op12_merkle_manifest(spark, tables(tmp_path, df)).collect())) == collections.Counter(want)
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("fanout, levels", [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest_of_several_rounds(spark, fanout, levels):
    from wharfline.llm.manifest import manifest

    for n in (0, 1, 2, fanout**levels, fanout**levels + 1, 60):
        df = frame(spark, [(i, f"t{i}", f"l{i % 13}" if n == 60 else "en") for i in range(n)] or [(0, "t")]).limit(n or 0)
        got = manifest(df, fanout=fanout, levels=levels).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256)).collect()
        want = manifest_of([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()], fanout)
        assert sorted(map(tuple, got)) == sorted(w[:5] for w in want)


# ---------------------------------------------------------------- periodic runs


def runs_by_force(w, least, times):
    got = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                got.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in got.items())


def test_runs_of_sequences():
    from wharfline.llm.periodic_runs import runs_of

    rng = random.Random(6)
    for _ in range(4000):
        s = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 40))]
        while len(s) < 70 and rng.random() < 0.9:
            s += (s[-rng.randint(1, 8) :] or [0]) * rng.randint(1, 6) + [rng.randrange(3)] * rng.randint(0, 2)
        for least, times in ((2, 2), (5, 3), (24, 3)):
            assert runs_of(s, least, times) == runs_by_force(s, least, times), s
    assert runs_of([0] * 50_000) == [(0, 50_000, 1)]


def test_op13(spark, tmp_path):
    from wharfline.llm.periodic_runs import op13_periodic_runs

    rng = random.Random(8)
    word = lambda: rng.choice(["a", "B", "b", "ccc", "é", "\x1c", "x y"])
    texts = [None, "", " \n\t", "one", "a " * 24, "a " * 23, "a\x0bb " * 400 + "c", ("lorem ipsum dolor " * 9 + "sit ") * 4, "  a" * 30, "k l m n " * 80_000]
    for _ in range(60):
        own = [word() for _ in range(rng.randint(0, 40))]
        texts.append(" ".join(own + own[-rng.randint(1, 12) :] * rng.randint(0, 9) + [word() for _ in range(rng.randint(0, 20))]))
    rows = [*enumerate(texts), (None, "a " * 40), (4, "b " * 30), (4, "b " * 30)]
    df = frame(spark, rows)
    want = collections.Counter()
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        h = zlib.crc32(str("" if i is None else i).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = runs_by_force(w, 24, 3) if len(w) < 100_000 else [(0, len(w), 4)]
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want[(i, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], H(lines), H(" ".join(v for k, v in enumerate(w) if k not in gone)))] += 1
    got = collections.Counter(map(tuple, op13_periodic_runs(spark, tables(tmp_path, df)).collect()))
    assert got == want and sum(n for k, n in want.items() if k[1]) > 10


def test_runs_of_no_documents(spark):
    from wharfline.llm.periodic_runs import periodic_runs

    assert periodic_runs(frame(spark, [(1, "x")]).limit(0)).collect() == []
