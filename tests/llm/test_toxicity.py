"""Toxicity: where spans may lie, weights of copies, the score against plain Python, and the query's own columns."""

import collections
import math
import random
import zlib

import numpy as np
import pytest


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_spans_are_found_as_by_the_pattern_alone():
    from wharfline.llm import toxicity as T

    r = T.Restorer(T.CharModel(np.random.default_rng(1).integers(0, 1000, T.SIGMA**3)))
    rng = random.Random(2)
    for _ in range(4000):
        texts = ["".join(rng.choice("aab cé🙂.-_!1@ \n3,'~·$٣߀Ⅷ*/\\€x(漢") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 4))]
        assert list(r.restored(*packed(texts))) == [T.SUSPECT.sub(lambda m: " " + r.span(m[0]) + " ", t) for t in texts]


def sample(rng):
    """Labelled texts: toxic ones hold an insult, written plainly or not; one toxic text has a hundred near copies full of words of its own."""
    vocab = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    plain = lambda n: [rng.choice(vocab) for _ in range(n)]
    written = {"grubface": ["grubface", "gr0bface", "g r u b f a c e", "grubf@ce", "gruuuubface"], "zonkwit": ["zonkwit", "z0nkw1t", "z.o.n.k.w.i.t", "zonkwiiit"]}
    rows = []
    for i in range(600):
        words = plain(rng.randint(20, 50))
        if i % 5 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(written[rng.choice(list(written))]))
        rows.append((" ".join(words), int(i % 5 == 0)))
    family = [f"only{w}" for w in plain(60)]
    for _ in range(100):
        own = list(family)
        own[rng.randrange(60)] = rng.choice(vocab)
        rows.append((" ".join(own + ["zonkwit"]), 1))
    rows += [(" ".join(plain(30) + [rng.choice(family)]), 0) for _ in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def case(spark):
    rows = sample(random.Random(9))
    extra = [None, "", " \n", "x " * 700_000, "calm words only", "grubface"]
    docs = spark.createDataFrame([(i, t, 1.0, 0, "w") for i, (t, _) in enumerate(rows)] + [(5000 + i, t, 1.0, 0, "w") for i, t in enumerate(extra)] + [(None, "z0nkw1t", 1.0, 0, "w"), (5005, "calm", 1.0, 0, "w")], "doc_id long, text string, weight double, toxic int, key string").repartition(4)
    labels = spark.createDataFrame([(i, 0, y, 1) for i, (_, y) in enumerate(rows)] + [(0, 0, rows[0][1], 1), (None, 0, 1, 1), (3, 0, 9, 1)], "doc_id long, quality int, toxic int, text int")
    return rows, docs, labels


def test_score_against_plain_python(case):
    """The sample's weights, the evidence and the score, from the features of each document; families are counted by their shared minima here too."""
    from wharfline.llm import toxicity as T
    from wharfline.llm.common import crc_mod

    rows, docs, labels = case
    got = {r.doc_id: (r.score, r.evidence) for r in T.toxicity(docs, labels).filter("doc_id < 1000").collect()}
    restorer = T.Restorer(T.CharModel(T.char_counts(docs)))
    features = [next(restorer.features(*packed([t]))) for t, _ in rows]
    train = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 3 != 1]
    chosen = docs.filter("doc_id < 1000").filter(crc_mod("doc_id", 3) != 1)
    # weights: how many training rows share a row's minima, the median deciding
    sketches = {r.text: r.sketch for r in T.sketched(chosen.selectExpr("0L as key", "0 as toxic", "text")).collect()}
    shared = collections.Counter((k, h) for i in train for k, h in enumerate(sketches[rows[i][0]]))
    weight = {i: 1 / sorted((shared[k, h] for k, h in enumerate(sketches[rows[i][0]])), reverse=True)[(T.SKETCH - 1) // 2] for i in train}
    near = [i for i in train if "only" in rows[i][0] and rows[i][1]]
    # minima by sequences of five words: near copies, with one of sixty words changed, share most of them
    assert len(near) > 40 and 0.5 < sum(weight[i] for i in near) < 6 and all(weight[i] == 1 for i in train if i not in near and rows[i][0].count(" ") > 15)
    n, total = [0.0, 0.0], {}
    for i in train:
        n[rows[i][1]] += weight[i]
        for w in features[i] | T.stems(features[i]):
            total.setdefault(w, [0.0, 0.0])[rows[i][1]] += weight[i]
    share, odds = n[1] / sum(n), {}
    for w, (a, b) in total.items():
        m = a + b
        surprise = (b * math.log(b / m / share) if b else 0) + (a * math.log(a / m / (1 - share)) if a else 0)
        o = math.log((b + 0.5) / (n[1] + 1)) - math.log((a + 0.5) / (n[0] + 1))
        if o >= T.MIN_ODDS and surprise >= math.log(len(total)) - math.log(T.CHANCE_FEATURES):
            odds[w] = o
    assert {"grubface", "zonkwit"} <= set(odds) and not [w for w in odds if w.startswith("only")]
    ones = [rows[i][1] for i in train]
    lexicon = T.Lexicon(odds, math.log((sum(ones) + 1) / (len(ones) - sum(ones) + 1)))
    for i, f in enumerate(features):
        score, why = lexicon.score(f)
        assert got[i][0] == pytest.approx(score) and sorted(got[i][1]) == sorted(why)
    held = [i for i in range(len(rows)) if i not in weight]
    assert all((got[i][0] >= 0.7) == bool(rows[i][1]) for i in held) and len(held) > 200


def test_op2(spark, case, tmp_path):
    from wharfline.llm.toxicity import op2_toxicity

    rows, docs, labels = case
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = op2_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    by = {r.doc_id: r.predicted for r in got if r.doc_id not in (None, 5005)}
    assert [by[5000 + i] for i in range(5)] == [0] * 5
    assert sorted(r.predicted for r in got if r.doc_id == 5005) == [0, 1] and [r.predicted for r in got if r.doc_id is None] == [1]
