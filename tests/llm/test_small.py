"""Each operator against brute force on small tables with nulls, empty and very long texts, ties, repeats, clashing columns and no rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(60)]


def words(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


BASE = words(80)
TEXTS = [None, "", " \n\t", "one", "Two words", BASE, BASE, BASE.upper(), BASE + " tail", BASE[:300], words(3000), "é ñ Ü ß 🙂 漢字 don't", *[words(rng.randint(1, 60)) for _ in range(20)]]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "x", 1, 1) for i, t in enumerate(TEXTS)] + [(None, BASE, "en", "s", 1, "x", 1, 1), (3, "one", "en", "s", 1, "x", 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string, n long, id long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_exact_dedup(docs, none):
    from wharfline.llm.exact_dedup import exact_dedup

    rows = docs.select("doc_id", "text").collect()
    for hot in (1024, 1):
        for keep, best in (("max", max), ("min", min)):
            got = exact_dedup(docs, keep=keep, hot_min=hot).collect()
            assert len(got) == len(rows)
            groups = collections.defaultdict(list)
            for r in rows:
                groups[hashlib.sha256((r.text or "").encode()).hexdigest()].append(r.doc_id)
            for r in got:
                ids = groups[r.text_sha256]
                assert r.group_size == len(ids) and r.keep_id == best(i for i in ids if i is not None)
            assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(none).isEmpty()


def test_exact_dedup_sorts_once(docs):
    from wharfline.llm.exact_dedup import exact_dedup

    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan and "Python" not in plan


def test_token_counts(docs, none):
    from wharfline.llm.token_counts import PieceEncoder, count_huge, token_counts

    path = P.path("piece_bpe_32k.model")
    enc = PieceEncoder(path)
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(enc.ids([r.text or ""])[0])) for r in docs.collect())
    for chunk, overlap in ((1 << 16, 512), (256, 16), (200, 150)):
        got = token_counts(docs, path, chunk=chunk, overlap=overlap).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    for text in ("x" * 3000, "  " * 900, "a" * 600 + " " + "b" * 3000, "漢" * 900 + " é" * 500, " lead" + words(200), "▁" * 300 + " a b"):
        assert count_huge(enc, text.encode(), 256, 16) == len(enc.ids([text])[0])
    assert token_counts(none, path).isEmpty()


def test_secret_scan(spark, none):
    from wharfline.llm.secret_scan import Automaton, base_spans, secret_scan

    hexes = ["".join(random.Random(i).choice("0123456789abcdef") for _ in range(40)) for i in range(60)]
    texts = [None, "", "password=abc", 'Api_Key: "abcdef1"', "AKIA" + "Q" * 16 + " x AKIA1", "secret = abcdef;token:xyz123", "ſecret=abcdefg", *[f"token = {h} and" for h in hexes], *[f"see {i * 1111111111111111} mail.x{i}@host example12345.com" for i in range(40)]]
    odd = "f0e1d2c3b4a5968778695a"  # a credential's alphabet, but shorter than the labelled kind
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, f"key {odd} end"])], "doc_id long, text string, kind int")
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.found] for r in secret_scan(d).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in enumerate(texts):
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 6] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        assert [s for s in got[i] if s[0] != "grammar"] == sorted(want, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        assert all(s[0] != "grammar" for s in got[i]) or i >= 7
    assert ("grammar", 4, 4 + len(odd)) in got[len(texts)]
    assert not any(s[0] == "grammar" for i in range(67, 107) for s in got[i])
    assert base_spans("") == [] and secret_scan(none).isEmpty()
    a = Automaton(["ab" * k for k in range(1, 30)] * 5)
    assert len(a.rows) < 12 and a.log2("ababab") > a.log2("aabbab")


def test_grammar_spans_find_formats_without_a_keyword(spark):
    """Recall and precision over planted strings: formats that are labelled elsewhere, against prose, numbers, addresses and identifiers."""
    from wharfline.llm.secret_scan import secret_scan

    g = random.Random(21)
    vocab = ["".join(g.choice("bcdfghklmnprstvwz") + g.choice("aeiouy") for _ in range(g.randint(2, 5))) for _ in range(300)]
    prose = lambda n: " ".join(g.choice(vocab) for _ in range(n))
    some = lambda chars, n: "".join(g.choice(chars) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    formats = [lambda: "ghp_" + some(alnum, 36), lambda: "xk-" + some(alnum, 20) + "-" + some("0123456789", 12), lambda: some("0123456789abcdef", 8) + "-" + some("0123456789abcdef", 12)]
    other = [lambda: some("0123456789", 14), lambda: f"mail.{g.choice(vocab)}.{g.choice(vocab)}", lambda: "_".join(g.choice(vocab) for _ in range(4)), lambda: "/".join(g.choice(vocab) for _ in range(5)), lambda: f"v{g.randint(1, 9)}.{g.randint(0, 99)}.{g.randint(0, 999)}", lambda: "-".join(g.choice(vocab) for _ in range(3))]
    rows, planted = [], {}
    for i in range(900):
        text = prose(150)
        if i < 240:
            text += f" secret: {formats[i % 3]()} " + prose(5)
        elif i < 390:
            own = formats[i % 3]()
            planted[i] = (len(text) + 1, len(text) + 1 + len(own))
            text += f" {own} " + prose(5)
        text += " " + " ".join(other[k % 6]() for k in range(i, i + 4)) + " end"
        rows.append((i, text))
    found = {r.doc_id: [(f.start, f.end) for f in r.found if f.kind == "grammar"] for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(planted[i] in found[i] for i in planted)
    wrong = sum(span != planted.get(i) for i, spans in found.items() for span in spans)
    assert hits >= 0.9 * len(planted) and wrong <= 0.1 * hits


def test_background_leaves_the_string_out_at_every_length():
    from wharfline.llm.secret_scan import CELLS, SIGMA, Background, _CODES

    b = Background(np.random.default_rng(3).integers(0, 9, CELLS))
    for n in (1, 7, 999, 1000, 1001, 1500):
        s = words(n)[:n].replace(" ", "_")
        codes = [0, 0, *(_CODES[c] for c in s), 0]
        three = collections.Counter(zip(codes, codes[1:], codes[2:]))
        two = collections.Counter(zip(codes[1:], codes[2:]))
        before3, before2 = collections.Counter(zip(codes, codes[1:-1])), collections.Counter(codes[1:-1])
        total = 0.0
        for x, y, z in zip(codes, codes[1:], codes[2:]):
            b2 = max(int(b.bi[y * SIGMA + z]) - two[y, z], 0)
            p2 = (b2 + 4 * b.one[z]) / (max(int(b.after_one[y]) - before2[y], 0, b2) + 4)
            b3 = max(int(b.tri[(x * SIGMA + y) * SIGMA + z]) - three[x, y, z], 0)
            total += np.log2((b3 + 4 * p2) / (max(int(b.after_two[x * SIGMA + y]) - before3[x, y], 0, b3) + 4))
        assert b.log2(s) == pytest.approx(total)


def test_chat_format(spark):
    from wharfline.llm.chat_format import CLOSE, chat_format, digests, read_back

    talk = [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\\\h </turn>\n \\e"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "a: b"), (2, 1, "us: er", "tail"), (3, 0, "user", "only"), (None, None, None, "x"), (4, 0, "user", "t"), (4, 0, "user", "t")]
    d = spark.createDataFrame([(*t, 1) for t in talk], "conv_id long, turn long, role string, text string, context int")
    ex = chat_format(d)
    for r in ex.withColumn("back", read_back(F.when(F.col("closing"), F.col("context")).otherwise(F.concat("context", "reply", F.lit(CLOSE))))).collect():
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in talk if t[0] == r.conv_id))
        assert [(b.role, b.text) for b in r.back] == [x[1:] for x in own][: len(r.back)]
    got = {r.conv_id: r for r in digests(ex).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == len("\\\\h </turn>\n \\e")
    assert got[1].loss_sha256 == hashlib.sha256("\\\\h </turn>\n \\e".encode()).hexdigest() and got[3].loss_chars == 0 and got[4].n_turns == 2
    assert chat_format(d.limit(0)).isEmpty()


def test_packing(docs, none):
    from wharfline.llm.packing import encoder, pack, pack_sequences, sequence_sizes

    path = P.path("word_bpe_49k.json")
    enc = encoder(path)
    rows = pack_sequences(docs, path, capacity=64, block_tokens=700).collect()
    tokens = {r.doc_id: [*enc.whole(r.text or "").tolist(), 1] for r in docs.collect() if r.doc_id is not None and r.doc_id != 3}
    for i, ids in tokens.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids) for r in own)
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        n = sum(x[1] for x in s)
        assert [x[0] for x in s] == np.cumsum([0, *[x[1] for x in s]])[:-1].tolist() and n <= 64 and n & (n - 1) == 0
    assert sequence_sizes(0) == [] and sequence_sizes(4096 + 5) == [2048, 2048, 4, 1]
    for _ in range(50):
        lengths = [rng.randint(1, 300) for _ in range(rng.randint(1, 40))]
        got = collections.Counter()
        for d, s, n, k, o in pack(lengths, 64):
            got[d] += n
        assert [got[i] for i in range(len(lengths))] == lengths
    assert pack_sequences(none, path).isEmpty()


def brute_leaks(texts, items, window=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    wins = collections.defaultdict(set)
    for i, t in items:
        w = find(low(t))
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[j : j + k])].add(str(i))
    out = []
    for t in texts:
        w, its = find(low(t)), set()
        hit = [False] * len(w)
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if got := wins.get(tuple(w[j : j + k])):
                    its |= got
                    hit[j : j + k] = [True] * k
        out.append((len(w), sum(hit), sorted(its)))
    return out


def test_decontaminate(spark, docs, none):
    from wharfline.llm.decontaminate import FMIndex, decontaminate, suffix_array

    items = [(1, BASE[:200]), (2, None), (3, ""), (4, "Two"), (5, words(30)), (5, BASE[100:300].upper()), (6, words(9)), (None, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs.collect()
    want = sorted(map(str, brute_leaks([r.text for r in rows], [(i if i is not None else "", t) for i, t in items])))
    places = []
    for shard, block in ((1 << 20, 1 << 20), (500, 1 << 20), (1 << 20, 100)):
        got = decontaminate(docs, bench, shard_bytes=shard, block_bytes=block).collect()
        places.append(sorted(str((r.doc_id, r.spans, r.byte_spans)) for r in got))
        assert places[-1] == places[0]
        assert sorted(str((r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"]))) for r in got) == want
        for r in got:
            text = next((x.text or "" for x in rows if x.doc_id == r.doc_id), "").encode()
            assert all(0 <= s.start < s.end <= len(text) for s in r.byte_spans if r.doc_id is not None)
    # two items that adjoin in a text are one span, in words and in bytes, whether or not one block holds both
    first, second = words(10), words(10)
    one = spark.createDataFrame([(1, f"zz {first} {second}, yy")], "doc_id long, text string")
    two = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    for block in (1 << 20, 10):
        r = decontaminate(one, two, block_bytes=block).first()
        assert [tuple(s) for s in r.spans] == [(1, 21)] and [tuple(s) for s in r.byte_spans] == [(3, 3 + len(first) + 1 + len(second))]
    assert decontaminate(none, bench).isEmpty() and decontaminate(docs, bench.limit(0)).filter(F.size("spans") > 0).isEmpty()
    for seed in range(20):
        s = np.random.default_rng(seed).integers(0, 4, 200)
        text = np.append(s, 0)
        seps = np.flatnonzero(text == 0).tolist()
        key = lambda p: [(1, int(x)) if x else (0, seps.index(p + j)) for j, x in enumerate(text[p:])]
        assert suffix_array(text).tolist() == sorted(range(len(text)), key=key)
        index = FMIndex(s, 3)
        pats = np.random.default_rng(seed).integers(1, 4, (30, 3))
        lo, hi = index.search(pats, np.full(30, 3))
        for p, a, b in zip(pats, lo, hi):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [j for j in range(len(s) - 2) if s[j : j + 3].tolist() == p.tolist()]


def brute_join(rows):
    """Per row (in order) its set size and the smallest id of its component; every row is a document of its own."""
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(k)] = min(r.doc_id, least.get(find(k), r.doc_id))
    return [(r.doc_id, len(x), least.get(find(k))) for k, (r, x) in enumerate(zip(rows, sets))]


def test_ngram_join(spark, docs, none):
    from wharfline.llm.ngram_join import ngram_join

    # two families of near copies whose members are linked in chains, many of them not to the family's centre
    texts = [r.text for r in docs.filter("doc_id is not null and doc_id != 3").collect()]
    for _ in range(2):
        base = [rng.choice(VOCAB) + str(rng.randint(0, 30)) for _ in range(70)]
        chain = base[:]
        for i in range(70):
            w = base[:]
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(70)] = f"e{rng.randint(0, 400)}"
            texts.append(" ".join(w))
            chain[rng.randrange(70)] = f"c{i}"
            texts.append(" ".join(chain))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(brute_join(d.collect()))
    for hot in (4096, 3):
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(d, hot_min=hot).collect()) == want
    assert len({v[2] for v in want}) < len(want)
    # null and repeated ids, by their own texts; one row of every component is kept, and other columns go along
    odd = ngram_join(docs, carry=["token", "n"]).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in odd))) == sorted(map(str, brute_join(docs.collect())))
    kept = [r for r in odd if r.kept]
    assert len({r.component_id for r in kept if r.n_shingles}) == len([r for r in kept if r.n_shingles]) and all(r.kept for r in odd if not r.n_shingles)
    assert sorted(r.text or "" for r in odd) == sorted(r.text or "" for r in docs.collect()) and all(r.carried.token == "x" for r in odd)
    assert ngram_join(none).isEmpty()


def test_components_of_chains(spark):
    from wharfline.llm.ngram_join import components, ngram_join

    # after one round document 3 of the first chain has two parents, neither of them a child
    chains, at = [[1, 4, 3, 5, 2]], 10
    for seed in range(12):
        ids = list(range(at, at := at + 3 + seed * 3))
        random.Random(seed).shuffle(ids)
        chains.append(ids)
    for some in (chains[:1], chains):
        edges = spark.createDataFrame([e for c in some for e in zip(c, c[1:])], "a long, b long")
        got = sorted((r.id, r.root) for r in components(edges).collect())
        assert got == sorted((i, min(c)) for c in some for i in c if i != min(c))
    text, texts = [f"w{k}" for k in range(100)], {}
    for step, i in enumerate(chains[0]):
        text = text[:]
        if step:
            text[10 + step * 18], text[18 + step * 18] = f"x{step}", f"y{step}"
        texts[i] = " ".join(text)
    d = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join(d).collect()) == [(i, 1) for i in range(1, 6)]


def test_lm_score(spark, docs, none):
    from wharfline.llm import lm_score as lm
    from wharfline.llm.lm_score import ABSENT, EliasFano, Level, lm_score

    import math

    got = lm_score(docs, F.col("doc_id") % 3 != 1).collect()
    rows = docs.collect()
    tok = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    c = collections.Counter(x for r in rows if r.doc_id is not None and r.doc_id % 3 != 1 for x in tok(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), len(tok(r.text)), sum(c[x] > 0 for x in tok(r.text)), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tok(r.text)), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 for r in got) and lm_score(none, F.lit(True)).isEmpty()
    assert lm_score(docs, F.lit(False)).filter("n_known > 0").isEmpty()
    for seed in range(10):
        g = np.random.default_rng(seed)
        x = np.unique(g.integers(0, 10 ** g.integers(2, 9), 500))
        e = EliasFano.build(x, int(x[-1]) + 1)
        assert e.get(np.arange(len(x))).astype(np.int64).tolist() == x.tolist()
        q = g.integers(0, int(x[-1]) + 1, 300)
        assert e.successor(q).tolist() == np.searchsorted(x, q).tolist()
    # a shard's level, in its memory map, finds every child by its context and nothing else
    for seed in range(5):
        g = np.random.default_rng(seed)
        key = np.unique(g.integers(0, 40 * 50, 700))
        key = key[(key // 50) % 7 > 0]
        contexts = np.unique(g.integers(0, 1 << 63, 40).astype(np.uint64) * np.uint64(2))
        seen, of = np.unique(key // 50, return_inverse=True)
        level = Level.build(contexts[seen], of, key % 50, np.arange(len(key), dtype=np.uint16), seen.astype(np.uint16) + 7, 50)
        every = np.arange(40 * 50)
        want = {int(k): i for i, k in enumerate(key)}
        for block in (1 << 16, 7, 1):
            lm.BLOCK_KEYS = block
            for asked in (every, every[g.random(len(every)) < 0.1]):
                own, place = np.unique(asked // 50, return_inverse=True)
                p, back = level.find(contexts[own], place, asked % 50)
                assert p.tolist() == [want.get(k, ABSENT) for k in asked.tolist()]
                assert back.tolist() == [c + 7 if c in seen else 0 for c in own.tolist()]
            assert level.find(contexts[:3] + np.uint64(1), np.arange(3), np.zeros(3, np.int64))[0].tolist() == [ABSENT] * 3
            x = np.unique(g.integers(0, 10 ** g.integers(2, 9), 500))
            e = EliasFano.build(x, int(x[-1]) + 1)
            assert all(e.part(a, b).tolist() == x[a:b].tolist() for a, b in ((0, len(x)), (3, 3), (5, 77), (len(x) - 1, len(x))))
            q = np.unique(np.concatenate((g.integers(0, int(x[-1]) + 1, 50), g.choice(x, 20))))
            assert e.find(q).tolist() == [int(np.searchsorted(x, k)) if k in x else -1 for k in q.tolist()]
        lm.BLOCK_KEYS = 1 << 16


def test_lm_score_keeps_all_grams(spark):
    """Every word has an id and every gram counts: brute-force interpolated absolute discounting over words far rarer than 1e-4 of the tokens."""
    import math

    from wharfline.llm.lm_score import lm_score

    g = random.Random(5)
    texts = [" ".join(g.choice(VOCAB) for _ in range(900)) for _ in range(30)] + ["rare pair here", "rare pair here", "rare pair there", "new rare pair", None]
    train = [i not in (3, 33) for i in range(len(texts))]
    seqs = [[*(t or "").split(), "</s>"] for t in texts]
    one, pairs = collections.Counter(), collections.defaultdict(collections.Counter)
    for s, learn in zip(seqs, train):
        for i, w in enumerate(s if learn else []):
            one[w] += 1
            pairs[(s[i - 1] if i else "<s>",)][w] += 1
            if i:
                pairs[(s[i - 2] if i > 1 else "<s>", s[i - 1])][w] += 1
    mass = sum(one.values()) + len(one) + 1

    def back(context, w, lower):
        c = pairs.get(context)
        return lower if not c else max(c[w] - 0.75, 0) / sum(c.values()) + 0.75 * len(c) / sum(c.values()) * lower

    want = []
    for s in seqs:
        total = 0
        for i, w in enumerate(s):
            p = back((s[i - 1] if i else "<s>",), w, (one[w] + 1) / mass)
            total += math.log10(back((s[i - 2] if i > 1 else "<s>", s[i - 1]), w, p) if i else p)
        want.append(total)
    d = spark.createDataFrame(list(zip(range(len(texts)), texts, train)), "doc_id long, text string, train boolean").repartition(3)
    for chunk in (8 << 20, 3000):
        got = {r.doc_id: (r.score, r.n_tokens) for r in lm_score(d, F.col("train"), chunk_text=chunk).collect()}
        assert all(got[i][0] == pytest.approx(want[i], abs=3e-4 * got[i][1]) for i in range(len(texts)))


def test_toxicity(spark, none):
    from wharfline.llm.toxicity import toxicity

    bad = ["zonkwit", "grubface", "vexhead"]
    texts, toxic = [], []
    for i in range(240):
        w = words(30).split()
        if i % 4 == 0:
            w[rng.randrange(30)] = rng.choice(bad)
        texts.append(" ".join(w)), toxic.append(int(i % 4 == 0))
    extra = [None, "", "he is a z0nkw1t now", "g r u b f a c e", "veeeexhead", words(5000)]
    d = spark.createDataFrame(list(enumerate([*texts, *extra])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(0, 1, toxic[0]), (None, 1, 1), (5, 1, 7)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity(d, labels).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == bool(toxic[i]) for i in held) and len(held) > 50
    assert all(got[240 + k] >= 0.7 for k in (2, 3, 4)) and all(got[240 + k] < 0.7 for k in (0, 1, 5))
    assert toxicity(none, labels).isEmpty() and toxicity(d, labels.limit(0)).filter("score >= 0.7").isEmpty()


def test_lattice_decoding():
    """The Viterbi search against all readings of short spans, and long spans against the same search without flushes."""
    import itertools

    from wharfline.llm import toxicity as T

    g = np.random.default_rng(4)
    r = T.Restorer(T.CharModel(g.integers(0, 50, T.SIGMA**3) * (g.random(T.SIGMA**3) < 0.05)))

    def cost(text, choice):
        p, q, total = 0, 0, 0.0
        for c, extra in choice:
            total += extra
            if c:
                code = T.ALPHABET.get(c, 0 if c == " " else T._OTHER)
                total += r.cost[p][q][code]
                p, q = q, code
        return total + r.cost[p][q][0]

    pick = random.Random(3)
    for _ in range(60):
        text = "".join(pick.choice("ab1!o0 -.*s5") for _ in range(pick.randint(1, 6)))
        every = [(cost(text, c), "".join(x for x, _ in c)) for c in itertools.product(*(r._options(text, i) for i in range(len(text))))]
        made = r._decode(text)
        assert min(c for c, m in every if m == made) == pytest.approx(min(every)[0]), text
    long = "".join(pick.choice("abcdefgh1350!- ") for _ in range(3000))
    flushed, T.FLUSH = r._decode(long), 1 << 30
    try:
        assert flushed == r._decode(long) and len(flushed) > 1000
    finally:
        T.FLUSH = 256
    text = "a t3xt".encode()
    assert " " in next(r.restored(np.frombuffer(text, np.uint8), np.array([0, len(text)])))


def test_pack_takes_the_lowest_cost_with_room():
    from wharfline.llm.packing import pack, sequence_sizes

    for seed in range(30):
        g = random.Random(seed)
        lengths = [g.randint(1, 200) for _ in range(g.randint(1, 60))]
        sizes = sequence_sizes(sum(lengths), 64)
        room, cost = sizes[:], [0.0] * len(sizes)
        for _, _, n, k, offset in pack(lengths, 64):
            fits = [i for i in range(len(sizes)) if room[i] >= n]
            assert offset == sizes[k] - room[k] and k in fits
            # a whole piece goes to the cheapest sequence with room for it; a cut one fills the cheapest that has any
            assert cost[k] == min(cost[i] for i in fits) or room[k] == n
            room[k] -= n
            cost[k] += n + n * n / 2048
        assert not any(room)


def test_background_counts():
    """Counts of the background automaton against a walk over all candidates, and exclusion of base spans."""
    from wharfline.llm.secret_scan import CANDIDATE, CELLS, SIGMA, _CODES, transitions, without

    texts = ["", "short", "abcdef", "word.word... x=y_long+er token12.", "é漢abc123é456789", "........", "a.b.c.d.e.f.", words(30)]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    want = collections.Counter()
    for t in texts:
        for m in CANDIDATE.finditer(t):
            p = q = 0
            for c in [*(_CODES[x] for x in m[0]), 0]:
                want[(p * SIGMA + q) * SIGMA + c] += 1
                p, q = q, c
    got = transitions(data, offs)
    assert len(got) == CELLS and {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(want)
    assert without("0123456789", [(2, 4, "", ""), (3, 5, "", "")]) == "01   56789"


def test_fixity(spark):
    from wharfline.llm.common import materialise
    from wharfline.llm.fixity import FANOUT, LEVELS, VOLUME, audit, descent, leaves, tree

    big = "x" * 1_200_000
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>", 1, "s") for i in range(5000)] + [(None, None, None, 1, "s"), (None, "u", "x", 1, "s"), (None, "u", "x", 1, "s"), (5001, "u", big, 1, "s"), (5001, "u", None, 1, "s"), (5001, "u", "", 1, "s")]
    rows += [(7, "http://h/7", f"again {k % 50}", 1, "s") for k in range(400)]  # one id with many copies, repeated ones among them
    schema = "page_id long, url string, html string, slot int, shelf string"
    a = spark.createDataFrame(rows, schema).repartition(3)
    changed = [(i, u, "<p>XX</p>" if i == 42 else "<p>longer than before</p>" if i == 1000 else h, n, s) for i, u, h, n, s in rows if i != 4999]
    b = spark.createDataFrame([*changed, (6000, "new", "page", 1, "s")], schema)
    ours, theirs = materialise(leaves(a), "leaves"), materialise(leaves(b), "leaves")
    places = ours.collect()
    assert len(places) == len(rows) and len({(r.volume, r.shelf, r.slot) for r in places}) == len(rows)
    per = collections.defaultdict(list)
    for r in places:
        per[r.volume, r.shelf].append((r.slot, r.offset, r.length))
    for v in per.values():
        assert len(v) <= VOLUME and all(0 <= s < VOLUME for s, _, _ in v)
        assert [o for _, o, _ in sorted(v)] == np.cumsum([0, *[n for _, _, n in sorted(v)]])[:-1].tolist()
    got = {(r.page_id, r.status) for r in audit(ours, theirs).collect()}
    moved = {(i, "shifted") for i in range(1001, (1000 // VOLUME + 1) * VOLUME)} | {(5001, "shifted")}  # the latter lies behind 4999
    assert got == {(42, "corrupt"), (1000, "corrupt"), (4999, "missing"), (6000, "extra")} | moved
    # clean branches are not looked into: every level holds one node for each damaged record here
    levels = [d.collect() for d in descent(materialise(tree(ours), "tree"), materialise(tree(theirs), "tree"))]
    assert len(levels) == LEVELS + 1 and all(len(x) == 4 for x in levels)
    assert {(r.volume, r.node) for r in levels[-1]} == {(i // VOLUME, i % VOLUME) for i in (42, 1000, 4999, 6000)} and {r.node for r in levels[1]} == {i % VOLUME // FANOUT ** (LEVELS - 1) for i in (42, 1000, 4999, 6000)}
    assert audit(ours, ours).isEmpty() and audit(leaves(a.limit(0)), leaves(a.limit(0))).isEmpty()
    assert {r.status for r in audit(leaves(a.limit(0)), theirs).collect()} == {"extra"}


def test_pipeline(spark, tmp_path):
    """Each stage on what its predecessor kept, against brute force, with null and repeated ids, nulls, empty texts and clashing columns."""
    import corpus_pipeline as cp
    from wharfline.llm.common import materialise

    g = random.Random(2)
    pool = ["".join(g.choice("mnoprstuvw") for _ in range(g.randint(3, 7))) for _ in range(400)]
    prose = lambda n: " ".join(g.choice(pool) for _ in range(n))
    passage = prose(14)
    rows = [(i, prose(40)) for i in range(360)]
    toxic = {i for i in range(360) if i % 3 == 0}
    rows = [(i, t + " zonkwit" if i in toxic else t) for i, t in rows]
    clean = [t for i, t in rows if i not in toxic]
    rows += [(500, clean[0]), (None, clean[1]), (4, clean[2]), (501, clean[3] + " more"), (None, clean[4] + " more"), (7, "what a z0nkw1t he is"), (None, "zonkwit"), (None, None), (502, ""), (None, prose(40)), (None, prose(40)), (8, prose(40))]
    rows += [(503, "start " + passage + " end of it"), (None, "other " + passage)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    labels = [(i, 1, int(i in toxic)) for i in range(360)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, passage)], "item_id long, text string")):
        spark.createDataFrame(data, schema).repartition(2).write.parquet(f"file://{tmp_path}/{name}.parquet")
    key = lambda r: (r[0] is None, r[0] or 0)

    def brute(name, docs):
        if name == "toxicity":
            return [r for r in docs if not re.search("zonkwit|z0nkw1t", r[1] or "")]
        if name == "exact_dedup":
            least = {}
            for r in docs:
                least.setdefault(r[1] or "", []).append(r)
            return [min(v, key=key) for v in least.values()]
        if name == "ngram_jaccard_join":
            w = [frozenset(zip(*(low(r[1]).split()[k:] for k in range(5)))) for r in docs]
            root = list(range(len(docs)))
            for a in range(len(docs)):
                for b in range(a):
                    if w[a] and 100 * len(w[a] & w[b]) >= 75 * len(w[a] | w[b]):
                        old, new = root[a], root[b]
                        root = [new if x == old else x for x in root]
            return [min((docs[k] for k in range(len(docs)) if root[k] == x), key=key) for x in set(root)]
        return [r for r in docs if passage not in (r[1] or "")]

    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    plain = lambda d: sorted(map(repr, d))
    for name, stage in cp.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = materialise(stage(spark, docs, f"file://{tmp_path}"), name)
        after = [tuple(r) for r in docs.collect()]
        want = brute(name, before)
        if name in ("exact_dedup", "ngram_jaccard_join"):  # of rows without ids any may stay
            assert sorted(map(str, (r[0] for r in after))) == sorted(map(str, (r[0] for r in want))) and set(after) <= set(before), name
        else:
            assert plain(after) == plain(want), name
        assert len(after) < len(before) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = cp.run(spark, f"file://{tmp_path}").collect()
    pieces = collections.Counter()
    for r in out:
        pieces[r.doc_id, r.doc_tokens] += r.length
    assert sorted(map(str, {r.doc_id for r in out})) == sorted(map(str, {r[0] for r in after}))
    assert all(n % tokens == 0 for (_, tokens), n in pieces.items()) and sum(n // t for (_, t), n in pieces.items()) == len(after)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"file://{tmp_path}/none/{name}.parquet")
    assert cp.run(spark, f"file://{tmp_path}/none").isEmpty()
