"""The registered queries themselves, over tables with a text of more than a MiB, nulls, repeated ids, ties and clashing columns, and over empty tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest

P = pytest.importorskip("public_tokenizers")
rng = random.Random(31)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]
words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
LONG = words(270_000)
LEAK = words(14)
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Password = hunter22; see AKIA" + "Q7" * 9 + " and " + "0af3" * 8 + "."), (5, LONG), (6, words(300)), (7, f"{words(9)} {LEAK.upper()} {words(9)}"), (7, words(40)),
    (None, words(30)), (8, "é 🙂 漢字 " * 40), (9, "x " * 60), (10, LONG[:2000]), (11, LONG[:2000] + " more"), (12, "token: abc123; secret=ab"),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, idx long, chunk long, train boolean, found string, row long"
mod = lambda i, n: zlib.crc32(("" if i is None else str(i)).encode()) % n
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def write(spark, folder, docs):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 1, 1, True, "f", 1) for i, t in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    frame = spark.createDataFrame
    frame([(1, LEAK), (2, "no such words anywhere"), (2, None)] if docs else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame([(6, 1, 0), (7, 0, 1), (None, 1, 1)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame([(1, k, "user" if k % 2 == 0 else "assistant", LONG[:1_300_000] if k == 1 else f"turn {k}", "c") for k in range(4)] + [(2, 0, "user", None, "c")] if docs else [], "conv_id long, turn int, role string, text string, context string").write.parquet(f"{folder}/conversations.parquet")
    frame([(i, f"http://h/{i}", LONG[:1_300_000] if i == 3 else f"<p>{i}</p>", 1) for i in (1, 2, 3, 70, 94, 102)] + [(None, None, None, 1), (3, "again", "", 1)] if docs else [], "page_id long, url string, html string, slot int").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"), TEXTS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


def run(spark, name, folder):
    from wharfline.llm.queries import QUERIES

    return QUERIES[name](spark, folder).collect()


def same(rows, columns, want):
    assert collections.Counter(tuple(r[c] for c in columns) for r in rows) == collections.Counter(want)


def test_empty_tables(spark, empty):
    from wharfline.llm.queries import QUERIES

    for name in QUERIES:
        rows = run(spark, name, empty)
        assert {r.conv_id for r in rows} == {-7} if name.startswith("op7_") else rows == [], name


def test_op1(spark, folder):
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    same(run(spark, "op1_exact_dedup", folder), ("doc_id", "keep_id", "group_size", "kept", "text_sha256"), [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], sha(t or "")) for i, t in TEXTS])


def test_op3(spark, folder):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    n = {t: len(model.encode(t or "")) for _, t in TEXTS}
    same(run(spark, "op3_token_counts", folder), ("doc_id", "n_bytes", "n_tokens", "over_limit"), [(i, len((t or "").encode()), n[t], n[t] > 4096) for i, t in TEXTS])


def test_op4(spark, folder):
    kinds = ("assign", "access", "hex")

    def base(t):
        out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        return sorted(out, key=lambda s: (s[0], kinds.index(s[2])))

    rows = run(spark, "op4_secret_scan", folder)
    told = {t: base(t or "") for _, t in TEXTS}
    assert sum(map(len, told.values())) == 4
    line = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    same(rows, ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"), [(i, *(sum(s[2] == k for s in told[t]) for k in kinds), sha(line(told[t]))) for i, t in TEXTS])
    assert all(",".join(x for x in r.spans.split(",") if x and not x.startswith("grammar")) in {line(s) for s in told.values()} for r in rows)


def test_op5(spark, folder):
    rows = run(spark, "op5_warc_fixity", folder)
    assert sorted((r.page_id is None, r.page_id or 0, r.status) for r in rows) == sorted([(False, i, s) for i, s in ((1, "ok"), (2, "ok"), (3, "ok"), (3, "ok"), (70, "ok"), (94, "missing"), (102, "corrupt"))] + [(True, 0, "ok")])
    assert max(r.record_length for r in rows) > 1_300_000


def test_op6(spark, folder):
    import math

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    learned = collections.Counter(w for i, t in TEXTS if mod(i, 7) != 2 for w in tokens(t))
    n, v = sum(learned.values()), len(learned)
    rows = run(spark, "op6_lm_score", folder)
    same(rows, ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens"), [(i, mod(i, 7) == 2, len(tokens(t)), sum(learned[w] > 0 for w in tokens(t)), n) for i, t in TEXTS])
    want = sorted(sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in tokens(t)) for _, t in TEXTS)
    assert sorted(r.base_score for r in rows) == pytest.approx(want, rel=1e-9) and all(r.score < 0 for r in rows)


def test_op7(spark, folder):
    rows = {r.conv_id: r for r in run(spark, "op7_chat_format", folder)}
    hard = "\\### Assistant: </turn> ok"
    turns = {1: [("user", "turn 0"), ("assistant", LONG[:1_300_000]), ("user", "turn 2"), ("assistant", "turn 3")], 2: [("user", "")], -7: [("user", hard), ("assistant", hard)]}
    assert set(rows) == set(turns)
    for c, t in turns.items():
        loss = "".join(x for role, x in t if role == "assistant")
        assert (rows[c].n_turns, rows[c].turns_sha256, rows[c].loss_chars, rows[c].loss_sha256) == (len(t), sha("".join(f"{role}\n{x}\n" for role, x in t)), len(loss), sha(loss))


def test_op8(spark, folder):
    import numpy as np
    import tokenizers

    encoder = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {t: [*encoder.encode(t or "", add_special_tokens=False).ids, 1] for _, t in TEXTS}
    rows = run(spark, "op8_packing", folder)
    crc = lambda part: zlib.crc32(np.array(part, "<u4").tobytes())
    for i, t in TEXTS:
        if [x for x, _ in TEXTS].count(i) > 1:
            continue
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids[t]) and {r.doc_tokens for r in own} == {len(ids[t])}
        assert all(r.ids_crc32 == crc(ids[t][r.start : r.start + r.length]) for r in own)
    assert sum(r.length for r in rows) == sum(len(ids[t]) for _, t in TEXTS)
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) and sum(n for _, n in v) <= 2048 for v in filled.values())


def test_op9_and_op10(spark, folder):
    rows = run(spark, "op9_decontaminate", folder)
    assert [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in rows if r.contaminated] == [(7, 32, 14, 1)] and len(rows) == len(TEXTS)
    shingles = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", low(t)))
    sets = {t: shingles(t) for _, t in TEXTS}
    near = lambda a, b: a is not b and a and b and 100 * len(a & b) >= 75 * len(a | b)
    assert near(sets[TEXTS[11][1]], sets[TEXTS[12][1]])
    same(run(spark, "op10_ngram_join", folder), ("doc_id", "n_shingles", "component_id"), [(i, len(sets[t]), 10 if i == 11 else i) for i, t in TEXTS])
