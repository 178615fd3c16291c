"""Language-model scoring with an Elias-Fano n-gram trie.

A trigram model with interpolated absolute discounting over all training words is learned from the training documents; every
word has an id and every bigram and trigram is kept. The trie lies in hash shards of contexts. A shard is one flat memory map (``Level``):
its contexts and, by monotone pointers, their children are Elias-Fano sequences, the children with discounted probabilities and the contexts with
back-off weights, both quantised to 16 bits. A query finds a word among a context's children by successor search in a context-relative key.

Nothing that is learned sits in one place: texts are cut into chunks, each chunk's distinct words and then grams go to hash
shards, and the shards answer with counts and ids, then with probabilities. The children of contexts of frequent words alone (a document's start
among them) are spread over further shards by word, as one context may lead to a third of all tokens; their totals, a bounded table, are summed up.
"""

from __future__ import annotations

import math
import mmap

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, store_parts
from .common import NON_SPACE, bounded_batches, chunks, crc_mod, materialise, mix, release, table, word_hashes, word_spans

ABSENT = 65535
UNKNOWN, END, START = 0, 1, 2  # ids before those of the words
END_AND_START = 3
DISCOUNT = 0.75
CHUNK_TEXT = 8 << 20
#: A word with more than 1 / FREQUENT of the training tokens is frequent: there are fewer than FREQUENT, and fewer than its square contexts of them.
FREQUENT = 1024
#: a task has 2 ** TASK_BITS shards, one after another: shards stay small, and so does the number of files
TASK_BITS = 2
#: so many keys are searched at a time
BLOCK_KEYS = 1 << 16
STEP = 4096.0  # quantisation: codes per unit of log10


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A non-decreasing sequence below ``universe``: low bits packed, high bits in unary. Lives in uint64 words of a flat buffer."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high)
        self.ones_before = np.concatenate(([0], np.cumsum(ones))).astype(np.int64)
        self.zeros_before = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones_before

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) if n else 0) + (universe >> bits) - (int(values[-1]) >> bits if n else 0) + 3
        flags = np.zeros((size // 64 + 1) * 64, bool)
        flags[place] = True
        return cls(n, bits, low, np.packbits(flags, bitorder="little").view(np.uint64))

    @staticmethod
    def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit (from 0)."""
        at = np.searchsorted(before, k, "right") - 1
        word, rest = words[at], k - before[at]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            under = np.bitwise_count((word >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            right = rest >= under
            rest = np.where(right, rest - under, rest)
            place += np.where(right, width, 0)
        return at * 64 + place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        left = (np.uint64(64) - shift) & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << left, np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(self.high, self.ones_before, i) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, key: np.ndarray) -> np.ndarray:
        """Index of the first value not below each key."""
        high = (key >> self.low_bits).astype(np.int64)
        both = np.concatenate((high - 1, high))
        zero = self._select(~self.high, self.zeros_before, np.maximum(both, 0)) - both
        begin, end = np.where(high > 0, zero[: len(key)], 0), zero[len(key) :]
        target = (key & ((1 << self.low_bits) - 1)).astype(np.uint64)
        at, end = begin.copy(), end.copy()
        live = np.flatnonzero(at < end)
        while len(live):  # by halves: a frequent context has thousands of children with equal high bits
            middle = (at[live] + end[live]) // 2
            short = self._low(middle) < target[live]
            at[live[short]] = middle[short] + 1
            end[live[~short]] = middle[~short]
            live = live[at[live] < end[live]]
        return at

    def part(self, a: int, b: int) -> np.ndarray:
        """The values from index ``a`` to ``b``, read in one go."""
        if a >= b:
            return np.empty(0, np.uint64)
        edge = self._select(self.high, self.ones_before, np.array([a, b - 1]))
        word = int(edge[0]) // 64
        bits = np.unpackbits(self.high[word : int(edge[1]) // 64 + 1].view(np.uint8), bitorder="little")
        place = np.flatnonzero(bits)[a - int(self.ones_before[word]) :][: b - a] + word * 64
        index = np.arange(a, b)
        return ((place - index).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(index)

    def find(self, key: np.ndarray, within: tuple[int, int] | None = None) -> np.ndarray:
        """Index of each of the ascending keys, -1 where it is absent; ``within`` bounds the indices.

        A block of keys has its successors in one stretch of the sequence, which is read in one go; a stretch that is much longer than the block is not, its keys are searched one by one.
        """
        out = np.full(len(key), -1, np.int64)
        low, end = within or (0, self.n)
        for at in range(0, len(key), BLOCK_KEYS):
            own = key[at : at + BLOCK_KEYS].astype(np.uint64)
            a, b = np.clip(self.successor(own[[0, -1]]), low, end).tolist()
            b = min(b + 1, end)
            if b - a > 16 * len(own) + 4096:
                place = self.successor(own)
                inside = np.minimum(place, self.n - 1)
                hit = (place < end) & (self.get(inside) == own)
            else:
                values = self.part(a, b)
                place = np.searchsorted(values, own)
                hit = place < len(values)
                hit[hit] = values[place[hit]] == own[hit]
                place = place + a
            out[at : at + len(own)] = np.where(hit, place, -1)
        return out


# ---------------------------------------------------------------- the model


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 * STEP), 0, 65535).astype(np.uint16)


class Level:
    """Contexts, their children and the codes of both, in a flat buffer such as a memory map; the arrays are views into it."""

    def __init__(self, buffer):
        shape = np.frombuffer(buffer, np.int64, 15).tolist()
        self.buffer, self.width = buffer, shape[0]
        at, levels, codes = 15 * 8, [], []
        for k in range(1, 13, 4):
            n, bits, low, high = shape[k : k + 4]
            levels.append(EliasFano(n, bits, np.frombuffer(buffer, np.uint64, low, at), np.frombuffer(buffer, np.uint64, high, at + low * 8)))
            at += (low + high) * 8
        for n in shape[13:]:
            codes.append(np.frombuffer(buffer, np.uint16, n, at))
            at += (n * 2 + 7) // 8 * 8
        self.contexts, self.pointers, self.children = levels
        self.p, self.g = codes

    @classmethod
    def build(cls, contexts: np.ndarray, of: np.ndarray, words: np.ndarray, p: np.ndarray, g: np.ndarray, width: int) -> Level:
        """From distinct sorted contexts with their codes g, and children (the context's index, the word) in order with their codes p."""
        n = len(contexts)
        parts, shape = [], [width]
        for values, universe in ((contexts, 1 << 64), (np.searchsorted(of, np.arange(n + 1)), len(of) + 1), (of.astype(np.uint64) * np.uint64(width) + words.astype(np.uint64), max(n, 1) * width)):
            e = EliasFano.build(values, universe)
            shape += [e.n, e.low_bits, len(e.low), len(e.high)]
            parts += [e.low.tobytes(), e.high.tobytes()]
        for codes in (p, g):
            shape.append(len(codes))
            parts.append(codes.tobytes() + bytes(-len(codes) * 2 % 8))
        parts.insert(0, np.array(shape, np.int64).tobytes())
        buffer = mmap.mmap(-1, sum(map(len, parts)))
        for part in parts:
            buffer.write(part)
        return cls(buffer)

    def find(self, context: np.ndarray, of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words after the contexts (ABSENT where not in training) and of the contexts' back-off weights (0, all mass, where not in training).

        Contexts ascend; ``of`` has each word's context's number, and words ascend within a context. The children of a block of contexts lie between the pointers of its first
        and of the one after its last; there the words are searched, relative to their contexts.
        """
        p, g = np.full(len(word), ABSENT, np.uint16), np.zeros(len(context), np.uint16)
        node = self.contexts.find(context)
        seen = np.flatnonzero(node >= 0)
        g[seen] = self.g[node[seen]]
        first = np.searchsorted(of, np.arange(len(context) + 1))
        begins, at = first[seen], 0
        while at < len(seen):
            # contexts with about BLOCK_KEYS words together, or one
            to = max(at + 1, int(np.searchsorted(begins, begins[at] + BLOCK_KEYS)))
            block = seen[at:to]
            begin, end = self.pointers.get(np.array([node[block[0]], node[block[-1]] + 1])).astype(np.int64).tolist()
            mine = np.flatnonzero(node[of[first[block[0]] : first[block[-1] + 1]]] >= 0) + first[block[0]]
            key = node[of[mine]].astype(np.uint64) * np.uint64(self.width) + word[mine].astype(np.uint64)
            for k in range(0, len(key), BLOCK_KEYS):
                child = self.children.find(key[k : k + BLOCK_KEYS], (begin, end))
                hit = child >= 0
                p[mine[k : k + BLOCK_KEYS][hit]] = self.p[child[hit]]
            at = to
        return p, g


# ---------------------------------------------------------------- chunks of documents


def _pack(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the upper bytes of small numbers cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def _unpack(b: bytes, kind=np.uint64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=keys.dtype.type(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint64)


CHUNK = "train binary, lengths binary, by_count binary, seq binary, train_tokens long, train_docs long, words binary, learned binary, part int"


def chunk_documents(docs: DataFrame, limit: int) -> DataFrame:
    """Rows of the documents of about ``limit`` bytes of text (a longer text alone), as words rather than text.

    Of each a row of part 0: chunk, ids, train flags, lengths in words, the places of its distinct words in the order of frequency, and the documents' words by that order; tokens and
    documents in training; and one of part 1: the sorted hashes of its distinct words, and how often each is in training documents.
    """

    def cut(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size, id_type = 0, None

        def flush():
            nonlocal number
            ids = [i for h in held for i in h[0]]
            train = np.array([t for h in held for t in h[1]], bool)
            lengths = np.concatenate([h[2] for h in held])
            word, place, times = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True, return_counts=True)
            learned = np.bincount(place, np.repeat(train, lengths), len(word)).astype(np.uint32)
            by_count = np.argsort(-times, kind="stable").astype(np.uint32)
            rank = np.empty(len(word), np.uint32)
            rank[by_count] = np.arange(len(word), dtype=np.uint32)
            two = lambda value, kind: pa.array([value, None], kind)
            row = [
                pa.array([(task << 24) + number] * 2), two(ids, pa.list_(id_type)), *(two(m, pa.binary()) for m in (train.tobytes(), _pack(lengths.astype(np.uint32)), _pack(by_count), _pack(rank[place]))),
                two(int((lengths[train] + 1).sum()), pa.int64()), two(int(train.sum()), pa.int64()), *(pa.array([None, m], pa.binary()) for m in (_pack_sorted(word), _pack(learned))), pa.array([0, 1], pa.int32()),
            ]
            number += 1
            held.clear()
            release()
            return pa.RecordBatch.from_arrays(row, names=["chunk", "ids", "train", "lengths", "by_count", "seq", "train_tokens", "train_docs", "words", "learned", "part"])

        for part, data, offs in chunks(batches, "text"):
            id_type = part.column("doc_id").type
            starts, ends, first = word_spans(data, offs, NON_SPACE)
            held.append((part.column("doc_id").to_pylist(), part.column("train").to_pylist(), np.diff(first), word_hashes(data, starts, ends)))
            size += len(data)
            if size >= limit:
                size = 0
                yield flush()
        if held:
            yield flush()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(cut, f"chunk long, ids array<{kind}>, {CHUNK}")


def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    """Borders of the shards (by the top bits) in a sorted array."""
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]


def word_requests(packed: DataFrame, bits: int) -> DataFrame:
    """For each chunk and shard the chunk's distinct words and their training counts."""

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, words, learned = (batch.column(c)[i].as_py() for c in ("chunk", "words", "learned"))
                word, count = _unpack_sorted(words), _unpack(learned, np.uint32)
                cut = _shards(word, bits)
                shards = [s for s in range(1 << bits) if cut[s] < cut[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards, pa.int32()), pa.array([chunk] * len(shards), pa.int64()), *(pa.array([f(a[cut[s] : cut[s + 1]]) for s in shards], pa.binary()) for f, a in ((_pack_sorted, word), (_pack, count)))],
                    names=["shard", "chunk", "words", "counts"],
                )

    return packed.select("chunk", "words", "learned").mapInArrow(ask, "shard int, chunk long, words binary, counts binary")


def word_answers(requests: DataFrame, bar: int) -> DataFrame:
    """The corpus counts and numbers within the shard (from 1; 0 if not in training) for every request; and per shard (chunk null) how many training words it has, and the numbers of those over ``bar`` (a)."""

    def answer(part: pa.Table) -> pa.Table:
        words = [_unpack_sorted(b) for b in part.column("words").to_pylist()]
        word, where = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(where, np.concatenate([_unpack(b, np.uint32) for b in part.column("counts").to_pylist()]), len(word)).astype(np.uint64)
        number = np.zeros(len(word), np.uint64)  # by descending count, so that frequent words have small ids
        order = np.argsort(-total.astype(np.int64), kind="stable")[: int((total > 0).sum())]
        number[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
        cut = np.cumsum([0, *map(len, words)])
        own = [where[a:b] for a, b in zip(cut[:-1], cut[1:])]
        shard = part.column("shard")[0].as_py()
        return pa.table({
            "chunk": pa.array([*part.column("chunk").to_pylist(), None], pa.int64()), "shard": pa.array([shard] * (len(own) + 1), pa.int32()),
            "a": pa.array([*(_pack(total[i]) for i in own), _pack(number[total > bar])], pa.binary()), "b": pa.array([*(_pack(number[i]) for i in own), None], pa.binary()),
            "distinct": pa.array([0] * len(own) + [int((total > 0).sum())], pa.int64()),
        })

    return requests.groupBy("shard").applyInArrow(answer, "chunk long, shard int, a binary, b binary, distinct long")


def distinct_grams(before: np.ndarray, word: np.ndarray, inner: np.ndarray, width: int, frequent: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (context, word) of both orders, by shards, then contexts and words; each gram's place among them; the shards' borders.

    Grams after contexts of frequent words alone lie in the second half of the shards.
    """
    w = np.uint64(width)
    two, at2 = np.unique(before * w + word, return_inverse=True)
    three, at3 = np.unique(at2[inner - 1].astype(np.uint64) * w + word[inner], return_inverse=True)
    pair = two[(three // w).astype(np.int64)]
    c = np.concatenate((two // w, pair + np.uint64(1 << 63)))
    words = np.concatenate((two % w, three % w))
    often = np.isin(two // w, frequent)
    often = np.concatenate((often, (often & np.isin(two % w, frequent))[(three // w).astype(np.int64)]))
    shard = (np.where(often, mix(mix(c) ^ words), mix(c)) >> np.uint64(64 - bits)).astype(np.int32) + (often.astype(np.int32) << bits)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(c), np.int64)
    place[order] = np.arange(len(c))
    return c[order], words[order], place[np.concatenate((at2, at3 + len(two)))], np.searchsorted(shard[order], np.arange((2 << bits) + 1))


def word_ids(number: np.ndarray, shard: int, bits: int) -> np.ndarray:
    """Ids of words from their numbers within a shard (0 is unknown); the shards' ids are interleaved."""
    return np.where(number > 0, ((number - np.uint64(1)) << np.uint64(bits)) + np.uint64(shard + START + 1), np.uint64(UNKNOWN))


def chunk_grams(chunk: pa.Table, replies: pa.Table, width: int, frequent: np.ndarray, bits: int) -> tuple:
    """Of one chunk: each word's count, the documents' first words and starts, and the distinct grams of both orders with their training counts."""
    train, lengths, by_count, seq = (chunk.column(c)[0].as_py() for c in ("train", "lengths", "by_count", "seq"))
    by_shard = sorted((r["shard"], r["a"], r["b"]) for r in replies.to_pylist() if r["grams"] == 0)
    none = np.empty(0, np.uint64)
    count = np.concatenate([none, *(_unpack(a) for _, a, _ in by_shard)]).astype(np.int64)
    number = np.concatenate([none, *(word_ids(_unpack(b), shard, bits) for shard, _, b in by_shard)])
    at = _unpack(by_count, np.uint32)[_unpack(seq, np.uint32)]
    count, ids = count[at], number[at]
    firsts = np.concatenate(([0], np.cumsum(_unpack(lengths, np.uint32), dtype=np.int64)))
    seq, starts = sequences(ids, firsts, END)
    before = np.empty(len(seq), np.uint64)
    before[1:] = seq[:-1]
    before[starts[:-1]] = START
    inside = np.ones(len(seq), bool)
    inside[starts[:-1]] = False
    inner = np.flatnonzero(inside)
    c, w, at, cut = distinct_grams(before, seq, inner, width, frequent, bits)
    learn = np.repeat(np.frombuffer(train, bool), np.diff(starts))
    learned = np.bincount(at, np.concatenate((learn, learn[inner])), len(c)).astype(np.uint32)
    return count, firsts, starts, inner, c, w, at, cut, learned


def changes(context: np.ndarray) -> np.ndarray:
    """Whether a context differs from the one before it; the first one does."""
    new = np.ones(len(context), bool)
    new[1:] = context[1:] != context[:-1]
    return new


def gram_answers(requests: DataFrame, width: int, tokens: int, bits: int) -> DataFrame:
    """For every requested gram the code of its discounted probability (ABSENT if not in training), and for each of a request's contexts its back-off weight.

    In the shards of contexts that are spread the code is the discounted count's share of all tokens, and a further row (chunk null) has
    the contexts (a) and their totals and numbers of children there (b).
    """

    def answer(part: pa.Table) -> pa.Table:
        shard = part.column("shard")[0].as_py()
        spread = shard >> bits
        asked = [_unpack_sorted(b) for b in part.column("contexts").to_pylist()]
        words = [_unpack(b, np.uint32) for b in part.column("words").to_pylist()]
        cut = np.cumsum([0, *map(len, asked)])
        context, of = np.unique(np.concatenate(asked), return_inverse=True)
        key, where = np.unique(of.astype(np.uint64) * np.uint64(width) + np.concatenate(words), return_inverse=True)
        times = np.bincount(where, np.concatenate([_unpack(b, np.uint32) for b in part.column("counts").to_pylist()]), len(key))
        learned = times > 0
        total, own = times[learned], (key[learned] // np.uint64(width)).astype(np.int64)
        whole, kinds = np.bincount(own, total, len(context)), np.bincount(own, minlength=len(context))
        seen = np.flatnonzero(whole)
        number = np.cumsum(whole > 0) - 1
        level = Level.build(context[seen], number[own], key[learned] % np.uint64(width), quantise(np.log10((total - DISCOUNT) / (tokens if spread else whole[own]))), quantise(np.log10(DISCOUNT * kinds[seen] / whole[seen])), width)
        # every gram that any chunk asks for is searched once
        p, g = level.find(context, (key // np.uint64(width)).astype(np.int64), (key % np.uint64(width)).astype(np.uint32))
        chunk = part.column("chunk").to_pylist()
        a = [_pack(p[where[i:j]]) for i, j in zip(cut[:-1], cut[1:])]
        b = [_pack(g[of[i:j][changes(of[i:j])]]) for i, j in zip(cut[:-1], cut[1:])]  # one for each of its contexts
        if spread:
            chunk.append(None), a.append(_pack(context[seen])), b.append(_pack(np.concatenate((whole[seen], kinds[seen])).astype(np.uint64)))
        del level
        release()
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "shard": pa.array([shard] * len(chunk), pa.int32()), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "grams": pa.array([1] * len(chunk), pa.int32())})

    return requests.groupBy("shard").applyInArrow(answer, "chunk long, shard int, a binary, b binary, grams int")


def spread_totals(replied: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts that are spread over shards (fewer than FREQUENT + 1 squared, and themselves), their totals and numbers of children."""

    def rows(batches):
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                context, both = _unpack(a), _unpack(b).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(both[: len(context)]), pa.array(both[len(context) :])], names=["context", "whole", "kinds"])

    got = replied.filter("chunk is null").select("a", "b").mapInArrow(rows, "context long, whole long, kinds long")
    got = got.groupBy("context").agg(F.sum("whole").alias("whole"), F.sum("kinds").alias("kinds")).toArrow()
    context = got.column("context").to_numpy().view(np.uint64)
    order = np.argsort(context)
    return context[order], got.column("whole").to_numpy()[order], got.column("kinds").to_numpy()[order]


def sequences(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' ids with an END after each, and where each begins (one more entry at the end)."""
    docs = len(first) - 1
    starts = first + np.arange(docs + 1)
    out = np.full(starts[-1], end, np.uint64)
    out[np.arange(len(ids)) + np.repeat(np.arange(docs), np.diff(first))] = ids
    return out, starts


def lm_score(docs: DataFrame, train, chunk_text: int = CHUNK_TEXT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text under an add-one unigram model and a trigram model, both learned from the rows where ``train`` (a column) holds.

    Returns doc_id, n_tokens (words and an end), n_known (tokens seen in training), train_tokens, base_score (add-one unigram log10
    probability), score (the trigram model's log10 probability).

    Edge cases: words are runs of non-blanks with A-Z lower-cased; null and empty texts are an end token alone; a null training
    flag is false; without training rows every word is unseen and only the add-one masses decide; ids may be null or repeated; an
    empty table gives an empty result. Very long texts are scored whole. Other columns are not read.

    Scale: texts are written once, as compressed words, in chunks; each chunk sends its distinct words and grams to hash shards (their
    number follows the chunks'), one at a time in a task. No word or gram is dropped; only the totals of contexts of frequent words alone are broadcast
    (their number is bounded). Ids must stay below 2**31, so that two make a context (an error beyond); there is one small blob per chunk and shard, so beyond
    about 1 TB of text ``chunk_text`` should grow with the square root of the input.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = dict(source.dtypes)["doc_id"]
    packed, vocabulary = store_parts(chunk_documents(source, chunk_text), "part", [0, 1], "chunks")
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.sum("train_tokens").alias("t"), F.sum("train_docs").alias("d")).first()
    tokens, ends = size.t or 0, size.d or 0
    bits = max(4, int(size.n).bit_length())
    answers = materialise(word_answers(word_requests(vocabulary, bits).repartition(1 << bits - TASK_BITS, "shard"), tokens // FREQUENT), "counts")
    discard(vocabulary)
    shards = answers.filter("chunk is null").select("shard", "distinct", "a").collect()
    frequent = np.concatenate([np.array([END, START], np.uint64), *(word_ids(_unpack(r.a), r.shard, bits) for r in shards)])
    distinct = sum(r.distinct for r in shards)
    width = (max((r.distinct for r in shards), default=0) << bits) + END_AND_START
    if width > 1 << 31:
        raise ValueError(f"{width} word ids: beyond 2**31 two of them no longer make a context")
    types = distinct + (ends > 0)
    base_mass = math.log10(tokens + types + 1)
    end_base = math.log10(ends + 1) - base_mass
    words = answers.filter("chunk is not null").select("chunk", "shard", "a", "b", F.lit(0).alias("grams"))
    texts = packed.select("chunk", "ids", "train", "lengths", "by_count", "seq").repartition(int(size.n) or 1, "chunk")
    by_chunk = lambda d: d.repartition(int(size.n) or 1, "chunk").groupBy("chunk")

    def ask(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        *_, c, w, _, cut, learned = chunk_grams(chunk, replies, width, frequent, bits)
        shards = [s for s in range(2 << bits) if cut[s] < cut[s + 1]]
        own = lambda f, a: pa.array([f(a[cut[s] : cut[s + 1]]) for s in shards], pa.binary())
        release()
        return pa.table({"shard": pa.array(shards, pa.int32()), "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(shards), pa.int64()), "contexts": own(_pack_sorted, c), "words": own(_pack, w.astype(np.uint32)), "counts": own(_pack, learned)})

    requests = texts.groupBy("chunk").cogroup(by_chunk(words)).applyInArrow(ask, "shard int, chunk long, contexts binary, words binary, counts binary")
    replied = materialise(gram_answers(requests.repartition(2 << bits - TASK_BITS, "shard"), width, max(tokens, 1), bits), "grams")
    sent = docs.sparkSession.sparkContext.broadcast(spread_totals(replied))

    def score(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        count, first, starts, inner, c, _, at, cut, _ = chunk_grams(chunk, replies, width, frequent, bits)
        by_shard = sorted((r["shard"], r["a"], r["b"]) for r in replies.to_pylist() if r["grams"] == 1)
        p, g = (np.concatenate([np.empty(0, np.uint16), *(_unpack(r[k], np.uint16) for r in by_shard)]) for k in (1, 2))
        new = changes(c)
        new[[k for k in cut if k < len(c)]] = True  # a shard's answer begins with its first context
        g = g[np.cumsum(new) - 1]
        p, g = np.where(p == ABSENT, 0.0, 10 ** (p / -STEP)), 10 ** (g / -STEP)
        context, whole, kinds = sent.value
        half = cut[1 << bits]
        node = np.searchsorted(context, c[half:])
        seen = node < len(context)
        seen[seen] = context[node[seen]] == c[half:][seen]
        node = node[seen]
        g[half:] = 1.0
        g[half:][seen] = DISCOUNT * kinds[node] / whole[node]
        p[half:][seen] *= tokens / whole[node]
        p, g = p[at], g[at]
        docs_ = len(first) - 1
        of, spread = np.repeat(np.arange(docs_), np.diff(first)), np.repeat(np.arange(docs_), np.diff(starts))
        plain = np.full(starts[-1], end_base)
        plain[np.arange(len(count)) + of] = np.log10(count + 1.0) - base_mass
        n = len(plain)
        model = p[:n] + g[:n] * 10**plain
        model[inner] = p[n:] + g[n:] * model[inner]
        known = np.bincount(of, count > 0, docs_).astype(np.int64) + (ends > 0)
        release()
        return pa.table({
            "doc_id": pa.array(chunk.column("ids")[0].as_py(), chunk.column("ids").type.value_type), "n_tokens": pa.array(np.diff(starts)), "n_known": pa.array(known),
            "base_score": pa.array(np.bincount(spread, plain, docs_)), "score": pa.array(np.bincount(spread, np.log10(np.minimum(model, 1.0)), docs_)),
        })

    scored = texts.groupBy("chunk").cogroup(by_chunk(words.unionByName(replied.filter("chunk is not null")))).applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = lm_score(docs, crc_mod("doc_id", 7) != 2)
    return got.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
