"""Cost-balanced packing.

A piece of ``n`` tokens costs ``linear * n + quadratic * n**2`` (projections and attention). Within a block of documents the pieces
are taken in descending order, each to the lowest-cost sequence with enough remaining token capacity; a piece that fits in no
sequence fills up the lowest-cost one and what is left of it goes on as a smaller piece. The block's tokens determine the sequences
beforehand: full ones, and for the rest powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, table, word_hashes

CAPACITY = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
CACHE_WORDS = 1 << 19


#: byte classes of the splitter: 0 blank, 1 letter (any part of a Latin letter beyond ASCII too), 2 digit, 3 other
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
#: texts with anything else (other scripts, marks, special tokens, apostrophes as in contractions) are encoded whole
_UNUSUAL = re.compile(r"[^\x00-\x26\x28-\x7fªµºÀ-ÖØ-öø-\u012f\u0131-\u024f]|<\|")


class WordEncoder:
    """Ids of a word-level BPE as the tokenizers library gives them, with a cache of words.

    The model's splitter makes words independent, so a text's ids are its words' ids in order. Words are found and hashed for a
    whole slice of texts at once, and the library encodes each distinct word that the cache does not have.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = [np.empty(0, np.uint32)]
        self.sizes = [np.empty(0, np.int64)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        """Encode new words, in one call as far as possible (words are split at blanks)."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):
            parts = [self.whole(w) for w in words]
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        at = len(self.place)
        self.place.update(zip(hashes, range(at, at + len(hashes))))
        self.flat = [np.concatenate((*self.flat, ids))]
        self.sizes = [np.concatenate((*self.sizes, np.diff(ends, prepend=0)))]

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's offset among them (one more entry at the end)."""
        n, docs = len(data), len(offs) - 1
        if not n:
            return np.empty(0, np.uint32), np.zeros(docs + 1, np.int64)
        kind = _CLASS[data]
        border = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=border[1:-1])
        border[:-1] |= kind == 2
        border[1:] |= kind == 2
        border[offs] = True
        edges = np.flatnonzero(border)
        starts, ends = edges[:-1], edges[1:]
        solid = kind[starts] != 0
        starts, ends = starts[solid], ends[solid]
        first = np.searchsorted(starts, offs)
        body = data.tobytes()
        odd = [d for d in range(docs) if _UNUSUAL.search(body[offs[d] : offs[d + 1]].decode())]
        if odd:  # their words are left out here
            usual = np.ones(len(starts), bool)
            for d in odd:
                usual[first[d] : first[d + 1]] = False
            starts, ends = starts[usual], ends[usual]
            first = np.searchsorted(starts, offs)
        word, at, where = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        keys = word.tolist()
        if len(self.place) + len(keys) > CACHE_WORDS:
            self.forget()
        place = list(map(self.place.get, keys))
        new = [i for i, p in enumerate(place) if p is None]
        if new:
            self._learn([keys[i] for i in new], [unicodedata.normalize("NFC", body[s:e].decode()).lower() for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            place = list(map(self.place.__getitem__, keys))
        place = np.array(place, np.int64)
        sizes, flat = self.sizes[0], self.flat[0]
        begin = np.cumsum(sizes) - sizes
        own = place[where] if len(keys) else np.empty(0, np.int64)
        many = sizes[own]
        upto = np.concatenate(([0], np.cumsum(many)))
        ids = flat[np.repeat(begin[own] - upto[:-1], many) + np.arange(upto[-1])]
        cut = upto[first]
        if odd:
            parts = [ids[cut[d] : cut[d + 1]] for d in range(docs)]
            for d in odd:
                parts[d] = self.whole(body[offs[d] : offs[d + 1]].decode())
            ids, cut = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, cut


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def sequence_sizes(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Capacities of the sequences for so many tokens: full ones, then descending powers of two."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); every sequence of sequence_sizes is filled exactly.

    All sequences of the block are searched for each piece: the lowest-cost one that has room is found, and a piece is cut only where none has.
    """
    sizes = sequence_sizes(sum(lengths), capacity)
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    queue = []
    for d, n in enumerate(lengths):
        queue += [(-min(capacity, n - s), d, s) for s in range(0, n, capacity)]
    heapq.heapify(queue)
    out = []
    while queue:
        n, d, s = heapq.heappop(queue)
        n = -n
        fits = room >= n
        k = int(np.where(fits, cost, np.inf).argmin())
        if not fits[k]:  # it fits in none: the lowest-cost one with any room takes what it can
            k = int(np.where(room > 0, cost, np.inf).argmin())
        take = min(n, int(room[k]))
        out.append((d, s, take, k, sizes[k] - int(room[k])))
        room[k] -= take
        cost[k] += linear * take + quadratic * take * take
        if take < n:
            heapq.heappush(queue, (take - n, d, s + take))
    return out


def pack_sequences(docs: DataFrame, model_path: str, capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack every text's ids and an end id into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, start, length, ids (array, if ``with_ids``), ids_crc32, doc_tokens, sequence_id, offset.

    Edge cases: null and empty texts are the end id alone; ids may be null or repeated, each row is a document of its own; an
    empty table gives no pieces; very long texts are cut into several pieces. Other columns are not read.

    Scale: no shuffle; a task packs blocks of about ``block_tokens`` tokens, so memory is bounded, and only the last sequences of a
    block are shorter than ``capacity`` (powers of two). A sequence's id is its task and its number there; a task that runs again
    gives the same rows.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def run(batches):
        from pyspark import TaskContext

        enc, task, number = encoder(model_path), TaskContext.get().partitionId(), 0
        names, values, tokens, id_type = [], [], 0, None

        def flush():
            nonlocal number
            cols: list[list] = [[] for _ in range(7)]
            bodies: list[np.ndarray] = []
            lengths = [len(v) for v in values]
            for d, s, n, k, o in sorted(pack(lengths, capacity, linear, quadratic), key=lambda p: (p[3], p[4])):
                body = values[d][s : s + n]
                for c, v in zip(cols, (names[d], s, n, zlib.crc32(body.astype("<u4").tobytes()), lengths[d], (task << 40) + number + k, o)):
                    c.append(v)
                bodies.append(body)
            number += len(sequence_sizes(sum(lengths), capacity))
            arrays = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:]]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                at = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
                arrays.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(bodies).astype(np.int32))))
                fields.append("ids")
            batch = pa.RecordBatch.from_arrays(arrays, names=fields)
            names.clear(), values.clear()
            return batch

        for rows, data, offs in chunks(batches, "text"):
            found, cut = enc.batch(data, offs)
            id_type = rows.column("doc_id").type
            for name, a, b in zip(rows.column("doc_id").to_pylist(), cut[:-1], cut[1:]):
                ids = np.append(found[a:b], np.uint32(END_ID))
                names.append(name), values.append(ids)
                tokens += len(ids)
                if tokens >= block_tokens:
                    tokens = 0
                    yield flush()
        if names:
            yield flush()

    extra = ", ids array<int>" if with_ids else ""
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{extra}")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
