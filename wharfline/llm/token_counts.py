"""Token counts with overlap resynchronisation.

Short texts are encoded whole. A huge text is encoded in overlapping chunks with byte offsets; neighbouring chunks are spliced
at a common token boundary that is proven stable, and the overlap widens (in the end to the rest of the text) where none is found.

The proof: if no piece of the vocabulary holds a space mark after another character, no merge can ever cross the place before a
space that follows a non-space, so the tokens on either side do not depend on the other side. The vocabulary is checked for this
when it is loaded; texts for which offsets cannot be trusted (they hold the space mark itself) are encoded whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, table

CHUNK = 1 << 16
OVERLAP = 1 << 9
SPACE_MARK = "▁"


class PieceEncoder:
    """A sentencepiece model with the byte length of every piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.length = np.array([1 if self.sp.is_byte(i) else len(p.replace(SPACE_MARK, " ").encode()) for i, p in enumerate(pieces)])
        self.stable_before_space = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def ends(self, ids: list[int], size: int) -> np.ndarray | None:
        """Byte offset at the end of each token (the model's dummy space has none); None if they don't add up to ``size``."""
        ends = np.cumsum(self.length[np.asarray(ids, np.int64)]) - 1
        return ends if len(ends) and ends[-1] == size else None


def _cut(data: bytes, at: int) -> int:
    """The nearest character boundary at or before ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_huge(enc: PieceEncoder, data: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long UTF-8 text; equals ``len(enc.ids([text])[0])``."""
    whole = lambda: len(enc.ids([data.decode()])[0])
    if not enc.stable_before_space or SPACE_MARK.encode() in data:
        return whole()
    view = np.frombuffer(data, np.uint8)
    total, spliced, start = 0, -1, 0  # tokens up to the byte `spliced` are counted (a dummy space may end at 0); the chunk begins at `start`
    end = _cut(data, min(len(data), chunk))
    while True:
        ids = enc.ids([data[start:end].decode()])[0]
        ends = enc.ends(ids, end - start)
        if ends is None:
            return whole()
        ends = ends + start
        if end == len(data):
            return total + int((ends > spliced).sum())
        # the next chunk overlaps this one; look for a boundary in the overlap at which both have a token edge
        width = overlap
        while True:
            nxt = _cut(data, max(spliced, 0, end - width))
            to = _cut(data, min(len(data), max(nxt + chunk, end + overlap)))
            zone = view[nxt:end]
            places = np.flatnonzero((zone[1:] == 32) & (zone[:-1] != 32)) + nxt + 1
            places = places[(places > spliced) & np.isin(places, ends)]
            if len(places):
                other = enc.ends(enc.ids([data[nxt:to].decode()])[0], to - nxt)
                if other is None:
                    return whole()
                agreed = places[np.isin(places, other + nxt)]
                if len(agreed):
                    splice = int(agreed[-1])
                    break
            if nxt <= max(spliced, 0):  # no boundary anywhere: this chunk grows instead
                nxt, splice, to = start, spliced, _cut(data, min(len(data), end + max(chunk, end - start)))
                break
            width *= 2
        total += int(((ends > spliced) & (ends <= splice)).sum())
        start, spliced, end = nxt, splice, to


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Bytes and tokens of every text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Edge cases: null and empty texts have 0 bytes and 0 tokens; null and repeated ids are kept as they are, one row per input row;
    an empty table gives an empty result; other columns are not read. Texts over ``chunk`` bytes go through count_huge.

    Scale: no shuffle; each task holds one Arrow slice of about 2 MB of text at a time.
    """

    def count(batches):
        enc = encoder(model_path)
        for rows, data, offs in chunks(batches, "text"):
            sizes = np.diff(offs)
            tokens = np.zeros(len(sizes), np.int64)
            short = np.flatnonzero(sizes <= chunk)
            body = data.tobytes()
            tokens[short] = [len(x) for x in enc.ids([body[offs[i] : offs[i + 1]].decode() for i in short])] if len(short) else []
            for i in np.flatnonzero(sizes > chunk):
                tokens[i] = count_huge(enc, body[offs[i] : offs[i + 1]], chunk, overlap)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
