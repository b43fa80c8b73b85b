"""Encoding of a corpus with a byte-level BPE vocabulary.

The vocabulary file holds one ``base64(bytes) rank`` pair a line.  A text is
cut into pre-tokens by the vocabulary's pattern; each pre-token's bytes form a
doubly linked list of symbols, and a priority queue of (merge rank, place)
yields the next merge.  An entry whose symbols have changed since it was
pushed is stale and skipped, so a pre-token of n bytes costs O(n log n), also
one of a million bytes.  Decoding joins the vocabulary's byte strings.

Defined results: a null text and an empty text both have no ids (an empty
list, never null); every other text has at least one.  Strings that look like
special tokens are ordinary text.  Lone surrogates cannot occur in Parquet
text; other unusual characters are encoded by their UTF-8 bytes.  Extra
columns pass through untouched when ``keep`` names them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the split pattern that belongs to the 50k byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers; a full memory is emptied, which changes no result.
REMEMBERED = 200_000


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary package keeps ``name``."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def merge_symbols(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token by repeated merging of the lowest-ranked neighbours."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    text: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue: list[tuple[int, int, int]] = []

    def offer(left: int) -> None:
        right = after[left]
        if right < n:
            rank = ranks.get(text[left] + text[right])
            if rank is not None:
                heapq.heappush(queue, (rank, left, len(text[left]) + len(text[right])))

    for i in range(n - 1):
        offer(i)
    while queue:
        rank, left, size = heapq.heappop(queue)
        if text[left] is None or after[left] >= n:
            continue
        right = after[left]
        if len(text[left]) + len(text[right]) != size or ranks.get(text[left] + text[right]) != rank:
            continue  # stale: one of the two has grown since
        text[left] += text[right]
        text[right] = None
        after[left] = after[right]
        if after[right] < n:
            before[after[right]] = left
        if before[left] >= 0:
            offer(before[left])
        offer(left)
    out, i = [], 0
    while i < n:
        out.append(ranks[text[i]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder of one vocabulary file, given as a path or as its bytes."""

    def __init__(self, vocabulary: str | bytes, pattern: str = SPLIT) -> None:
        import regex

        lines = (vocabulary if isinstance(vocabulary, bytes) else Path(vocabulary).read_bytes()).splitlines()
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(pattern).finditer
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for found in self.split(text):
            piece = found.group()
            ids = known.get(piece)
            if ids is None:
                ids = merge_symbols(piece.encode("utf-8", "surrogatepass"), self.ranks)
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        if not hasattr(self, "strings"):
            self.strings = {rank: token for token, rank in self.ranks.items()}
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[tuple[int, str], ByteBpe] = {}


def _coder(vocabulary: Broadcast, pattern: str) -> ByteBpe:
    """One coder per worker process and vocabulary."""
    key = (hash(vocabulary.value), pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(vocabulary.value, pattern)
    return _LOADED[key]


def _shared(path: str | None) -> Broadcast:
    """The vocabulary file, read on the driver and sent to the workers; it is a fixed file of a megabyte or so."""
    return SparkSession.active().sparkContext.broadcast(Path(path or default_vocabulary()).read_bytes())


def encode_column(text: str | Column, path: str | None = None, pattern: str = SPLIT) -> Column:
    """Column of ids of ``text``; only the driver need be able to read ``path``."""
    vocabulary = _shared(path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(vocabulary, pattern)
        for batch in batches:
            yield batch.map(coder.encode)

    return encode(text)


def decode_column(ids: str | Column, path: str | None = None, pattern: str = SPLIT) -> Column:
    """Column of the texts that ``ids`` stand for; null ids give null."""
    vocabulary = _shared(path)

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(vocabulary, pattern)
        for batch in batches:
            yield batch.map(coder.decode)

    return decode(ids)


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: the document's id and its token ids. No shuffle."""
    return documents.select(F.col(doc_id).alias("doc_id"), encode_column(F.col(text), path).alias("ids"))
