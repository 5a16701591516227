"""Byte-pair encoding of a whole corpus with a public vocabulary.

A text is cut into words by the vocabulary's own pattern and each word's bytes are merged by rank. The merges of one word
are driven by a segment tree over the ranks of its adjacent pairs: a leaf holds ``rank * length + position`` of the pair
that starts there, an inner node the lesser of its children, so that the root is the leftmost pair of the lowest rank. A
merge changes three leaves, each in logarithmic time, until no pair at the root can be merged; a word of a million bytes
takes n log n steps.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from knotwork.llm.common import TOKENIZERS, spread

# Fixed value: the published word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a worker's memory; when there are more, the worker starts anew. It bounds memory and changes no result.
KEPT_WORDS = 200_000
#: Longer words aren't kept.
KEPT_BYTES = 64


class Encoder(dict):
    """word -> its ids. A word that was met before is looked up."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.words = regex.compile(WORDS)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(self.merge(raw))
        if len(raw) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def rank(self, left: int, right: int) -> int:
        """Rank of the merged pair, -1 if the vocabulary hasn't it. The rank is also the merged token's id."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            found = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            if len(self.pairs) >= KEPT_WORDS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        n = len(raw)
        ids = [self.ranks[raw[i : i + 1]] for i in range(n)]
        if n < 2:
            return ids
        rank = self.rank
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        size = 1 << (n - 1).bit_length()
        never = 1 << 62
        tree = [never] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i], ids[i + 1])
            if r >= 0:
                tree[size + i] = r * n + i
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            if tree[node] == value:
                return
            tree[node] = value
            node >>= 1
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left <= right else right
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] != never:
            merged, i = divmod(tree[1], n)
            gone = after[i]
            ids[i] = merged
            after[i] = following = after[gone]
            put(gone, never)
            ids[gone] = -1
            if following < n:
                before[following] = i
                r = rank(merged, ids[following])
                put(i, r * n + i if r >= 0 else never)
            else:
                put(i, never)
            if (left := before[i]) >= 0:
                r = rank(ids[left], merged)
                put(left, r * n + left if r >= 0 else never)
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> array:
        """Ids of a text; of NULL and of the empty text an empty list. Special tokens' strings are ordinary text."""
        if not text:
            return array("i")
        return array("i", chain.from_iterable(map(self.__getitem__, self.words.findall(text))))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The worker's encoder of a vocabulary file, read once."""
    path = f"{folder.rstrip('/')}/{vocabulary}.tiktoken"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batches(batches: Iterator[pa.RecordBatch], text: str, out: str, count: bool, vocabulary: str, folder: str) -> Iterator[pa.RecordBatch]:
    one = encoder(vocabulary, folder)
    for batch in batches:
        flat, ends = array("i"), [0]
        for value in batch.column(batch.schema.get_field_index(text)):
            ids = one.encode(value.as_py())
            if not count:
                flat.extend(ids)
            ends.append(ends[-1] + len(ids))
        offsets = np.asarray(ends)
        column = (
            pa.array(np.diff(offsets).astype("int64"))
            if count
            else pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(np.frombuffer(flat, "int32") if flat else np.empty(0, "int32")))
        )
        fields = [i for i, name in enumerate(batch.schema.names) if name not in (text, out)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in fields), column], names=[*(batch.schema.names[i] for i in fields), out])


def _mapped(df: DataFrame, text: str, out: str, count: bool, vocabulary: str, folder: str) -> DataFrame:
    kind = T.LongType() if count else T.ArrayType(T.IntegerType())
    schema = T.StructType([f for f in df.schema.fields if f.name not in (text, out)] + [T.StructField(out, kind)])
    return spread(df).mapInArrow(lambda batches: _batches(batches, text, out, count, vocabulary, folder), schema)


def encode_texts(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with ``text`` replaced by ``out``, the list of its token ids.

    NULL and empty texts get an empty list. Each row is encoded by itself, equal rows alike; an empty table gives an
    empty table. A column already named ``out`` is replaced. One pass over the texts, no shuffle (a table of fewer
    partitions than cores is spread once).
    """
    return _mapped(df, text, out, False, vocabulary, folder)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """As ``encode_texts``, with the number of ids in place of the ids: 0 for NULL and empty texts."""
    return _mapped(df, text, out, True, vocabulary, folder)
