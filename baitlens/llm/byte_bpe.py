"""Byte-level BPE encoding and decoding over Arrow batches.

The rank file becomes a model of the tokenizers library: each byte has a printable character, a token is the string of
its bytes' characters, and every split of a token into two tokens is a merge, in the order of the ranks. Texts are cut
by the pattern; each distinct chunk (a word with what is around it) is encoded once and remembered while memory allows. Decoding maps
characters back to bytes; a character split over tokens is whole again once its bytes are joined.

Defined results: a null or empty text has no ids; long texts are encoded whole; ties between merges are broken by rank,
then leftmost; repeated rows give equal rows; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, fresh

#: Chunks remembered by a worker, and the longest that is worth it; longer ones are encoded each time.
REMEMBERED, LONGEST = 1_000_000, 64
#: Characters that are encoded in one go.
GROUP = 1 << 20
_SPACES = re.compile(r"\s | \s|^ | $").search


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it has one, else the next one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return [others.get(b, chr(b)) for b in range(256)]


class ByteBpe:
    """A vocabulary of ranked byte strings, as the tokenizers library runs it."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.characters = byte_characters()
        word = {token: "".join(self.characters[b] for b in token) for token in ranks}
        merges = sorted(
            (rank, ranks[token[:i]], ranks[token[i:]], word[token[:i]], word[token[i:]])
            for token, rank in ranks.items() for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks)
        model = models.BPE(vocab={word[t]: r for t, r in ranks.items()}, merges=[m[3:] for m in merges],
                           ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces = regex.compile(pattern).findall
        byte = {c: b for b, c in enumerate(self.characters)}
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = bytes(byte[c] for c in word[token])
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.digits = [str(i) for i in range(len(self.bytes))]
        #: ids of a chunk that follows a space, by the chunk without it
        self.known: dict[str, bytes] = {}

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids as the bytes of 32-bit integers; their distinct pieces go to the library in one call."""
        cut = [self.pieces(c) for c in chunks]
        pieces = list(set(chain.from_iterable(cut)))
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(found.ids, np.int32).tobytes()
        ends = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(pieces)), "right")).tolist()
        ids = {p: raw[a:b] for p, a, b in zip(pieces, [0, *ends], ends, strict=False)}
        return [b"".join(map(ids.__getitem__, x)) for x in cut]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Texts are cut at spaces that stand alone between two other characters: no piece spans such a place."""
        out, group, size = [], [], 0
        for i, text in enumerate(texts):
            group.append([text] if _SPACES(text) else text.split(" "))
            size += len(text)
            if size >= GROUP or i == len(texts) - 1:
                out += self._encode_group(group)
                group, size = [], 0
        return out

    def _encode_group(self, group: list[list[str]]) -> list[np.ndarray]:
        heads = self._encode_chunks([chunks.pop(0) for chunks in group])
        new = list(set(chain.from_iterable(group)).difference(self.known))
        found = dict(zip(new, self._encode_chunks([" " + c for c in new]), strict=True))
        short = {c: ids for c, ids in found.items() if len(c) <= LONGEST}
        if len(self.known) + len(short) > REMEMBERED:
            used = set(chain.from_iterable(group))
            self.known = {c: ids for c, ids in self.known.items() if c in used}
        self.known.update(short)
        table = self.known if len(short) == len(found) else self.known | found
        return [np.frombuffer(head + b"".join(map(table.__getitem__, chunks)), np.int32)
                for head, chunks in zip(heads, group, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str, ids) -> tuple[list[int], list[int]]:
        """First and last character (exclusive) of each id; ids that share a character both span it."""
        after = np.cumsum(self.lengths[np.asarray(ids, np.int64)])
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80)
        return (character[np.concatenate([[0], after[:-1]]).astype(np.int64)] - 1).tolist() if len(after) else [], (
            character[after - 1]).tolist()


@lru_cache(maxsize=4)
def bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """``array<int>`` of the text's ids."""

    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        model = bpe(path, pattern)
        return pd.Series(model.encode_many([x or "" for x in texts]), dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that the ids stand for; a null array has none."""

    @pandas_udf("binary")
    def back(arrays: pd.Series) -> pd.Series:
        model = bpe(path, pattern)
        return pd.Series([model.decode_bytes([] if x is None else x.tolist()) for x in arrays], dtype=object)

    return back(ids)


def token_offsets(text: Column, ids: Column, path: str, pattern: str) -> Column:
    """``struct<starts, ends>``: the characters that each id spans."""

    @pandas_udf("starts array<int>, ends array<int>")
    def spans(texts: pd.Series, arrays: pd.Series) -> pd.DataFrame:
        model = bpe(path, pattern)
        rows = [model.offsets(t or "", [] if a is None else a) for t, a in zip(texts, arrays, strict=True)]
        return pd.DataFrame({"starts": [r[0] for r in rows], "ends": [r[1] for r in rows]})

    return spans(F.coalesce(text, F.lit("")), ids)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """The frame with ``ids`` and, if asked for, ``token_offsets`` (renamed where it has such columns)."""
    bounded_batches(docs.sparkSession)
    name = fresh(docs, "ids")
    out = docs.withColumn(name, encoded(F.col(f"`{text}`"), path, pattern))
    if offsets:
        out = out.withColumn(fresh(docs, "token_offsets"),
                             token_offsets(F.col(f"`{text}`"), F.col(name), path, pattern))
    return out


def digests(ids: Column, path: str, pattern: str) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>`` of ids and of the bytes they decode to."""

    @pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(arrays: pd.Series) -> pd.DataFrame:
        model = bpe(path, pattern)
        rows = []
        for x in arrays:
            x = x.tolist()
            rows.append((len(x), hashlib.sha256(",".join(map(model.digits.__getitem__, x)).encode()).hexdigest(),
                         hashlib.sha256(model.decode_bytes(x)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(ids)


def token_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its id, the number of ids, and the digests of the ids and of the decoded bytes."""
    bounded_batches(docs.sparkSession)
    found = digests(encoded(F.col(f"`{text}`"), path, pattern), path, pattern)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), found.alias("_d")).select("doc_id", "_d.*")
