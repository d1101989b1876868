"""Byte-level BPE by dynamic programming over prefixes.

BPE is compositional: the encoding of a byte string has exactly one possible last token, and what stands before it is
the encoding of the prefix in front of that token. A table with the last token of every prefix therefore holds the
encoding of all prefixes at once. The last token of a prefix is the vocabulary token that ends there and is a valid
neighbour of the last token of the prefix in front of it; two tokens are valid neighbours if encoding their joined
bytes gives back the two.

The table makes appends exact (only new prefixes are computed) and edits local (`PrefixTable.replace`): behind an edit,
as soon as last tokens agree with the old table over the longest token's length, the rest of the old table holds.

Work per piece is linear in its length. In the Spark job a task keeps a memo of the parts between spaces it has seen,
so that the table is only built for new ones; memos are bounded and change no result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import load, query, single_blanks, text_column

#: Entries a memo may hold; later strings are then worked out each time. Frequent ones come early.
MEMO = 250_000
#: Up to this many bytes a piece's table is filled from the back, and strings go to the memos.
SHORT = 48
NONE = -1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file's content: base64 and number on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    """Ranks of byte tokens, with how each token is merged from two and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {n: b for b, n in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._pairs: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is None or right is None or left >= rank or right >= rank:
                    continue
                # Ranks below this one are all known here: the two halves are what BPE makes of the token before its
                # own merge exactly if they are valid neighbours so far.
                if self._reachable(left) and self._reachable(right) and self._valid(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        #: Tokens that BPE can end up with; others occur only as whole pieces.
        self.usable = {b: n for b, n in ranks.items() if self._reachable(n)}

    def _reachable(self, token: int) -> bool:
        return token in self.parts or len(self.bytes_of[token]) == 1

    def _valid(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two tokens alone.

        Both tokens are taken apart again in reverse order of their merges. At each step the tokens that face each
        other at the border are those present just before the later merge; had their own merge come first, BPE would
        have crossed the border.
        """
        parts, merged = self.parts, self.merged
        a, b, before = left, right, len(self.bytes_of) + (1 << 40)
        while True:
            joined = merged.get((a, b))
            if joined is not None and joined < before:
                return False
            a_from, b_from = parts.get(a), parts.get(b)
            if a_from is None and b_from is None:
                return True
            # Of equal merges on both sides the left one came first, so the right one is undone first.
            if b_from is None or (a_from is not None and a > b):
                before, a = a, a_from[1]
            else:
                before, b = b + 1, b_from[0]

    def forget(self) -> None:
        self._pairs.clear()

    def _remember(self, left: int, right: int) -> bool:
        valid = self._valid(left, right)
        if len(self._pairs) < MEMO:
            self._pairs[left << 32 | right] = valid
        return valid

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Append the last tokens of the prefixes of `data` up to length `stop` to those known; last[0] is the empty prefix."""
        get, longest, pairs = self.usable.get, self.longest, self._pairs
        for end in range(len(last), stop + 1):
            found = NONE
            for begin in range(end - longest if end > longest else 0, end):
                token = get(data[begin:end])
                if token is None:
                    continue
                if begin:
                    left = last[begin]
                    if left == NONE:
                        continue
                    valid = pairs.get(left << 32 | token)
                    if valid is None:
                        valid = self._remember(left, token)
                    if not valid:
                        continue
                found = token
                break
            last.append(found)

    def last_token(self, data: bytes, end: int, known: dict[int, int]) -> int:
        """The same table filled from the back: only prefixes that are asked for are computed. For short strings."""
        get, longest, pairs = self.usable.get, self.longest, self._pairs
        for begin in range(end - longest if end > longest else 0, end):
            token = get(data[begin:end])
            if token is None:
                continue
            if begin:
                left = known.get(begin)
                if left is None:
                    left = self.last_token(data, begin, known)
                if left == NONE:
                    continue
                valid = pairs.get(left << 32 | token)
                if valid is None:
                    valid = self._remember(left, token)
                if not valid:
                    continue
            known[end] = token
            return token
        known[end] = NONE
        return NONE

    def split(self, data: bytes, last: dict[int, int] | list[int]) -> list[int]:
        """The encoding that a table of last tokens, by length of prefix, holds."""
        out, at, bytes_of = [], len(data), self.bytes_of
        while at:
            token = last[at]
            out.append(token)
            at -= len(bytes_of[token])
        out.reverse()
        return out


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [NONE]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; what is known of its prefixes stays."""
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put `new` for the bytes [start, end); returns how many prefixes had to be computed anew."""
        old_size, old_last, longest = len(self.data), self.last, self.vocabulary.longest
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[: start + 1]
        edited, shift, agreed = start + len(new), start + len(new) - end, 0
        self.vocabulary.extend(self.data, self.last, edited)
        for at in range(end, old_size):
            self.vocabulary.extend(self.data, self.last, at + shift + 1)
            # A last token looks back no further than the longest token.
            agreed = agreed + 1 if self.last[-1] == old_last[at + 1] else 0
            if agreed >= longest:
                computed = len(self.last) - 1 - start
                self.last.extend(old_last[at + 2 :])
                return computed
        return len(self.last) - 1 - start

    def tokens(self) -> list[int]:
        """The encoding of the whole string."""
        return self.vocabulary.split(self.data, self.last)


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """One match of the split pattern. A piece that is itself a token is that token."""
    token = vocabulary.ranks.get(piece)
    if token is not None:
        return [token]
    if len(piece) > SHORT:
        return PrefixTable(vocabulary, piece).tokens()
    known: dict[int, int] = {0: NONE}
    vocabulary.last_token(piece, len(piece), known)
    return vocabulary.split(piece, known)


#: The pattern for which texts may be cut in front of single spaces: a fixed value.
CUTTING = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Whole texts: split by the pattern, every match encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.cuts = pattern == CUTTING
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}
        self.decimal = {token: str(token) for token in self.vocabulary.bytes_of}

    def encode(self, text: str) -> list[int]:
        pieces, out = self.pieces, []
        for piece in self.pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = encode_piece(self.vocabulary, piece.encode())
                if len(piece) < SHORT and len(pieces) < MEMO:
                    pieces[piece] = ids
            out += ids
        return out

    def forget(self) -> None:
        """Empty the memos: an idle worker process should not hold them."""
        self.parts.clear()
        self.pieces.clear()
        self.vocabulary.forget()

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def _packed(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode_parts(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers.

        No match of CUTTING runs across the front of a single space, so with that pattern a text whose white space is
        single spaces and line feeds can be cut there and each part looked up. Other texts are split as a whole.
        """
        if not text:
            return b""
        if not self.cuts or not single_blanks(text):
            return self._packed(text)
        parts = self.parts
        first, *rest = text.split(" ")
        found = [self._packed(first)]
        for part in rest:
            ids = parts.get(part)
            if ids is None:
                ids = self._packed(" " + part)
                if len(part) < SHORT and len(parts) < MEMO:
                    parts[part] = ids
            found.append(ids)
        return b"".join(found)


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks: dict[bytes, int], key: tuple[int, str]) -> Encoder:
    # Kept for the life of the worker process: building takes a second.
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, key[1])
    return _ENCODERS[key]


DIGEST = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
IDS = "id bigint, n_tokens bigint, ids array<int>"


def _job(broadcast, key: tuple[int, str], schema: str, describe):
    import numpy as np

    arrow = T.StructType.fromDDL(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(arrow)
        encoder = _encoder(broadcast.value, key)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(encoder.encode_parts(text.as_py()), "<i4")
                rows.append((doc.as_py(), *describe(encoder, ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
        encoder.forget()

    return work


def _digests(encoder: Encoder, ids) -> tuple:
    listed = ids.tolist()
    decimal = ",".join(map(encoder.decimal.__getitem__, listed))
    decoded = encoder.decode(listed)
    return len(listed), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def _lists(encoder: Encoder, ids) -> tuple:
    return len(ids), ids


def _run(docs: DataFrame, ranks: dict[bytes, int], pattern: str, schema: str, describe, id_col: str, text_col: str) -> DataFrame:
    broadcast = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size is fixed by the file
    key = (hash(frozenset(ranks.items())), pattern)
    return text_column(docs, id_col, text_col).mapInArrow(_job(broadcast, key, schema, describe), schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text: doc_id, n_tokens, ids.

    * Null and empty texts have no ids. Every row is encoded by itself: repeated rows and null ids come through.
    * Special tokens are never made; their strings are ordinary text.
    * Other columns are not read. An empty table gives an empty result.
    """
    return _run(docs, ranks, pattern, IDS, _lists, id_col, text_col).withColumnRenamed("id", "doc_id")


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like `encode`, with digests of the ids and of the bytes decoded from them in place of the ids."""
    return _run(docs, ranks, pattern, DIGEST, _digests, id_col, text_col).withColumnRenamed("id", "doc_id")


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds `decoded`: the bytes that the ids stand for; null ids give null."""
    spark = tokens.sparkSession
    rows = [(n, b) for b, n in ranks.items()]
    table = spark.createDataFrame(rows, "token int, bytes binary")
    listed = tokens.withColumn("__row", F.monotonically_increasing_id())
    parts = listed.select("__row", F.posexplode(ids_col).alias("at", "token")).join(F.broadcast(table), "token")
    texts = parts.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), ""))
    out = listed.join(texts.select("__row", joined.alias("decoded")), "__row", "left").drop("__row")
    empty = F.col(ids_col).isNotNull() & F.col("decoded").isNull()
    return out.withColumn("decoded", F.when(empty, F.unhex(F.lit(""))).otherwise(F.col("decoded")))


def ranks_of(spark: SparkSession, path: str | None = None) -> dict[bytes, int]:
    """A rank file; by default the many-language one of the public tokenizers package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        return read_ranks(file.read())


def encode_stage(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ids of every document, with the production vocabulary.

    Null and empty texts have no ids. Every row has a row, also repeated ones and those without doc_id; other columns are
    not read. An empty table gives an empty result.
    """
    import public_tokenizers

    return encode(docs, ranks_of(docs.sparkSession), public_tokenizers.PATTERN)


@query("op2_prefix_bpe")
def _op2(spark, sf_dir):
    import public_tokenizers

    return encode_digests(load(spark, sf_dir, "documents"), ranks_of(spark), public_tokenizers.PATTERN)
