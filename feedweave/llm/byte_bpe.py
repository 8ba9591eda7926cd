"""Byte-level BPE: token ids and character offsets of whole texts, and back.

The vocabulary is a rank file (base64 bytes and rank, a line each). Its merges are derived once a worker: a token's two
parts are what the merges of lower rank make of its bytes. The tokenizers library runs them over the byte-to-character
form (each byte as one printable character); a piece that is itself a token stays whole, as rank tables have it. Texts are
cut by the pattern, and each worker keeps a bounded table of pieces it has met, so the library sees a piece once.

* null text: empty, no token. White space, control characters and characters of several bytes are bytes like any others.
* Offsets count characters (code points): a token that holds part of a character covers it, so offsets of neighbours may
  overlap where a character is split.
* Decoding joins the tokens' bytes. A character split over tokens comes back whole; bytes that are no UTF-8 (a cut id
  list) become U+FFFD in the text and stay as they are in the bytes. A null list, null ids or unknown ids give null.
* Very long texts are taken whole; a batch is worked off in slices of SLICE_BYTES bytes or one text. Rows, repeated
  or not, are independent; other columns never enter Python.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.llm.common import documents

#: Pieces whose ids a worker keeps; the table is emptied beyond that.
PIECES = 1 << 18
SLICE_BYTES = 1 << 21
ENCODED = "ids array<int>, starts array<int>, ends array<int>"
DECODED = "bytes binary, text string, n_split int"


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character of each byte: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in seen else next(hidden)) for b in range(256)]


def two_parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """What the merges of lower rank leave of a token's bytes, leftmost lowest rank first."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            raise ValueError(f"no merges of lower rank make {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        letters = byte_characters()
        shown = {token: "".join(letters[b] for b in token) for token in ranks}
        merges = [tuple(shown[p] for p in two_parts(token, ranks)) for token in sorted(ranks, key=ranks.get) if len(token) > 1]
        self.library = Tokenizer(models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cut = regex.compile(pattern).findall
        # the byte table, reversed: characters of the vocabulary's own tokens back to bytes
        byte_of = {c: b for b, c in enumerate(letters)}
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for text, i in self.library.get_vocab(with_added_tokens=False).items():
            self.tokens[i] = bytes(byte_of[c] for c in text)
        self.sizes = np.array([len(t or b"") for t in self.tokens], np.int64)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > PIECES:
            self.known.clear()
        cut, known = [self.cut(x) for x in texts], self.known
        if new := [*(set(chain.from_iterable(cut)) - known.keys())]:
            known.update(zip(new, (np.array(e.ids, "<i4").tobytes() for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [np.frombuffer(b"".join([known[p] for p in pieces]), "<i4") for pieces in cut]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last."""
        size = self.sizes[ids]
        end = np.cumsum(size)
        char = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80) - 1
        return char[end - size], char[end - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes | None:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            return None
        try:
            return b"".join([self.tokens[i] for i in ids.tolist()])
        except TypeError:  # a free id has no bytes
            return None

    def split_characters(self, ids: np.ndarray, body: bytes) -> int:
        """Characters whose bytes lie in more than one token."""
        starts = np.frombuffer(body, np.uint8) & 0xC0 != 0x80
        ends = np.cumsum(self.sizes[ids])[:-1]
        inside = ends[~starts[ends]]  # token starts within a character
        return len(np.unique(np.cumsum(starts)[inside]))


@cache
def bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts or [np.empty(0)]).astype(np.int32)))


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, SLICE_BYTES or one text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES)))
        yield [x or "" for x in texts.slice(at, to - at).to_pylist()]
        at = to


def encode(text: Column, path: str | None = None, pattern: str | None = None, *, offsets: bool = True) -> Column:
    """Struct of ids, starts and ends of a text column; starts and ends are null where offsets are not asked for."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in ENCODED.split(', '))}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = bpe(path, pattern)
        for batch in batches:
            ids, where = [], []
            for texts in _slices(batch):
                found = coder.encode(texts)
                ids += found
                where += [coder.offsets(x, i) for x, i in zip(texts, found, strict=True)] if offsets else []
            cols = [_lists(ids)]
            if offsets:
                cols += [_lists([a for a, _ in where]), _lists([b for _, b in where])]
            else:
                cols += [pa.nulls(len(ids), pa.list_(pa.int32()))] * 2
            yield pa.StructArray.from_arrays(cols, ["ids", "starts", "ends"])

    return run(text)


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Struct of bytes, text and n_split (characters split over tokens) of a column of id lists."""
    path, pattern = path or rank_file(), pattern or split_pattern()

    @F.arrow_udf(f"struct<{', '.join(c.replace(' ', ':', 1) for c in DECODED.split(', '))}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = bpe(path, pattern)
        for batch in batches:
            bodies, splits = [], []
            for row in batch:
                found = row.values if row.is_valid else None
                number = None if found is None or found.null_count else found.to_numpy(zero_copy_only=False)
                body = None if number is None else coder.decode(number)
                bodies.append(body)
                splits.append(None if body is None else coder.split_characters(number, body))
            texts = [b.decode("utf-8", "replace") if b is not None else None for b in bodies]
            yield pa.StructArray.from_arrays([pa.array(bodies, pa.binary()), pa.array(texts, pa.string()), pa.array(splits, pa.int32())], ["bytes", "text", "n_split"])

    return run(ids)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_split: ids of whole texts and their way back, as hashes, a slice at a time."""
    path, pattern = path or rank_file(), pattern or split_pattern()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        shown = [str(i) for i in range(len(coder.tokens))]
        for b in batches:
            rows = []
            for texts in _slices(b.column(1)):
                for ids in coder.encode(texts):
                    body = coder.decode(ids)
                    listed = " ".join([shown[i] for i in ids.tolist()])
                    rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(body).hexdigest(), coder.split_characters(ids, body)))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
