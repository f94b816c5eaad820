"""Byte-level BPE encoding and decoding through a sentencepiece model serialised from a rank file.

Every byte is mapped to one printable character, so a rank file's byte strings become sentencepiece pieces; a piece's
score is its negative rank, so the best-scored merge is the lowest-ranked one. The normaliser is the identity.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import arrow_map, slices

CACHE = 250_000
UNKNOWN = "⁇"


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks aren't 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose piece i is tokens[i], byte-mapped, with score -i; the unknown piece comes last."""
    # Field numbers and enumerators of the public sentencepiece model format.
    pieces_field, trainer_field, normalizer_field = 1, 2, 3
    piece_text, piece_score, piece_type = 1, 2, 3
    type_unknown, model_type, model_bpe = 2, 3, 2
    unk_id, bos_id, eos_id, pad_id = 40, 41, 42, 43
    norm_name, add_dummy_prefix, remove_extra_spaces, escape_spaces = 1, 3, 4, 5

    letters = byte_letters()
    out = [_field(pieces_field, _field(piece_text, "".join(letters[b] for b in t).encode()) + _field(piece_score, float(-i))) for i, t in enumerate(tokens)]
    out.append(_field(pieces_field, _field(piece_text, UNKNOWN.encode()) + _field(piece_score, 0.0) + _field(piece_type, type_unknown)))
    none = (1 << 64) - 1  # -1 as a varint
    trainer = _field(model_type, model_bpe) + _field(unk_id, len(tokens)) + _field(bos_id, none) + _field(eos_id, none) + _field(pad_id, none)
    normalizer = _field(norm_name, b"identity") + _field(add_dummy_prefix, 0) + _field(remove_extra_spaces, 0) + _field(escape_spaces, 0)
    return b"".join([*out, _field(trainer_field, trainer), _field(normalizer_field, normalizer)])


class ByteBpe:
    """Encoder and decoder of one rank file; pre-tokens met often are encoded once."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        if missing := [b for b in range(256) if bytes([b]) not in self.whole]:
            raise ValueError(f"{path}: no token for the bytes {missing}")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.split = regex.compile(pattern).findall
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.seen: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: list[str]) -> None:
        rest = []
        for w in words:
            if (i := self.whole.get(w.encode("utf-8"))) is not None:  # a token in itself needs no merges
                self.seen[w] = (i,)
            else:
                rest.append(w)
        mapped = [w.encode("utf-8").decode("latin-1").translate(self.letters) for w in rest]
        for w, ids in zip(rest, self.model.encode(mapped, num_threads=1)):
            self.seen[w] = tuple(ids)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """Each text's ids; texts' unknown pre-tokens go to the model together, some 256 KB of text at a time."""
        for i, j in slices([len(t) for t in texts], 1 << 18):
            split = [self.split(t) for t in texts[i:j]]
            new = {w for words in split for w in words if w not in self.seen}
            if len(self.seen) + len(new) > CACHE:
                self.seen.clear()
                new = {w for words in split for w in words}
            if new:
                self._learn(list(new))
            for words in split:
                yield list(chain.from_iterable(map(self.seen.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: list[int]) -> bytes:
        """The ids' byte strings, one after another."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def _coder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: each whole text's token ids.

    Each match of pattern is encoded separately, without special tokens. Null text: as empty, no ids. One row per row,
    repeated and null ids included; other columns are ignored.
    """
    pattern, kind = pattern or _default_pattern(), docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, texts = _coder(path, pattern), batch.column(1).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(coder.encode_batch(texts)), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")), run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes binary of a table of doc_id, ids; null ids: no bytes. An id outside the vocabulary fails."""
    pattern, kind = pattern or _default_pattern(), encoded.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(path, pattern)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256, n_bytes (decoded), whole; with keep_ids also ids.

    Encodes and decodes in one pass; what is decoded, and without keep_ids the ids, stay in the Python worker. whole: the decoded
    bytes are the text's. Rules for nulls and repeated rows as in encode_texts().
    """
    pattern, kind = pattern or _default_pattern(), docs.schema[id_col].dataType.simpleString()

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "whole"] + ["ids"] * keep_ids

    def run(batches):
        coder = _coder(path, pattern)
        for batch in batches:
            for i, j in slices(pa.compute.binary_length(batch.column(1)).to_pylist(), 4 << 20):
                texts, rows = batch.column(1).slice(i, j - i).to_pylist(), []
                for t, ids in zip(texts, coder.encode_batch(texts)):
                    back = coder.decode(ids)
                    named = ",".join(map(coder.digits.__getitem__, ids)).encode()
                    row = (len(ids), hashlib.sha256(named).hexdigest(), hashlib.sha256(back).hexdigest(), len(back), back == t.encode("utf-8"))
                    rows.append((*row, np.array(ids, np.int32)) if keep_ids else row)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *arrays], names)

    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, whole boolean" + ", ids array<int>" * keep_ids)
