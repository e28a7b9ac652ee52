"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each byte becomes one printable character, each vocabulary entry a piece scored by its negative
rank; normalisation is the identity. Pre-tokens (matches of the pattern) are encoded one by one.
Null text counts as empty: no ids. Any text, whatever its length, is encoded whole; bytes that are no UTF-8 are read as
U+FFFD. Null ids are rows like others; repeated rows stay repeated; columns besides id and text do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import _power_tables, chunks, mix, valid

#: Pre-tokens whose ids a worker remembers; the memory is emptied beyond it.
MEMO = 300_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    entries = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in entries] != list(range(len(entries))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [token for _, token in entries]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
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


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto of type BPE with the tokens as pieces 0, 1, ... and an unknown piece last."""
    letters = byte_letters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += _field(41, -1) + _field(42, -1) + _field(43, -1)
    out += _field(2, trainer)
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


#: The one pattern that is also known as rules over character classes, for speed; any other is run by the regex library.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE = range(5)


@functools.lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and random 64-bit value of each code point."""
    text = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            out[m.start() : m.end()] = kind
    out[32] = _SPACE
    return out, mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def split_points(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the matches of KNOWN start in texts laid end to end; rows: where each non-empty text starts."""
    kind = _classes()[0][codes]
    n = len(kind)
    head = np.zeros(n + 1, dtype=bool)
    head[rows] = True
    head[n] = True
    blank = kind >= _BLANK
    start = head[:n].copy()
    start[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & ~blank[1:]
    start[1:] |= blank[1:] & ~blank[:-1]
    start[:-1] |= blank[:-1] & ~blank[1:] & ~head[1:-1]
    quote = np.flatnonzero((codes == 39) & start)
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        at = quote[quote + len(ending) < n]
        for k, c in enumerate(ending, 1):
            at = at[(codes[at + k] == ord(c)) & ~head[at + k]]
        start[at + 1] = False
        after = at + len(ending) + 1
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.letters = dict(enumerate(byte_letters()))
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.find = None if pattern == KNOWN else regex.compile(pattern).finditer
        self.memo: dict[int, np.ndarray] = {}
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _ids(self, hashes: list[int], pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        known = [self.whole.get(b, -1) for b in raw]
        for h, i in zip(hashes, known, strict=True):
            if i >= 0:
                self.memo[h] = np.array([i], dtype=np.uint32)
        spelt = [j for j, i in enumerate(known) if i < 0]
        letters = [raw[j].decode("latin-1").translate(self.letters) for j in spelt]
        for j, ids in zip(spelt, self.model.encode(letters, num_threads=1), strict=True):
            self.memo[hashes[j]] = np.array(ids, dtype=np.uint32)

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end as UTF-8, and the offsets of each text's ids."""
        text = data.tobytes().decode()
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        if self.find is None:
            first = split_points(codes, at[:-1][at[:-1] < at[1:]])
            last = np.append(first[1:], len(codes))
        else:
            spans = [(a + m.start(), a + m.end()) for a, b in zip(at, at[1:], strict=False) for m in self.find(text[a:b])]
            first, last = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        power, inverse = _power_tables(len(codes))
        values = _classes()[1][codes] * power
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        hashes = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
        unique, where, inverse_of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.memo) > MEMO:
            self.memo.clear()
        keys = unique.tolist()
        new = [k for k, h in enumerate(keys) if h not in self.memo]
        self._ids([keys[k] for k in new], [text[first[where[k]] : last[where[k]]] for k in new])
        found = list(map(self.memo.__getitem__, keys))
        count = np.fromiter(map(len, found), np.int64, len(found))
        ids = _gather(np.concatenate(found), np.cumsum(count) - count, count, inverse_of)
        ends = np.concatenate(([0], np.cumsum(count[inverse_of])))
        return ids, ends[np.searchsorted(first, at)]

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the offset of each id's bytes."""
        return _gather(self.bytes, self.starts, self.lengths, ids), np.concatenate(([0], np.cumsum(self.lengths[ids])))

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_all(np.array(list(ids), dtype=np.int64))[0].tobytes()


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches flat[starts[i] : starts[i] + lengths[i]] for each i of which, end to end."""
    n = lengths[which]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[which] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]


@functools.lru_cache(maxsize=2)
def _codec(vocabulary: bytes, pattern: str) -> Codec:
    tokens = [base64.b64decode(line) for line in vocabulary.split(b"\n")]
    return Codec(serialise(tokens), tokens, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row of docs, repeated rows included."""
    vocabulary = b"\n".join(base64.b64encode(t) for t in read_ranks(path))  # bounded by the vocabulary
    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, pattern)
        for batch in batches:
            for at, end, data, offsets in chunks(batch.column(1)):
                ids, cuts = codec.encode_all(data, offsets)
                back, places = codec.decode_all(ids)
                raw, decoded = ids.astype("<u4").tobytes(), back.tobytes()
                tokens = [raw[4 * a : 4 * b] for a, b in pairwise(cuts.tolist())]
                columns = [batch.column(0).slice(at, end - at), pa.array(np.diff(cuts), pa.int64())]
                columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in tokens]))
                columns.append(pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in pairwise(places[cuts].tolist())]))
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(tokens, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_column, valid(text_column)).mapInArrow(run, schema + (", ids binary" if with_ids else ""))
