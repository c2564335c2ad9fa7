"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised here, by the model's own compiled character map: at each
place the longest key of the map that starts there gives way to its
replacement, and each byte that is made remembers the byte of the source it
came from. What comes out is cut before each run of space symbols (no piece
of such a vocabulary reaches across), the fragments become pieces, and the
pieces' ends are carried back through the remembered places: each piece has
the span of bytes of the original text that it stands for.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestry.llm.common import Batches, Memo, mapped, texts_of

SPACE = "▁"
WIDTH = len(SPACE.encode())
#: Fragments that a worker remembers (see Memo).
REMEMBERED = 300_000
#: Characters of a text that are cut into fragments at once.
BLOCK = 1 << 20
FRAGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CUT = re.compile(f"[^{SPACE}]{SPACE}")

# Fixed values of the model file's format: numbers of fields, and types of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, PIECE_TYPE = 1, 3
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
SUFFIX_SPACE, BYTE_FALLBACK, UNKNOWN_SURFACE = 24, 35, 44
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
        if b < 128:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """The fields of a protobuf message: number, value, and the bytes of the field as they stand."""
    at = 0
    while at < len(data):
        start = at
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value, data[start:at]


def _field(number: int, value: int | bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 keys, and the replacements they lead to."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.replacements = b""
        self.first = frozenset()
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.replacements = blob[4 + size :]
            self.first = frozenset(b for b in range(1, 256) if self._step(self._below(0, 0), b) is not None)

    def _below(self, unit_at: int, node: int) -> int:
        unit = self.units[unit_at]
        return node ^ (unit >> 10) << ((unit & 1 << 9) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        """The place of the unit that a byte leads to."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & (1 << 31 | 0xFF) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """The length of the longest key at a place of data, and its replacement; length 0 without one."""
        best, value, node = 0, 0, self._below(0, 0)
        for i in range(at, len(data)):
            unit_at = self._step(node, data[i])
            if unit_at is None:
                break
            node = self._below(unit_at, unit_at)
            if self.units[unit_at] >> 8 & 1:
                best, value = i + 1 - at, self.units[node] & (1 << 31) - 1
        return (best, self.replacements[value : self.replacements.index(b"\0", value)]) if best else (0, b"")


@dataclass
class Normaliser:
    """Texts to what the pieces are made of, with the source of each byte."""

    characters: CharacterMap
    dummy_prefix: bool = True
    remove_extra: bool = True
    suffix: bool = False
    space: bytes = field(default=SPACE.encode())

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text; for each of its bytes, and for its end, the byte of the source where what it came from starts."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int32)
        return self._mapped(data) if self.characters.units or self.remove_extra or self.suffix else self._copied(text, data)

    def _copied(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """Without a map a text is copied but for its spaces: all of it at once."""
        source = np.frombuffer(data, np.uint8)
        starts = np.arange(len(data), dtype=np.int32)
        if not text.isascii():  # each byte of a character comes from where the character starts
            starts = np.maximum.accumulate(np.where(source & 0xC0 == 0x80, np.int32(0), starts))
        widths = np.where(source == 0x20, WIDTH, 1)
        lead = WIDTH if self.dummy_prefix else 0
        at = np.concatenate([np.zeros(lead, np.int32), np.repeat(starts, widths), np.array([len(data)], np.int32)])
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), at

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        if data[at] in self.characters.first:
            size, replacement = self.characters.longest(data, at)
            if size:
                return replacement, size
        size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at : at + size], size

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        out, source, at = bytearray(), [], 0
        if self.remove_extra:
            while at < len(data):
                made, size = self._prefix(data, at)
                if made != b" ":
                    break
                at += size
            if at == len(data):
                return "", np.array([at], np.int32)
        if self.dummy_prefix and not self.suffix:
            out += self.space
            source += [at] * WIDTH
        after_space = self.remove_extra
        while at < len(data):
            made, size = self._prefix(data, at)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                wide = made.replace(b" ", self.space)
                out += wide
                source += [at] * len(wide)
                after_space = self.remove_extra and made.endswith(b" ")
            at += size
        if self.remove_extra:
            while out.endswith(self.space):
                at = source[-WIDTH]
                del out[-WIDTH:], source[-WIDTH:]
        if self.dummy_prefix and self.suffix:
            out += self.space
            source += [at] * WIDTH
        return out.decode(), np.array([*source, at], np.int32)


codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceModel(Memo):
    """A model: fragment of normalised text -> its ids, as bytes of 32-bit integers."""

    def __init__(self, model: bytes):
        super().__init__(REMEMBERED)
        parts = [(number, value, raw) for number, value, raw in message(model)]
        trainer = {n: v for number, value, _ in parts if number == TRAINER for n, v, _ in message(value)}
        rules = {n: v for number, value, _ in parts if number == NORMALIZER for n, v, _ in message(value)}
        pieces = [{n: v for n, v, _ in message(value)} for number, value, _ in parts if number == PIECES]
        kinds = [p.get(PIECE_TYPE, NORMAL) for p in pieces]
        if not trainer.get(BYTE_FALLBACK) or USER_DEFINED in kinds or not rules.get(ESCAPE, 1):
            raise ValueError("the model needs byte pieces, visible spaces, and no symbols of a user's own")
        self.normalise = Normaliser(CharacterMap(rules.get(CHARACTER_MAP, b"")), bool(rules.get(DUMMY_PREFIX, 1)), bool(rules.get(REMOVE_EXTRA, 1)), bool(trainer.get(SUFFIX_SPACE, 0)))
        names = [p.get(PIECE, b"") for p in pieces]
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        #: Whether texts can be cut before spaces.
        self.cuts = not any(k == NORMAL and crossing.search(n.decode()) for k, n in zip(kinds, names))
        # What merges the fragments is the library with a normaliser that changes nothing, as they are normalised.
        plain = _field(DUMMY_PREFIX, 0) + _field(REMOVE_EXTRA, 0) + _field(ESCAPE, 0)
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=b"".join(raw for number, _, raw in parts if number != NORMALIZER) + _field(NORMALIZER, _field(1, b"identity") + plain))
        self.end = self.merger.eos_id()
        unknown = trainer.get(UNKNOWN_SURFACE, " ⁇ ".encode())
        #: For each id: bytes of the normalised text, what it decodes to (the space symbol stays), its number as text.
        self.widths = np.array([0 if k in (CONTROL, UNKNOWN) else 1 if k == BYTE else len(n) for k, n in zip(kinds, names)], np.int64)
        self.written = [b"" if k == CONTROL else unknown if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE else n for k, n in zip(kinds, names)]
        self.decimal = [str(i) for i in range(len(names))]

    def compute(self, key: str) -> bytes:
        return np.array(self.merger.encode(key), np.int32).tobytes()

    def fragments(self, text: str) -> Iterator[list[str]]:
        """A normalised text's fragments, block by block."""
        at = 0
        while self.cuts and len(text) - at > BLOCK:
            cut = CUT.search(text, at + BLOCK)
            if not cut:
                break
            yield FRAGMENT.findall(text[at : cut.start() + 1])
            at = cut.start() + 1
        yield FRAGMENT.findall(text[at:]) if self.cuts else [text[at:]] if at < len(text) else []

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a text with an end id, and the first byte and the byte after the last of what each stands for.

        The bytes of a character that has no piece share its span: the last
        one has it, those before are empty at its start. The end id is empty
        at the text's end.
        """
        normal, source = self.normalise(text)
        made = b"".join([b"".join([self[f] for f in block]) for block in self.fragments(normal)])
        ids = np.concatenate([np.frombuffer(made, np.int32), np.array([self.end], np.int32)])
        ends = np.cumsum(self.widths[ids])
        if ends[-1] != len(source) - 1:
            raise ValueError("the pieces don't add up to the text")
        at = source[np.concatenate([[0], ends])]
        at[-1] = at[-2] = source[-1]
        return ids, at[:-1], at[1:]

    def decode(self, ids: list[int]) -> str:
        """The library's decode(): pieces as text without the space before the first; bytes that are no character are each U+FFFD."""
        out = b"".join([self.written[i] for i in ids])
        rules, space = self.normalise, SPACE.encode()
        if rules.dummy_prefix and not rules.suffix or rules.remove_extra:
            while out.startswith(space):
                out = out[WIDTH:]
                if not rules.remove_extra:
                    break
        return out.decode("utf-8", "each_byte").replace(SPACE, " ")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model, once for each worker process."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's kept columns with ids, begins and ends (array<int>; spans in bytes of the text as UTF-8) and decoded (string).

    A null text is the empty text: it has the end id alone. Texts are encoded
    whole, whatever their length, repeated rows alike, and an empty table
    gives an empty table. Columns other than those kept don't appear, so none
    clashes.
    """
    kept = [docs.schema[c] for c in keep]
    lists = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "begins", "ends")]
    schema = T.StructType([*kept, *lists, T.StructField("decoded", T.StringType())])

    def run(batches: Batches) -> Batches:
        model = load(path)
        for b in batches:
            got = [model.encode(t) for t in texts_of(b, text_col)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in got])]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[i] for x in got] or [np.zeros(0, np.int32)]))) for i in range(3)]
            decoded = pa.array([model.decode(x[0].tolist()) for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns, decoded], names=schema.names)

    return mapped(docs.select(*dict.fromkeys([*keep, text_col])), run, schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: the number of ids, and SHA-256 digests of the ids in decimal, of the decoded text, and of the spans.

    The spans are digested as pairs of little-endian 32-bit integers. The ids
    never leave the worker, so a row costs some hundred bytes however long
    its text is. Null and repeated texts are as in encode().
    """
    texts = [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256", "spans_sha256")]
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), *texts])

    def run(batches: Batches) -> Batches:
        model = load(path)
        hexed = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            rows = []
            for text in texts_of(b, text_col):
                ids, begins, ends = model.encode(text)
                listed = ids.tolist()
                rows.append((len(listed), hexed(" ".join([model.decimal[i] for i in listed]).encode()), hexed(model.decode(listed).encode()), hexed(np.stack([begins, ends], 1).astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string())))], names=schema.names)

    return mapped(docs.select(id_col, text_col), run, schema)
