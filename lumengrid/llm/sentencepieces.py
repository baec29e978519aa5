"""SentencePiece encoding and decoding with offsets into the original bytes.

Text is normalised here, by longest-prefix matches in the model's compiled character map, while the
source position of every normalised byte is recorded. The normalised text is cut before each run of
space marks (no piece of the vocabulary may reach over such a border; this is checked when the model
is loaded, and otherwise the whole text is one chunk). Distinct chunks are merged into pieces by the
sentencepiece library, with its own normalisation switched off, and kept in a bounded cache; spans of
pieces are projected back through the alignment.

Nulls count as empty. An empty text has only the begin and end ids. Repeated rows give repeated
results, an empty table an empty one, and very long texts are encoded whole. Of pieces that could be
merged equally well the library's choice holds. A carried column that has an output's name is replaced.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumengrid.llm.common import map_text

MARK = "▁"
_OUTPUTS = {
    "n_tokens": T.LongType(),
    "ids": T.BinaryType(),
    "begins": T.ArrayType(T.IntegerType()),
    "ends": T.ArrayType(T.IntegerType()),
    "spans": T.BinaryType(),
    "decoded": T.StringType(),
}


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


def _message(fields: list[tuple[int, int | bytes]]) -> bytes:
    def varint(value: int) -> bytes:
        out = bytearray()
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes(out + bytes([value]))

    return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in fields)


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes, then the replacements."""

    def __init__(self, blob: bytes):
        self.units, self.replacements = np.zeros(0, np.uint32), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] that the map replaces, and its replacement."""
        units, node, found = self.units, 0, None
        unit = units[0]
        node ^= unit >> 10 << ((unit & 1 << 9) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if unit & (1 << 31 | 255) != byte:
                break
            node ^= unit >> 10 << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                value = units[node] & ~(1 << 31)
                found = i + 1 - at, value
        if not found:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Encoder:
    """A model in one task: normaliser, chunk cache and the library's merge and decode steps."""

    def __init__(self, model: bytes, cache_entries: int = 250_000, cache_chars: int = 48):
        import sentencepiece

        fields = list(_fields(model))
        trainer = dict(_fields(next((v for n, v in fields if n == 2), b"")))
        spec = dict(_fields(next((v for n, v in fields if n == 3), b"")))
        if trainer.get(24, 0):
            raise NotImplementedError("space marks as suffixes")
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.trim, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = _message([(1, b"identity"), (2, b""), (3, 0), (4, 0), (5, 0)])
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=_message_raw(fields, plain))
        pieces = [dict(_fields(v)) for n, v in fields if n == 1]
        if any(p.get(3, 1) == 4 for p in pieces):
            raise NotImplementedError("user-defined symbols")
        if not trainer.get(35, 0):
            raise NotImplementedError("vocabularies without byte fallback")
        self.is_byte = np.array([p.get(3, 1) == 6 for p in pieces])
        self.sizes = np.where(self.is_byte, 1, [len(p[1]) for p in pieces])
        self.splits = self.dummy and self.escape and not any(MARK in p[1].decode().lstrip(MARK) for p in pieces)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.cache: dict[str, bytes] = {}
        self.cache_entries, self.cache_chars = cache_entries, cache_chars

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of the original it comes from."""
        data = text.encode()
        if data and not len(self.map.units) and not self.trim and self.escape:
            return self.marked(text, data)
        mark = MARK.encode() if self.escape else b" "
        out, source = bytearray(), []
        at, end = 0, len(data)
        mapped = bool(len(self.map.units))

        def step(i: int) -> tuple[int, bytes]:
            if mapped and (hit := self.map.longest(data, i)):
                return hit
            lead = data[i]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return size, data[i : i + size]

        if self.trim:
            while at < end:
                size, piece = step(at)
                if piece != b" ":
                    break
                at += size
        if at == end:
            return "", np.array([end])
        if self.dummy:
            out += mark
            source += [at] * len(mark)
        after_space = self.trim
        while at < end:
            size, piece = step(at)
            if self.trim and after_space:
                piece = piece.lstrip(b" ")
            if piece:
                after_space = piece.endswith(b" ")
                piece = piece.replace(b" ", mark)
                out += piece
                source += [at] * len(piece)
            at += size
            after_space = after_space if self.trim else False
        stop = end
        if self.trim:
            while out.endswith(mark):
                del out[-len(mark) :]
                stop = source[-len(mark)]
                del source[-len(mark) :]
        return out.decode(), np.array([*source, stop])

    def marked(self, text: str, data: bytes) -> tuple[str, np.ndarray]:
        """normalise() of a model that has no map to match and only marks spaces."""
        codes = np.frombuffer(data, np.uint8)
        leads = np.maximum.accumulate(np.where(codes & 0xC0 != 0x80, np.arange(len(data)), 0))
        size = len(MARK.encode())
        source = np.repeat(leads, np.where(codes == 32, size, 1))
        front = np.zeros(size if self.dummy else 0, source.dtype)
        return (MARK if self.dummy else "") + text.replace(" ", MARK), np.concatenate([front, source, [len(data)]])

    def chunks(self, normal: str) -> list[str]:
        """The chunks without their first space mark; the whole text where it can't be cut so."""
        if not normal:
            return []
        if not self.splits:
            return [normal]
        words = normal.split(MARK)[1:]
        if MARK * 2 not in normal and not normal.endswith(MARK):
            return words
        out, marks = [], ""
        for word in words[:-1]:
            if word:
                out.append(marks + word)
                marks = ""
            else:
                marks += MARK
        return [*out, marks + words[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each normalised text, as little-endian unsigned 32-bit."""
        cut = [self.chunks(t) for t in texts]
        cache = self.cache
        missing = list(set().union(*cut).difference(cache))
        if len(cache) + len(missing) > self.cache_entries:
            cache.clear()
            missing = list(set().union(*cut))
        found = self.merger.encode([MARK + c for c in missing] if self.splits else missing, num_threads=1)
        ids = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        at = 0
        for chunk, one in zip(missing, found, strict=True):
            cache[chunk] = ids[at : (at := at + 4 * len(one))]
        out = [b"".join(map(cache.__getitem__, chunks)) for chunks in cut]
        for chunk in missing:
            if len(chunk) > self.cache_chars:
                del cache[chunk]
        return out

    def spans(self, ids: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte spans. Of the byte pieces of one character the last has its span, those before an empty one."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        if sizes.sum() != len(source) - 1:
            raise ValueError("pieces that don't cover the normalised text")
        begins = ends - sizes
        first, last = source[begins].copy(), source[ends].copy()
        byte = self.is_byte[ids]
        for k in np.flatnonzero(byte):
            if k and byte[k - 1] and source[begins[k]] == first[k - 1] and begins[k] and source[begins[k] - 1] == source[begins[k]]:
                first[k] = first[k - 1]
            if k + 1 < len(ids) and byte[k + 1] and source[ends[k]] == source[begins[k]]:
                last[k] = first[k]
        return first, last


def _message_raw(fields: list[tuple[int, int | bytes]], normaliser: bytes) -> bytes:
    """The model with another normaliser and without its self-test samples."""
    kept = [(n, v) for n, v in fields if n in (1, 2)]
    return _message([*kept, (3, normaliser)])


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(
    df: DataFrame,
    model_path: str,
    text: str = "text",
    carry: list[str] | None = None,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "begins", "ends", "decoded"),
    bos: bool = True,
    eos: bool = True,
) -> DataFrame:
    """Encode whole texts and decode the ids again; returns the carried columns and the chosen outputs.

    n_tokens counts all ids; ids holds them as little-endian unsigned 32-bit integers; begins and ends
    are each id's span in the UTF-8 bytes of the text (begin and end ids: an empty span at its ends),
    and spans (not chosen by default) holds begin and end of each id in turn, encoded like ids;
    decoded is the library's decode of the ids. The model file is read on the driver and travels with
    the tasks. Nulls count as empty texts.
    """
    with open(model_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())
    carry = [c for c in df.columns if c != text] if carry is None else carry
    spans, decode = {"begins", "ends", "spans"} & set(outputs), "decoded" in outputs

    def make():
        encoder = _encoder(model.value)
        head = struct.pack("<I", encoder.bos) if bos else b""
        tail = struct.pack("<I", encoder.eos) if eos else b""

        def run(texts: list) -> list:
            texts = [t or "" for t in texts]
            normal, sources = zip(*map(encoder.normalise, texts), strict=True)
            found = encoder.encode(list(normal))
            ids = [head + i + tail for i in found]
            got: dict = {"n_tokens": [len(i) // 4 for i in ids], "ids": ids}
            if spans:
                places = []
                for t, i, source in zip(texts, found, sources, strict=True):
                    first, last = encoder.spans(np.frombuffer(i, "<u4"), source)
                    end = len(t.encode())
                    places.append((np.concatenate([[0] * bos, first, [end] * eos]), np.concatenate([[0] * bos, last, [end] * eos])))
                if "begins" in outputs:
                    got["begins"] = [b.astype(int).tolist() for b, _ in places]
                if "ends" in outputs:
                    got["ends"] = [e.astype(int).tolist() for _, e in places]
                if "spans" in outputs:
                    got["spans"] = [np.stack(p, 1).astype("<u4").tobytes() for p in places]
            if decode:
                got["decoded"] = [encoder.library.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
            return [pa.array(got[n], pa.binary()) if n in ("ids", "spans") else got[n] for n in outputs]

        return run

    return map_text(df, text, make, [(n, _OUTPUTS[n]) for n in outputs], carry)
