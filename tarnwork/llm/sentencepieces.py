"""Offset-preserving SentencePiece encoding and decoding.

A text is first normalised by longest-prefix replacement through the model's compiled
character map; every replaced unit records where it came from.  The pieces are those of the
normalised text: the model is loaded once more without its own normaliser, so it merges just
the bytes that the map has given, and each piece is projected through the recorded sources to
a span of the original UTF-8 bytes.  Decoding is the library's.

Edge cases: a null text is an empty one; an empty text has only the end id and no spans; a
piece that covers no original byte (the marker put before the text) has an empty span; rows
that repeat, ids included, are each encoded; null ids are kept; an empty table gives an empty
result; a text of any length is encoded whole, a slice of rows at a time; other columns,
whatever their names, are dropped at once.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.llm import fingerprints as fp
from tarnwork.llm.common import id_type, map_batches, texts

#: The mark that stands for a space in pieces.
SPACE_MARK = "▁".encode()


class CharacterMap:
    """The compiled map: a double-array trie of byte strings, and their replacements.

    Layout of the binary: trie size, trie units of 32 bits, replacements ended by zero bytes.
    A unit has, from its high bits: leaf mark with value or label, and an offset.
    """

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4) if compiled else ()
        self.replacements = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of data[at:], and its replacement."""
        if not self.units:
            return None
        found, unit = None, self.units[0]
        node = self._offset(unit)
        for k in range(at, len(data)):
            byte = data[k]
            node ^= byte
            unit = self.units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.replacements[value : self.replacements.index(b"\0", value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)


def _utf8_length(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Encoder:
    """A model with its normaliser and its pieces' lengths."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        self.rules = sentencepiece_model_pb2.NormalizerSpec()
        self.rules.CopyFrom(proto.normalizer_spec)
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        self.mark = SPACE_MARK if self.rules.escape_whitespaces else b" "
        byte_type = sentencepiece_model_pb2.ModelProto.SentencePiece.BYTE
        #: Normalised bytes that a piece stands for; an unknown piece has no fixed length.
        self.lengths = np.array([1 if p.type == byte_type else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.fixed_lengths = proto.trainer_spec.byte_fallback
        self.end = self.library.eos_id()
        #: Pieces that stand for themselves; the map leaves them alone.
        self.own = tuple(sorted((p.piece.encode() for p in proto.pieces if p.type == sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED), key=len, reverse=True))
        bare = proto.normalizer_spec
        bare.precompiled_charsmap = b""
        bare.add_dummy_prefix = bare.remove_extra_whitespaces = bare.escape_whitespaces = False
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them plus the end the original offset it starts from."""
        if not self.map.units and not self.rules.remove_extra_whitespaces:
            raw = np.frombuffer(data, np.uint8)
            widths = np.where(raw == 0x20, len(self.mark), 1)
            source, end = np.repeat(np.arange(len(raw)), widths), len(data)
            out = data.replace(b" ", self.mark)
        else:
            parts: list[bytes] = []
            origin: list[int] = []
            at = 0
            while at < len(data):
                kept = next((p for p in self.own if data.startswith(p, at)), None)
                size, text = (len(kept), kept) if kept else self.map.longest(data, at) or (n := _utf8_length(data[at]), data[at : at + n])
                parts.append(text)
                origin += [at] * len(text)
                at += size
            out, source, end = b"".join(parts), np.array(origin, np.int64), len(data)
            if self.rules.remove_extra_whitespaces:
                raw = np.frombuffer(out, np.uint8)
                space = raw == 0x20
                keep = ~space
                keep[1:] |= space[1:] & ~space[:-1]
                last = np.flatnonzero(~space)
                end = int(source[last[-1] + 1]) if len(last) and last[-1] + 1 < len(source) else end  # dropped spaces belong to no piece
                keep[: last[0] if len(last) else len(keep)] = False
                keep[last[-1] + 1 if len(last) else 0 :] = False
                out, source = raw[keep].tobytes(), source[keep]
            raw = np.frombuffer(out, np.uint8)
            source = np.repeat(source, np.where(raw == 0x20, len(self.mark), 1))
            out = out.replace(b" ", self.mark)
        if self.rules.add_dummy_prefix and out:
            ends = (b"", self.mark) if self.suffix else (self.mark, b"")
            source = np.concatenate([np.zeros(len(ends[0]), np.int64), source, np.full(len(ends[1]), end, np.int64)])
            out = ends[0] + out + ends[1]
        return out, np.append(source, end)

    def span_ends(self, normalised: bytes, source: np.ndarray, ids: list[int]) -> np.ndarray:
        """Where each piece ends in the original bytes; it starts where the one before ends."""
        if self.fixed_lengths:
            ends = np.cumsum(self.lengths[np.array(ids, np.int64)])
        else:  # an unknown piece may cover any text
            ends = np.cumsum([len(p.surface.encode()) for p in self.pieces.encode(normalised.decode(), return_type="proto").pieces])
        if len(ends) and ends[-1] != len(normalised):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normalised)} normalised bytes")
        return source[ends] if len(ends) else ends

    def encode(self, column: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids with an end id, and span ends for all but that one, of a column of texts."""
        texts = column.to_pylist()
        plain = not self.map.units and not self.own and not self.rules.remove_extra_whitespaces and not self.suffix and self.fixed_lengths
        if plain:  # normalising only marks spaces
            mark = self.mark.decode()
            found = self.pieces.encode([mark * self.rules.add_dummy_prefix + t.replace(" ", mark) if t else "" for t in texts], num_threads=1)
        else:
            rows = [self.normalise(t.encode()) for t in texts]
            found = self.pieces.encode([out.decode() for out, _ in rows], num_threads=1)
            ends = [self.span_ends(out, source, ids) for (out, source), ids in zip(rows, found, strict=True)]
        for ids in found:
            ids.append(self.end)
        ids = pa.array(found, pa.list_(pa.int32()))
        counts = np.diff(ids.offsets.to_numpy())
        return ids, _lists(self._plain_ends(column, ids.values.to_numpy(), counts) if plain else ends, counts - 1)

    def _plain_ends(self, column: pa.Array, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``span_ends`` of all rows at once, where normalising only marks spaces."""
        data, offsets = fp.buffer_of(column)
        widths = np.where(data == 0x20, len(self.mark), 1)
        marked = np.concatenate((np.zeros(1, np.int64), np.cumsum(widths)))  # bytes before each byte, spaces marked
        source = np.append(np.repeat(np.arange(len(data)), widths), len(data))
        prefix = np.where(np.diff(offsets) > 0, len(self.mark) * self.rules.add_dummy_prefix, 0)
        total = prefix + np.diff(marked[offsets])
        row_ends, last = np.cumsum(total), np.cumsum(counts) - 1
        lengths = self.lengths[flat]
        lengths[last] = 0
        ends = np.cumsum(lengths)
        if not np.array_equal(ends[last], row_ends):
            raise ValueError("pieces do not cover the normalised text")
        inner = np.ones(len(flat), bool)
        inner[last] = False
        row = np.repeat(np.arange(len(counts)), counts)[inner]
        local = np.maximum(ends[inner] - (row_ends - total + prefix)[row], 0)
        return source[marked[offsets[:-1]][row] + local] - offsets[:-1][row]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each process and model file."""
    return Encoder(path)


def _lists(rows, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts))).astype(np.int32)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]) if isinstance(rows, list) else rows
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32), pa.int32()))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, span_ends): piece k covers the original bytes [span_ends[k-1], span_ends[k])."""

    def work(batch: pa.RecordBatch) -> dict:
        ids, ends = encoder(model_path).encode(batch.column(1))
        return {id_col: batch.column(0), "ids": ids, "span_ends": ends}

    return map_batches(texts(docs, id_col, text_col), work, f"{id_col} {id_type(docs, id_col)}, ids array<int>, span_ends array<int>", size_col=text_col, piece_bytes=1 << 20)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, span_ends, decoded): ids back to text."""

    def work(batch: pa.RecordBatch) -> dict:
        library = encoder(model_path).library
        decoded = [library.decode(x) if x else "" for x in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), ids_col: batch.column(1), "span_ends": batch.column(2), "decoded": pa.array(decoded, pa.string())}

    return map_batches(rows.select(id_col, ids_col, "span_ends"), work, f"{id_col} {id_type(rows, id_col)}, {ids_col} array<int>, span_ends array<int>, decoded string", size_col=ids_col, piece_bytes=400_000)
