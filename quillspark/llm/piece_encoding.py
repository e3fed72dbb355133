"""SentencePiece encoding with byte offsets into the original text, and decoding.

Normalisation is redone here by the model's own rules (longest-prefix match against the compiled
character map, dummy prefix, white-space escaping and folding) and keeps, for every normalised byte,
where its source begins. The library encodes the text; the surfaces of its pieces add up to the normalised string, so
each piece's span in the original bytes falls out of two cumulative sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BATCH_BYTES = 2 << 20
#: The escaped space of piece surfaces.
SPACE = "▁".encode()


class CharsMap:
    """The compiled map: a double-array trie over byte strings, and NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").astype(np.int64).tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that data has at `at`, and its replacement."""
        units, node, found = self.units, 0, None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[k]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & ((1 << 31) - 1))
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class PieceModel:
    """One model file: the library's processor, its normaliser settings, and byte lengths of its pieces."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        self.map = CharsMap(n.precompiled_charsmap) if n.precompiled_charsmap else None
        self.prefix, self.fold, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        #: User-defined pieces, the longest first.
        self.own = sorted((p.piece.encode() for p in proto.pieces if p.type == 4), key=len, reverse=True)
        kinds = np.array([p.type for p in proto.pieces])
        #: Bytes that a piece takes of the normalised text: one for a byte piece, none for a control piece.
        self.widths = np.where(kinds == 6, 1, np.where(kinds == 3, 0, [len(p.piece.encode()) for p in proto.pieces]))
        self.unknown, self.end = self.processor.unk_id(), self.processor.eos_id()
        #: Whether normalising only adds the prefix and escapes spaces: then alignment needs no scan in Python.
        self.plain = self.map is None and not self.fold and self.escape and not self.suffix and not self.own

    def aligned(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each of them and for the end, the source byte where it begins."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            wide = np.where(raw == 0x20, 3, 1)
            at = np.repeat(np.arange(len(raw)), wide)
            lead = np.zeros(3 * self.prefix, np.int64)
            return SPACE * self.prefix + data.replace(b" ", SPACE), np.concatenate([lead, at, [len(raw)]])
        space = SPACE if self.escape else b" "
        units: list[tuple[bytes, int]] = []
        k = 0
        while k < len(data):
            own = next((p for p in self.own if data.startswith(p, k)), None)
            hit = (len(own), own) if own else self.map.longest(data, k) if self.map else None
            if hit is None:
                width = 1 if data[k] < 0x80 else 2 if data[k] < 0xE0 else 3 if data[k] < 0xF0 else 4
                hit = (width, data[k : k + width])
            units.append((hit[1], k))
            k += hit[0]
        out, at = bytearray(), []

        def put(piece: bytes, where: int) -> None:
            out.extend(piece)
            at.extend([where] * len(piece))

        if self.fold:
            while units and units[0][0] == b" ":
                units.pop(0)
        if not units:
            return b"", np.array([len(data)], np.int64)
        if self.prefix and not self.suffix:
            put(space, units[0][1])
        last = self.fold
        for text, where in units:
            while last and text.startswith(b" "):
                text = text[1:]
            if text:
                for x in text.split(b" ")[:1]:
                    put(x, where)
                for x in text.split(b" ")[1:]:
                    put(space, where)
                    put(x, where)
                last = self.fold and text.endswith(b" ")
        end = len(data)
        if self.fold:
            while out.endswith(space):
                end = at[len(out) - len(space)]
                del out[len(out) - len(space) :], at[len(at) - len(space) :]
        if self.prefix and self.suffix:
            put(space, end)
        return bytes(out), np.array([*at, end], np.int64)

    def spans(self, data: bytes, ids: np.ndarray) -> np.ndarray:
        """Begin and end of each id's source bytes in data, shape (len(ids), 2); the end id gets the empty span at the end."""
        normal, at = self.aligned(data)
        widths = self.widths[ids]
        for i in np.flatnonzero(ids == self.unknown):  # an unknown piece spans what no piece has: the library's surface
            widths[i] = 0
        if (ids == self.unknown).any():
            pieces = self.processor.encode(data.decode("utf-8", "replace"), out_type=str)
            widths[: len(pieces)] = [len(p.encode()) if i == self.unknown else w for p, i, w in zip(pieces, ids, widths, strict=False)]
        ends = np.cumsum(widths)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("pieces do not add up to the normalised text")
        return np.stack([at[ends - widths], at[ends]], axis=1)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Rows (key, ids, begins, ends, decoded), or with digests (key, n_tokens, ids_sha256, decoded_sha256, n_spans_bytes, spans_sha256).

    Ids are the library's for the whole text with an end id, no sampling; begins and ends are byte offsets
    into the UTF-8 text; decoded is decode(ids). n_spans_bytes is the number of source bytes that the spans
    cover, spans_sha256 the digest of all begins and ends, id by id, as little-endian 64-bit numbers. A very long text is
    encoded whole. Null or empty text: the end id alone, decoded "". Repeated rows are encoded each; an empty table
    gives no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType
    full = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("begins", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]
    short = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_spans_bytes", T.LongType()), T.StructField("spans_sha256", T.StringType())]
    schema = T.StructType([T.StructField(key, kind), *(short if digests else full)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in common.slices_by_bytes(batches, "_text", BATCH_BYTES):
            texts = common.strings(batch.column("_text"))
            coded = [x + [m.end] for x in m.processor.encode(texts, num_threads=1)]
            plain = m.processor.decode(coded, num_threads=1)
            columns: list[list] = [[] for _ in names[1:]]
            for t, ids, d in zip(texts, coded, plain, strict=True):
                span = m.spans(t.encode(), np.array(ids))
                if digests:
                    row = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest(), int((span[:, 1] - span[:, 0]).sum()), hashlib.sha256(span.astype("<i8").tobytes()).hexdigest())
                else:
                    row = (ids, span[:, 0], span[:, 1], d)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] if digests else [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text): the library's decode of each id list; null counts as an empty list."""
    schema = T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(model(path).processor.decode(lists, num_threads=1) if lists else [], pa.string())], names=[key, "text"])

    return encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, schema)
