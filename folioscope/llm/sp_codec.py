"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map (a Darts double
array); an alignment array records which original byte each normalised byte stems from. The normalised text is what the
library gets, from a copy of the model whose own normaliser does nothing: it only merges. The pieces' lengths in
normalised bytes, projected through the alignment, give every piece its span of original UTF-8 bytes. The model's bytes
travel with the tasks: executors need no file of their own. A model without a character map replaces nothing; there
the alignment is made from whole arrays.

Defined cases: null and empty texts have no ids and no spans and decode to ""; repeated rows and texts are each
encoded alike; extra columns are dropped by `encoded`; the texts of one call are bounded by bytes, one
longer text is a call of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import arrow_map, chunks

_MODELS: dict[bytes, "Codec"] = {}
#: What the library writes for a space.
META = "▁".encode()


class CharMap:
    """A compiled character map: a double array of UTF-8 prefixes and the strings that replace them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", count=size // 4, offset=4).tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key that data has at `at`: its length and its replacement."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if (unit & 0x800000FF) != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spec = spec = proto.normalizer_spec
        bare = sentencepiece_model_pb2.ModelProto.FromString(model)
        bare.normalizer_spec.Clear()
        bare.normalizer_spec.name = "identity"
        bare.normalizer_spec.add_dummy_prefix = bare.normalizer_spec.remove_extra_whitespaces = bare.normalizer_spec.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.space = META if spec.escape_whitespaces else b" "
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharMap(self.spec.precompiled_charsmap) if self.spec.precompiled_charsmap else None
        #: Normalised bytes of each piece; a byte piece stands for one, an unknown one (0 here) for its surface.
        self.lengths = np.array([1 if p.type == 6 else 0 if p.type in (2, 3) else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == 2}

    def normalised(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The normalised bytes; for each step of normalisation its original start and its length in them.

        Steps run from left to right; a dummy prefix is a step at the first kept byte that takes none.
        """
        n, mark = len(data), len(self.space)
        if self.map is None and not self.spec.remove_extra_whitespaces:
            raw = np.frombuffer(data, np.uint8)
            starts, sizes = np.arange(n, dtype=np.int64), np.where(raw == 0x20, mark, 1).astype(np.int64)
            out = data.replace(b" ", self.space)
            if self.spec.add_dummy_prefix and n:
                if self.suffix:
                    return out + self.space, np.append(starts, n), np.append(sizes, mark)
                return self.space + out, np.insert(starts, 0, 0), np.insert(sizes, 0, mark)
            return out, starts, sizes
        kept = self._kept(list(self._steps(data)), n)
        texts = [t for _, t in kept]
        return b"".join(texts), np.array([x[0] for x in kept], np.int64), np.array([len(t) for t in texts], np.int64)

    def _kept(self, steps: list[tuple[int, bytes]], n: int) -> list[tuple[int, bytes]]:
        """Steps with the dummy prefix or suffix and the marks of spaces, without the spaces that are too many.

        As the library has it: steps that are a space go from the front; after a step that ends with a space the next
        loses those it begins with; at the end marks go, whether they stood for spaces or were in the text.
        """
        trim, dummy = self.spec.remove_extra_whitespaces, self.spec.add_dummy_prefix
        if trim:
            first = next((k for k, (_, t) in enumerate(steps) if t != b" "), len(steps))
            steps = steps[first:]
        if not steps:
            return []
        kept = [(steps[0][0], self.space)] if dummy and not self.suffix else []
        after_space = trim
        for start, text in steps:
            text = text.lstrip(b" ") if after_space else text
            if text:
                kept.append((start, text.replace(b" ", self.space)))
                after_space = trim and text.endswith(b" ")
        while trim and kept and kept[-1][1].endswith(self.space):
            start, text = kept.pop()
            if text := text[: -len(self.space)]:
                kept.append((start, text))
        return [*kept, (n, self.space)] if dummy and self.suffix else kept

    def _steps(self, data: bytes):
        """(start, replacement) of the longest prefixes; a character that no key begins with stands for itself."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, data[at : at + size]
            yield at, hit[1]
            at += hit[0]

    def encoded(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """The ids of each text, and the span [start, stop) of original bytes of each id."""
        made = [self.normalised(t.encode()) for t in texts]
        ids = self.merger.encode([out.decode() for out, _, _ in made], num_threads=1)
        return [(i, self.spans(len(t.encode()), *x, i)) for t, x, i in zip(texts, made, ids, strict=True)]

    def spans(self, n: int, out: bytes, starts: np.ndarray, sizes: np.ndarray, ids: list[int]) -> np.ndarray:
        """Pieces laid along the normalised bytes, and those bytes' places among the n original ones."""
        if not ids:
            return np.zeros((0, 2), np.int64)
        own = self.lengths[np.array(ids, np.int64)]
        if self.unknown.intersection(ids):
            own = np.array([len(p.encode()) for p in self.merger.encode(out.decode(), out_type=str)], np.int64)
        ends, edges = np.cumsum(own), np.cumsum(sizes)
        if ends[-1] != edges[-1]:
            raise ValueError("the pieces do not spell the normalised text")
        stop = np.append(starts, n)[np.searchsorted(edges, ends, side="right")]
        stop[-1] = n
        return np.stack([np.insert(stop[:-1], 0, 0), stop], 1)


def codec(model: bytes) -> Codec:
    if model not in _MODELS:
        _MODELS.clear()
        _MODELS[model] = Codec(model)
    return _MODELS[model]


def _encode(batches, model: bytes, digests: bool):
    own = codec(model)
    for batch in batches:
        for part in chunks(batch, "text", 2 << 20):
            texts = [x or "" for x in part.column(1).to_pylist()]
            found = own.encoded(texts)
            ids, spans = [i for i, _ in found], [s for _, s in found]
            if not digests:
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([s[:, 0] for s in spans], pa.list_(pa.int64())), pa.array([s[:, 1] for s in spans], pa.list_(pa.int64())), pa.array([own.library.decode(i) for i in ids])],
                    ["doc_id", "ids", "starts", "stops", "decoded"],
                )
                continue
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([sha(",".join(map(str, i)).encode()) for i in ids]),
                    pa.array([sha(own.library.decode(i).encode()) for i in ids]),
                    pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_span_bytes"],
            )


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids, starts and stops (original byte spans) and the decoded text of every row."""
    return arrow_map(docs.select("doc_id", "text"), _encode, "doc_id long, ids array<int>, starts array<long>, stops array<long>, decoded string", model, False)


def digested(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_span_bytes (all spans together) of every row."""
    return arrow_map(docs.select("doc_id", "text"), _encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_span_bytes long", model, True)


def public_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op10(spark, sf_dir: str) -> DataFrame:
    return digested(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_model())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of the documents that are left."""
    return digested(docs, public_model())
