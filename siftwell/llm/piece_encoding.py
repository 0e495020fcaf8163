"""SentencePiece encoding and decoding that keeps source offsets.

The normaliser walks the text with the longest prefix that the model's compiled character map knows (a double-array
trie followed by its replacement strings, both read from the model file), and records for each normalised byte the
original byte it came from. What it gives is what gets encoded: the library's merges run on the normalised text, with
the library's own normalisation switched off. Each piece covers a run of normalised bytes, which the alignment
projects to a span of original bytes.

If no piece of the model continues behind a space mark, merges never cross the beginning of a word. Then words are
encoded one by one and remembered; otherwise the whole text is one stretch.

Defined cases: a null text is empty and has no ids; an empty table gives an empty result; very long texts are
encoded whole, one at a time; repeated rows are encoded alike, each on its own; of merges with equal scores the leftmost goes first, as in the library;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import small_batches, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, buf[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, buf[at : at + n]
            at += n


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 bytes, and the replacement strings."""

    def __init__(self, blob: bytes = b"") -> None:
        self.units, self.strings = (), b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.strings = blob[4 + n :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of data[at:], and its replacement; (0, b"") if none is known."""
        units, pos = self.units, 0
        found, value = 0, 0
        pos ^= self._offset(units[0])
        for i in range(at, len(data)):
            pos ^= data[i]
            if pos >= len(units) or units[pos] & (1 << 31 | 0xFF) != data[i]:
                break
            unit = units[pos]
            pos ^= self._offset(unit)
            if unit >> 8 & 1:
                found, value = i + 1 - at, units[pos] & 0x7FFFFFFF
        if not found:
            return 0, b""
        return found, self.strings[value : self.strings.index(b"\0", value)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Normalizer:
    """The model's normalisation with source alignment."""

    def __init__(self, model: bytes) -> None:
        spec = next((v for k, v in _fields(model) if k == 3), b"")
        got = dict(_fields(spec))
        self.map = CharacterMap(got.get(2, b""))
        self.dummy, self.squeeze, self.escape = bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and the alignment: normalised byte i came from original byte align[i]; one more entry ends it."""
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.map or self.squeeze:
            return self._general(data)
        src = np.frombuffer(data, np.uint8)
        space = src == 32
        width = np.where(space, 3, 1) if self.escape else np.ones(len(src), np.int64)
        align = np.repeat(np.arange(len(src)), width)
        norm = data.replace(b" ", SPACE) if self.escape else data
        if self.dummy:
            head = SPACE if self.escape else b" "
            norm, align = head + norm, np.concatenate([np.zeros(len(head), np.int64), align])
        return norm, np.append(align, len(src))

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, align, at = [], [], 0
        space = SPACE if self.escape else b" "
        started = blank = False
        while at < len(data):
            n, piece = self.map.longest(data, at) if self.map else (0, b"")
            if not n:
                first = data[at]
                n = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                piece = data[at : at + n]
            for b in (bytes((x,)) for x in piece):
                is_space = b == b" "
                if self.squeeze and is_space and (blank or not started):
                    continue
                if not started and self.dummy:
                    out.append(space)
                    align += [at] * len(space)
                started, blank = True, is_space
                x = space if is_space else b
                out.append(x)
                align += [at] * len(x)
            at += n
        if self.squeeze and blank and out:
            last = out.pop()
            del align[-len(last) :]
        return b"".join(out), np.array([*align, len(data)], np.int64)


#: Appended to a model, this empties its character map and takes no part in white space: text is encoded as it is.
AS_IT_IS = b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00"
WORD = re.compile("▁+[^▁]*|[^▁]+")
#: Words that an encoder remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64


class PieceEncoder:
    """Encodes normalised text by the library's merges and projects pieces to spans of original bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model + AS_IT_IS)
        self.normalizer = Normalizer(model)
        n = self.lib.get_piece_size()
        pieces = [self.lib.id_to_piece(i) for i in range(n)]
        self.decimal = [str(i) for i in range(n)]
        self.width = np.array([1 if self.lib.is_byte(i) else 0 if self.lib.is_control(i) else len(pieces[i].encode()) for i in range(n)], np.int64)
        self.unknown = self.lib.unk_id()
        kinds = {dict(_fields(v)).get(3, 1) for k, v in _fields(model) if k == 1}
        # 4: symbols that a user defined are cut out before the merges
        self.by_words = self.normalizer.escape and 4 not in kinds and "▁" in pieces and not any("▁" in x.lstrip("▁") for x in pieces)
        self.known: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        ids = self.merges.encode(word, add_bos=False, add_eos=False)
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode_normalized(self, norm: bytes) -> list[int]:
        text = norm.decode()
        if not self.by_words:
            return self.merges.encode(text, add_bos=False, add_eos=False)
        known, word, out = self.known, self._word, []
        for x in WORD.findall(text):
            out += known.get(x) or word(x)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_normalized(self.normalizer(text.encode())[0])

    def encode_spans(self, text: str) -> tuple[list[int], np.ndarray]:
        """The ids, and for each the [begin, end) of original bytes that it covers, as rows. The spans lie side by side."""
        norm, align = self.normalizer(text.encode())
        ids = self.encode_normalized(norm)
        width = self.width[ids] if ids else np.zeros(0, np.int64)
        ends = np.cumsum(width)
        if len(ids) and ends[-1] != len(norm):  # an unknown piece without byte fallback has no fixed width
            return ids, self._spans_by_search(norm, align, ids)
        edge = align[np.concatenate([[0], ends])] if len(ids) else np.zeros(1, np.int64)
        return ids, np.stack([edge[:-1], edge[1:]], 1)

    def _spans_by_search(self, norm: bytes, align: np.ndarray, ids: list[int]) -> np.ndarray:
        edges, at = [0], 0
        pieces = [self.lib.id_to_piece(i).encode() for i in ids]
        for k, i in enumerate(ids):
            if i == self.unknown:
                nxt = next((pieces[j] for j in range(k + 1, len(ids)) if ids[j] != self.unknown), None)
                at = len(norm) if nxt is None else max(at, norm.find(nxt, at + 1))
            else:
                at += int(self.width[i])
            edges.append(at)
        edge = align[np.array(edges)]
        return np.stack([edge[:-1], edge[1:]], 1)

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path)


ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered_bytes long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids, begins and ends (original byte offsets of each piece), decoded."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(MODEL)

    def run(batches):
        enc = encoder(path)
        for ids, texts in _texts(batches):
            got, spans = zip(*map(enc.encode_spans, texts), strict=True)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(got, pa.list_(pa.int32())), pa.array([s[:, 0] for s in spans], pa.list_(pa.int32())),
                pa.array([s[:, 1] for s in spans], pa.list_(pa.int32())), pa.array([enc.decode(g) for g in got]),
            ], ["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, ENCODED)


def encoding_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Counts and digests of what encode_documents gives, without shipping the ids.

    doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (of begin and end of every span, as 64-bit little-endian
    numbers), covered_bytes (the sum of their lengths).
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path(MODEL)

    def run(batches):
        enc = encoder(path)
        name = enc.decimal.__getitem__
        for ids, texts in _texts(batches):
            got, spans = zip(*map(enc.encode_spans, texts), strict=True)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(g) for g in got], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(name, g)).encode()).hexdigest() for g in got]),
                pa.array([hashlib.sha256(enc.decode(g).encode()).hexdigest() for g in got]),
                pa.array([hashlib.sha256(s.astype("<i8").tobytes()).hexdigest() for s in spans]),
                pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered_bytes"])

    return docs.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, DIGESTS)


def op9_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
