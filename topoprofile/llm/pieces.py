"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text becomes marked words: each space is the mark ``\\u2581``, one more mark is
put in front, and a word is a run of marks and what follows up to the next mark
(no piece has a mark after another character, so words are independent). The
distinct new words of a batch are sorted, which lays out their trie depth-first;
a word keeps the forward column (score, last piece, back pointer) of the prefix
it shares with the word before it and only extends it.

The forward step is the model's own. For a unigram model: the piece with the
best score so far. For a byte-pair model: scores are merge priorities, not log
probabilities, so a sum of them would not give the model's segmentation; a step
from one piece to the next is allowed only if merging the two pieces'
characters by priority gives just those two pieces. Exactly one allowed path
reaches every prefix, the one the merges produce, and it carries over to longer
words, so the forward columns are shared in the same way.

Characters without a piece fall back to their bytes. Decoding joins the pieces,
bytes first, drops the leading mark and turns marks into spaces (a mark that was
in the text comes back as a space, as in the format itself).

Defined cases. Null text: null ids for ``encode``; the query reads it as empty.
Empty text: no ids. Texts and words of any length are encoded whole. Repeated
rows are encoded each. Extra columns are kept; a column named ``ids`` is replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topoprofile.llm.files import small_batches

MARK = "▁"
#: Distinct marked words of a worker's younger cache (an older one is as large), and checked pairs of pieces.
CACHE = 200_000
PAIRS = 500_000
#: Characters whose distinct words are searched together.
BATCH_CHARS = 2_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6

_workers: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Pieces, scores and kind of a model file; the search over sorted words."""

    def __init__(self, data: bytes):
        self.kind, self.pieces, kinds = UNIGRAM, [], []
        self.scores: list[float] = []
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normal = dict(_fields(value))
                if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1):
                    raise ValueError("only models with the identity normalizer, a leading mark and kept spaces are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and byte-pair models are supported")
        self.ids = {p: k for k, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(self.pieces, kinds, strict=True)) if kind == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.unknown_score = min(self.scores[k] for k in self.ids.values()) - 10.0
        #: every ending of a piece: its id, or -1 if it is none itself
        self.endings: dict[str, int] = {}
        for p in self.ids:
            for n in range(1, len(p) + 1):
                self.endings[p[-n:]] = self.ids.get(p[-n:], -1)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind not in (NORMAL, UNKNOWN) else p.encode("utf-8") for p, kind in zip(self.pieces, kinds, strict=True)]
        self.width = np.dtype("<u2" if len(self.pieces) < 1 << 16 else "<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.allowed: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> PieceModel:
        if path not in _workers:
            with open(path, "rb") as f:
                _workers[path] = cls(f.read())
        return _workers[path]

    def merged(self, text: str) -> list[str]:
        """The byte-pair segmentation by its definition: best priority first, leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.scores[self.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids]
            if not found:
                return parts
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _pair(self, before: int, after: int, key: int) -> bool:
        """Whether merging keeps the two pieces (or, at a start, the one) as they are."""
        kept = [self.pieces[k] for k in (before, after) if k < len(self.pieces)]
        if len(self.allowed) >= PAIRS:
            self.allowed.clear()
        self.allowed[key] = ok = self.merged("".join(kept)) == kept
        return ok

    def search(self, words: list[str]) -> list[list[int]]:
        """Ids of each marked word; ``words`` are sorted."""
        scores, endings, allowed = self.scores, self.endings.get, self.allowed
        byte_pair, size = self.kind == BPE, len(self.pieces) + 1
        none = size - 1  # stands for the start, and for a character without a piece: nothing merges with either
        last, width, total = [none], [0], [0.0]  # the forward column of each prefix
        out, before = [], ""
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], width[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, step, score, n = none, 1, -1e300, 1
                while n <= end:
                    piece = endings(word[end - n : end])
                    if piece is None:
                        break
                    if piece >= 0:
                        reached = total[end - n] + scores[piece]
                        if byte_pair:
                            key = last[end - n] * size + piece
                            ok = allowed.get(key)
                            if ok is None:
                                ok = self._pair(last[end - n], piece, key)
                            if ok:
                                best, step, score = piece, n, reached
                                break
                        elif reached >= score:  # of equals, the longest
                            best, step, score = piece, n, reached
                    n += 1
                if best == none or (not byte_pair and word[end - 1] not in self.ids):
                    lone = total[end - 1] + self.unknown_score
                    if lone > score:
                        best, step, score = none, 1, lone
                last.append(best)
                width.append(step)
                total.append(score)
            at, path = len(word), []
            while at:
                if last[at] == none:
                    path.extend(self._fallback(word[at - 1]))
                else:
                    path.append(last[at])
                at -= width[at]
            out.append(path[::-1])
            before = word
        return out

    def _fallback(self, char: str) -> list[int]:
        """Byte ids of a character, last byte first."""
        found = [self.bytes.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")]
        return found[::-1] if self.bytes else [self.unknown]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of ``width``; words are kept without their first mark."""
        split = []
        for text in texts:
            words = text.split(" ") if text else []
            if MARK in text or "" in words:  # runs of marks belong to the word behind them
                words = [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))] if text else []
            split.append(words)
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.older, self.known = self.known, {}  # what is used again moves up
            new = set().union(*split)
        if self.older:
            self.known |= {word: self.older[word] for word in new if word in self.older}
            new.difference_update(self.known)
        new = sorted(new)
        for word, ids in zip(new, self.search([MARK + w for w in new]), strict=True):
            self.known[word] = array(self.code, ids).tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(MARK).replace(MARK, " ")


def _in_batches(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode(docs: DataFrame, model_path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int). No shuffle; a batch of rows at a time.

    With ``digest`` also ``decoded_sha256``: of the text the ids decode to.
    """
    small_batches(docs.sparkSession)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + digest * [T.StructField("decoded_sha256", T.StringType())]
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of_worker(model_path)
        for batch in batches:
            texts = batch.column(place)
            packed = [p for part in _in_batches(["" if t is None else t for t in texts.to_pylist()]) for p in model.encode(part)]
            counts = np.fromiter(map(len, packed), np.int64, len(packed)) // model.width.itemsize
            values = np.frombuffer(b"".join(packed), model.width)
            offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.r_[texts.is_null().to_numpy(zero_copy_only=False), False])
            new = [pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))]
            if digest:
                back = (model.decode(np.frombuffer(p, model.width).tolist()) for p in packed)
                new.append(pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def decoded(frame: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``frame`` with ``decoded``, the text of each row's ids."""
    def run(rows: pd.Series) -> pd.Series:
        model = PieceModel.of_worker(model_path)
        return pd.Series([None if r is None else model.decode(r.tolist()) for r in rows], dtype=object)

    return frame.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids)))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the digest of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = encode(docs, default_model(), digest=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded_sha256").alias("text_sha256"), "ids")
