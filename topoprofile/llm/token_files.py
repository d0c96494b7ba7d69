"""Token-id files: a zstandard frame per document, over a shared dictionary, with an offset index.

A file holds a range of documents in ascending id order (null ids first; equal
ids by their text's hash, then text, so one id's rows may span files)::

    header   magic, bytes per id, SHA-256 of the dictionary (zeros: none)
    frames   one per document: its ids, little-endian unsigned, compressed alone
    index    per document: id, whether the id is null, offset, ids so far
    footer   offset of the index, documents, ids, CRC-32 of the index, magic

``read_document`` fetches one document by a binary search in the index and a
single read. The dictionary is trained on the serialized ids of a bounded sample
of short documents (``SAMPLE_DOCS`` expected, up to ``SAMPLE_CHARS`` characters
each), since it serves short documents; all documents are encoded and written.

Where the tokenizer's tokens never cross the six ASCII white-space characters, nor
take them in, ids come for each distinct space-free run of a batch: a text's ids are
the ids of its runs in order, and a worker keeps those of the last ``CACHE`` to twice
as many distinct runs. That is probed (``_splits``), as is whether case matters; any
other tokenizer (byte-level ones keep the space in the token) encodes whole texts.

Defined cases. Null text: empty, only the end id. Repeated rows are written each.
Texts of any length are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoprofile.llm.files import attempt_name, each_in_a_task, opened, partition_id, small_batches, written
from topoprofile.runtime import materialize, new_path

MAGIC = b"TOKPACK1"
HEADER, HEADER_BYTES = "<8sI32s", 44
FOOTER, FOOTER_BYTES = "<QQQI8s", 36
INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("at", "<u8"), ("ids", "<u8")])
END_ID = 1
LEVEL = 3
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 4_096
DICTIONARY_BYTES = 65_536
#: Runs of a worker's younger cache (an older one is as large): just under 2**20 * 2/3, where a dict doubles its table.
CACHE = 690_000
#: Runs of one call to the tokenizer, and the run put between them.
JOINED = 200
SEPARATOR = b"\x01"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A lower-case word of a-z and the lower-case letters of Latin-1 (UTF-8), and the ASCII marks behind it: no apostrophe, no "<".
_WORD = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{-~]*)")
#: Byte-level models read a byte that does not print as another character.
_BYTES = {0x9F: chr(0x141), 0xA0: chr(0x142), 0xAD: chr(0x143)}
#: Characters whose distinct runs are encoded together.
BATCH_CHARS = 2_000_000

_workers: dict = {}


def _splits(ids) -> bool:
    """Whether ids of texts are those of their runs between white space, probed over words, digits, marks and accents."""
    words = ["hello", "brave", "New", "the", "a", "it's", "2024", "x_1", "(", ".", "...", "é", "漢字", "-", "\u0301"]
    known = {w: ids(w) for w in words}
    pairs = [(w, words[(k + by) % len(words)]) for by in (1, 4) for k, w in enumerate(words)]
    gaps = [*" \t\n\v\f\r", "  ", "\r\n", " \t "]
    return all(ids(a + gap + b) == known[a] + known[b] and ids(gap + a + gap) == known[a] for a, b in pairs for gap in gaps)


class RunEncoder:
    """Ids of whole texts as bytes, through a bounded cache of runs."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        lone = ids(SEPARATOR.decode())
        self.separator = lone[0] if len(lone) == 1 and ids(f"a {SEPARATOR.decode()} b") == ids("a") + lone + ids("b") else None
        letters = "abcdefghijklmnopqrstuvwxyz"
        probes = [letters, letters[::-1], *letters, "the", "internationalization", "qzxjq"]
        self.lowers = all(ids(form) == ids(p) for p in probes for form in (p.upper(), p.title()))
        self.splits = _splits(ids)
        probes += [*"àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "éàíüßñ", "straße", "português", *"!.,#$%&()*+-/:;=>?@[]^_`{|}~\\\"", "...", "--", ".***"]
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.plain = self.lowers and all("<" in t.content for t in added) and all(self._model_ids(p.encode()) == ids(p) for p in probes)
        self.plain = self.plain and all(ids(w + m) == ids(w) + ids(m) for w in ("the", "é", "straße") for m in probes if not m[0].isalpha())
        self.code = "H" if self.kind.itemsize == 2 else "I"

    @classmethod
    def of_worker(cls, tokenizer_path: str) -> RunEncoder:
        if tokenizer_path not in _workers:
            _workers[tokenizer_path] = cls(tokenizer_path)
        return _workers[tokenizer_path]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array([*e.ids, END_ID], self.kind).tobytes() for e in found]
        runs = [self._runs(t) for t in texts]
        new = set().union(*runs).difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.older, self.known = self.known, {}  # what is used again moves up
            new = set().union(*runs)
        if self.older:
            self.known |= {run: self.older[run] for run in new if run in self.older}
            new.difference_update(self.known)
        self._learn(list(new))
        ids = self.known.__getitem__
        end = np.array([END_ID], self.kind).tobytes()
        return [b"".join(map(ids, words)) + end for words in runs]

    def _runs(self, text: str) -> list[bytes]:
        """The space-free runs; in lower case where the tokenizer has it so and no special token could come to be."""
        raw = text.encode("utf-8")
        return (raw.translate(_LOWER) if self.lowers and b"<|" not in raw else raw).split()

    def _model_ids(self, piece: bytes) -> list[int]:
        """What the model alone makes of a word, or of marks."""
        text = piece.decode("latin-1")
        return [t.id for t in self.tokenizer.model.tokenize(text if piece.isascii() else text.translate(_BYTES))]

    def _packed(self, piece: bytes) -> bytes:
        return array(self.code, self._model_ids(piece)).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Ids of unknown runs: many in one call, with a separator run between them that has an id of its own."""
        alone = [run for run in new if self.separator is None or SEPARATOR in run]
        for run in alone:
            self.known[run] = np.array(self.tokenizer.encode(run.decode("utf-8"), add_special_tokens=False).ids, self.kind).tobytes()
        many = [run for run in new if self.separator is not None and SEPARATOR not in run]
        if self.plain:  # such a word is one for the model as it stands, and so are its marks: only the model is needed
            # (with "<|" in a text its letters may be upper case: those take the long way)
            rest, marked, tails = [], [], {}
            for run in many:
                if run.isalpha() and run.islower():
                    self.known[run] = self._packed(run)
                elif found := _WORD.fullmatch(run):
                    if found[2]:
                        marked.append((run, *found.groups()))
                    else:
                        self.known[run] = self._packed(run)
                else:
                    rest.append(run)
            for run, word, marks in marked:  # most of their words are known by now
                if marks not in tails:
                    tails[marks] = self._packed(marks)
                self.known[run] = (self.known.get(word) or self._packed(word)) + tails[marks]
            many = rest
        for at in range(0, len(many), JOINED):
            part = many[at : at + JOINED]
            text = (b" " + SEPARATOR + b" ").join(part).decode("utf-8")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.separator)
            raw, width = ids.tobytes(), self.kind.itemsize
            starts, stops = np.r_[0, cuts + 1] * width, np.r_[cuts, len(ids)] * width
            for run, a, b in zip(part, starts.tolist(), stops.tolist(), strict=True):
                self.known[run] = raw[a:b]


def _in_batches(texts: list[str]) -> Iterator[slice]:
    start = chars = 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= BATCH_CHARS:
            yield slice(start, k + 1)
            start, chars = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from the ids of a hashed sample of short documents; empty if there are too few."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    picked = docs.where(hashed & (F.length("text") <= SAMPLE_CHARS)).select("text").limit(2 * SAMPLE_DOCS).collect()
    samples = RunEncoder(tokenizer_path).encode([r.text for r in picked]) if picked else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _codec(dictionary: bytes):
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)  # digested once, not for every document
    return (
        zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True),
        zstandard.ZstdDecompressor(dict_data=shared),
    )


def write_token_files(docs: DataFrame, tokenizer_path: str, dictionary: bytes, folder: str) -> DataFrame:
    """Encode ``doc_id, text`` into files of ``folder``; the manifest ``file, path, docs, ids`` (written, read back).

    Texts cross the network once, dealt by ranges of the id; each task encodes
    and writes its range as a stream.
    """
    small_batches(docs.sparkSession)
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a hash beside the id, so that rows which share an id (or have none) are dealt over tasks too
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = partition_id()
        path = f"{folder}/{attempt_name()}.ids"
        encoder = RunEncoder.of_worker(tokenizer_path)
        compress = _codec(dictionary)[0].compress
        digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
        index, ids = [np.empty(0, INDEX)], 0
        with written(path) as out:
            out.write(struct.pack(HEADER, MAGIC, encoder.kind.itemsize, digest))
            at = HEADER_BYTES
            for frame in frames:
                texts = frame["text"].tolist()
                names = frame["doc_id"].astype("Int64")
                for part in _in_batches(texts):
                    entries = []
                    for name, raw in zip(names[part], encoder.encode(texts[part]), strict=True):
                        packed = compress(raw)
                        out.write(packed)
                        ids += len(raw) // encoder.kind.itemsize
                        entries.append((0 if pd.isna(name) else int(name), pd.isna(name), at, ids))
                        at += len(packed)
                    index.append(np.array(entries, INDEX))
            index = np.concatenate(index)  # 25 bytes a document
            table = index.tobytes()
            out.write(table + struct.pack(FOOTER, at, len(index), ids, zlib.crc32(table), MAGIC))
        if len(index):
            yield pd.DataFrame({"file": [number], "path": [path], "docs": [len(index)], "ids": [ids]})

    return materialize(dealt.mapInPandas(write, "file long, path string, docs long, ids long"), "manifest")


def read_index(source) -> tuple[int, bytes, np.ndarray, int]:
    """Bytes per id, dictionary hash, index and end of the frames of an open file."""
    size = source.size()
    source.seek(0)
    magic, width, digest = struct.unpack(HEADER, source.read(HEADER_BYTES))
    source.seek(size - FOOTER_BYTES)
    at, docs, _, crc, end = struct.unpack(FOOTER, source.read(FOOTER_BYTES))
    source.seek(at)
    table = source.read(docs * INDEX.itemsize)
    if magic != MAGIC or end != MAGIC or zlib.crc32(table) != crc:
        raise ValueError("not a whole token-id file")
    return width, digest, np.frombuffer(table, INDEX), at


def _checked(digest: bytes, dictionary: bytes) -> zstandard.ZstdDecompressor:
    if digest != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
        raise ValueError("the file was written with another dictionary")
    return _codec(dictionary)[1]


def read_document(path: str, doc_id: int, dictionary: bytes) -> np.ndarray | None:
    """The ids of one document (the first of several that share the id), or none."""
    with opened(path) as source:
        width, digest, index, end = read_index(source)
        named = int(np.count_nonzero(index["null"]))
        k = named + int(np.searchsorted(index["id"][named:], doc_id))
        if k == len(index) or index["id"][k] != doc_id:
            return None
        stop = int(index["at"][k + 1]) if k + 1 < len(index) else end
        source.seek(int(index["at"][k]))
        raw = _checked(digest, dictionary).decompress(source.read(stop - int(index["at"][k])))
        return np.frombuffer(raw, f"<u{width}")


def read_token_files(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    based = materialize(manifest.select("file", "path", F.coalesce(before, F.lit(0)).alias("base")), "bases")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                with opened(path) as source:
                    width, digest, index, end = read_index(source)
                    expand = _checked(digest, dictionary).decompress
                    stops = np.r_[index["at"][1:], np.uint64(end)].astype(np.int64)
                    source.seek(HEADER_BYTES)
                    for low in range(0, len(index), 5_000):
                        part = index[low : low + 5_000]
                        crcs, counts = [], []
                        for at, stop in zip(part["at"].tolist(), stops[low : low + 5_000].tolist(), strict=True):
                            ids = np.frombuffer(expand(source.read(stop - at)), f"<u{width}")
                            counts.append(len(ids))
                            crcs.append(zlib.crc32(ids.astype("<u4")))
                        starts = base + part["ids"].astype(np.int64) - np.array(counts)
                        names = pd.array(part["id"].astype(np.int64), dtype="Int64")
                        names[part["null"].astype(bool)] = pd.NA
                        yield pd.DataFrame({"doc_id": names, "start": starts, "n_tokens": counts, "ids_crc32": crcs})

    return each_in_a_task(based, "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """Every whole document, tokenized, written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokenizer = default_tokenizer()
    dictionary = train_dictionary(docs, tokenizer)
    manifest = write_token_files(docs, tokenizer, dictionary, new_path(spark, "token-files"))
    return read_token_files(manifest, dictionary)
