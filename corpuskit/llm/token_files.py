"""Token ids in flat binary files, written and read by tasks.

A set is a folder of parts.  A part has ``<name>.bin``, the ids of its documents one after another as little-endian unsigned integers (16 bits if
the vocabulary allows, else 32); ``<name>.idx``, the 64-bit offset of each document in the part and the total; and ``<name>.doc``, the 64-bit ids of
its documents.  ``index.json`` lists the parts in order with the number of documents, ids and null ids, and the base of each part: the prefix sum of the
ids before it.  Parts are consecutive ranges of doc_id (null first), so the whole set is in ascending order and can be memory-mapped part by part.

Documents are encoded where they are read, then go to the task of their range as packed ids.  A task writes under a name of its own
and returns it, and only files that the index names are ever read, so repeated or lost attempts do no harm.  The folder lies on the shared file
system and is opened through pyarrow.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import shared_folder

DOCS_PER_PART = 8192
MAX_PARTS = 10_000
CACHE = 800_000
END = 1
_TAIL = re.compile(rb"(.*[a-z0-9])([!-/:-@\[-`{-~]+)", re.S)
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
# Byte-level vocabularies write a byte that isn't a printable character of Latin-1 as the next free character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = dict(zip((b for b in range(256) if b not in _PRINTED), range(256, 512), strict=False))
_open: dict[str, WordIds] = {}


class WordIds(dict):
    """Packed ids of each white-space separated word, kept between texts of a Python worker and emptied when they grow too many.

    For tokenizers that lower-case, drop white space and split letters from punctuation (``_by_word``), the ids of a text are those of its words in turn.
    Words of ASCII are then filed in lower case, except near special tokens, whose case counts; punctuation behind letters or digits is filed apart; and
    words of plain Latin letters, which normalising and splitting leave as they are, go to the tokenizer's model directly.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _by_word(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # ASCII letters, the most frequent case
            value = self._known(word.decode())
        else:
            # with other characters a capital may compose with a mark in lower case only, which normalising, before lower-casing, doesn't do
            low = word.lower() if word.isascii() and b"|" not in word else word
            apart = None if b"|" in low else _TAIL.fullmatch(low)
            if apart:
                value = self[apart[1]] + self[apart[2]]
            elif low != word:
                value = self[low]
            else:
                plain = word.decode("utf-8", "replace")
                value = self._known(word.decode("latin-1").translate(BYTE_LEVEL)) if _LATIN.fullmatch(plain) else self._packed(self.whole(plain))
        if len(self) < CACHE:
            self[word] = value
        return value

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _known(self, letters: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, raw: bytes | None) -> bytes:
        if not self.by_word:
            return self._packed(self.whole((raw or b"").decode("utf-8", "replace")))
        if len(self) >= CACHE:
            self.clear()
        return b"".join(map(self.__getitem__, (raw or b"").split()))


def _by_word(config: dict) -> bool:
    def kinds(part: dict | None, key: str) -> list[str]:
        return [x["type"] for x in (part or {}).get(key, [])]

    return (
        kinds(config["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"]
        and kinds(config["pre_tokenizer"], "pretokenizers") == ["Split", "ByteLevel"]
        and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in str(config["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex"))
        and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in config["added_tokens"])
    )


def word_ids(path: str, end: int = END) -> WordIds:
    if path not in _open:
        _open[path] = WordIds(path, end)
    return _open[path]


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, data) -> None:
    store, path = _filesystem(folder)
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def _get(folder: str, name: str) -> pa.Buffer:
    """The file memory-mapped where it is local to the task, else read."""
    store, path = _filesystem(folder)
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(f"{path}/{name}") as source:
            return source.read_buffer()
    with store.open_input_file(f"{path}/{name}") as source:
        return source.read_buffer()


def write_tokens(docs: DataFrame, tokenizer: str, text: str = "text", end: int = END, folder: str | None = None, docs_per_part: int = DOCS_PER_PART) -> str:
    """Encode every whole text, append ``end`` to each document, write the set and return its folder.

    Null and empty texts hold the end alone.  Null ids come first; rows with equal ids stay together, ordered by their ids' bytes.  Extra columns are ignored.
    An empty frame gives an index without parts.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    store, path = _filesystem(folder)
    store.create_dir(path, recursive=True)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    n = ids.count()
    parts = max(1, min(MAX_PARTS, -(-n // docs_per_part)))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = np.array(sorted(set(cuts or [])), dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, end)
        stop = np.array([end], dtype=words.dtype).tobytes()
        for b in batches:
            packed = [words.encode(t) + stop for t in b.column(1).to_pylist()]
            at = np.searchsorted(bounds, b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array(packed, pa.binary())], names=["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_ids(tokenizer, end).dtype
        store, path = _filesystem(folder)
        done: list[tuple] = []
        now: tuple | None = None

        def close() -> None:
            number, name, out, lengths, names = now
            out.close()
            _put(folder, f"{name}.idx", np.concatenate(([0], np.cumsum(lengths))).astype("<i8").tobytes())
            _put(folder, f"{name}.doc", np.array([0 if d is None else d for d in names], dtype="<i8").tobytes())
            done.append((number, name, len(names), int(sum(lengths)), sum(d is None for d in names)))

        for b in batches:
            for number, doc, packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or now[0] != number:
                    if now is not None:
                        close()
                    name = f"part-{number:05d}-{uuid.uuid4().hex}"
                    now = (number, name, store.open_output_stream(f"{path}/{name}.bin"), [], [])
                now[2].write(packed)
                now[3].append(len(packed) // dtype.itemsize)
                now[4].append(doc)
        if now is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "name", "docs", "ids", "nulls"), d, strict=True)) for d in done], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("nulls", pa.int64())]))

    encoded = docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("binary")).mapInArrow(encode, "part int, doc_id bigint, ids binary")
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    rows = sorted(ordered.mapInArrow(write, "part int, name string, docs bigint, ids bigint, nulls bigint").collect(), key=lambda r: r["part"])
    base, listed = 0, []
    for r in rows:  # one row per part, MAX_PARTS at most
        listed.append(r.asDict() | {"base": base})
        base += r["ids"]
    _put(folder, "index.json", json.dumps({"width": word_ids(tokenizer, end).dtype.itemsize, "parts": listed}).encode())
    return folder


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document from the files; start counts the ids of all documents before it."""
    index = json.loads(_get(folder, "index.json").to_pybytes())
    width = index["width"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base, nulls in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(_get(folder, f"{name}.bin"), dtype=f"<u{width}")
                offsets = np.frombuffer(_get(folder, f"{name}.idx"), dtype="<i8")
                docs = np.frombuffer(_get(folder, f"{name}.doc"), dtype="<i8")
                crc = [zlib.crc32(ids[s:e].astype("<u4")) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                named = pa.array(docs, mask=np.arange(len(docs)) < nulls)
                yield pa.RecordBatch.from_arrays([named, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = spark.createDataFrame([(p["name"], p["base"], p["nulls"]) for p in index["parts"]], "name string, base bigint, nulls bigint")
    return parts.repartition(max(1, len(index["parts"]))).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
