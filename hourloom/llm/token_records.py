"""Token ids in length-delimited binary records, with an offset index beside each shard.

A shard holds records one after the other:
    u64 length | u32 masked crc32 of the length | payload | u32 masked crc32 of the payload
All integers are little-endian. A payload is one byte with the width of an id (2 or 4) and the ids.
Masking rotates a checksum by 15 bits and adds a constant, so that a checksum of data that holds
checksums stays useful. The index of a shard holds one fixed entry per record: doc_id, whether it is
null, byte offset, number of ids; shuffled reads seek by it.

Documents are range-partitioned by (doc_id, text hash) and every task writes one shard, so shard
after shard is in ascending doc_id order. File names are unique per task attempt and only files that
a successful task reports stand in the manifest, so repeated or lost attempts leave no record behind
in it. Texts, ids and records are handled batch by batch; only the manifest has one row per shard.

Encoding goes through the tokenizers library. For a tokenizer that drops white space and never joins
across it, each distinct word is encoded once and remembered in a bounded cache; new words are handed
to the library many at a time, as one text, and take the tokens that start within them.

Defined results. A null or empty text has only the end id. Rows with equal or null doc_id come in
the order of their text hash, nulls first. Extra columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hourloom.llm.store import saved, shared_folder

MASK_DELTA = 0xA282EAD8  # fixed value of the masked checksum
ENTRY = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("n_tokens", "<u4")])
CACHED_WORDS = 500_000  # twice as many at most are remembered
READERS = 4096  # most tasks that read shards
GROUP = 256  # texts encoded at once
JOINED = 1024  # new words encoded as one text
MANIFEST = "shard int, records string, index string, n_docs bigint, n_tokens bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; a wrong checksum or a cut record raises."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    payload, tail = stream.read(size), stream.read(4)
    if len(payload) < size or len(tail) < 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("damaged record")
    return payload


def ids_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4")


class Encoder:
    """Texts (UTF-8) to ids, as bytes of `width` each."""

    def __init__(self, path: str, by_word: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[bytes, bytes] = {b"": b""}  # words met lately, and those met before
        self.old: dict[bytes, bytes] = {}
        self.points = dict(zip(b".,!?", self._encoded([".", ",", "!", "?"]))) if by_word else {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words that are encoded as one text and dealt back by where their tokens start."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.fromiter((start for start, _ in found.offsets), np.int64, len(found))
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # where the next word starts
        ids, edges = np.array(found.ids, self.kind).tobytes(), [0, *(np.searchsorted(starts, after) * self.width).tolist()]
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    @staticmethod
    def _cased(raw: bytes) -> bytes:
        """A-Z lower-cased to meet fewer distinct words.

        Texts with combining marks or control strings keep their case: composing a mark or matching
        a control string comes before lower-casing in the tokenizer.
        """
        plain = b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw
        return raw.lower() if plain else raw

    def _learn(self, words: list[bytes]) -> None:
        """Put the ids of all words into known. A point after a letter is a token of its own.

        Words that composing would change or that may hold a control string are encoded one by one,
        as their offsets may not be those of the joined text.
        """
        known, old, missing, pointed = self.known, self.old, set(), []
        for word in words:
            ids = old.get(word)
            if ids is not None:
                known[word] = ids
            elif word[-1] in self.points and len(word) > 1 and 0x61 <= word[-2] <= 0x7A:
                pointed.append(word)
                stem = word[:-1]
                if stem not in known:
                    if stem in old:
                        known[stem] = old[stem]
                    else:
                        missing.add(stem)
            else:
                missing.add(word)
        joined, alone = [], []
        for word in missing:
            text = word.decode()
            (joined if is_normalized("NFC", text) and "<|" not in text else alone).append((word, text))
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            known.update(zip([w for w, _ in part], self._joined([t for _, t in part])))
        if alone:
            known.update(zip([w for w, _ in alone], self._encoded([t for _, t in alone])))
        for word in pointed:
            known[word] = known[word[:-1]] + self.points[word[-1]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Per word: the words between ASCII white space, each distinct one looked up once."""
        if not self.by_word:
            return self._encoded([t.decode() for t in texts])
        if len(self.known) > CACHED_WORDS:
            self.known, self.old = {b"": b""}, self.known
        cased = pa.array([self._cased(t) for t in texts], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(cased)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self._learn([w for w in words if w not in self.known])
        ids = pa.array(list(map(self.known.__getitem__, words)), pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        edges = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist()
        whole = memoryview(data or b"")
        return [bytes(whole[a:b]) for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=1)
def _encoder(path: str, by_word: bool) -> Encoder:
    return Encoder(path, by_word)  # one per worker process, shared by its tasks


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, by_word: bool = False) -> DataFrame:
    """Write all texts and return the manifest, one row per shard.

    tokenizer: a tokenizers JSON file that every executor can read. folder: a URI that pyarrow's file
    systems can write, by default a new one in the shared checkpoint folder. by_word: the tokenizer
    drops white space, so that words can be encoded one by one.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer, by_word), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.kind).tobytes()
        lead, name = bytes([encoder.width]), f"shard-{shard:06d}-{uuid.uuid4().hex}"
        system, stream, offset, tokens, entries = None, None, 0, 0, []
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), GROUP):
                if stream is None:
                    system, path = _open_folder(folder)
                    stream = system.open_output_stream(f"{path}/{name}.rec")
                part = texts.slice(at, GROUP).cast(pa.large_binary()).to_pylist()
                for doc_id, found in zip(ids.slice(at, GROUP).to_pylist(), encoder.encode([x or b"" for x in part])):
                    record = frame(b"".join((lead, found, end)))
                    n = len(found) // encoder.width + 1
                    stream.write(record)
                    entries.append((doc_id or 0, doc_id is None, offset, n))
                    offset, tokens = offset + len(record), tokens + n
        if stream is None:
            return
        stream.close()
        with system.open_output_stream(f"{path}/{name}.idx") as index:
            index.write(np.array(entries, ENTRY).tobytes())
        row = {"shard": shard, "records": f"{name}.rec", "index": f"{name}.idx", "n_docs": len(entries), "n_tokens": tokens}
        yield pa.RecordBatch.from_pylist([row], pa.schema(
            [("shard", pa.int32()), ("records", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
        ))

    text = F.col("text").cast("string")
    order = ["doc_id", "_hash"]
    dealt = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash")).repartitionByRange(*order)
    done = dealt.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, MANIFEST)
    return saved(done).withColumn("folder", F.lit(folder))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = fs.FileSystem.from_uri(row["folder"])
            with system.open_input_stream(f"{path}/{row['index']}") as stream:
                entries = np.frombuffer(stream.read(), ENTRY)
            start, cells = row["start"], []
            with system.open_input_stream(f"{path}/{row['records']}", buffer_size=1 << 20) as stream:
                for k, entry in enumerate(entries):
                    ids = ids_of(read_frame(stream))
                    doc_id = None if entry["is_null"] else int(entry["doc_id"])
                    cells.append((doc_id, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(cells) == 4096 or k == len(entries) - 1:
                        columns = [pa.array(c, pa.int64()) for c in zip(*cells)]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        cells = []


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files of a manifest."""
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    dealt = placed.repartition(max(1, min(READERS, manifest.count())), "shard")
    return dealt.mapInArrow(_read_shards, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, ids) of every record in a seeded random order, found by seeking with the index."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["folder"])
                with system.open_input_stream(f"{path}/{row['index']}") as stream:
                    found = np.frombuffer(stream.read(), ENTRY)
                n, name = len(found), f"{row['folder']}/{row['records']}"
                ids = pa.array(found["doc_id"].astype(np.int64), mask=found["is_null"].astype(bool))
                at = pa.array(found["offset"].astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * n, pa.string()), at], names=["doc_id", "file", "offset"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_files: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part, out = batch.slice(at, GROUP), []
                for row in part.to_pylist():
                    if row["file"] not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        system, path = fs.FileSystem.from_uri(row["file"])
                        open_files[row["file"]] = system.open_input_file(path)
                    stream = open_files[row["file"]]
                    stream.seek(row["offset"])
                    out.append(ids_of(read_frame(stream)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    listed = manifest.repartition(max(1, min(READERS, manifest.count())), "shard").mapInArrow(entries, "doc_id bigint, file string, offset bigint")
    shuffled = listed.orderBy(F.xxhash64(F.lit(seed), "file", "offset"))
    return shuffled.mapInArrow(fetch, "doc_id bigint, ids array<bigint>")
