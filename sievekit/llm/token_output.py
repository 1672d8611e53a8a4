"""Token-ID / binary output: length-delimited records with masked checksums
and a separate offset index.

File format, one file per range of doc_ids, in ascending order of doc_id:
    record = u64 length of the payload, u32 masked crc32 of those 8 bytes,
             payload, u32 masked crc32 of the payload   (all little-endian)
    payload = the ids of a document as unsigned 16- or 32-bit integers, the
              end id last; the width is in the file's 16-byte header.
    mask(c) = rotate right by 15, plus 0xA282EAD8, modulo 2^32.
The index is a Parquet table (file_no, record_no, doc_id, byte_offset, n_bytes,
n_tokens, start), so any record can be read by itself, in any order.

There is a file for about ``FILE_BYTES`` of texts, so files and tasks grow with
the input and no file grows beyond a task's share.

Encoding: a text is cut where ASCII white space follows a character that is
not white space, and where an ASCII mark follows an ASCII letter or digit. The pre-tokenizer always cuts there, so the text's ids are
the ids of its chunks in order; chunks repeat, so each distinct one is encoded
once by a worker's tokenizer, kept by two 64-bit hashes in a bounded table, and
its ids are gathered for all places. A slice in which two chunks have one key
and differ in the second hash is encoded text by text.

A task writes its file under a name of its own attempt and renames it, so a
lost executor's repeated task replaces the file by an equal one.

Cases: null and empty texts hold the end id alone; a null doc_id sorts first;
rows with equal doc_id are ordered by text; rows that repeat are written each;
an empty table gives no files and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.stage import checkpoint_stage
from .arrays import ASCII_SPACE, buffers, gather, prefix, slices, span_hash

HEADER = b"SIEVEIDS"
CACHE_BYTES = 32 << 20
SLICE = 1 << 20
FILE_BYTES = 32 << 20
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def mask(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, mask(zlib.crc32(head)).to_bytes(4, "little"), payload, mask(zlib.crc32(payload)).to_bytes(4, "little")))


def unframe(record: bytes) -> bytes:
    """The payload; ValueError if lengths or checksums do not fit."""
    head, check = record[:8], record[8:12]
    payload, last = record[12:-4], record[-4:]
    if mask(zlib.crc32(head)).to_bytes(4, "little") != check or int.from_bytes(head, "little") != len(payload):
        raise ValueError("record length is damaged")
    if mask(zlib.crc32(payload)).to_bytes(4, "little") != last:
        raise ValueError("record payload is damaged")
    return payload


ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
MARK = np.zeros(256, bool)
MARK[0x21:0x7F] = True
MARK &= ~ALNUM
MARK[0x27] = False


def chunk_starts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray = MARK) -> np.ndarray:
    """Starts of the chunks: rows' starts, ASCII white space after a character
    that no regex engine counts as white space, and ASCII marks (but for the
    apostrophe of contractions) after an ASCII letter or digit."""
    space = ASCII_SPACE[data]
    p1, p2, p3 = (np.concatenate([np.zeros(k, np.uint8), data])[:len(data)] for k in (1, 2, 3))
    # separators beyond ASCII end in these bytes: C2 85, C2 A0, E1 9A 80, E2 80 xx, E2 81 9F, E3 80 80
    other = ((p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))) | ((p3 >= 0xE1) & (p3 <= 0xE3) & np.isin(p2, [0x9A, 0x80, 0x81])) | (p1 < 0x21)
    cut = (space & ~other) | (marks[data] & ALNUM[p1])
    first = offsets[:-1][np.diff(offsets) > 0]
    cut[first] = True
    return np.flatnonzero(cut)


#: Bytes that a plain chunk has none of after its first: controls, white space,
#: and the lead bytes of the separators beyond ASCII.
NOT_PLAIN = np.zeros(256, bool)
NOT_PLAIN[:0x21] = True
NOT_PLAIN[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Another order of the bytes' values, for the second hash.
SHUFFLED = (np.arange(256) * 167 + 91 & 255).astype(np.uint8)


class ChunkEncoder:
    """Encodes slices of texts; distinct chunks are encoded once and kept.

    Plain chunks (at most one space, then no white space) go to the tokenizer
    in long texts, joined by line ends: the pre-tokenizer takes a line end
    before a space or a word as a token of its own, so the ids are split at its
    id. Other chunks are encoded one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.marks = MARK.copy()  # no cut within the strings of added tokens
        for added in self.tok.get_added_tokens_decoder().values():
            self.marks[list(added.content.encode())] = False
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.line = ids("\n")
        self.joins = len(self.line) == 1 and ids("a1\n b!\nc\n,d") == ids("a1") + self.line + ids(" b!") + self.line + ids("c") + self.line + ids(",d")
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.second = np.zeros(0, np.uint64)  # another hash of each key's chunk
        self.place = np.zeros(0, np.int64)  # of each key, among the rows of (table, bounds)
        self.table, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.second, self.place, self.table, self.bounds))

    def whole(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the rows, each encoded as it stands."""
        return self._encode_single(data, offsets[:-1], offsets[1:])

    def _encode_joined(self, data, start, end) -> tuple[np.ndarray, np.ndarray]:
        size = end - start
        at = np.cumsum(size + 1)
        out = np.full(at[-1], 10, np.uint8)
        inside = np.ones(at[-1], bool)
        inside[at - 1] = False
        out[inside] = data[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)]
        # texts of about 64 KB, cut after a line end
        cuts = np.unique(np.append(np.searchsorted(at, np.arange(65536, at[-1], 65536)), len(at) - 1))
        raw, lo, texts = out.tobytes(), 0, []
        for c in cuts:
            texts.append(raw[lo:at[c]].decode("utf-8", "replace"))
            lo = at[c]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
        stop = np.flatnonzero(ids == self.line[0])
        if len(stop) != len(size):
            raise ValueError("a line end was not a token of its own")
        return ids[ids != self.line[0]], np.append(0, stop - np.arange(len(stop)))

    def _encode_single(self, data, start, end) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist())]
        own = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(own), np.append(0, np.cumsum([len(x) for x in own]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the rows."""
        start = chunk_starts(data, offsets, self.marks)
        end = np.append(start[1:], len(data))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        one = span_hash(prefix(data), start, end)
        two = span_hash(prefix(SHUFFLED[data]), start, end)
        key, first, which = np.unique(one, return_index=True, return_inverse=True)
        if self.held() > CACHE_BYTES:
            self.clear()
        at = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            new = self.keys[near] != key
            if (self.second[near] != two[first])[~new].any():
                return self.whole(data, offsets)
        if (two != two[first][which]).any():
            return self.whole(data, offsets)
        if new.any():
            s, e = start[first[new]], end[first[new]]
            odd = np.append(0, np.cumsum(NOT_PLAIN[data]))
            plain = (odd[e] == odd[s + 1]) & ((data[s] == 0x20) & (e - s > 1) | ~NOT_PLAIN[data[s]])
            if not self.joins:
                plain[:] = False
            place = np.zeros(len(s), np.int64)
            for group, encode in ((plain, self._encode_joined), (~plain, self._encode_single)):
                if group.any():
                    ids, bounds = encode(data, s[group], e[group])
                    place[group] = len(self.bounds) - 1 + np.arange(len(bounds) - 1)
                    self.bounds = np.append(self.bounds, bounds[1:] + len(self.table))
                    self.table = np.append(self.table, ids)
            # new keys are sorted among themselves and go to their places
            self.keys, self.second, self.place = (
                np.insert(have, at[new], more) for have, more in ((self.keys, key[new]), (self.second, two[first[new]]), (self.place, place)))
        rows = self.place[np.searchsorted(self.keys, key)]
        ids, chunk_bounds = gather(self.table, self.bounds, rows[which])
        return ids, chunk_bounds[np.searchsorted(start, offsets)]


def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of this Python worker, kept over its tasks (functions are
    pickled by value, so a global of this module would not last)."""
    kept = sys.__dict__.setdefault("_sievekit_encoders", {})
    if path not in kept:
        kept.clear()
        kept[path] = ChunkEncoder(path)
    return kept[path]


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _writer(tokenizer: str, folder: str, end_id: int):
    def write(batches):
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        where, path = _filesystem(folder)
        no = TaskContext.get().partitionId()
        part = f"{path}/.part-{no:06d}-{uuid.uuid4().hex}"
        out, coder, offset, start, record = None, worker_encoder(tokenizer), 16, 0, 0
        dtype = np.dtype("<u2" if coder.width == 2 else "<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = where.open_output_stream(part)
                out.write(HEADER + coder.width.to_bytes(8, "little"))
            data, offsets = buffers(batch.column("text"))
            rows = []
            for a, b in slices(offsets, SLICE):
                piece = data[offsets[a]:offsets[b]]
                ids, bounds = coder.encode(piece, offsets[a:b + 1] - offsets[a])
                ids = ids.astype(dtype)
                for r in range(b - a):
                    payload = ids[bounds[r]:bounds[r + 1]].tobytes() + int(end_id).to_bytes(coder.width, "little")
                    rec = frame(payload)
                    out.write(rec)
                    n = len(payload) // coder.width
                    rows.append((record, offset, len(rec), n, start))
                    record, offset, start = record + 1, offset + len(rec), start + n
            cols = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), no, np.int64)), pa.array(cols[0]), batch.column("doc_id"), *(pa.array(c) for c in cols[1:])], names=INDEX_NAMES)
        if out is not None:
            out.close()
            where.move(part, f"{path}/part-{no:06d}.ids")
    return write


INDEX_NAMES = ["file_no", "record_no", "doc_id", "byte_offset", "n_bytes", "n_tokens", "start_in_file"]
INDEX = "file_no long, record_no long, doc_id long, byte_offset long, n_bytes long, n_tokens long, start_in_file long"


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, n_files: int | None = None) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and the index with the global
    ``start``. The texts are shuffled once, by ranges of doc_id."""
    spark = docs.sparkSession
    folder = shared_path(spark, "token_ids")
    where, path = _filesystem(folder)
    where.create_dir(path)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # files of about FILE_BYTES, and work for all cores
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    n = n_files or max(spark.sparkContext.defaultParallelism, -(-(src.agg(size.alias("s")).first()["s"] or 0) // FILE_BYTES))
    # rows of one doc_id may lie in one range only, so the order holds over all files
    dealt = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    index = checkpoint_stage(dealt.mapInArrow(_writer(tokenizer or tokenizer_path(), folder, end_id), INDEX), "token_index")
    # one row per file: bounded by the number of files
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("file_no", F.coalesce(F.sum("_n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return folder, index.join(before, "file_no").withColumn("start", F.col("start_in_file") + F.col("_before")).drop("start_in_file", "_before")


def _reader(folder: str):
    def read(batches):
        where, path = _filesystem(folder)
        at, file, width = None, None, 2
        for batch in batches:
            crcs, counts = [], []
            for no, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file_no", "byte_offset", "n_bytes"))):
                if at != no:
                    if file is not None:
                        file.close()
                    at, file = no, where.open_input_file(f"{path}/part-{no:06d}.ids")
                    head = file.read(16)
                    if head[:8] != HEADER:
                        raise ValueError(f"{path}/part-{no:06d}.ids is no file of token ids")
                    width = int.from_bytes(head[8:], "little")
                file.seek(offset)
                ids = np.frombuffer(unframe(file.read(size)), "<u2" if width == 2 else "<u4")
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return read


def read_tokens(folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files, by the index."""
    return (index.sortWithinPartitions("file_no", "byte_offset")
            .select("doc_id", "start", "file_no", "byte_offset", "n_bytes")
            .mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_output(docs: DataFrame) -> DataFrame:
    folder, index = write_tokens(docs)
    return read_tokens(folder, index)


def op6_token_output(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def write_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' ids written and read back."""
    return token_output(docs.select("doc_id", "text"))
