"""Token ids in sorted-string-table shards on shared storage.

A shard holds documents in ascending order of identifier::

    block*  filter  index  footer

* A block is the zlib-compressed run of entries and its restart table. An entry is ``shared u16,
  own u16, value bytes u32, own key bytes, value``: the key's first ``shared`` bytes are those of
  the entry before. Every RESTART entries a key is whole, and the block ends with the positions of
  those (u32 each) and their number (u32).
* The filter is a Bloom filter over the keys: ``bits u32, hashes u32`` and the bit bytes.
* The index has one entry per block: ``position u64, size u32, key bytes u16, first key``.
* The footer has fixed size: positions and sizes of filter and index, number of documents and of
  ids, bytes of an id, CRC-32 of filter and index, and the magic word.

All numbers are little-endian but for the key's own. A key is one byte (1, or 2 for a null
identifier, which sorts last) and the identifier in 8 bytes, offset so that bytes sort as numbers do.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import file_system, materialise, new_path, text_or_empty
from .pieces import CachedEncoder, slices

MAGIC = b"TSSTABL1"
RESTART = 16
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, HASHES = 10, 7
#: New words that go to the library as one text.
AT_ONCE = 64
_FOOTER = struct.Struct("<QQQQQQIIHI8s")


def key_of(identifier: int | None) -> bytes:
    return b"\x02" + bytes(8) if identifier is None else b"\x01" + ((identifier + (1 << 63)) % (1 << 64)).to_bytes(8, "big")


def identifier_of(key: bytes) -> int | None:
    return None if key[0] == 2 else int.from_bytes(key[1:], "big") - (1 << 63)


def _spots(key: bytes, bits: int, hashes: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Streams entries in ascending key order to a file; holds one block, the keys' hashes and the index."""

    def __init__(self, out, id_bytes: int):
        self._out, self._id_bytes = out, id_bytes
        self._at, self._index, self._keys, self._ids = 0, [], [], 0
        self._start_block()

    def _start_block(self) -> None:
        self._block, self._size, self._restarts, self._count, self._first, self._before = [], 0, [], 0, None, b""

    def add(self, identifier: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self._id_bytes):
            raise ValueError(f"id {int(ids.max())} doesn't fit in {self._id_bytes} bytes")
        key, value, before = key_of(identifier), ids.astype(f"<u{self._id_bytes}").tobytes(), self._before
        if self._keys and key < self._keys[-1]:
            raise ValueError("identifiers have to come in ascending order")
        shared = 0
        if self._count % RESTART == 0:
            self._restarts.append(self._size)
        else:
            shared = next((i for i in range(len(key)) if key[i] != before[i]), len(key))
        entry = struct.pack("<HHI", shared, len(key) - shared, len(value)) + key[shared:] + value
        self._first = self._first or key
        self._block.append(entry)
        self._size += len(entry)
        self._count += 1
        self._before = key
        self._keys.append(key)
        self._ids += len(ids)
        if self._size >= BLOCK_BYTES:
            self._end_block()

    def _write(self, data: bytes) -> tuple[int, int]:
        self._out.write(data)
        self._at += len(data)
        return self._at - len(data), len(data)

    def _end_block(self) -> None:
        if self._count:
            restarts = struct.pack(f"<{len(self._restarts) + 1}I", *self._restarts, len(self._restarts))
            at, size = self._write(zlib.compress(b"".join(self._block) + restarts, 1))
            self._index.append(struct.pack("<QIH", at, size, len(self._first)) + self._first)
        self._start_block()

    def close(self) -> tuple[int, int]:
        """Write what is left; the number of documents and of ids."""
        self._end_block()
        bits = max(64, len(self._keys) * BITS_PER_KEY)
        table = bytearray(bits // 8 + 1)
        for key in self._keys:
            for s in _spots(key, bits, HASHES):
                table[s >> 3] |= 1 << (s & 7)
        bloom, index = struct.pack("<II", bits, HASHES) + bytes(table), b"".join(self._index)
        spans = (*self._write(bloom), *self._write(index))
        self._write(_FOOTER.pack(*spans, len(self._keys), self._ids, len(self._index), 0, self._id_bytes, zlib.crc32(bloom + index), MAGIC))
        return len(self._keys), self._ids


class ShardReader:
    """Looks a document up by binary search, or reads all of them in order, block by block."""

    def __init__(self, file, size: int):
        self._file = file
        file.seek(size - _FOOTER.size)
        bloom_at, bloom_size, index_at, index_size, self.documents, self.ids, blocks, _, self._id_bytes, crc, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token table")
        file.seek(bloom_at)
        bloom, index = file.read(bloom_size), file.read(index_size)
        if zlib.crc32(bloom + index) != crc:
            raise ValueError("the table's filter or index is damaged")
        self._bits, self._hashes = struct.unpack_from("<II", bloom)
        self._bloom, self._firsts, self._spans, at = bloom[8:], [], [], 0
        for _ in range(blocks):
            where, length, key_bytes = struct.unpack_from("<QIH", index, at)
            self._firsts.append(index[at + 14 : at + 14 + key_bytes])
            self._spans.append((where, length))
            at += 14 + key_bytes

    def _block(self, k: int) -> tuple[bytes, tuple[int, ...], int]:
        at, size = self._spans[k]
        self._file.seek(at)
        data = zlib.decompress(self._file.read(size))
        n = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * n
        return data, struct.unpack_from(f"<{n}I", data, end), end

    def _entries(self, data: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, own, size = struct.unpack_from("<HHI", data, at)
            key = key[:shared] + data[at + 8 : at + 8 + own]
            at += 8 + own
            yield key, np.frombuffer(data, f"<u{self._id_bytes}", size // self._id_bytes, at)
            at += size

    def may_hold(self, identifier: int | None) -> bool:
        return all(self._bloom[s >> 3] >> (s & 7) & 1 for s in _spots(key_of(identifier), self._bits, self._hashes))

    def get(self, identifier: int | None) -> list[np.ndarray]:
        """The ids of every document of this identifier."""
        found, key = [], key_of(identifier)
        if not self.may_hold(identifier):
            return found
        for k in range(max(0, bisect_left(self._firsts, key) - 1), bisect_right(self._firsts, key)):
            data, restarts, end = self._block(k)

            def whole(r: int) -> bytes:
                return data[restarts[r] + 8 : restarts[r] + 8 + struct.unpack_from("<H", data, restarts[r] + 2)[0]]

            start = max(0, bisect_left(range(len(restarts)), key, key=whole) - 1)
            for other, ids in self._entries(data, restarts[start], end):
                if other > key:
                    break
                if other == key:
                    found.append(ids)
        return found

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self._spans)):
            data, _, end = self._block(k)
            for key, ids in self._entries(data, 0, end):
                yield identifier_of(key), ids


class WholeTextEncoder:
    """Encodes texts that hold one of ``strings`` as wholes, and all others by ``cached``."""

    def __init__(self, cached: CachedEncoder, strings: list[str], encode_text: Callable[[str], np.ndarray]):
        self._cached, self._strings, self._encode_text = cached, strings, encode_text

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``CachedEncoder.batch``."""
        whole = np.zeros(len(texts), bool)
        for s in self._strings:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._cached.batch(texts)
        ids, ends = self._cached.batch(pc.if_else(pa.array(whole), "", texts))
        parts = [ids[a:b] for a, b in zip(ends, ends[1:])]
        for k in np.flatnonzero(whole).tolist():
            parts[k] = self._encode_text(texts[k].as_py())
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


_loaded: dict[tuple[str, bool], CachedEncoder | WholeTextEncoder] = {}


def library_encoder(path: str, added_tokens: bool = False) -> CachedEncoder | WholeTextEncoder:
    """An encoder that asks the tokenizers library for new words and odd texts; one per worker process.

    The file has to hold a byte-level vocabulary, each of whose token's characters stands for one
    byte. New words go to the library as short texts, whose ids are dealt out by their tokens' lengths.
    Strings of special tokens in a text are ordinary text, unless ``added_tokens`` is set: then the
    strings of all added tokens become their ids, as by the library's default.
    """
    if (path, added_tokens) not in _loaded:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        vocabulary = library.get_vocab()
        lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            lengths[i] = len(token)

        def encode_text(text: str) -> np.ndarray:
            return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

        def encode_words(words: list[str]) -> list[bytes]:
            texts = [" " + " ".join(words[at : at + AT_ONCE]) for at in range(0, len(words), AT_ONCE)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in library.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64) + 1)
            at = np.cumsum(lengths[ids])
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                raise ValueError("a token reaches across words; the vocabulary isn't byte-level")
            data, cuts = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
            return [data[a:b] for a, b in zip(cuts, cuts[1:])]

        def encode_texts(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

        encoder = CachedEncoder(encode_words, encode_texts)
        if added_tokens:

            def encode_whole(text: str) -> np.ndarray:
                library.encode_special_tokens = False
                try:
                    return encode_text(text)
                finally:
                    library.encode_special_tokens = True

            strings = [t.content for t in library.get_added_tokens_decoder().values()]
            encoder = WholeTextEncoder(encoder, strings, encode_whole)
        _loaded[path, added_tokens] = encoder
    return _loaded[path, added_tokens]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 2, added_tokens: bool = False) -> DataFrame:
    """Encode all texts, write them as shards in ``folder`` and return the manifest.

    The manifest has shard, path, documents and ids, in ascending order of shard; shard k holds
    smaller identifiers than shard k+1. Rows are dealt by ranges of (identifier, text hash), so that
    a repeated or null identifier doesn't fill one task. Null texts count as empty: they get the
    end id only. Repeated rows are all written, those of one identifier in order of the text's hash.
    ``added_tokens`` is that of ``library_encoder``.
    A retried task writes the same file again under the same name. Identifiers that aren't whole
    numbers raise ValueError, and so does an id that doesn't fit ``id_bytes``. Other columns are not read.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"the identifiers in {id_col} aren't whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("order", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_last(), F.col("order")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encoder, shard = library_encoder(tokenizer, added_tokens), TaskContext.get().partitionId()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        path = f"shard-{shard:06d}.sst"
        part = f"{base}/{path}.{uuid.uuid4().hex}"
        end, wrote = np.array([end_id], "<u4"), None
        for batch in batches:
            if batch.num_rows and wrote is None:
                out = fs.open_output_stream(part)
                wrote = ShardWriter(out, id_bytes)
            for some in slices(batch, 1):
                ids, ends = encoder.batch(some.column(1))
                for identifier, a, b in zip(some.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    wrote.add(identifier, np.concatenate((ids[a:b], end)))
        if wrote is not None:
            documents, ids = wrote.close()
            out.close()
            fs.move(part, f"{base}/{path}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{path}"], "documents": [documents], "ids": [ids]})

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = dealt.mapInArrow(write, "shard long, path string, documents long, ids long")
    return materialise(written, "manifest").orderBy("shard")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the files of a manifest.

    ``start`` is the number of ids of all documents before it. The manifest has a row per file and
    is added up on the driver, which holds numbers of files and nothing of documents.
    """
    files = [(r.path, r.ids) for r in manifest.orderBy("shard").select("path", "ids").collect()]
    starts = np.cumsum([0, *(n for _, n in files)]).tolist()
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = file_system(path)
                rows = []
                with fs.open_input_file(name) as f:
                    for identifier, ids in ShardReader(f, f.size()):
                        rows.append((identifier, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    if not files:
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long")
    listed = spark.createDataFrame([(p, s) for (p, _), s in zip(files, starts)], "path string, start long")
    return listed.repartition(len(files)).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, identifiers: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids of a few documents, by filter and binary search in each shard (a driver-side tool)."""
    found: dict = {i: [] for i in identifiers}
    for row in manifest.select("path").collect():
        fs, name = file_system(row.path)
        with fs.open_input_file(name) as f:
            reader = ShardReader(f, f.size())
            for i in identifiers:
                found[i] += [ids.copy() for ids in reader.get(i)]
    return found


def token_tables(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write the shards to a new folder of shared storage and read them back; see the two steps."""
    return read_shards(write_shards(docs, new_path(docs.sparkSession, "token-tables"), tokenizer, end_id, **options))
