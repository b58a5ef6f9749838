"""Cached encoding of whole texts, piece by piece, for byte-level vocabularies."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker's table remembers at most, with up to eight ids each on average, and the length of the longest.
REMEMBERED, LONGEST_REMEMBERED = 600_000, 40


def vocabulary_path(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def slices(batch: pa.RecordBatch, text: int, rows: int = 2048, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of up to ``rows`` rows and ``size`` bytes of text; a longer text is a part by itself."""
    ends, at = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < batch.num_rows:
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = min(max(most, at + 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


class CachedEncoder:
    """Ids of texts as unsigned 32-bit numbers, with common words remembered.

    A text is cut before each single space that a visible character follows. No match of a byte-level
    splitting pattern reaches across such a place, so these words have ids of their own, and each
    different word of a batch is looked up once. ``encode_words`` maps a list of words, each behind a
    space, to their ids as little-endian strings; ``encode_texts`` takes texts as wholes, which is
    for those in which spaces stand otherwise, and for what comes before the first space. The table of
    words is Arrow and numpy arrays, a few tens of bytes a word. When it is full, the half that was met last
    stays.
    """

    #: A space before any white space of Unicode, or at the end.
    _gap = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], encode_texts: Callable[[list[str]], list[bytes]]):
        self._encode_words, self._encode_texts = encode_words, encode_texts
        self._words, self._table, self._sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)
        self._used, self._round = np.zeros(0, np.int64), 0

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, sizes, places) of different words: the ids of word i are the slice of number ``places[i]``."""
        places = pc.index_in(words, value_set=self._words).fill_null(-1).to_numpy().astype(np.int64)
        self._round += 1
        self._used[places[places >= 0]] = self._round
        missing = np.flatnonzero(places < 0)
        unknown = words.take(pa.array(missing))
        parts = self._encode_words(unknown.to_pylist()) if len(missing) else []
        if len(parts) != len(missing):
            raise ValueError("as many words have to come back as went in")
        places[missing] = len(self._words) + np.arange(len(missing))
        table = np.concatenate((self._table, np.frombuffer(b"".join(parts), "<u4")))
        sizes = np.concatenate((self._sizes, np.fromiter(map(len, parts), np.int64, len(parts)) // 4))
        if len(missing):
            self._remember(pa.concat_arrays([self._words, unknown]), table, sizes)
        return table, sizes, places

    def _remember(self, words: pa.Array, table: np.ndarray, sizes: np.ndarray) -> None:
        used = np.concatenate((self._used, np.full(len(words) - len(self._used), self._round)))
        keep = np.flatnonzero(pc.utf8_length(words).to_numpy() <= LONGEST_REMEMBERED)
        if len(keep) > REMEMBERED or sizes[keep].sum() > 8 * REMEMBERED:
            keep = keep[np.argsort(-used[keep], kind="stable")][: REMEMBERED // 2]
            keep = keep[np.cumsum(sizes[keep]) <= 4 * REMEMBERED]
        if len(keep) < len(words):
            starts = np.cumsum(sizes) - sizes
            table = table[np.repeat(starts[keep] - np.cumsum(sizes[keep]) + sizes[keep], sizes[keep]) + np.arange(sizes[keep].sum())]
            words, sizes, used = words.take(pa.array(keep)), sizes[keep], used[keep]
        self._words, self._table, self._sizes, self._used = words, table, sizes, used

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins and the last ends) of a string array without nulls."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = pc.match_substring_regex(texts, self._gap)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets, words = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py(), split.flatten()
        heads = pc.if_else(odd, texts, words.take(pa.array(offsets[:-1])))
        different = words.dictionary_encode()
        codes = different.indices.to_numpy().astype(np.int64)
        table, sizes, places = self._ids(different.dictionary.cast(pa.string()))
        codes = places[codes]
        codes[offsets[:-1]] = np.arange(len(sizes), len(sizes) + len(texts))
        parts = self._encode_texts(heads.to_pylist())
        table = np.concatenate((table, np.frombuffer(b"".join(parts), "<u4")))
        sizes = np.concatenate((sizes, np.fromiter(map(len, parts), np.int64, len(parts)) // 4))
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        kind = np.int32 if ends[-1] < 2**31 and len(table) < 2**31 else np.int64
        ids = table[np.repeat((starts[codes] - ends[:-1]).astype(kind), lengths) + np.arange(ends[-1], dtype=kind)]
        return ids, ends[offsets]
