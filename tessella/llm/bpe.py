"""Byte-level BPE by prefix dynamic programming, with exact appends and local re-encoding.

The last token of the encoding of a byte prefix is unique, and dropping it leaves the encoding of a
shorter prefix. So one number per prefix holds the encodings of all prefixes: the last token of
``p`` is the vocabulary suffix ``t`` of ``p`` whose boundary with the last token of the rest is one
that merging never crosses. Appending bytes adds numbers and changes none.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .pieces import CachedEncoder, default_pattern, read_ranks, slices

#: Entries that the tables of prefixes and of token pairs hold at most.
_REMEMBERED = 300_000
_SHORT = 48
_NEVER = 1 << 62


class PrefixBpe:
    """Encodes single pieces (matches of the splitting pattern) by their prefixes' last tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._last: dict[bytes, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self._halves:
            whole, ranks = self.tokens[token], self.ranks
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                rank, i = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank >= token:
                    raise ValueError(f"token {token} isn't made by merges of lower rank")
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens at one edge of a token's merge tree, from the byte up to the token."""
        edge = [token]
        while halves := self._split(edge[-1]):
            edge.append(halves[side])
        return edge[::-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side.

        Replays the merges at the boundary in rank order: the next event is the growth of the left
        edge, that of the right edge, or a merge across. At equal rank the one further left comes first.
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            next_a = a[i + 1] if i + 1 < len(a) else _NEVER
            next_b = b[j + 1] if j + 1 < len(b) else _NEVER
            across = self.ranks.get(self.tokens[a[i]] + self.tokens[b[j]], _NEVER)
            if across < next_a and across <= next_b:
                stays = False
                break
            if next_a == next_b == _NEVER:
                stays = True
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self._fits) > _REMEMBERED:
            self._fits.clear()
        self._fits[left, right] = stays
        return stays

    def _last_of(self, prefix: bytes) -> int:
        token = self._last.get(prefix)
        if token is None:
            ranks = self.ranks
            for at in range(max(0, len(prefix) - self.longest), len(prefix)):
                token = ranks.get(prefix[at:])
                if token is not None and (not at or self.fits(self._last_of(prefix[:at]), token)):
                    break
            self._last[prefix] = token
        return token

    def last_tokens(self, piece: bytes, known: array | None = None, stop=None) -> array:
        """The last token of every non-empty prefix; ``known`` holds those that are right already."""
        last, ranks, longest, fits = array("I", known or ()), self.ranks, self.longest, self.fits
        for end in range(len(last) + 1, len(piece) + 1):
            for at in range(max(0, end - longest), end):
                token = ranks.get(piece[at:end])
                if token is not None and (not at or fits(last[at - 1], token)):
                    last.append(token)
                    break
            if stop is not None and stop(end, last):
                break
        return last

    def revise(self, old: bytes, last: array, new: bytes) -> array:
        """The table of ``new`` from that of ``old``: only positions near the edit are computed.

        Positions before the first change stand. Once as many positions in a row as the longest
        token has bytes agree with the old table, within bytes that both end with, all later ones do.
        """
        most = min(len(old), len(new))
        head = next((i for i in range(most) if old[i] != new[i]), most)
        tail = next((i for i in range(most - head) if old[-1 - i] != new[-1 - i]), most - head)
        shift, agreed = len(old) - len(new), 0

        def settled(end: int, table: array) -> bool:
            nonlocal agreed
            same = end > len(new) - tail and table[end - 1] == last[end - 1 + shift]
            agreed = agreed + 1 if same else 0
            return agreed >= self.longest

        table = self.last_tokens(new, last[:head], settled)
        return table + last[len(table) + shift :] if len(table) < len(new) else table

    def tokens_of(self, piece: bytes, last: array) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        ids, end = [], len(piece)
        while end:
            ids.append(last[end - 1])
            end -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) > _SHORT:
            return self.tokens_of(piece, self.last_tokens(piece))
        if len(self._last) > _REMEMBERED:
            self._last.clear()
        ids = []
        while piece:
            ids.append(self._last_of(piece))
            piece = piece[: -len(self.tokens[ids[-1]])]
        return ids[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EncodedText:
    """A text with its pieces and their prefix tables, which edits keep up to date."""

    def __init__(self, bpe: PrefixBpe, text: str, pattern: str | None = None):
        import regex

        self._bpe, self._pattern = bpe, regex.compile(pattern or default_pattern())
        self.text, self._starts, self._pieces, self._tables = "", [], [], []
        self.computed = 0
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [t for p, table in zip(self._pieces, self._tables) for t in self._bpe.tokens_of(p, table)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of ``text[start:end]``.

        A match depends on at most two characters behind it, so pieces that end two characters
        before the edit stay. Behind it, matching is redone until a match starts where an old piece
        started: all later pieces are the old ones.
        """
        old_starts, grown = self._starts, len(new) - (end - start)
        first = 0
        while first < len(old_starts) and old_starts[first] + len(self._pieces[first].decode()) + 2 <= start:
            first += 1
        at = old_starts[first] if first < len(old_starts) else len(self.text)
        if first == len(old_starts) and old_starts:
            first, at = first - 1, old_starts[-1]
        text = self.text[:start] + new + self.text[end:]
        later = {s + grown: k for k, s in enumerate(old_starts) if s >= end and k >= first}
        starts, pieces, tables, rest = [], [], [], len(old_starts)
        for m in self._pattern.finditer(text, at):
            if m.start() in later and m.start() >= start + len(new):
                rest = later[m.start()]
                break
            piece, k = m[0].encode(), first + len(pieces)
            if k < len(self._pieces):
                table = self._bpe.revise(self._pieces[k], self._tables[k], piece)
            else:
                table = self._bpe.last_tokens(piece)
            self.computed += 1
            starts.append(m.start())
            pieces.append(piece)
            tables.append(table)
        self._starts = old_starts[:first] + starts + [s + grown for s in old_starts[rest:]]
        self._pieces = self._pieces[:first] + pieces + self._pieces[rest:]
        self._tables = self._tables[:first] + tables + self._tables[rest:]
        self.text = text


_loaded: dict[tuple[str, str], tuple[PrefixBpe, CachedEncoder]] = {}


def _encoder(path: str, pattern: str) -> tuple[PrefixBpe, CachedEncoder]:
    """One encoder per vocabulary and worker process."""
    if (path, pattern) not in _loaded:
        import regex

        bpe, split = PrefixBpe(read_ranks(path)), regex.compile(pattern).findall

        def encode_text(text: str) -> bytes:
            return b"".join([array("I", bpe.encode(p.encode())).tobytes() for p in split(text)])

        _loaded[path, pattern] = bpe, CachedEncoder(lambda words: [encode_text(" " + w) for w in words], lambda texts: [encode_text(t) for t in texts])
    return _loaded[path, pattern]


#: Rows that are turned into ids at once within a task, fewer if their texts are long; bounds a worker's memory.
_ROWS = 512


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) for every row, and with ``decoded`` the bytes that the ids stand for.

    ``vocabulary`` is a file of base64 tokens and ranks. Each match of ``pattern`` is encoded by
    itself, without special tokens. Null and empty texts have no ids. Repeated rows stay repeated;
    other columns are not read.
    """
    pattern = pattern or default_pattern()
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _encoder(vocabulary, pattern)
        for batch in (part for b in batches for part in slices(b, 1, _ROWS)):
            ids, ends = encoder.batch(batch.column(1))
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))]
            if decoded:
                columns.append(pa.array([bpe.decode(ids[a:b].tolist()) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(encode, f"id {id_type}, ids array<int>" + ", decoded binary" * decoded)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) from arrays of ids; a null array decodes to no bytes.

    An id that the vocabulary lacks raises KeyError.
    """
    id_type = encoded.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(vocabulary, default_pattern())[0]
        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(decode, f"id {id_type}, decoded binary")


def edit_documents(docs: DataFrame, edits: DataFrame, vocabulary: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, ids) of the documents that ``edits`` (id, start, end, new) change.

    The edits of a document apply from the back, so their positions are those of the original text;
    ties go by end and then by text. An edit at the end appends. Only pieces near an edit are encoded anew.
    """
    pattern = pattern or default_pattern()
    id_type = docs.schema[id_col].dataType.simpleString()
    listed = edits.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new")), asc=False).alias("edits"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(vocabulary, pattern)[0]
        for batch in batches:
            rows = []
            for key, text, changes in zip(*(c.to_pylist() for c in batch.columns)):
                state = EncodedText(bpe, text, pattern)
                for x in changes:
                    state.replace(x["start"], x["end"], x["new"] or "")
                rows.append((key, state.text, state.ids()))
            keys, texts, ids = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["id", "text", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(listed, "id")
    return rows.mapInArrow(apply, f"id {id_type}, text string, ids array<int>")
