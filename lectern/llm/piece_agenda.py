"""Encoding and decoding with a SentencePiece vocabulary of merge type.

A unit's symbols are its characters at first. Its agenda holds every pair of adjacent symbols
whose join is a piece, by the piece's score, then by place; the head of the agenda is merged and
its neighbours' entries are renewed, until no entry is left. Characters that are no piece become
bytes. Short units of a batch go in step: each round takes the head of each unit's agenda by array
operations. Longer units have an agenda of their own, a heap.

A text is cut into units before each blank that follows another character: where no piece has a
blank behind another character, no merge crosses such a cut, so each distinct unit is encoded once
and remembered within bounds. A vocabulary with such a piece is not cut. Every unit that a worker
meets anew is compared with the library, in the Arrow batch that brings it; a difference is an error.

Defined results: a null text is an empty one and has no ids. U+2581 is a blank, as in the library,
and comes back as one. Rows that repeat each have their own result; other columns stay as they are,
but for one named ``ids``, which is replaced, and ``text`` in decoding. An empty table gives an
empty result. A text of any length is handled in parts of about ``PART`` bytes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import kernels

PART = 1 << 20
#: Symbols of the longest unit that goes in step with others.
IN_STEP = 48
#: Distinct units that one worker remembers before it starts anew.
MEMORY = 1 << 19
#: Ids that the library decodes at once.
DECODED = 1 << 18
_BLANK = "▁"
_NEVER = np.int64(1 << 62)
_PLACES = np.int64(1 << 40)


class Vocabulary:
    """Pieces, the joins of two pieces that are pieces, and the units met so far; one lives in each worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        apart = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        if any(self.library.is_unused(i) for i in range(size)):
            raise ValueError("a vocabulary with unused pieces is not of the kind that merges decide alone")
        self.size = size
        self.pieces = {self.library.id_to_piece(i): i for i in range(size) if not apart[i]}
        scores = np.array([self.library.get_score(i) for i in range(size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.byte = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.unknown = self.library.unk_id()
        self.bytes_known = bool(all(apart[i] and i != self.unknown for i in self.byte.tolist()))
        self.cuts = not any(a != _BLANK and b == _BLANK for p in self.pieces for a, b in zip(p, p[1:], strict=False))
        joins = {}
        for piece, i in self.pieces.items():
            for k in range(1, len(piece)):
                left, right = self.pieces.get(piece[:k]), self.pieces.get(piece[k:])
                if left is not None and right is not None:
                    joins[left * size + right] = i
        self.joins = joins
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ids = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)
        chars = sorted((ord(p), i) for p, i in self.pieces.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in chars], np.int64)
        self.char_ids = np.array([i for _, i in chars], np.int64)
        self.leads = np.zeros(size, bool)
        self.leads[[i for p, i in self.pieces.items() if p.startswith(_BLANK)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two adjacent symbols make, -1 if none; symbols below 0 are characters without a piece."""
        if not len(self.join_keys):
            return np.full(len(left), -1, np.int64)
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
        return np.where(self.join_keys[at] == key, self.join_ids[at], -1)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """A piece for each character, or the character itself as a number below 0."""
        if not len(self.chars):
            return -1 - points
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, self.char_ids[at], -1 - points)

    def _in_step(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of many units, one after another, when no agenda has an entry; and how many symbols each has."""
        units = len(sizes)
        owner = np.repeat(np.arange(units), sizes)
        out_symbols, out_owner = [], []
        joined = np.full(len(symbols), -1, np.int64)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        joined[inner] = self._joined(symbols[inner], symbols[inner + 1])
        while len(symbols):
            entry = np.where(joined >= 0, self.rank[joined] * _PLACES + np.arange(len(symbols)), _NEVER)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            head = np.minimum.reduceat(entry, first)
            going = head != _NEVER
            if not going.all():
                stays = np.repeat(going, np.diff(np.append(first, len(symbols))))
                out_symbols.append(symbols[~stays])
                out_owner.append(owner[~stays])
                moved = np.cumsum(stays) - 1
                symbols, owner, joined = symbols[stays], owner[stays], joined[stays]
                at = moved[head[going] % _PLACES]
            else:
                at = head % _PLACES
            symbols[at] = joined[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            symbols, owner, joined = symbols[keep], owner[keep], joined[keep]
            joined[at] = -1
            behind = at[at + 1 < len(symbols)]
            behind = behind[owner[behind] == owner[behind + 1]]
            joined[behind] = self._joined(symbols[behind], symbols[behind + 1])
            ahead = at[at > 0]
            ahead = ahead[owner[ahead - 1] == owner[ahead]] - 1
            joined[ahead] = self._joined(symbols[ahead], symbols[ahead + 1])
        if not out_owner:
            return symbols, np.zeros(units, np.int64)
        symbols, owner = np.concatenate(out_symbols), np.concatenate(out_owner)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=units)

    def _by_heap(self, symbols: list[int]) -> list[int]:
        """What is left of one unit of any length."""
        n, joins, rank, size = len(symbols), self.joins, self.rank, self.size
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def note(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and symbols[i] >= 0 and symbols[j] >= 0:
                piece = joins.get(symbols[i] * size + symbols[j])
                if piece is not None:
                    heapq.heappush(agenda, (int(rank[piece]), i, j, symbols[i], symbols[j], piece))

        gone = bytearray(n)
        for i in range(n - 1):
            note(i)
        while agenda:
            _, i, j, a, b, piece = heapq.heappop(agenda)
            if gone[i] or gone[j] or after[i] != j or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = piece
            gone[j] = 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            note(before[i])
            note(i)
        return [s for s, x in zip(symbols, gone, strict=True) if not x]

    def _final(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the symbols: characters without a piece are bytes, or the unknown piece where the vocabulary has no bytes."""
        bare = np.flatnonzero(symbols < 0)
        if not len(bare):
            return symbols.astype(np.int32), sizes
        made = [self.byte[list(chr(-1 - s).encode())] if self.bytes_known else np.array([self.unknown]) for s in symbols[bare].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[bare] = [len(x) for x in made]
        upto = np.cumsum(width)
        out = np.empty(int(upto[-1]), np.int32)
        single = symbols >= 0
        out[upto[single] - 1] = symbols[single]
        for at, ids in zip((upto - width)[bare].tolist(), made, strict=True):
            out[at : at + len(ids)] = ids
        ends = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(sizes)])]
        return out, np.diff(ends)

    def _encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that each begin with a blank, compared with the library's."""
        text = b"".join(units).decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 32] = ord(_BLANK)
        symbols = self._symbols(points)
        heads = np.frombuffer(b"".join(units), np.uint8) & 0xC0 != 0x80
        counted = np.concatenate([[0], np.cumsum(heads)])
        ends = counted[np.cumsum([0, *map(len, units)])]
        sizes = np.diff(ends)
        long = np.flatnonzero(sizes > IN_STEP)
        if len(long):
            short = sizes <= IN_STEP
            some, some_sizes = self._in_step(symbols[np.repeat(short, sizes)], sizes[short])
            begins = np.concatenate([[0], np.cumsum(some_sizes)])
            parts, left, s = [], np.zeros(len(units), np.int64), 0
            for i in range(len(units)):
                if short[i]:
                    part = some[begins[s] : begins[s + 1]]
                    s += 1
                else:
                    part = np.array(self._by_heap(symbols[ends[i] : ends[i + 1]].tolist()), np.int64)
                parts.append(part)
                left[i] = len(part)
            symbols, sizes = np.concatenate(parts), left
        else:
            symbols, sizes = self._in_step(symbols, sizes)
        ids, sizes = self._final(symbols, sizes)
        theirs = self.library.encode([u[1:].decode() if len(u) > 1 else "" for u in units], num_threads=1)
        at = np.cumsum(sizes) - sizes
        lone = [i for i, u in enumerate(units) if len(u) == 1]  # the library has no such text; its one id is that of the blank
        for i in lone:
            theirs[i] = ids[at[i] : at[i] + sizes[i]].tolist()
        if np.fromiter((x for t in theirs for x in t), np.int32).tobytes() != ids.tobytes() or any(len(t) != n for t, n in zip(theirs, sizes.tolist(), strict=True)):
            wrong = next(u for u, t, a, n in zip(units, theirs, at.tolist(), sizes.tolist(), strict=True) if ids[a : a + n].tolist() != t)
            raise ValueError(f"the library encodes {wrong[:200]!r} otherwise")
        return ids, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and end."""
        texts = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), _BLANK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        raw, offsets = kernels.text_buffer(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        blank = raw == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        if not self.cuts:
            begins[:] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        hashes, first, unit = np.unique(kernels.segment_hashes(raw, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > MEMORY:
            self._forget()
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inner = place < len(self.known)
        new[inner] = self.known[place[inner]] != hashes[inner]
        if new.any():
            data = raw.tobytes()
            ids, sizes = self._encode_units([data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])[order]
            self.length = np.concatenate([self.length, sizes])[order]
            self.ids = np.concatenate([self.ids, ids])
            place = np.searchsorted(self.known, hashes)
        entry = place[unit]
        count = self.length[entry]
        upto = np.cumsum(count)
        where = np.arange(int(upto[-1])) - np.repeat(upto - count - self.start[entry], count)
        return self.ids[where], np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of one text, cut into parts before blanks. Each part but the first drops its first blank, which encoding sets again."""
        parts, low = [], 0
        while self.cuts and len(text) - low > PART:
            cut = low + PART
            while cut < len(text) and not (text[cut] in (" ", _BLANK) and text[cut - 1] not in (" ", _BLANK)):
                cut += 1
            if cut + 1 >= len(text):
                break
            parts.append(text[low:cut])
            low = cut + 1
        ids = [self.encode(pa.array([p]))[0] for p in [*parts, text[low:]]]
        return np.concatenate(ids)

    def decode(self, ids: np.ndarray) -> str:
        """The library's text, asked for in parts that begin with a piece that begins with a blank."""
        parts, low = [], 0
        while len(ids) - low > DECODED:
            found = np.flatnonzero(self.leads[ids[low + DECODED :]])
            if not len(found):
                break
            parts.append(self.library.decode(ids[low : low + DECODED + found[0]].tolist()))
            low += DECODED + int(found[0])
        parts.append(self.library.decode(ids[low:].tolist()))
        return " ".join(parts)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of a file."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a column in place of one of that name, else as the last."""
    at = batch.schema.get_field_index(name)
    return batch.append_column(name, values) if at < 0 else batch.set_column(at, name, values)


def _schema(frame: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The frame's columns, one of them replaced or added."""
    field = T.StructField(name, kind)
    fields = [field if f.name == name else f for f in frame.schema]
    return T.StructType(fields if name in frame.columns else [*fields, field])


def encode(documents: DataFrame, path: str) -> DataFrame:
    """The documents with a column ``ids``: those of the whole text, without begin or end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in kernels.blocks(batches, "text"):
            column = batch.column(batch.schema.get_field_index("text"))
            if batch.num_rows == 1 and len(column[0].as_py() or "") > PART:
                ids = words.encode_long(column[0].as_py())
                at = np.array([0, len(ids)])
            else:
                ids, at = words.encode(column)
            yield _replaced(batch, "ids", pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))

    return documents.mapInArrow(run, _schema(documents, "ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str, name: str = "text") -> DataFrame:
    """The rows with the library's text of their column ``ids``; null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            flat, at = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
            rows = [(int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield _replaced(batch, name, pa.array([words.decode(flat[a:b]) for a, b in rows], pa.string()))

    return encoded.mapInArrow(run, _schema(encoded, name, T.StringType()))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Ids and the text they decode to, as counts and SHA-256 sums."""
    encoded = encode(documents.select("doc_id", "text"), path).select("doc_id", "ids")
    both = decode(encoded, path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
