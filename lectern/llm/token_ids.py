"""Token ids of a public tokenizer for a whole column of texts.

A text is cut after each word, so a unit is a word with the white space before it. A
tokenizer that splits at white space never joins two units, hence each distinct unit is
encoded once and the ids are gathered by array operations. Texts with white space that the
cut does not know (no-break spaces, separators), or with the string of an added token, are
encoded in one piece by the tokenizer itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from lectern.llm import kernels

#: Distinct units that one worker remembers before it starts anew.
MEMORY = 1 << 19
_PIECES = 1 << 16
_JOINED = 1 << 13
#: Units that may be taken together: known white space and one word without any other white space.
_KNOWN_SPACE = " \t\n\x0b\x0c\r"
_UNIT = re.compile(r"[\x20\x09-\x0D]+[^\s\x1c-\x1f\x85]+")


def vocabulary_path(name: str) -> str:
    """Where the installed vocabulary files have the one of this name."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd_space(raw: np.ndarray) -> np.ndarray:
    """Positions of white space other than blanks and the controls 9 to 13."""
    found = [np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))]
    padded = np.concatenate([raw, np.zeros(2, np.uint8)])
    for lead, pairs in ((0xC2, ((0x85,), (0xA0,))), (0xE1, ((0x9A, 0x80),)), (0xE2, (*((0x80, x) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, 0x9F))), (0xE3, ((0x80, 0x80),))):
        at = np.flatnonzero(raw == lead)
        if not len(at):
            continue
        for pair in pairs:
            hit = padded[at + 1] == pair[0]
            if len(pair) > 1:
                hit &= padded[at + 2] == pair[1]
            found.append(at[hit])
    return np.concatenate(found)


class Encoder:
    """Encodes columns of texts; one lives in each Python worker and is used again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [x.encode() for x in added]
        self.has_added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self._forget()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self._learn_rule()

    def _learn_rule(self) -> None:
        """Find out how the tokenizer cuts a blank and a run of letters, with and without a mark behind."""
        cut = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(" abc.")]
        self.lead = cut[0].removesuffix("abc") if len(cut) == 2 and cut[0].endswith("abc") and cut[1] == "." else None
        self.folds = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str(" ABC") == " abc"
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self.byte_sign = {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}

    def _simple(self, unit: str) -> tuple[int, ...] | None:
        """Ids of a blank, letters, and marks behind them; None for any other unit."""
        core = unit[1:].rstrip(".,;:!?")
        if unit[0] != " " or not core.isalpha():
            return None
        tail = unit[1 + len(core) :]
        if core.isascii():
            core = core.lower() if self.folds else core
        elif self.tokenizer.normalizer is None:
            core = core.encode().decode("latin-1").translate(self.byte_sign)
        else:
            return None
        ids = self._piece(self.lead + core)
        return ids + self._piece(tail) if tail else ids

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= _PIECES:
                self.pieces.clear()
            got = self.pieces[piece] = tuple(t.id for t in self.tokenizer.model.tokenize(piece))
        return got

    def _joined(self, units: list[str]) -> tuple[list[int], np.ndarray] | None:
        """Ids of units that each are white space and one word, and how many each has."""
        text = "".join(units)
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
            begins = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 32)
            if len(begins) != len(units):
                return None
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            owner = np.searchsorted(begins, np.fromiter((at[0] for _, at in cut), np.int64, len(cut)), side="right") - 1
            if len(owner) and owner[0] < 0:
                return None
        else:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            ends = np.cumsum(np.fromiter((len(u.encode()) for u in units), np.int64, len(units)))
            upto = np.cumsum(np.fromiter((len(p) for p, _ in cut), np.int64, len(cut)))  # a character for each byte
            if not len(upto) or upto[-1] != ends[-1]:
                return None
            owner = np.searchsorted(ends, upto, side="left")
        made = [self._piece(p) for p, _ in cut]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return [i for ids in made for i in ids], np.bincount(owner, weights=sizes, minlength=len(units)).astype(np.int64)

    def _encode_units(self, units: list[str], odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in order, and how many each has; ``odd`` if some may have other white space or an added token."""
        out: list = [self._simple(u) for u in units] if self.lead is not None else [None] * len(units)
        left = [i for i, ids in enumerate(out) if ids is None]
        if odd:
            at = [i for i in left if _UNIT.fullmatch(units[i]) and not self.has_added(units[i])]
        else:
            at = [i for i in left if units[i][0] in _KNOWN_SPACE and not units[i].isspace()]
        single = sorted({*left} - {*at})
        for low in range(0, len(at), _JOINED):
            part = at[low : low + _JOINED]
            got = self._joined([units[i] for i in part])
            if got is None:
                single.extend(part)
                continue
            ids, sizes = got
            ends = np.cumsum(sizes)
            for i, a, b in zip(part, (ends - sizes).tolist(), ends.tolist(), strict=True):
                out[i] = ids[a:b]
        for i in single:
            out[i] = self._whole(units[i])
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter((x for ids in out for x in ids), np.uint32, int(sizes.sum())), sizes

    def _added_at(self, raw: np.ndarray) -> np.ndarray:
        """Where the strings of added tokens begin."""
        data, found = raw.tobytes(), []
        for content in self.added:
            at = data.find(content)
            while at >= 0:
                found.append(at)
                at = data.find(content, at + 1)
        return np.array(found, dtype=np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and end."""
        raw, offsets = kernels.text_buffer(column)
        _, ends, _ = kernels.word_ranges(raw, offsets)
        odd = np.concatenate([_odd_space(raw), self._added_at(raw)])
        if len(odd):
            bad = np.unique(np.searchsorted(offsets, odd, side="right") - 1)
            inside = np.isin(np.searchsorted(offsets, ends - 1, side="right") - 1, bad)
            ends = ends[~inside]
        closing = offsets[1:][np.diff(offsets) > 0]
        at = np.searchsorted(ends, closing)
        there = ends[np.minimum(at, len(ends) - 1)] == closing if len(ends) else np.zeros(len(closing), bool)
        ends = np.insert(ends, at[~there], closing[~there])
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
        hashes, first, unit = np.unique(kernels.segment_hashes(raw, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > MEMORY:
            self._forget()
        place = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inner = place < len(self.known)
        new[inner] = self.known[place[inner]] != hashes[inner]
        if new.any():
            low, high = starts[first[new]].tolist(), ends[first[new]].tolist()
            data = raw.tobytes()
            ids, sizes = self._encode_units([data[a:b].decode() for a, b in zip(low, high, strict=True)], len(odd) > 0)
            begin = len(self.ids) + np.cumsum(sizes) - sizes
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.start = np.concatenate([self.start, begin])[order]
            self.length = np.concatenate([self.length, sizes.astype(np.int32)])[order]
            self.ids = np.concatenate([self.ids, ids])
            place = np.searchsorted(self.known, hashes)
        entry = place[unit]
        count = self.length[entry].astype(np.int64)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        where = np.arange(total) - np.repeat(upto - count - self.start[entry], count)
        before = np.concatenate([np.zeros(1, np.int64), upto])
        return self.ids[where], before[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
