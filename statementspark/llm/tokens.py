"""Encoding Arrow string columns with a public tokenizer, each distinct unit of text once.

A text is cut before every single space or newline that stands between two other characters, and between a Latin
letter and an ASCII sign other than the apostrophe. The two known pre-tokenizers never join what stands on the two
sides of such a place, so the ids of a text are the ids of its units, one after another; texts of any other tokenizer file
are not cut and go to the library whole. Words repeat, so a batch has far fewer distinct units than units; a worker
also remembers units from one batch to the next, up to ``memo`` units.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

END_ID = 2


def _cut_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where units start, in bytes: all text starts, and each lone space or newline inside a text."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    cut = (data == 32) | (data == 10)
    if len(data):
        cut[1:] &= ~blank[:-1]
        cut[:-1] &= ~blank[1:]
        cut[-1] = False
        # A white space of Unicode in front would belong to the same run: those end a C2, E1, E2 or E3 sequence.
        odd = np.zeros(len(data), bool)
        odd[2:] |= (data[:-2] == 0xC2) & (data[1:-1] <= 0xA0) & (data[1:-1] >= 0x80)
        odd[3:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3)
        cut &= ~odd
        sign = ((data > 32) & (data < 48) & (data != 39)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))
        letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        cut[1:] |= letter[:-1] & sign[1:]
    cut = np.append(cut, False)
    cut[starts] = True
    return np.flatnonzero(cut[: len(data)]) if len(data) else np.zeros(0, np.int64)


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Units that only hold Latin letters, digits, ASCII signs but the apostrophe, and at most one blank, in front.
PLAIN = re.compile(rf"[ \n]?[{LETTERS}0-9!-&(-/:-@\[-`{{-~]+\Z")
#: Pre-tokens of plain units, for the two kinds of pre-tokenizer: byte level, and split by letters.
# A carriage return stands in no plain unit, so it may stand between two of them.
BYTE_LEVEL = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s")
BY_LETTERS = re.compile(rf"[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+|\r")
# The whole pre-tokenizer and normalizer entries that the two patterns stand for. Any other file takes the library's chain.
BYTE_LEVEL_CHAIN = ({"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None)
BY_LETTERS_CHAIN = (
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
)
#: What a byte-level model calls each byte: printable ones themselves, the others from U+0100 on.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PRINT)}
NAMES = "".join(chr(BYTE_NAMES.get(b, b)) for b in range(256))
#: Odd, so that their powers have inverses modulo 2 ** 64 and 2 ** 32.
BASE, SECOND = 0x9E3779B97F4A7C15, 0x85EBCA77
CHUNK = 1 << 19  # bytes of text that are looked at together
LONGEST = 64  # longer units are looked up by themselves and not by hash


class Encoder:
    """``encode(column)`` gives the ids of all texts (uint32, no end ids) and where each text starts in them.

    Known units are found by a 64-bit hash of their bytes in an open table, and are taken only if a second hash of 32 bits and the length
    agree; new ones go to the tokenizer, and so does a unit that only the first hash takes for a known one. Plain units
    of the two known kinds of tokenizer go to its model at once, pre-token by pre-token, which is far cheaper than its
    whole chain; all others take the whole chain.
    """

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        parts = (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)
        chain = tuple(part and json.loads(part.__getstate__()) for part in parts)
        self.split = None
        if chain == BYTE_LEVEL_CHAIN:
            self.split, self.lower = BYTE_LEVEL, False
        elif chain == BY_LETTERS_CHAIN:
            self.split, self.lower = BY_LETTERS, True
        self.memo = memo
        self.bits = max(12, (2 * memo).bit_length())
        self._reset()
        kinds = ((BASE, np.uint64, 64), (SECOND, np.uint32, 32))
        self.powers = [np.cumprod(np.full(CHUNK + 1, base, kind), dtype=kind) for base, kind, _ in kinds]
        self.inverses = [np.cumprod(np.full(CHUNK + 1, pow(base, -1, 1 << bits), kind), dtype=kind) for base, kind, bits in kinds]

    def _reset(self) -> None:
        self.known = 0
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        # Of each known unit: where its ids are and how many, second hash and length (32 bits each), and whether it came again in a later chunk.
        self.span, self.check, self.again = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, bool)

    def _forget(self) -> None:
        """Makes room: units that came again stay, unless they are more than half of what may be kept."""
        slot = np.flatnonzero(self.keys)
        slot = slot[self.again[self.place[slot]]]
        slot = slot[np.argsort(self.place[slot])]  # frequent units come early, so they stay side by side
        if 0 < len(slot) <= self.memo // 2:
            hashes, number = self.keys[slot], self.place[slot]
            sizes, check, flat = self.span[number] & 0xFFFFFFFF, self.check[number], self._ids_of(number)
            self._reset()
            self._insert(hashes, self._keep(flat, sizes, check))
        else:
            self._reset()

    def _ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of units, one after another."""
        span = self.span.take(numbers)
        sizes = span & 0xFFFFFFFF
        ends = np.cumsum(sizes)
        return self.ids[np.repeat((span >> 32) - ends + sizes, sizes) + np.arange(int(ends[-1]))]

    def _fresh(self, units: list[str]) -> tuple[list[int], np.ndarray, list[int]]:
        """Ids of units by the tokenizer, one after another, how many each has, and the places of the units in this order."""
        fits = PLAIN.match
        plain = [k for k, unit in enumerate(units) if fits(unit)]
        ids: list[int] = []
        ends: list[int] = [0]
        if plain:
            text = "\r".join([units[k] for k in plain]) + "\r"
            pieces = self.split.findall(text.lower() if self.lower else text)
            tokenize, stop = self.tokenizer.model.tokenize, NAMES[13]
            for named in codecs.charmap_decode("\x00".join(pieces).encode(), "strict", NAMES)[0].split(NAMES[0]):
                if named == stop:
                    ends.append(len(ids))
                else:
                    ids += [x.id for x in tokenize(named)]
        rest = sorted(set(range(len(units))).difference(plain)) if len(plain) < len(units) else []
        for i in range(0, len(rest), 1024):
            for x in self.tokenizer.encode_batch_fast([units[k] for k in rest[i : i + 1024]], add_special_tokens=False):
                ids += x.ids
                ends.append(len(ids))
        return ids, np.diff(ends), plain + rest

    def _learn(self, units: list[str], check: np.ndarray) -> np.ndarray:
        """Keeps the ids of new units, with a second hash and the length of each; their numbers."""
        flat, sizes, order = self._fresh(units)
        numbers = np.empty(len(units), np.int32)
        numbers[order] = self._keep(np.array(flat, np.uint32), sizes, check[order])
        return numbers

    def _keep(self, flat: np.ndarray, sizes: np.ndarray, check: np.ndarray) -> np.ndarray:
        n = len(sizes)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.known + n > len(self.span):
            self.span, self.check, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.span, self.check, self.again))
        new = slice(self.known, self.known + n)
        self.ids[self.used : self.used + len(flat)] = flat
        self.check[new] = check
        self.span[new] = (self.used + np.cumsum(sizes) - sizes) << 32 | sizes
        self.used += len(flat)
        self.known += n
        return np.arange(new.start, new.stop, dtype=np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each unit, or -1."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys.take(slot)
        out = np.where(key == hashes, self.place.take(slot), -1)
        open_ = np.flatnonzero((out < 0) & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            key = self.keys[slot[open_]]
            hit = key == hashes[open_]
            out[open_[hit]] = self.place[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _insert(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """``hashes``: distinct and new."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            _, first = np.unique(slot, return_index=True)
            take = np.zeros(len(slot), bool)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.place[slot[take]] = hashes[take], numbers[take]
            hashes, numbers, slot = hashes[~take], numbers[~take], (slot[~take] + 1) & ((1 << self.bits) - 1)

    def _hashes(self, data: np.ndarray, cuts: np.ndarray, ends: np.ndarray, kind: int) -> np.ndarray:
        """A hash of each unit's bytes. One is added to each byte, as a zero would leave no trace."""
        powers = self.powers[kind]
        values = np.add(data, powers.dtype.type(1), dtype=powers.dtype)
        values *= powers[: len(data)]
        sums = np.zeros(len(data) + 1, powers.dtype)
        np.cumsum(values, dtype=powers.dtype, out=sums[1:])
        # Units follow one another, so each ends where the next one starts.
        hashes = np.diff(sums.take(cuts), append=sums[-1:]) * self.inverses[kind].take(cuts)
        if kind:
            return hashes
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        return hashes ^ (hashes >> np.uint64(32))

    def _numbers(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The number of each unit of a chunk, in order."""
        ends = np.append(cuts[1:], len(data))
        hashes, length = self._hashes(data, cuts, ends, 0) | np.uint64(1), ends - cuts
        check = self._hashes(data, cuts, ends, 1).astype(np.uint64) << np.uint64(32) | length.view(np.uint64)
        alone = length > LONGEST
        out = self._find(hashes)
        out[alone] = -2
        new = np.flatnonzero(out == -1)
        text = data.tobytes()
        units = lambda which: [text[a:b].decode() for a, b in zip(cuts[which].tolist(), ends[which].tolist(), strict=True)]
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            if self.known + len(fresh) + alone.sum() > self.memo and self.known:
                self._forget()
                if self.known + len(fresh) + alone.sum() > self.memo:
                    self._reset()
                return self._numbers(data, cuts)
            self.again[out[out >= 0]] = True
            numbers = self._learn(units(new[first]), check[new[first]])
            if len(fresh) < self.memo:
                self._insert(fresh, numbers)
                out[new] = self._find(hashes[new])
            else:  # one chunk holds more than the memo
                out[new] = numbers[np.searchsorted(fresh, hashes[new])]
        alone |= (out >= 0) & (self.check.take(np.maximum(out, 0)) != check)
        if alone.any():
            odd = np.flatnonzero(alone)
            out[odd] = self._learn(units(odd), check[odd])
        return out

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cuts = _cut_points(data, offsets[:-1][offsets[:-1] < len(data)])
        # A single text longer than a chunk is hashed in parts, between units.
        if len(data) <= CHUNK:
            number = self._numbers(data, cuts)
            ends = np.cumsum(self.span.take(number) & 0xFFFFFFFF)
            return self._ids_of(number), np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        half = cuts[len(cuts) // 2] if len(cuts) > 1 else 0
        if not half:
            ids = np.array(self.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            return ids, np.where(offsets > 0, len(ids), 0)
        inside = offsets[(offsets > 0) & (offsets < half)], offsets[(offsets > half) & (offsets < len(data))]
        a, sa = self._chunk(data[:half], np.concatenate([[0], inside[0], [half]]))
        b, sb = self._chunk(data[half:], np.concatenate([[0], inside[1] - half, [len(data) - half]]))
        known = np.concatenate([[0], inside[0], [half], inside[1], [len(data)]])
        starts = np.concatenate([sa, len(a) + sb[1:]])
        return np.concatenate([a, b]), starts[np.searchsorted(known, offsets)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if self.split is None:
            found = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        ids, starts, k = [], [np.zeros(1, np.int64)], 0
        while k < n:
            stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
            found, at = self._chunk(data[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k])
            ids.append(found)
            starts.append(at[1:] + starts[-1][-1])
            k = stop
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(starts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    return Encoder(path)


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each document."""
    n = len(starts) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    for k, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        out[a + k : b + k] = ids[a:b]
    return out, starts + np.arange(n + 1)
