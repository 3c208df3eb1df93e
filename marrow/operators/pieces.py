"""Token ids of texts, many texts at a time, by a tokenizer whose words never cross a blank: pieces of texts are known by 64-bit numbers, and each is encoded once."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa

from marrow.operators import words as word_hashes
from marrow.operators.batches import slices


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level tokenizers."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


#: Distinct pieces of texts whose ids a worker holds, about, and the bits of their table's size.
PIECES, PIECE_BITS = 600_000, 21
#: The number of the end of a text; pieces have others.
ENDS = np.uint64(1)
PART_BYTES = 1_000_000
#: What the known family of tokenizers takes for a word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: blanks, letters up to U+024F (of ASCII, or the two bytes of another), ASCII signs, and all else.
GAP, LETTER, SIGN, OTHER = range(4)
KIND = np.array([GAP if word_hashes.BLANK[b] else LETTER if chr(b).isalpha() and b < 128 or 0x80 <= b < 0xC0 or 0xC3 <= b <= 0xC9 else SIGN if 32 < b < 127 and not chr(b).isdigit() else OTHER for b in range(256)], np.uint8)
#: Among those no letters (the signs of multiplication and division), or more than one in lower case (the capital i with a dot).
NO_LETTERS = [c.encode() for c in "\u00d7\u00f7\u0130"]


class Held:
    """A table of 64-bit numbers, none of them 0, and where each is kept; open addresses, many at a time."""

    def __init__(self, bits: int):
        self.key, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.size, self.mask = 0, np.uint64((1 << bits) - 1)

    def find(self, number: np.ndarray) -> np.ndarray:
        """The value of each number, -1 if it is not here."""
        at = (number & self.mask).view(np.int64)
        key = self.key.take(at)
        out = np.where(key == number, self.value.take(at), np.int32(-1))
        left = np.flatnonzero((key != number) & (key != 0))
        at, number = at[left], number[left]
        while len(left):
            at = (at + 1) & int(self.mask)
            key = self.key.take(at)
            same = key == number
            out[left[same]] = self.value.take(at[same])
            more = ~same & (key != 0)
            left, at, number = left[more], at[more], number[more]
        return out

    def add(self, number: np.ndarray) -> None:
        """New distinct numbers, which get the next values."""
        value = np.arange(self.size, self.size + len(number), dtype=np.int32)
        self.size += len(number)
        at = (number & self.mask).view(np.int64)
        while len(number):
            free = self.key[at] == 0
            self.key[at[free]] = number[free]
            mine = free & (self.key[at] == number)  # of two at one place the later has it
            self.value[at[mine]] = value[mine]
            number, value, at = number[~mine], value[~mine], (at[~mine] + 1) & int(self.mask)


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte."""
    kind = KIND.take(data)
    lead = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xC4))
    for a, b in NO_LETTERS:
        kind[lead[(data[lead] == a) & (data[lead + 1] == b)]] = OTHER
    return kind


def sign_cuts(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where signs begin that follow letters, of the pieces that have only both: the word pattern of this family of files cuts there, whatever the letters and signs."""
    begins = np.zeros(len(kind) + 1, bool)
    begins[rows] = True
    new = begins[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(new)
    run, row = kind[at], begins[at]
    gap = run == GAP
    alone = np.r_[True, gap[:-1]] | row  # nothing of the piece before
    ends = np.r_[gap[1:] | row[1:], True]
    return at[1:][(run[:-1] == LETTER) & alone[:-1] & (run[1:] == SIGN) & ends[1:] & ~row[1:]]


class Words:
    """Ids of texts by a tokenizer given as JSON, by pieces between ASCII blanks, less the signs at the end of a word. A worker holds the ids of many distinct pieces."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer)
        spec["truncation"] = spec["padding"] = None
        self.whole = Tokenizer.from_str(json.dumps(spec))
        steps = [s["type"] for s in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        # this family of files drops blanks between words, whatever the words beside them
        self.by_piece = steps == ["Split", "ByteLevel"] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": PATTERN} and spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed" and not spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        self.size, self.model = self.whole.get_vocab_size(), self.whole.model
        self.letters = np.array([ord(c) for c in byte_letters()], "<u4")
        self.forget()

    def forget(self) -> None:
        """Value 0 is the end of a text."""
        self.held = Held(PIECE_BITS)
        self.number = np.array([ENDS], np.uint64)
        self.held.add(self.number)
        self.begin, self.length, self.flat, self.used = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, np.uint32), np.zeros(1, np.int64)

    def thin(self) -> None:
        """Forget the pieces that were met least, half of all at least."""
        edge = max(2, int(np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]) + 1)
        kept = np.flatnonzero((self.used >= edge) | (np.arange(len(self.used)) == 0))
        length = self.length[kept]
        stops = np.cumsum(length)
        self.flat = self.flat[np.repeat(self.begin[kept] - (stops - length), length) + np.arange(int(stops[-1]))]
        self.number, self.begin, self.length, self.used = self.number[kept], stops - length, length, self.used[kept] // 2
        self.held = Held(PIECE_BITS)
        self.held.add(self.number)

    def learn(self, number: np.ndarray, pieces: list[bytes], plain: np.ndarray) -> None:
        """plain: which pieces are letters alone, which are a word each and go to the model at once."""
        order = np.argsort(~plain, kind="stable")
        number, pieces, n = number[order], [pieces[i] for i in order.tolist()], int(plain.sum())
        lowered = b"\n".join(pieces[:n]).decode().lower().encode()
        words = self.letters.take(np.frombuffer(lowered, np.uint8)).tobytes().decode("utf-32-le").split(chr(self.letters[10])) if n else []
        tokenize = self.model.tokenize
        ids, ends = array("I"), [0]
        for w in words:
            ids.extend([t.id for t in tokenize(w)])
            ends.append(len(ids))
        for p in pieces[n:]:
            ids.extend(self.whole.encode(p.decode(), add_special_tokens=False).ids)
            ends.append(len(ids))
        length = np.diff(np.array(ends, np.int64))
        self.begin = np.r_[self.begin, len(self.flat) + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.flat = np.r_[self.flat, np.asarray(ids, np.uint32)]
        self.number = np.r_[self.number, number]
        self.used = np.r_[self.used, np.zeros(len(number), np.int64)]
        self.held.add(number)

    def encode(self, column: pa.Array | list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each with the end id, if there is one, behind it, and where each starts."""
        column = column if isinstance(column, pa.Array) else pa.array(column, pa.string())
        if not self.by_piece:
            last = [] if end is None else [end]
            found = [np.array([*self.whole.encode(x or "", add_special_tokens=False).ids, *last], np.uint32) for x in column.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
        parts = [self.part(x, end) for x in slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", PART_BYTES)]
        starts = np.concatenate([np.diff(p[1]) for p in parts]) if parts else np.zeros(0, np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts)]), np.r_[0, np.cumsum(starts)]

    def part(self, batch: pa.RecordBatch, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        data, rows = word_hashes.raw(batch.column("text"))
        kind = kinds(data)
        number, first, stop, row = word_hashes.numbers(data, rows, lower=self.lower, cuts=sign_cuts(kind, rows))
        number[number <= ENDS] += np.uint64(2)  # 0 is no piece and ENDS is the end
        if self.held.size > PIECES:
            self.thin()
        where = self.held.find(number)
        missing = np.flatnonzero(where < 0)
        if len(missing):
            new, at = np.unique(number[missing], return_index=True)
            at = missing[at]
            raw, a, b = data.tobytes(), first[at], stop[at]
            other = np.r_[0, np.cumsum(kind != LETTER)]
            plain = (other[b] == other[a]) & self.lower
            self.learn(new, [raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], plain)
            where[missing] = self.held.find(number[missing])
        self.used += np.bincount(where, minlength=len(self.used))
        if end is not None:
            where, row = np.insert(where, row[1:], 0), row + np.arange(len(row))
            self.flat[0] = end
        each = self.length.take(where)
        stops = np.cumsum(each)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat.take(np.repeat(self.begin.take(where) - (stops - each), each) + np.arange(total))
        return ids, np.r_[0, stops][row]
