"""Token ids of the lower-casing word tokenizer for whole columns of texts.

The library merges one word after the other. Here the words of a batch are found in one pass over its code points, told apart by Arrow's
dictionary, and all distinct words are merged side by side, one merge of each in a step. The first `MEMO` words of a worker are kept with
their ids. Only texts in long-settled Latin ranges take this way; any other text, and any word of more than `LONG` bytes, goes to the
library. Tests hold both against each other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from masklake.llm.tokencount import byte_alphabet

#: Fixed value: the pre-token pattern of the word tokenizer.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ranges in which normal form C changes nothing, and in which lower case and character classes are settled. The capital dotted I
#: (0x130), the separators 0x1C to 0x1F and 0x85 are left to the library.
LATIN = [(0x0, 0x1B), (0x20, 0x84), (0x86, 0x12F), (0x131, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]
LONG = 64
STRETCH = 1 << 21
MEMO = 400_000
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = range(5)
_NONE = np.int32(1 << 30)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point up to the last of LATIN; one more entry stands for all beyond."""
    kind, lower = np.full(LATIN[-1][1] + 2, _UNKNOWN, np.uint8), np.arange(LATIN[-1][1] + 2, dtype=np.uint32)
    for low, high in LATIN:
        for c in range(low, high + 1):
            s = chr(c)
            kind[c] = _SPACE if s.isspace() else _LETTER if s.isalpha() else _DIGIT if s.isnumeric() else _OTHER
            lower[c] = ord(s.lower())
    return kind, lower


class Merges:
    """The merge rules as an open hash table over pairs of ids, for look-ups of whole arrays."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        left, right = (np.array([vocab[m[k]] for m in model["merges"]], np.uint64) for k in (0, 1))
        self.keys = left << np.uint64(32) | right
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        self.bits = max(4, int(len(self.keys)).bit_length() + 2)
        self.slot = np.full((1 << self.bits) + 64, -1, np.int32)
        at, todo = self._home(self.keys), np.arange(len(self.keys))
        while len(todo):  # the first that asks for a free slot gets it, the others move on
            free = self.slot[at[todo]] < 0
            asked, who = np.unique(at[todo[free]], return_index=True)
            self.slot[asked] = todo[free][who]
            todo = todo[self.slot[at[todo]] != todo]
            at[todo] += 1
        plain = {b: c for c, b in byte_alphabet().items()}
        self.first = np.array([vocab[plain[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[plain[b] + suffix] for b in range(256)], np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs, _NONE for those without a rule."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._home(key)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != key))
        while len(open_):
            at[open_] += 1
            out[open_] = self.slot[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[out[open_]] != key[open_])]
        return np.where(out < 0, _NONE, out)

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of them in each row) of words data[start:start + size], all of at most `LONG` bytes; ids are rows, left-aligned."""
        width = max(2, int(size.max(initial=0)))
        column = np.arange(width)
        inside = column < size[:, None]
        byte = data[np.minimum(start[:, None] + column, len(data) - 1)]
        ids = np.where(column == size[:, None] - 1, self.last[byte], self.first[byte])
        ids[~inside] = 0
        count = size.astype(np.int64).copy()
        rank = np.full((len(size), width), _NONE, np.int32)
        r, c = np.nonzero(column + 1 < size[:, None])
        rank[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        live = np.arange(len(size))
        work, left = ids, rank
        while len(live):
            at = left.argmin(1)
            best = left[np.arange(len(live)), at]
            going = best < _NONE
            if not going.all():
                ids[live[~going]] = work[~going]
                live, work, left, at, best = live[going], work[going], left[going], at[going], best[going]
                if not len(live):
                    break
            row = np.arange(len(live))
            count[live] -= 1
            source = np.minimum(column + (column > at[:, None]), width - 1)
            work = np.take_along_axis(work, source, 1)
            left = np.take_along_axis(left, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            left[:, -1] = _NONE
            work[row, at] = self.made[best]
            before = np.flatnonzero(at > 0)
            left[before, at[before] - 1] = self.rank(work[before, at[before] - 1], work[before, at[before]])
            after = np.flatnonzero(at + 1 < count[live])
            left[after, at[after]] = self.rank(work[after, at[after]], work[after, at[after] + 1])
        return ids, count


class WordBpe:
    """Encodes batches of texts. `spec` is the text of the tokenizer's file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parts = json.loads(spec)
        split = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        normal = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        if (normal != ["NFC", "Replace", "Lowercase"] or split[0].get("pattern") != {"Regex": PRE_TOKEN} or len(split) != 2
                or any(t["normalized"] for t in parts["added_tokens"]) or parts["model"]["type"] != "BPE"):
            raise ValueError("only the lower-casing word tokenizer is encoded here")
        self.library = Tokenizer.from_str(spec)
        self.merges = Merges(parts["model"])
        self.kind, self.lower = _tables()
        special = [t["content"] for t in parts["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.known: dict[bytes, int] = {}
        self.known_ids, self.known_number = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of text r, without begin and end tokens, are ids[bounds[r]:bounds[r + 1]]."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        kind = self.kind[np.minimum(points, len(self.kind) - 1)]
        ends = np.cumsum([0, *map(len, texts)])
        unknown = np.flatnonzero(kind == _UNKNOWN)
        strange = set(np.searchsorted(ends, unknown, "right") - 1) if len(unknown) else set()
        strange |= {r for r, t in enumerate(texts) if "<" in t and self.special(t)}
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for r in strange:
            out[r] = np.array(self.library.encode(texts[r], add_special_tokens=False).ids, np.uint32)
        plain, a = [r for r in range(len(texts)) if r not in strange], 0
        while a < len(plain):  # stretches of bounded size; a very long text alone is cut at white space
            z, size = a + 1, len(texts[plain[a]])
            while z < len(plain) and size + len(texts[plain[z]]) <= STRETCH:
                size += len(texts[plain[z]])
                z += 1
            rows = plain[a:z]
            pick = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in rows]) if strange else slice(ends[rows[0]], ends[rows[-1] + 1] if len(rows) > 1 else ends[rows[0] + 1])
            p, k = points[pick], kind[pick]
            bounds = np.cumsum([0, *(len(texts[r]) for r in rows)])
            if len(rows) == 1:
                parts = [self._words(p[x:y], k[x:y], np.array([0, y - x]))[0] for x, y in _cuts(k)]
                out[rows[0]] = np.concatenate(parts) if parts else out[rows[0]]
            else:
                ids, at = self._words(p, k, bounds)
                for n, r in enumerate(rows):
                    out[r] = ids[at[n]:at[n + 1]]
            a = z
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.cumsum([0, *map(len, out)])

    def _words(self, points: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and where each text's begin."""
        letters = self.lower[points]
        begin = kind != _SPACE
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        edge = bounds[1:-1]
        edge = edge[edge < len(kind)]
        begin[edge] = kind[edge] != _SPACE
        self._contractions(letters, kind, begin, bounds)
        solid = kind != _SPACE
        letters, begin = letters[solid], begin[solid]
        first = np.searchsorted(np.flatnonzero(begin), np.concatenate([[0], np.cumsum(solid)])[bounds])
        wide = 1 + (letters >= 0x80).astype(np.int64) + (letters >= 0x800)
        place = np.concatenate([[0], np.cumsum(wide)])
        offsets = np.append(place[:-1][begin], place[-1]).astype(np.int64)
        data = letters.astype(np.uint32).tobytes().decode("utf-32-le").encode()
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        ids, start, number = self._looked_up(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = number[code]
        total = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(start[code] - total[:-1], many) + np.arange(total[-1])
        return ids[at].astype(np.uint32), total[first]

    def _looked_up(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, begin, number of ids of each word); words met for the first time join the memo while there is room."""
        texts = words.to_pylist()
        place = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(place < 0)
        ids, count = self._distinct(words.take(pa.array(new)))
        place[new] = len(self.known) + np.arange(len(new))
        flat, number = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_number, count])
        if len(number) <= MEMO:
            self.known.update(zip([texts[k] for k in new.tolist()], place[new].tolist(), strict=True))
            self.known_ids, self.known_number = flat, number
        return flat, (np.cumsum(number) - number)[place], number[place]

    def _distinct(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word)."""
        n = len(words)
        off = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8) if n and words.buffers()[2] is not None else np.zeros(1, np.uint8)
        size = np.diff(off)
        number = np.zeros(n, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (4, 8, 12, 16, 24, LONG):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(rows):
                ids, number[rows] = self.merges.merge(data, off[rows], size[rows])
                held.append((rows, ids))
        longer = {int(r): self.library.encode(words[r].as_py().decode(), add_special_tokens=False).ids for r in np.flatnonzero(size > LONG)}
        for r, ids in longer.items():
            number[r] = len(ids)
        start = np.cumsum(number) - number
        flat = np.zeros(int(number.sum()), np.int32)
        for rows, ids in held:
            inside = np.arange(ids.shape[1]) < number[rows][:, None]
            flat[(start[rows][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        for r, ids in longer.items():
            flat[start[r]:start[r] + len(ids)] = ids
        return flat, number

    @staticmethod
    def _contractions(letters: np.ndarray, kind: np.ndarray, begin: np.ndarray, bounds: np.ndarray) -> None:
        """Lets an apostrophe that is a run of its own take the letters of a contraction; moves the next word's begin behind them."""
        n = len(letters)
        at = np.flatnonzero(begin & (letters == ord("'")))
        end = bounds[np.searchsorted(bounds, at, "right")]  # of the apostrophe's text
        at, end = at[at + 1 < end], end[at + 1 < end]
        after, later = letters[at + 1], letters[np.minimum(at + 2, n - 1)]
        one = np.isin(after, [ord(c) for c in "stmd"])
        two = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (after == ord(a)) & (later == ord(b)) & (at + 2 < end)
        begin[at[one | two] + 1] = False
        for hit, length in ((one, 2), (two, 3)):
            to = at[hit] + length
            to = to[(to < end[hit])]
            begin[to] |= kind[to] == _LETTER


def _cuts(kind: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of about STRETCH code points that end behind white space, as far as there is some."""
    if len(kind) <= STRETCH:
        return [(0, len(kind))] if len(kind) else []
    space, out, at = np.flatnonzero(kind == _SPACE), [], 0
    while at < len(kind):
        k = int(np.searchsorted(space, at + STRETCH))
        end = int(space[k]) + 1 if k < len(space) else len(kind)
        out.append((at, end))
        at = end
    return out


@lru_cache(maxsize=2)
def encoder(spec: str) -> WordBpe:
    """The encoder of a worker, which later tasks of the same worker find again."""
    return WordBpe(spec)
