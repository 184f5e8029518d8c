"""Operator 7, SentencePiece encoding and decoding: suffix-array matching.

The words of a batch (text cut before each space mark, each distinct one once)
are concatenated and indexed by a suffix array, ordered by as many characters as
the longest piece has. Every vocabulary piece is looked up by binary search; the
range of suffixes that it heads gives its occurrences. Ranges lie within each
other, so the longest piece at every place tells the shorter ones, too.

The model at hand is a byte-pair model, whose pieces join by rank, so the
shortest path by score is not its segmentation. Of the edges that start where a
segmentation of a prefix ends, the longest is taken whose piece stays apart from
the one before it when their characters are joined by rank; a place from which
no edge goes on is left for the piece before. Prefixes have one segmentation,
so each place is left once at most. Characters outside the vocabulary are
spelled in byte pieces. Results equal the library's, ids and text.

Defined cases: a null text counts as empty and has no pieces; decoding gives
back the normalised text; repeated rows give repeated results; words of more
than ``LONG`` characters cost a step a character and are not remembered.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm.batches import filter_rows, map_rows, slices

#: Where public vocabulary files lie; a parameter of every function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words whose pieces a worker remembers.
REMEMBERED = 300_000
#: Longer words are relaxed alone and not remembered.
LONG = 2_000


class _Pairs:
    """A hash table from number to truth value that looks up whole arrays; it starts anew when half full."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.key, self.value, self.n = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, bool), 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, which keys are known)."""
        slot = self._slot(key)
        todo = np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            k = self.key[slot[todo]]
            todo = todo[(k != key[todo]) & (k >= 0)]
        return self.value[slot], self.key[slot] == key

    def add(self, keys: np.ndarray, values: list[bool]) -> None:
        if self.n + len(keys) > 1 << (self.bits - 1):
            self.clear()
        for k, s, v in zip(keys.tolist(), self._slot(keys).tolist(), values):
            while self.key[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.key[s], self.value[s] = k, v
        self.n += len(keys)


class Codec:
    """Encoding and decoding by the vocabulary of one model file."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)  # read for vocabulary and normaliser only
        size = m.vocab_size()
        self.piece = [m.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: m.get_score(i) for i in plain}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(size) if m.is_byte(i)}
        spelled = {i: bytes((b,)) for b, i in self.byte.items()}
        self.raw = [spelled.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.longest = max(map(len, self.id))
        # a word ends before a mark unless some piece has a mark behind another character
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.id)
        self.pairs = _Pairs()
        self.known: dict[str, bytes] = {}
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")  # of the ids in known
        usable = [p for p in self.id if self._merge(list(p)) == [p]]
        self.search = sorted(usable)
        self.low = np.zeros((len(self.search), self.longest), "<u4")
        for k, p in enumerate(self.search):
            self.low[k, : len(p)] = [ord(c) for c in p]
        self.codes = int(self.low.max(initial=0))
        self.sizes = np.array([len(p) for p in self.search])
        self.steps = np.append(self.sizes, 1)
        self.numbers = np.array([self.id[p] for p in self.search] + [-1])
        place = {p: k for k, p in enumerate(self.search)}
        self.shorter = np.array([next((place[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in place), -1) for p in self.search])
        # below the shortest piece of a character outside the vocabulary lies the character itself
        self.shorter_or_other = np.append(np.where((self.shorter < 0) & (self.sizes > 1), len(self.search), self.shorter), -1)

    def _merge(self, parts: list[str]) -> list[str]:
        """Join neighbours by the best score, the leftmost first; for short strings."""
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b (places in the sorted vocabulary) stay apart when side by side."""
        key = a.astype(np.int64) * len(self.search) + b
        got, known = self.pairs.find(key)
        if not known.all():
            new = np.unique(key[~known])
            names = self.search
            value = []
            for k in new.tolist():
                x, y = names[k // len(names)], names[k % len(names)]
                value.append(self._merge(list(x + y)) == [x, y])
            self.pairs.add(new, value)
            at = np.flatnonzero(~known)
            got[at] = np.array(value)[np.searchsorted(new, key[at])]
        return got

    def _ranges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffixes in order, first, last) of ``text``, which ends with a null character: piece p heads suffixes[first[p]:last[p]]."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        width = self.longest
        # letters by number, as many in one key as fit
        seen = np.zeros(max(int(codes.max()), self.codes) + 1, bool)
        seen[codes] = True
        number = seen.cumsum() - 1
        bits = max(1, int(number[-1]).bit_length())
        step = min(63 // bits, width)
        padded = np.concatenate([number[codes], np.zeros(2 * width, np.int64)])
        head = np.zeros(len(codes) + width, np.int64)
        for k in range(step):
            head <<= bits
            head |= padded[k : k + len(head)]
        # ranks of prefixes of twice as many characters, again and again: the suffix array by doubling
        order_of, n = head, step
        while n < width:
            order_of = np.unique(order_of, return_inverse=True)[1]
            far = np.concatenate([order_of[n:], np.zeros(n, np.int64)])
            order_of = order_of * (far.max() + 1) + far
            n *= 2
        suffixes = np.argsort(order_of[: len(codes)])
        # binary search of all pieces at once; of those longer than a key, the rest is compared by characters
        first, last = np.zeros((2, len(self.search)), np.int64)
        at = np.flatnonzero((seen[self.low] | (self.low == 0)).all(1))  # no other has its letters here
        low, sizes = self.low[at], self.sizes[at]
        small = number[low] * (low > 0)
        one, other = np.zeros((2, len(at)), np.int64)
        for k in range(step):
            one, other = one << bits | small[:, k], other << bits | np.where(k < sizes, small[:, k], (1 << bits) - 1)
        heads = head[suffixes]
        lo, hi = np.searchsorted(heads, one), np.searchsorted(heads, other, "right")
        rest = np.flatnonzero((sizes > step) & (lo < hi))
        wide = np.arange(step, width)
        there = np.concatenate([codes, np.zeros(width, "<u4")])

        def bound(wanted, right):
            below, above = lo[rest], hi[rest]
            while (open_ := np.flatnonzero(below < above)).size:
                mid = (below[open_] + above[open_]) // 2
                h, w = there[suffixes[mid][:, None] + wide], wanted[open_]
                i = (h != w).argmax(1)
                r = np.arange(len(h))
                go = h[r, i] <= w[r, i] if right else h[r, i] < w[r, i]
                below[open_[go]] = mid[go] + 1
                above[open_[~go]] = mid[~go]
            return below

        if len(rest):
            end = np.where(wide < sizes[rest, None], low[rest, step:], 0xFFFFFFFF)
            lo[rest], hi[rest] = bound(low[rest, step:], False), bound(end, True)
        first[at], last[at] = lo, hi
        return suffixes, first, last

    def _edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece number) of every occurrence of every piece in ``text``."""
        suffixes, first, last = self._ranges(text)
        n = last - first
        piece = np.repeat(np.arange(len(n)), n)
        at = np.repeat(first - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        start = suffixes[at]
        return start, start + self.sizes[piece], piece

    def _longest(self, text: str) -> np.ndarray:
        """The longest piece that starts at each place of ``text``, or -1; the shorter ones are its ``shorter``."""
        suffixes, first, last = self._ranges(text)
        here = np.flatnonzero(first < last)
        # ranges lie within each other: behind the end of one, the next shorter piece that goes on holds
        behind = self.shorter[here]
        while (over := (behind >= 0) & (last[behind] == last[here])).any():
            behind[over] = self.shorter[behind[over]]
        told = np.full(len(suffixes) + 1, -2)
        told[0] = -1
        told[last[here]] = behind
        told[first[here]] = here  # of equal starts the last, which is the longest
        holds = np.maximum.accumulate(np.where(told > -2, np.arange(len(told)), 0))
        out = np.empty(len(suffixes), np.int32)
        out[suffixes] = told[holds[:-1]]
        return out

    def _encode_long(self, word: str) -> list[int]:
        """The pieces of one long word, position by position."""
        start, end, piece = self._edges(word + "\0")
        order = np.lexsort((start, end))  # by end, the longest first
        cut = np.searchsorted(end[order], np.arange(len(word) + 2)).tolist()
        start, piece = start[order].tolist(), piece[order].tolist()
        names, apart = self.search, {}
        last, came = [-1] * (len(word) + 1), list(range(-1, len(word)))
        for e in range(1, len(word) + 1):
            for k in range(cut[e], cut[e + 1]):
                s, p = start[k], piece[k]
                pair = last[s], p
                if s and pair[0] >= 0 and pair not in apart:
                    apart[pair] = self._merge(list(names[pair[0]] + names[p])) == [names[pair[0]], names[p]]
                if not s or pair[0] < 0 or apart[pair]:
                    last[e], came[e] = p, s
                    break
        return self._ids(word, len(word), 0, last, came)

    def _ids(self, text: str, e: int, b: int, last: list[int], came: list[int]) -> list[int]:
        """The ids on the way back from ``e`` to ``b``."""
        out: list[int] = []
        while e > b:
            if last[e] >= 0:
                out.append(self.id[self.search[last[e]]])
            else:
                out.extend(self.byte[x] for x in reversed(text[e - 1].encode("utf-8", "replace")))
            e = came[e]
        return out[::-1]

    def _encode_words(self, words: list[str]) -> None:
        """Put the pieces of new words into the memory; all words go on together, an edge at a time."""
        text = "\0".join(words) + "\0"  # a character between words that no piece holds
        longest = self._longest(text)
        other = len(self.search)  # stands for a character outside the vocabulary
        longest[longest < 0] = other
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        base = sizes.cumsum() - sizes + np.arange(len(words))
        last = np.full(len(text) + 1, -1, np.int32)  # the piece that ends here
        on, dead = np.zeros((2, len(text) + 1), bool)  # ends of pieces so far; places that lead to no end
        at, stop = base[sizes > 0], (base + sizes)[sizes > 0]
        piece = longest[at]
        while len(at):
            end = at + self.steps[piece]
            before = last[at]
            ok = ~dead[end]
            check = np.flatnonzero(ok & (before >= 0) & (before < other) & (piece < other))
            ok[check] = self._apart(before[check], piece[check])
            no = np.flatnonzero(~ok)
            yes = np.flatnonzero(ok)
            last[end[yes]] = piece[yes]
            on[end[yes]] = True
            at[yes] = end[yes]
            piece[yes] = longest[end[yes]]
            if len(no):
                less = self.shorter_or_other[piece[no]]
                piece[no] = less
                back = no[less < 0]  # none is left: the piece before gives way
                dead[at[back]], on[at[back]] = True, False
                piece[back] = last[at[back]]
                at[back] -= self.steps[piece[back]]
            left = np.flatnonzero(at < stop)
            if len(left) < len(at):
                at, stop, piece = at[left], stop[left], piece[left]
        ends = np.flatnonzero(on)
        ids = self.numbers[last[ends]]
        found, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        cut = np.append(np.searchsorted(ends, base, "right"), len(ends))
        byte = (cut * size).tolist()
        self.known.update(zip(words, map(found.__getitem__, map(slice, byte, byte[1:]))))
        strange = np.flatnonzero(ids < 0)
        for k in set((np.searchsorted(base, ends[strange], "left") - 1).tolist()):
            spelled: list[int] = []
            for e, x in zip(ends[cut[k] : cut[k + 1]].tolist(), ids[cut[k] : cut[k + 1]].tolist()):
                spelled.extend([x] if x >= 0 else [self.byte[y] for y in text[e - 1].encode("utf-8", "replace")])
            self.known[words[k]] = np.array(spelled, self.kind).tobytes()

    def encode(self, texts: list) -> list[list[int]]:
        """Ids of every text."""
        out: list[list[int]] = []
        for lo, hi in slices(texts):
            cut = [self._words(self.model.normalize(t)) if t else [] for t in texts[lo:hi]]
            new = set(chain.from_iterable(cut)).difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set(chain.from_iterable(cut))
            listed = [w for w in new if len(w) <= LONG]
            for i, j in slices(listed, 400_000):
                self._encode_words(listed[i:j])
            long = [w for w in new if len(w) > LONG]
            self.known.update((w, np.array(self._encode_long(w), self.kind).tobytes()) for w in long)
            known = self.known.__getitem__
            out += [np.frombuffer(b"".join(map(known, ws)), self.kind).tolist() for ws in cut]
            for w in long:
                del self.known[w]
        return out

    def _words(self, text: str) -> list[str]:
        if not self.cut:
            return [text] if text else []
        return _CUT.findall(text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, byte pieces bytes; the mark put before the text goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str = MODEL) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_numerals: list[str] = []


def ids_digest(ids: list[int]) -> str:
    """SHA-256 of the ids in decimal, joined by spaces."""
    if ids and max(ids) >= len(_numerals):
        _numerals[:] = map(str, range(max(ids) + 1))
    return hashlib.sha256(" ".join(map(_numerals.__getitem__, ids)).encode()).hexdigest()


def encode_documents(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids: one row per input row."""
    return map_rows(documents.select("doc_id", "text"), "doc_id bigint, ids array<int>", lambda i, t: {"doc_id": i, "ids": codec(path).encode(t)})


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of encode_documents()."""
    return map_rows(encoded.select("doc_id", "ids"), "doc_id bigint, text string", lambda i, x: {"doc_id": i, "text": [codec(path).decode(v or []) for v in x]})


def encode_and_decode(documents: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip (decoding gives the text): one row per input row."""

    def run(ids, texts):
        c = codec(path)
        got = c.encode(texts)
        back = [c.decode(g) for g in got]
        return {
            "doc_id": ids, "n_pieces": [len(g) for g in got], "ids_sha256": [ids_digest(g) for g in got],
            "decoded_sha256": [hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back], "round_trip": [b == (t or "") for b, t in zip(back, texts)],
        }

    return map_rows(documents.select("doc_id", "text"), "doc_id bigint, n_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean", run, by="text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), os.environ.get("LODEGRAPH_PIECES", MODEL))
