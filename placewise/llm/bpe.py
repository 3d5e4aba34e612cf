"""BPE by guess and check: longest matches are proposed, every adjacent pair is checked in arrays, only failing words are merged exactly."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from placewise.llm.rows import add_columns

# The vocabulary's way of cutting texts into words; white space as Unicode defines it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\p{Z}\p{L}\p{N}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"  # the same on lower-case ASCII
WORD_END = "</w>"
_MOST_CACHED = 100_000
_HEAD = 3  # first letters that bound the length of a token
_SHORT = 64  # letters up to which a word is merged without a heap
_NEVER = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Bpe:
    """A word-level BPE vocabulary file: normal form C, lower case, words with an end mark."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = vocab
        size = max(*vocab.values(), *self.special.values()) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.letters = _byte_letters()
        self.find, self.find_ascii = regex.compile(WORD_PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged = [c for _, _, c in pairs]
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1), np.full(size, -1)
        for r, (a, b, c) in enumerate(pairs):
            self.ranks.setdefault((a, b), r)
            if self.rank[c] < 0:
                self.rank[c], self.left[c], self.right[c] = r, a, b
        self.size = size
        keys = np.array([a * size + b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()), np.int64)[order]
        usable = self._usable(pairs)
        self.proposed = {token: i for token, i in vocab.items() if usable[i]}
        self.longest = max(map(len, self.proposed))
        self.reach: dict[str, int] = {}  # longest proposed token that begins with these letters
        for token in self.proposed:
            if len(token) >= _HEAD:
                self.reach[token[:_HEAD]] = max(len(token), self.reach.get(token[:_HEAD], 0))
        self.words: dict[str, bytes] = {}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether merging stops between neighbours a and b (or makes no merge across them of a rank under ``before``).

        Merging is played backwards: the later made of the two tokens at the border is taken apart, and at each step a
        merge across the border must not come before the merges that use up its parts.
        """
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until = np.full(len(a), _NEVER) if before is None else before.astype(np.int64)
        y_until = np.full(len(a), _NEVER) if before is None else before - 1
        while len(live):
            rank = self._pair_rank(x[live], y[live])
            hit = (rank < x_until[live]) & (rank <= y_until[live]) & (rank < _NEVER)
            ok[live[hit]] = False
            live = live[~hit]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            split_x, split_y = live[(rx > ry)], live[(ry >= rx) & (ry >= 0)]
            x_until[split_x], x[split_x] = self.rank[x[split_x]], self.right[x[split_x]]
            y_until[split_y], y[split_y] = self.rank[y[split_y]], self.left[y[split_y]]
            live = np.concatenate([split_x, split_y])
        return ok

    def _usable(self, pairs) -> np.ndarray:
        """Tokens that merging makes of their own text; only they are proposed."""
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        good = self.compatible(self.left[made], self.right[made], self.rank[made])
        out = np.ones(self.size, bool)
        for token, fine in zip(made.tolist(), good.tolist()):
            out[token] = fine and out[self.left[token]] and out[self.right[token]]
        return out

    def _propose(self, letters: str) -> list[int]:
        out, i, n, get, longest, reach = [], 0, len(letters), self.proposed.get, self.longest, self.reach.get
        ended = letters + WORD_END
        while i < n:
            token = get(ended[i:]) if n - i <= longest else None
            j = min(n, i + reach(letters[i : i + _HEAD], _HEAD - 1) + 1)
            while token is None:
                j -= 1
                if j == i:
                    raise ValueError("the vocabulary lacks a byte")
                token = get(letters[i:j])
            out.append(token)
            i = j
        return out

    def merge_exactly(self, letters: str) -> list[int]:
        """Merge by rank, leftmost first; only the ranks beside a merge change. Both ways below give the same tokens."""
        parts = [*map(self.ids.__getitem__, letters[:-1]), self.ids[letters[-1] + WORD_END]]
        return self._merge_short(parts) if len(parts) <= _SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        """Looks through all ranks for each merge, which is fastest for common words."""
        get = self.ranks.get
        ranks = list(map(get, zip(parts, parts[1:]), repeat(_NEVER)))
        while ranks and (rank := min(ranks)) != _NEVER:
            i = ranks.index(rank)
            parts[i : i + 2] = [self.merged[rank]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """A heap of (rank, place) over linked neighbours: n log n. An entry whose pair has changed since is passed over."""
        get, n = self.ranks.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i, pair in enumerate(zip(parts, parts[1:])) if (rank := get(pair)) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j == n or get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (rank := get((parts[left], parts[right]))) is not None:
                    heappush(heap, (rank, left))
        return [p for p in parts if p is not None]

    def learn(self, words: list[str]) -> None:
        """Encode new distinct words together."""
        if len(self.words) > _MOST_CACHED:
            self.words.clear()
        letters = ["".join([self.letters[b] for b in w.encode()]) for w in words]
        guess = [self._propose(x) for x in letters]
        flat = np.fromiter(chain.from_iterable(guess), np.int64)
        ends = np.cumsum(list(map(len, guess)))
        inner = np.ones(max(len(flat) - 1, 0), bool)
        inner[ends[:-1] - 1] = False  # no pair across words
        at = np.flatnonzero(inner)
        wrong = at[~self.compatible(flat[at], flat[at + 1])] if len(at) else at
        data, bounds = flat.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        for word, start, end in zip(words, bounds, bounds[1:]):
            self.words[word] = data[start:end]
        for i in np.unique(np.searchsorted(ends, wrong, "right")).tolist():
            ids = self.merge_exactly(letters[i])
            self.words[words[i]] = pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut, new = [], {}
        for text in texts:
            parts = self.split_special(text) if "<|" in text else [text]
            found = []
            for i, part in enumerate(parts):
                if i % 2:
                    found.append(part)
                else:
                    if part.isascii():
                        found += self.find_ascii(part.lower())
                    else:
                        found += self.find(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            cut.append(found)
            new.update(dict.fromkeys(found))
        for token, i in self.special.items():
            self.words[token] = np.array([i], "<u4").tobytes()
        if fresh := [w for w in new if w not in self.words]:
            self.learn(fresh)
            for token, i in self.special.items():
                self.words[token] = np.array([i], "<u4").tobytes()
            if missing := [w for w in new if w not in self.words]:  # the cache was emptied
                self.learn(missing)
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, found)), "<u4") for found in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with spaces between them: the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load_bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_bpe(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with the token ids of the text in an integer array column.

    ``vocabulary``: path of a vocabulary file that every worker has. Null or empty text: an empty array. Special tokens written
    in a text count as themselves. Whole texts are encoded; any row order and repeated rows are fine.
    """
    coded = lambda texts: [[x.astype(np.int32) for x in load_bpe(vocabulary).encode(texts)]]
    return add_columns(docs, text, [(ids, T.ArrayType(T.IntegerType()))], coded, keep_text=keep_text)


def decode_bpe(docs: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for; null or empty ids: an empty text."""
    return add_columns(docs, ids, [(text, T.StringType())], lambda lists: [list(map(load_bpe(vocabulary).decode, id_lists(lists)))], arrow=True)


def id_lists(column) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays; null: empty."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []
