"""BPE encoding and decoding: speculate by greedy longest match, verify every adjacent pair.

A token sequence is what merging by rank yields exactly when each neighbouring pair
would also come out of merging alone. So a word is cut greedily into the longest
vocabulary entries, all pairs of a batch of words are checked at once with array
look-ups, and only the words that fail are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from driftline.llm.common import arrow_columns, strings, struct

#: Words whose ids a task remembers; beyond, it starts anew.
CACHE = 150_000
NEVER = 1 << 60
#: Symbols of a word beyond which it is merged by a heap of its own.
LONG_WORD = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBpe:
    """Byte-level BPE over words that end in a suffix, read from a tokenizer file.

    NFC, lower case, white space dropped, pieces by the file's pattern; the file's
    added tokens are found in the raw text first. Ids equal those of the tokenizers
    library without special tokens, and decoded texts those of its decode().
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        v: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (v | self.added).items()}
        self.names: list[str | None] = [names.get(i) for i in range(max(names) + 1)]
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Unicode tables beyond Latin-1 differ between libraries: there the file's own normalizer and pattern decide.
        self.normalize = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.cut = pre_tokenizers.Split(Regex(self.pieces.pattern), "removed", invert=True).pre_tokenize_str
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.table = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.base = base = max(v.values()) + 1
        left = np.array([v[a] for a, _ in merges], np.int64)
        right = np.array([v[b] for _, b in merges], np.int64)
        self.made = np.array([v[a + b] for a, b in merges], np.int64)
        self.made_list: list[int] = self.made.tolist()
        key = left * base + right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order
        self.rank_at = dict(zip(key[::-1].tolist(), range(len(key) - 1, -1, -1), strict=True))  # of equals the first counts
        # The merge that made a token, -1 for single symbols, and its two parts.
        back = slice(None, None, -1)  # of equals the first counts
        self.birth = np.full(base, -1, np.int64)
        self.birth[self.made[back]] = np.arange(len(merges))[back]
        self.left, self.right = np.arange(base), np.arange(base)
        self.left[self.made[back]], self.right[self.made[back]] = left[back], right[back]
        # Single symbols inside a word, and at its end.
        self.inner = {c: i for c, i in v.items() if len(c) == 1}
        self.last = {c: v[c + self.suffix] for c in self.inner if c + self.suffix in v}
        # Only tokens that merging itself yields may be proposed.
        bodies = [(t.removesuffix(self.suffix), t.endswith(self.suffix) and t != self.suffix, i) for t, i in v.items() if t]
        ids, size = self._merged_all([self._symbols(b, end) for b, end, _ in bodies])
        at = np.cumsum(size) - size
        sound = [(b, end, i) for (b, end, i), n, k in zip(bodies, size.tolist(), at.tolist(), strict=True) if n == 1 and ids[k] == i]
        self.ending = {b: i for b, end, i in sound if end}
        # Tokens inside words, and -1 for what only begins one.
        self.starts = {b[:j]: -1 for b, end, _ in sound if not end for j in range(1, len(b))}
        self.starts |= {b: i for b, end, i in sound if not end}
        self.longest = max(map(len, chain(self.ending, self.starts)), default=1)
        self.words: dict[str, bytes] = {}

    def _symbols(self, word: str, end: bool = True) -> list[int]:
        ids = list(map(self.inner.__getitem__, word))
        if end:
            ids[-1] = self.last[word[-1]]
        return ids

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def _merged_all(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words side by side: ids one after another, and their counts.

        Each round makes in every unfinished word the merge of lowest rank, of equals
        the leftmost, and looks up only the pairs beside it. Long words, which would
        keep the rounds going, are merged one by one.
        """
        if long := {i: self._merged_long(w) for i, w in enumerate(words) if len(w) > LONG_WORD}:
            sym, size = self._merged_all([[] if i in long else w for i, w in enumerate(words)])
            for i, w in long.items():
                size[i] = len(w)
            parts = iter(np.split(sym, np.cumsum([n for i, n in enumerate(size.tolist()) if i not in long])[:-1]))
            return np.concatenate([long[i] if i in long else next(parts) for i in range(len(words))]), size
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.fromiter(chain.from_iterable(words), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), NEVER, np.int64)
        seam = np.flatnonzero(word[1:] == word[:-1])
        rank[seam] = self._ranks(sym[seam], sym[seam + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            if (ended := low == NEVER).any():
                done.append((word[ended], sym[ended]))
                sym, word, rank, low = sym[~ended], word[~ended], rank[~ended], low[~ended]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            p = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            sym[p] = self.made[low[p]]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            sym, word, rank = sym[keep], word[keep], rank[keep]
            p = p - np.arange(len(p))  # each merge before moved it by one
            rank[p] = NEVER
            r = p[np.append(word[p[:-1] + 1] == word[p[:-1]], p[-1] + 1 < len(word) and word[min(p[-1] + 1, len(word) - 1)] == word[p[-1]])]
            rank[r] = self._ranks(sym[r], sym[r + 1])
            q = p[(p > 0) & (word[p - 1] == word[p])]
            rank[q - 1] = self._ranks(sym[q - 1], sym[q])
        if not done:
            return sym, size
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _merged_long(self, word: list[int]) -> np.ndarray:
        """Exact merging of one word of n symbols by a linked list and a heap of pairs: n log n steps."""
        n, sym = len(word), list(word)
        array = np.array(word, np.int64)
        ranks = self._ranks(array[:-1], array[1:])
        heap = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(ranks.tolist()) if r != NEVER]
        heapq.heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        made, base, rank_at = self.made_list, self.base, self.rank_at.get

        def offer(i: int, j: int) -> None:
            if (r := rank_at(sym[i] * base + sym[j])) is not None:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:  # one side has been merged meanwhile
                continue
            sym[i], sym[j], right[i] = made[r], -1, right[j]
            if right[j] < n:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return np.array([x for x in sym if x >= 0], np.int64)

    def _propose(self, word: str) -> list[int]:
        """Greedy longest match; the last token carries the suffix."""
        out, i, n, most = [], 0, len(word), self.longest
        ending, starts = self.ending, self.starts
        while True:
            rest = word[i : i + most + 1]
            if rest in ending and n - i <= most:
                out.append(ending[rest])
                return out
            for j in range(1, min(n - i, most + 1)):
                if (k := starts.get(rest[:j])) is None:
                    break
                if k >= 0:
                    token, size = k, j
            out.append(token)
            i += size

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For token pairs: whether merging their joined symbols yields just the two.

        Both tokens are taken apart in the reverse order of their making. If at some
        moment the two symbols at the seam had a merge of lower rank than the merge
        that came next, it would have been taken, and the pair is not stable.
        """
        n = len(a)
        ok, live = np.ones(n, bool), np.arange(n)
        x, y = a.astype(np.int64), b.astype(np.int64)
        # Doubled ranks, odd at the seam: of equals the left token's merge comes before, the right one's after.
        limit = np.full(n, NEVER, np.int64)
        while len(live):
            bad = self._ranks(x, y) * 2 + 1 < limit
            ok[live[bad]] = False
            bx, by = self.birth[x], self.birth[y]
            on = ~bad & ((bx >= 0) | (by >= 0))
            live, x, y, bx, by = live[on], x[on], y[on], bx[on], by[on]
            first = bx > by  # the later made is undone first; of equals the right one was made later
            limit = np.where(first, bx * 2, by * 2 + 2)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of lower-case pieces into the cache as bytes."""
        mapped = [w.encode().decode("latin-1").translate(self.table) for w in words]
        proposed = list(map(self._propose, mapped))
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(words)), size)
        seam = np.flatnonzero(word[1:] == word[:-1])
        pair, back = np.unique(flat[seam] * self.base + flat[seam + 1], return_inverse=True)
        stable = self.compatible(pair // self.base, pair % self.base)[back]
        self._store(words, flat, size)
        if failed := np.unique(word[seam[~stable]]).tolist():
            self._store([words[i] for i in failed], *self._merged_all([self._symbols(mapped[i]) for i in failed]))

    def _store(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        raw, end = ids.astype("<u4").tobytes(), np.cumsum(size) * 4
        self.words.update(zip(words, [raw[a:b] for a, b in zip((end - size * 4).tolist(), end.tolist(), strict=True)], strict=True))

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.pieces.findall(text.lower())
        if _is_latin(text):
            return self.pieces.findall(unicodedata.normalize("NFC", text).lower())
        return [p for p, _ in self.cut(self.normalize(text))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE:
            self.words.clear()
        cut: list[tuple[list[list[str]], list[str]]] = []
        for t in texts:
            marks = self.special.findall(t) if "<|" in t else []
            cut.append(([self._pieces(p) for p in (self.special.split(t) if marks else [t])], marks))
        known = self.words
        fresh = set(chain.from_iterable(p for parts, _ in cut for p in parts)).difference(known)
        if fresh:
            self._learn(list(fresh))
        out = []
        for parts, marks in cut:
            ids = [b"".join(map(known.__getitem__, parts[0]))]
            for m, p in zip(marks, parts[1:], strict=True):
                ids += [self.added[m].to_bytes(4, "little"), *map(known.__getitem__, p)]
            out.append(b"".join(ids))
        for w in fresh:
            if len(w) > LONG_WORD:  # so that memory stays bounded
                del known[w]
        return out

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The tokens, joined by one space, special ones included; unknown ids vanish."""
        array = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        names = self.names
        try:
            return " ".join(map(names.__getitem__, array.tolist()))
        except (IndexError, TypeError):
            return " ".join([t for i in array.tolist() if i < len(names) and (t := names[i]) is not None])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(
    docs: DataFrame, text: str = "text", path: str | None = None, carry: list[str] | None = None, step: int = 256
) -> DataFrame:
    """docs with `ids` (array of int) and `n_tokens`. Null and empty texts give no ids.

    Long texts are encoded whole; a word of n letters takes n log n steps at most.
    Repeated rows give repeated results; columns named ids or n_tokens are replaced.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def work(column):
            texts = strings(column)
            ids = [x for i in range(0, len(texts), step) for x in bpe.encode_batch(texts[i : i + step])]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return [pa.ListArray.from_arrays(offsets, flat), pa.array(sizes)]

        return work

    return arrow_columns(docs, [text], struct(("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType())), make, carry)


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs with `decoded`, the text of the ids column; null ids give an empty text."""
    path = path or default_path()

    def make():
        bpe = load(path)

        def work(column):
            yield pa.array([bpe.decode(np.array(x or [], np.int64)) for x in column.to_pylist()], pa.string())

        return work

    return arrow_columns(docs, [ids], struct(("decoded", T.StringType())), make, carry)


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs with `ids`, `n_tokens` and `decoded`, the text that the ids decode to, in one pass."""
    path = path or default_path()

    def make():
        bpe = load(path)

        def work(column):
            ids = bpe.encode_batch(strings(column))
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4")))
            return [lists, pa.array(sizes), pa.array([bpe.decode(x) for x in ids], pa.string())]

        return work

    out = struct(("ids", T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType()), ("decoded", T.StringType()))
    return arrow_columns(docs, [text], out, make, carry)


def digests(docs: DataFrame, text: str = "text", path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding back.

    Same encoder and decoder as encode() and decode(), in one pass, so that neither
    ids nor decoded texts leave the task.
    """
    path = path or default_path()

    def make():
        bpe = load(path)

        def work(column, step: int = 256):
            n, a, b = [], [], []
            texts = strings(column)
            for i in range(0, len(texts), step):
                for ids in bpe.encode_batch(texts[i : i + step]):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return work

    return arrow_columns(
        docs,
        [text],
        struct(("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())),
        make,
        carry,
    )
