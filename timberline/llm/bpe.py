"""Byte-pair encoding from a public tokenizer file: speculate, verify, and merge only what fails.

A token sequence is what the merges give for its text if every token encodes alone as itself and
no merge ever crosses a border between two neighbours. The second is a property of the pair alone,
tested here for arrays of pairs at once. So a greedy longest match may propose tokens, and only
words with a failing pair are merged step by step.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata

import numpy as np
import regex

NEVER = np.int64(1) << 40
UNMERGED = (1 << 40, -1)
#: Words remembered by a worker; beyond it all but the first learned are forgotten, among which are the
#: common ones. Results don't change.
REMEMBERED, FIRST = 500_000, 60_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file, as arrays over token ids.

    ``end`` is the suffix that marks the last character of a word; inside, a space stands for it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self.size = max(self.names) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.born = np.full(self.size, -1, np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        keys = np.empty(len(pairs), np.int64)
        for r, (a, b) in enumerate(pairs):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.left[z], self.right[z], self.born[z] = x, y, r
            self.rank[x, y] = r, z
            keys[r] = x * self.size + y
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order
        self.whole = self._alone()
        inner = (lambda t: t[: -len(self.end)] + " " if t.endswith(self.end) else t) if self.end else (lambda t: t)
        whole = {inner(t): i for t, i in ids.items()}
        self.alphabet = {t: i for t, i in whole.items() if self.born[i] < 0}
        #: What a greedy match may propose: strings that encode alone as one token.
        self.proposals = {t: i for t, i in whole.items() if self.whole[i]}
        #: Lengths of proposals by their first three characters, the longest first.
        lengths: dict[str, set[int]] = {}
        for t in self.proposals:
            if len(t) > 2:
                lengths.setdefault(t[:3], {1, 2}).add(len(t))
        self.reach = {start: tuple(sorted(of, reverse=True)) for start, of in lengths.items()}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def borders_hold(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """For each pair: is the border between the tokens never merged across?

        The merges of both tokens are undone from the last to the first. At each point the pieces
        that touch, x and y, must not be due before either is taken by its own token. ``inner``
        leaves out the whole tokens themselves.
        """
        x, y = a.copy(), b.copy()
        due_x, due_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        good = np.ones(len(x), bool)
        met = np.full(len(x), not inner)
        while True:
            due = self.pair_rank(x, y)
            good &= ~(met & (due < due_x) & (due <= due_y))
            bx, by = self.born[x], self.born[y]
            undo_y = (by >= bx) & (by >= 0) & good
            undo_x = (bx > by) & good
            met = undo_x | undo_y
            if not met.any():
                return good
            due_x = np.where(undo_x, bx, due_x)
            due_y = np.where(undo_y, by, due_y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_y, self.left[y], y)

    def _alone(self) -> np.ndarray:
        """Proof for every token: does its string encode as this one token?"""
        made = np.flatnonzero(self.born >= 0)
        whole = self.born < 0
        whole[made] = self.borders_hold(self.left[made], self.right[made], inner=True)
        for t in made[np.argsort(self.born[made])]:  # a part that fails fails the whole
            whole[t] &= whole[self.left[t]] and whole[self.right[t]]
        return whole

    def symbols(self, word: str) -> list[int]:
        if self.end:
            return [*(self.alphabet[c] for c in word[:-2]), self.alphabet[word[-2:]]]
        return [self.alphabet[c] for c in word]

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank first, then the leftmost."""
        ids = self.symbols(word)
        if len(ids) > 40:
            return self._merge_long(ids)
        rank = self.rank
        due = [rank.get(p, UNMERGED) for p in zip(ids, ids[1:])]
        while due:
            least = min(due)
            if least is UNMERGED:
                break
            i = due.index(least)
            ids[i : i + 2] = (least[1],)
            del due[i]
            if i:
                due[i - 1] = rank.get((ids[i - 1], ids[i]), UNMERGED)
            if i < len(due):
                due[i] = rank.get((ids[i], ids[i + 1]), UNMERGED)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words: a heap over a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.rank[pair][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for s, e in ((before[i], i), (i, k)):
                if s >= 0 and e < n and (near := (ids[s], ids[e])) in self.rank:
                    heapq.heappush(heap, (self.rank[near][0], s, near))
        return [t for t in ids if t >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; with an end mark, never leaves the mark without a character."""
        out, at, n = [], 0, len(word)
        known, reach, mark = self.proposals, self.reach, bool(self.end)
        while at < n:
            for size in reach.get(word[at : at + 3], (2, 1)):
                stop = at + size
                if stop > n or (mark and stop == n - 1):
                    continue
                if (t := known.get(word[at:stop])) is not None:
                    out.append(t)
                    at = stop
                    break
        return out

    def encode(self, words: list[str], speculate: bool = True) -> list[list[int]]:
        """Token ids of words in the byte alphabet, the end mark as a space.

        A word that is proven to be one token is looked up. For the others a greedy match proposes
        and failing words are merged; without ``speculate`` all others are merged.
        """
        known = self.proposals
        if not speculate:
            return [[t] if (t := known.get(w)) is not None else self.merge(w) for w in words]
        out = [[t] if (t := known.get(w)) is not None else self.propose(w) for w in words]
        flat = np.fromiter((t for ids in out for t in ids), np.int64)
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        owner = np.repeat(np.arange(len(out)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pair, where = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.borders_hold(pair // self.size, pair % self.size)
        for i in np.unique(owner[inside[~good[where]]]).tolist():
            out[i] = self.merge(words[i])
        return out


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """One vocabulary per worker and path."""
    return Merges(path)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine; full paths are taken as they are."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_BYTES = byte_alphabet()


def in_bytes(word: str) -> str:
    return "".join([_BYTES[b] for b in word.encode("utf-8", "surrogatepass")])


class TextEncoder:
    """Whole texts by a vocabulary file.

    ``render`` turns the ids of a word into what is remembered for it, ``join`` puts such values
    together. What stands between two spaces is remembered as a whole; only new words meet the
    vocabulary, many at a time.
    """

    def __init__(self, path: str, render, join, speculate: bool = True):
        self.bpe = merges(path)
        self.render, self.join, self.speculate = render, join, speculate
        self.words: dict = {}
        self.chunks: dict = {}
        names = sorted(self.bpe.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def split(self, text: str) -> list[str]:
        """The words of any text."""
        raise NotImplementedError

    def of_chunk(self, chunk: str) -> list[str]:
        """The words of a chunk as ``cut`` gives it."""
        raise NotImplementedError

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Words of the beginning, and the chunks of the rest."""
        raise NotImplementedError

    def spell(self, word: str) -> str:
        return in_bytes(word)

    def _learn_words(self, words: set[str]) -> None:
        new = list(words - self.words.keys())
        ids = self.bpe.encode(list(map(self.spell, new)), self.speculate)
        self.words.update(zip(new, map(self.render, ids)))

    def _learn(self, heads: set[str], chunks: set[str]) -> None:
        split = {c: self.of_chunk(c) for c in chunks}
        heads = set(heads)
        for words in split.values():
            heads.update(words)
        self._learn_words(heads)
        of, join = self.words.__getitem__, self.join
        self.chunks.update({c: of(words[0]) if len(words) == 1 else join(list(map(of, words))) for c, words in split.items()})

    def _parts(self, text: str) -> list[tuple[list[str], list[str], str]]:
        """Words, chunks, and the special token that follows; in turn."""
        if self.special is None or not (m := self.special.search(text)):
            return [(*self.cut(text), "")]
        parts, at = [], 0
        while m:
            parts.append((self.split(text[at : m.start()]), [], m[0]))
            m = self.special.search(text, at := m.end())
        return [*parts, (self.split(text[at:]), [], "")]

    def texts(self, texts: list[str], at_once: int = 2_000_000) -> list:
        out, start = [], 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < at_once:
                size += len(texts[stop])
                stop += 1
            if len(self.chunks) + len(self.words) > REMEMBERED:
                self.words = dict(itertools.islice(self.words.items(), FIRST))
                self.chunks = dict(itertools.islice(self.chunks.items(), FIRST))
            known = self.chunks.get
            cuts, heads, new = [], set(), set()
            for text in texts[start:stop]:
                cuts.append(cut := [])
                for words, rest, name in self._parts(text):
                    heads.update(words)
                    values = list(map(known, rest))
                    if None in values:
                        new.update([c for c, v in zip(rest, values) if v is None])
                    else:
                        rest = None
                    cut.append((words, rest, values, name))
            self._learn(heads, new)
            word, chunk = self.words.__getitem__, self.chunks.__getitem__
            for cut in cuts:
                total = []
                for words, rest, values, name in cut:
                    total += map(word, words)
                    total += values if rest is None else map(chunk, rest)
                    if name:
                        total.append(self.render([self.bpe.specials[name]]))
                out.append(self.join(total))
            start = stop
        return out


class PieceEncoder(TextEncoder):
    """For byte-level vocabularies without normalisation, a leading space being part of a word."""

    #: Fixed: the published split pattern of this family of vocabularies.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    #: White space other than a space or a line feed.
    ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def split(self, text: str) -> list[str]:
        return self.SPLIT.findall(text)

    def of_chunk(self, chunk: str) -> list[str]:
        return self.SPLIT.findall(" " + chunk)

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or self.ODD.search(text):
            # A space touches white space: splitting at spaces would not give the same words.
            return self.SPLIT.findall(text), []
        first, *rest = text.split(" ")
        return self.SPLIT.findall(first), rest


class PieceLibrary:
    """Whole texts by the same kind of vocabulary in compiled code, for operators whose method is
    elsewhere: a text gives its unsigned 32-bit ids."""

    def __init__(self, path: str):
        import tiktoken

        bpe = merges(path)
        of = {c: b for b, c in enumerate(_BYTES)}
        special = set(bpe.specials.values())
        ranks = {bytes(of[c] for c in t): i for i, t in bpe.names.items() if i not in special}
        born = bpe.born[sorted(ranks.values())]
        if (np.diff(born[born >= 0]) < 0).any() or (born[:256] >= 0).any():
            raise ValueError("the order of ids must be the order of merges")
        self.codec = tiktoken.Encoding("file", pat_str=PieceEncoder.SPLIT.pattern, mergeable_ranks=ranks, special_tokens=bpe.specials)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        return [self.codec.encode_to_numpy(t, allowed_special="all") for t in texts]


class PieceCounter(PieceEncoder):
    """Token counts: a word that is proven to be one token is looked up, the others are merged by
    the compiled library."""

    def __init__(self, path: str):
        super().__init__(path, len, sum)
        of = {c: b for b, c in enumerate(_BYTES)}
        spelled = (bytes(of[c] for c in t) for t in self.bpe.proposals if t not in self.bpe.specials)
        #: The whole tokens as text, where they are text.
        self.whole = {t.decode() for t in spelled if t.decode(errors="ignore").encode() == t}
        self.merge = PieceLibrary(path).codec.encode_ordinary

    def _learn_words(self, words: set[str]) -> None:
        whole, merge = self.whole, self.merge
        self.words.update({w: 1 if w in whole else len(merge(w)) for w in words - self.words.keys()})


class MarkedEncoder(TextEncoder):
    """For lower-cased vocabularies that mark the end of words and drop white space."""

    #: Fixed: the published split pattern of this family of vocabularies.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Separators on which white space is defined differently.
    ODD = re.compile(r"[\x1c-\x1f]")

    def split(self, text: str) -> list[str]:
        # Letters are lowered one by one: a final sigma is not special.
        return self.SPLIT.findall(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    def of_chunk(self, chunk: str) -> list[str]:
        return [chunk.lower()] if chunk.isascii() and chunk.isalpha() else self.split(chunk)

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        return (self.split(text), []) if self.ODD.search(text) else ([], text.split())

    def spell(self, word: str) -> str:
        return in_bytes(word) + " "
