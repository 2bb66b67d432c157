"""Byte-pair encoding with word ends, for vocabularies in the ``tokenizers`` JSON form.

Two merge loops over the same merge table are here: one by heap and linked list, which only
counts, and one by a contiguous rank array, which yields the parts.  Both run once per distinct
word and worker; documents are then assembled with numpy from the words' results.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from sumiveil.llm.common import words_of

NO_PAIR = 1 << 30
#: The longest pre-token that is merged by scanning its rank array.
SHORT = 512
#: Latin-1 characters for which lower-casing and the word pattern are decided here; any other
#: character sends its word through the library's own normaliser and splitter.
PLAIN = re.compile("[!-~¡-¬®-ÿ]*")
LETTERS = "a-zªµºß-öø-ÿ"
DIGITS = "0-9²³¹¼-¾"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies use them."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand = {b: chr(b) for b in own}
    stand.update({b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in stand)})
    return [stand[b] for b in range(256)]


class WordBpe:
    """One vocabulary, its merges and the caches of a worker."""

    def __init__(self, path: str, cache_words: int = 250_000, cache_parts: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        stand = byte_letters()
        #: Ids are kept in 16 bits where the vocabulary allows it.
        self.kind = np.dtype(np.uint16 if max(self.tokens, default=0) < 1 << 16 else np.uint32)
        self.first = [vocab[c] for c in stand]
        self.last = [vocab[c + self.end] for c in stand]
        self.letter_byte = {c: b for b, c in enumerate(stand)}
        self.library = Tokenizer.from_file(path)
        self.cache_words, self.cache_parts = cache_words, cache_parts
        self.stand = stand
        self._caches: dict[Callable, tuple[dict, dict]] = {}

    def symbols(self, part: bytes) -> list[int]:
        first = self.first
        return [first[b] for b in part[:-1]] + [self.last[part[-1]]] if part else []

    def parts(self, word: str) -> list[bytes]:
        """The pre-tokens of a word that holds no ASCII white space and no special token."""
        if PLAIN.fullmatch(word):
            return [p.encode() for p in PARTS.findall(word.lower())]
        text = self.library.normalizer.normalize_str(word)
        return [bytes(self.letter_byte[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    # -- heap and linked list -------------------------------------------------------------

    def count_part(self, part: bytes) -> int:
        """Tokens of a pre-token: its symbols less the merges."""
        symbol = self.symbols(part)
        return len(symbol) - self.merge_by_heap(symbol)

    def merge_by_heap(self, symbol: list[int]) -> int:
        """The number of merges, popped lowest rank (then leftmost) first; in ``symbol`` a merged pair is its id and -1."""
        n = len(symbol)
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                found = merges.get((new, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbol[h], new))
                if found:
                    heapq.heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return done

    # -- contiguous rank array ------------------------------------------------------------

    def ids_part(self, part: bytes) -> list[int]:
        """Ids of a pre-token: the least rank of a flat array names the boundary to delete, again and again.

        Each scan is as long as the array, so beyond ``SHORT`` symbols the heap, which makes the same
        merges in the same order, takes its place.
        """
        ids = self.symbols(part)
        if len(ids) > SHORT:
            self.merge_by_heap(ids)
            return [i for i in ids if i >= 0]
        merges = self.merges
        none = (NO_PAIR, -1)
        ranks = [merges.get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least[0] == NO_PAIR:
                break
            at = ranks.index(least)
            ids[at] = least[1]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = merges.get((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = merges.get((ids[at - 1], ids[at]), none)
        return ids

    # -- words ----------------------------------------------------------------------------

    def _split(self, word: str) -> list[str]:
        if self.special_split is None or "<|" not in word:
            return [word]
        return [x for x in self.special_split.split(word) if x]

    def count_word(self, word: str, parts: dict) -> int:
        n = 0
        for piece in self._split(word):
            if piece in self.special:
                n += 1
                continue
            for p in self.parts(piece):
                if (k := parts.get(p)) is None:
                    k = parts[p] = self.count_part(p)
                n += k
        return n

    def library_part(self, part: bytes) -> list[int]:
        """Ids of a pre-token by the library's own merges, for operators that name no method of their own."""
        stand = self.stand
        return [t.id for t in self.library.model.tokenize("".join([stand[b] for b in part]))]

    def _ids(self, word: str, parts: dict, merge: Callable) -> bytes:
        out = b""
        for piece in self._split(word):
            if piece in self.special:
                out += self.kind.type(self.special[piece]).tobytes()
                continue
            for p in self.parts(piece):
                if (ids := parts.get(p)) is None:
                    ids = parts[p] = array(self.kind.char, merge(p)).tobytes()
                out += ids
        return out

    def ids_word(self, word: str, parts: dict) -> bytes:
        """The ids of a word by the rank array, as native numbers of ``kind``."""
        return self._ids(word, parts, self.ids_part)

    def library_word(self, word: str, parts: dict) -> bytes:
        return self._ids(word, parts, self.library_part)

    def digest_word(self, word: str, parts: dict) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal, and their tokens, each joined by blanks."""
        ids = np.frombuffer(self.ids_word(word, parts), self.kind).tolist()
        return len(ids), " ".join(map(str, ids)).encode(), " ".join([self.tokens[i] for i in ids]).encode()

    def lookup(self, words: pa.Array, one: Callable) -> list:
        """``one`` of every distinct word, from the worker's cache where it is there.

        The caches are emptied, not grown, beyond ``cache_words`` and ``cache_parts`` entries.
        """
        known, parts = self._caches.setdefault(one.__func__, ({}, {}))
        if len(known) > self.cache_words:
            known.clear()
        if len(parts) > self.cache_parts:
            parts.clear()
        out = []
        for w in words.to_pylist():
            if (r := known.get(w)) is None:
                r = known[w] = one(w, parts)
            out.append(r)
        return out

    def encode(self, texts: pa.Array, by_library: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Word codes, row offsets, each distinct word's ids (of ``kind``) and number of ids."""
        codes, offsets, words = words_of(texts)
        ids = self.lookup(words, self.library_word if by_library else self.ids_word)
        return codes, offsets, ids, np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The vocabulary at ``path``, read once per worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
