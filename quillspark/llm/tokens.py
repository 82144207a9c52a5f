"""Token ids of whole texts with the tokenizers library, encoding each distinct word of a worker once.

A text is divided where neither tokenizer joins anything: at single spaces (the byte-level one attaches a space to what
follows it, the word-level one drops it), and between a word and the signs after it. So the ids of a text are those of
its words in turn. Texts in which a space stands beside other white space are encoded in one piece where spaces count. The words' ids stay in the worker
for later batches, up to a number of words."""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space as the tokenizers' patterns see it.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BORDER = "\x01"
#: Texts encoded in one piece where spaces count; \x01 marks the borders in the others.
UNEVEN = f"{SPACES} | {SPACES}|{BORDER}"
#: Where spaces count: a letter before a sign (no apostrophe), and a line end between others, which any pattern divides.
SIGN_AFTER, LINE_END = r"([a-zA-ZÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])", r"([!-~])\n([!-~])"
CACHED = 500_000
#: Where spaces don't count: a letter and a run of signs (no apostrophe) before a space, which any pattern divides.
SIGNS = r"([a-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+) "
#: Capitals that composition may treat unlike small letters.
COMPOSED = r"[A-Z]\p{M}"
#: One mark at a word's end that is a token of its own for either tokenizer.
MARKS = frozenset(",.;:!?")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others counted up from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    def __init__(self, path: str, spaces_count: bool, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces_count, self.cached = Tokenizer.from_file(path), spaces_count, cached
        #: Strings that the library takes as one id wherever they stand: texts that hold one are encoded in one piece.
        self.special = "|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()) or r"[^\s\S]"
        self.size = self.tokenizer.get_vocab_size()
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint16 if self.size <= 1 << 16 else np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _word(self, key: str) -> list[int] | None:
        """Ids of a key that is letters, with one mark after them at most, straight from the library's model: no
        pattern divides it. None for other keys."""
        word, tail = key.removeprefix(" ") if self.spaces_count else key, ()
        if word[-1:] in MARKS:
            word, tail = word[:-1], self.merge(word[-1])
        if not word.isalpha():
            return None
        if not self.spaces_count:
            if not word.isascii() and (max(word) >= "\u0250" or "\u0130" in word):  # may change when normalised
                return None
            word = word.lower()
        elif key[0] == " ":
            word = " " + word
        if self.spaces_count or not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merge(word)]
        return ids + [t.id for t in tail] if tail else ids

    def _encode_keys(self, keys: list[str]) -> list[list[int]]:
        merge, word = self.merge, self._word
        if self.spaces_count:
            found = [word(k) for k in keys]
        else:
            found = [[t.id for t in merge(k.lower())] if k.isascii() and k.isalpha() else word(k) for k in keys]
        if rest := [i for i, x in enumerate(found) if x is None]:
            for i, x in zip(rest, self._ids([keys[i] for i in rest]), strict=True):
                found[i] = x
        return found

    def _learn(self, keys: list[str]) -> None:
        n = len(self.at)
        found = self._encode_keys(keys)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        while n + len(keys) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        while self.used + lengths.sum() > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.starts[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(keys)] = lengths
        flat = [i for x in found for i in x]
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.at.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _known(self, keys: list[str]) -> np.ndarray:
        """Rows of the keys. What is learned above the bound holds for this call's texts alone."""
        while len(self.at) > self.cached:
            self.at.popitem()
        self.used = min(self.used, int(self.starts[len(self.at) - 1] + self.lengths[len(self.at) - 1])) if self.at else 0
        found = list(map(self.at.get, keys))
        if None in found:
            at = [i for i, x in enumerate(found) if x is None]
            self._learn(list(dict.fromkeys(keys[i] for i in at)))
            for i in at:
                found[i] = self.at[keys[i]]
        return np.array(found, np.int64)

    def _divided(self, column: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer distinct words, where spaces don't count: in lower case, line ends as
        spaces, a space before the signs at a word's end."""
        lower = pc.ascii_lower(column)
        composed = pc.match_substring_regex(column, COMPOSED)
        if pc.any(composed).as_py():
            lower = pc.if_else(composed, column, lower)
        return pc.replace_substring_regex(pc.replace_substring(lower, "\n", " "), SIGNS, r"\1 \2 ")

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of ids of each text). Null counts as empty."""
        column = pc.fill_null(column, "")
        if not len(column):
            return self.pool[:0], np.zeros(0, np.int64)
        # either case: a vocabulary may put texts in lower case first
        whole = pc.match_substring_regex(column, f"(?i){self.special}").to_numpy(zero_copy_only=False)
        if self.spaces_count:
            whole = whole | pc.match_substring_regex(column, UNEVEN).to_numpy(zero_copy_only=False)
        divided = pc.if_else(pa.array(whole), "", column) if whole.any() else column
        if self.spaces_count:
            divided = pc.replace_substring(divided, " ", f"{BORDER} ")
            divided = pc.replace_substring_regex(divided, SIGN_AFTER, rf"\1{BORDER}\2")
            divided = pc.replace_substring_regex(divided, LINE_END, f"\\1{BORDER}\n{BORDER}\\2")
        else:
            divided = self._divided(divided)
        parts = pc.split_pattern(divided, BORDER if self.spaces_count else " ")
        words = parts.flatten().dictionary_encode()
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        rows = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        where = np.repeat(self.starts[rows] - ends + lengths, lengths) + np.arange(ends[-1])
        ids, counts = self.pool[where], np.add.reduceat(lengths, offsets[:-1])
        if whole.any():
            pieces, cut = [], np.concatenate([[0], np.cumsum(counts)])
            direct = iter(self._ids([column[i].as_py() for i in np.flatnonzero(whole)]))
            for i, w in enumerate(whole):
                pieces.append(np.array(next(direct), self.pool.dtype) if w else ids[cut[i] : cut[i + 1]])
            ids, counts = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        return ids, counts


_held: dict[tuple, object] = {}


def held(key: tuple, make):
    """What make() returns, kept for later tasks of this worker until it asks for another: workers outlive the stages of
    a pipeline, and those of an executor's cores would otherwise each keep the vocabularies and words of all stages."""
    if key not in _held:
        drop_held()
        _held[key] = make()
    return _held[key]


def drop_held() -> None:
    if _held:
        _held.clear()
        release()


def encoder(path: str, spaces_count: bool, cached: int = CACHED) -> WordEncoder:
    return held((path, spaces_count, cached), lambda: WordEncoder(path, spaces_count, cached))


def release() -> None:
    """Give memory that this worker no longer uses back to the system: workers outlive their tasks, and those of an
    executor's cores would otherwise each keep the most that any task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a system without it keeps the memory for later use
        pass


def slices(batches, column: str, most: int = 6_000_000):
    """Parts of the batches with at most that many bytes of text, one row at least: bounds a worker's memory."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end
    release()
