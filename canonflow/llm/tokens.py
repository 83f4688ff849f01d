"""Token ids of whole texts, by vocabularies of public tokenizers."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import shards

#: Text bytes whose different words are encoded together.
CHUNK_BYTES = 4 << 20
#: Words whose ids a worker remembers, for all its tasks; beyond these, words are encoded anew. It bounds memory (about 20 MB), and has no part in results.
REMEMBERED = 300_000
#: Words of two parts that are encoded apart: Latin letters, and ASCII punctuation without apostrophes, which can begin an ending ('s).
PLAIN = "^(?P<stem>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)(?P<tail>[!-&(-/:-@\\[-`{-~]*)$"
#: A word of its own, put between others; it has one token in the vocabularies used.
MARK = "\x01"
MARKED = 1000


def gather(ids: np.ndarray, start: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at places, one place after the other, and where each begins, with the total at the end."""
    length = (start[1:] - start[:-1])[places]
    total = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(start[:-1][places] - total[:-1], length)
    at += np.arange(total[-1])
    return ids[at], total


@functools.cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker."""
    return WordTokenizer(path)


class WordTokenizer:
    """Ids of a tokenizer that drops white space and never joins across it, so that the ids of a text are those of its parts between spaces and line breaks, in order. Each different part of some MB of text is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alone, spaced = self._encode(["ab", "\n ab  cd "])
        cased = ["A", "B", "X", "The", "ÀB"]
        if spaced != [*alone, *self._encode(["cd"])[0]]:
            raise ValueError(f"{path}: ids depend on white space, which this tokenizer is made to drop")
        #: Whether letters are folded by the tokenizer itself, so that they may be before.
        self.folds = self._encode(cased) == self._encode([x.lower() for x in cased])
        mark = self._encode([f"a {MARK} a"])[0]
        self.mark = mark[1] if len(mark) == 3 and mark[0] == mark[2] != mark[1] else None
        self.known = pa.array([""], pa.large_string())
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As learn, each word by itself."""
        own = self._encode(words.to_pylist())
        return np.array([x for ids in own for x in ids], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where each begins, with the total at the end)."""
        n = len(words)
        if self.mark is None or not n or pc.any(pc.match_substring(words, MARK)).as_py():
            return self.alone(words)
        cuts = np.append(np.arange(0, n, MARKED), n)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar(f" {MARK} ", words.type)).to_pylist()
        parts = [np.array(x, np.uint32) for text in joined for x in (*self._encode([text]), [self.mark])]
        ids = np.concatenate(parts)
        marks = np.flatnonzero(ids == self.mark)  # one after each word
        if len(marks) != n:  # a word has the mark's id, as unknown ones may
            return self.alone(words)
        return np.delete(ids, marks), np.concatenate([[0], marks - np.arange(n)])

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each different word, ids, where each place begins)."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        ids, start = self.learn(new)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        place[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(new)) + len(self.known)
        ids, start = np.concatenate([self.ids, ids]), np.concatenate([self.start, start[1:] + self.start[-1]])
        if len(self.known) + len(new) <= REMEMBERED:
            self.known, self.ids, self.start = pa.concat_arrays([self.known, new]), ids, start
        return place, ids, start

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all different words, where each begins, with the total at the end)."""
        parts = pc.extract_regex(words, PLAIN)
        plain = parts.is_valid()
        stems, tails = (pc.struct_field(parts, k).filter(plain) for k in (0, 1))
        stems, tails, rest = (pc.utf8_lower(stems) if self.folds else stems).dictionary_encode(), tails.dictionary_encode(), words.filter(pc.invert(plain))
        units = pc.unique(pa.concat_arrays([stems.dictionary, tails.dictionary, rest]))
        place, ids, start = self.look_up(units)
        of = lambda x: place[pc.index_in(x, value_set=units).to_numpy()]
        pair = np.zeros((len(words), 2), np.int64)  # place 0 is the empty word
        plain = plain.to_numpy(zero_copy_only=False)
        pair[plain, 0] = of(stems.dictionary)[stems.indices.to_numpy()]
        pair[plain, 1] = of(tails.dictionary)[tails.indices.to_numpy()]
        pair[~plain, 0] = of(rest)
        found, first = gather(ids, start, pair.reshape(-1))
        return found, first[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins, with the total at the end). Null is the empty text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        plain = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        lists = pc.split_pattern(plain, " ")
        first = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        ids, start = self.words(coded.dictionary)
        ids, total = gather(ids, start, coded.indices.to_numpy())
        return ids, total[first - first[0]]

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, beginnings) of runs of rows of some MB, or of one longer row."""
        for at, to, _, _ in shards(texts, CHUNK_BYTES):
            yield at, to, *self.encode(texts.slice(at, to - at))


class TiktokenCounter:
    """Counts of a byte-level vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.fromiter((0 if (t := x.as_py()) is None else len(self.encoding.encode_ordinary(t)) for x in texts), np.int64, len(texts))


@functools.cache
def byte_counter(path: str, pattern: str) -> TiktokenCounter:
    """One for all tasks of a worker: each holds the vocabulary and a pattern per thread."""
    return TiktokenCounter(path, pattern)
