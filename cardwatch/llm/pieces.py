"""Token ids of many texts at once, by a dictionary of their pieces between white space.

For a vocabulary that splits at white space and drops it, a text's tokens are those of its pieces one after another. Arrow cuts the texts of a slice
and numbers their distinct pieces; each distinct piece is looked up once, pieces not seen before are encoded by the library in bulk, and the ids
of all texts are gathered with offsets. What a worker remembers is bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

REMEMBERED = 500_000  # pieces, about 150 bytes each
AT_ONCE = 5_000
SPACE = " \t\n\v\f\r"
TAIL = ".,!?;:"  # tokens of their own behind a letter


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes of text, one row at least."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right")))
        yield i, j
        i = j


class PieceEncoder:
    """``tokenizer``: of the library; ``path``: its file."""

    def __init__(self, tokenizer, path: str):
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.splits = all(ids(f"a{c}b") == ids("a") + ids("b") for c in (*SPACE, SPACE)) and ids(SPACE) == [] and not any(set(SPACE) & set(t) for t in self.added)
        self.lowers = any(x == {"type": "Lowercase"} for x in (made.get("normalizer") or {}).get("normalizers", []))
        suffix = (made.get("model") or {}).get("end_of_word_suffix")
        self.closes = None
        if suffix:
            vocabulary = tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.closes[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.ids, self.used = np.zeros(1 << 18, dtype=np.int32), 0
        self._remember([""], np.zeros(0, np.int32), np.zeros(1, np.int64))  # before leading and behind trailing white space

    def _remember(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Pieces not known so far, their ids one after another, and where each one's end."""
        k, m = len(self.known), len(pieces)
        while k + m > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], ends[:-1]])
        self.start[k : k + m], self.length[k : k + m] = self.used + begins, ends - begins
        self.known.update(zip(pieces, range(k, k + m), strict=True))
        self.used += len(ids)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces. Those of letters only are one run of tokens each, closed by one that ends a word, so many are encoded as one text."""
        words = [x for x in pieces if x.isalpha()] if self.closes is not None else []
        for a in range(0, len(words), AT_ONCE):
            ids = np.array(self.tokenizer.encode(" ".join(words[a : a + AT_ONCE]), add_special_tokens=False).ids, dtype=np.int32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(words[a : a + AT_ONCE]):  # else they are encoded one by one
                self._remember(words[a : a + AT_ONCE], ids, ends)
        rest = [x for x in pieces if x not in self.known]
        for a in range(0, len(rest), AT_ONCE):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest[a : a + AT_ONCE], add_special_tokens=False)]
            self._remember(rest[a : a + AT_ONCE], np.array([i for x in found for i in x], dtype=np.int32), np.cumsum([len(x) for x in found]))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces stand."""
        strings = pieces.to_pylist()
        found = list(map(self.known.get, strings))
        if None in found:
            self._learn([x for x, k in zip(strings, found, strict=True) if k is None])
            found = list(map(self.known.__getitem__, strings))
        return np.array(found, dtype=np.int64)

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """A-Z lower-cased, as the vocabulary would do after composing characters; special tokens are matched as written, so texts stay where one would gain one by it."""
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy: of a slice the kernel gives wrong offsets
        low = pc.ascii_lower(texts)
        gains = any(pc.any(pc.xor(pc.match_substring(low, x), pc.match_substring(texts, x))).as_py() for x in self.added)
        return texts if gains or not self.lowers else low

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin and end; null has none."""
        if not self.splits or not len(texts):
            texts = texts.cast(pa.large_string()).fill_null("")
            found = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        ids, counts, offsets = self.by_piece(texts)
        return ids, np.concatenate([[0], np.cumsum(counts)])[offsets]

    def by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each piece has, and where each text's pieces begin and end. White space at an end of a text has an empty piece beyond it."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if len(self.known) > REMEMBERED:
            self._forget()
        lists = pc.ascii_split_whitespace(self._lowered(texts))
        numbered = lists.flatten().dictionary_encode()
        pieces, codes = numbered.dictionary, numbered.indices.to_numpy()
        # a second dictionary, of what is left without full stops and the like, and of those
        tailed = pc.match_substring_regex(pieces, "[a-z][" + TAIL + "]+$").to_numpy(zero_copy_only=False) & (self.closes is not None)
        whole, with_tail = pieces.filter(pa.array(~tailed)), pieces.filter(pa.array(tailed))
        cores = pc.utf8_rtrim(with_tail, characters=TAIL)
        tails = pa.array([p[n:] for p, n in zip(with_tail.to_pylist(), pc.utf8_length(cores).to_pylist(), strict=True)], pa.large_string())
        parts = pa.concat_arrays([whole, cores, tails, pa.array([""], pa.large_string())]).dictionary_encode()
        where = self._places(parts.dictionary)[parts.indices.to_numpy()]
        both = np.full((len(pieces), 2), where[-1], dtype=np.int64)
        both[~tailed, 0] = where[: len(whole)]
        both[tailed, 0], both[tailed, 1] = where[len(whole) : len(whole) + len(cores)], where[len(whole) + len(cores) : -1]
        # gather
        which = both[codes].ravel()
        n = self.length[which]
        stops = np.concatenate([[0], np.cumsum(n)])
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return self.ids[np.repeat(self.start[which] - stops[:-1], n) + np.arange(stops[-1])], n.reshape(-1, 2).sum(axis=1), offsets
