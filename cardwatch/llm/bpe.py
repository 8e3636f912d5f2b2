"""Operator 12: BPE encoding and decoding; long texts by tree concatenation.

Encoding is not local: what a cut takes apart changes tokens on both sides of it. A long text is cut in halves, again and again, down to
leaves; the leaves are encoded independently of each other, and halves are put together from the bottom up. At each join a window
of text around the cut is encoded. If it holds a token that the left half has too, and behind the cut one that the right half has too (same ids
over the same characters), the tokens up to the first, those of the window between, and those from the second on are the tokens
of both halves' text; else the window grows to twice its reach, at the end to the whole of both halves, which is encoding them directly.

Why this is exact: a sequence of tokens is the encoding of its text if and only if every two neighbours are the encoding of theirs. All neighbours
in the result are neighbours in the left half, in the window or in the right half, and behind a token that two encodings share the splitting into words goes on
alike. Tokens that share a character (bytes of one character), and all tokens of a short word between white space, are shared together or not at all. Special tokens are
found in the text before anything else, and normalisation composes marks with what they follow, so neither a cut nor the edge of a window lies inside a special token
or a combining sequence: it moves out of it. If a vocabulary's added tokens depend on what
stands around them (or on normalised text), texts are encoded whole.

A text of one leaf is encoded at once, by a dictionary of the pieces that texts share (``pieces``). Leaves of one text are encoded in bulk inside a task; of texts above TASK characters the leaves are rows that many tasks encode, and
each round of the tree joins two neighbouring rows and writes the result, so a lost executor costs one round.

Defined cases: null and empty texts have no tokens and decode to the empty text; rows that repeat and null ids are encoded row by row; an
empty table gives no rows; very long texts are encoded whole; other columns are not read, whatever their names. Truncation and padding that a vocabulary file
names are switched off. Decoding gives what the library's decode gives, special tokens included.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.pieces import SPACE, PieceEncoder, slices
from cardwatch.llm.text import table
from cardwatch.session import stage

LEAF = 16_384  # characters that are encoded at once
REACH = 64  # characters on each side of a cut that the first window holds
PIECE_CHARS = 256  # a piece between white space up to this long is shared whole or not at all
BULK = 512  # characters from which a part is cut into pieces instead of given to the library
TASK = 1 << 20  # characters of one text that a task encodes
PIECE = 4 << 20  # bytes of several texts at a time

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, first character, character behind the last


class Codec:
    """A vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # cores belong to tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.local = not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added)
        self._special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) or r"(?!)")
        self._strings: pa.Array | None = None

        self.pieces = PieceEncoder(self.tokenizer, path)

    def specials(self, text: str, base: int = 0) -> list[tuple[int, int]]:
        return [(m.start() + base, m.end() + base) for m in self._special.finditer(text)]

    def spans(self, texts: list[str], starts: list[int]) -> list[Tokens]:
        """Ids of parts of a text and the characters they stand for: of tokens in a piece between white space of up to PIECE_CHARS characters, all of the piece."""
        laid = [_laid(t) for t in texts]
        found: list[Tokens | None] = [None] * len(texts)
        plain = [i for i, (a, b) in enumerate(laid) if self.pieces.splits and len(texts[i]) > BULK and (b - a).max(initial=0) <= PIECE_CHARS]
        if plain:
            ids, counts, ends = self.pieces.by_piece(pa.array([texts[i] for i in plain], pa.large_string()))
            places = np.concatenate([[0], np.cumsum(counts)])
            for i, x, y in zip(plain, ends[:-1], ends[1:], strict=True):
                a, b = laid[i]
                found[i] = ids[places[x] : places[y]], np.repeat(a, counts[x:y]) + starts[i], np.repeat(b, counts[x:y]) + starts[i]
        rest = [i for i, x in enumerate(found) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            places = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
            first, behind = places[:, 0], places[:, 1]
            if self.pieces.splits and len(first):
                a, b = laid[i]
                k = np.searchsorted(a, first, side="right") - 1
                short = b[k] - a[k] <= PIECE_CHARS
                first, behind = np.where(short, a[k], first), np.where(short, b[k], behind)
            found[i] = np.array(e.ids, dtype=np.int32), first + starts[i], behind + starts[i]
        return found

    def join(self, text: str, base: int, cut: int, left: Tokens, right: Tokens, reach: int, special: list[tuple[int, int]]) -> Tokens:
        """Tokens of ``text``, which begins at ``base``, from those of its parts before and behind ``cut``."""
        stop = base + len(text)
        while True:
            low, high = _edge(cut - reach, text, base, special, up=False), _edge(cut + reach, text, base, special, up=True)
            low, high = max(base, low), min(stop, high)
            window = self.spans([text[low - base : high - base]], [low])[0]
            before = (0, 0) if low == base else _shared(left, window, low, cut, last=True)
            behind = (len(window[0]), len(right[0])) if high == stop else _shared(window, right, cut, high, last=False)
            if before and behind:
                (keep, a), (b, take) = before, behind
                return tuple(np.concatenate([x[:keep], y[a:b], z[take:]]) for x, y, z in zip(left, window, right, strict=True))
            reach *= 2

    def tree(self, text: str, base: int = 0, leaf: int = LEAF, reach: int = REACH) -> Tokens:
        """Tokens of a text of any length."""
        special = self.specials(text)
        edges = np.linspace(0, len(text), 2 ** max(0, (len(text) - 1) // leaf).bit_length() + 1).astype(np.int64).tolist()
        edges = [_edge(x, text, 0, special, up=False) for x in edges]
        parts = self.spans([text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], [base + a for a in edges[:-1]])
        placed = [(a + base, b + base) for a, b in special]
        while len(parts) > 1:
            halves = zip(edges[:-2:2], edges[1:-1:2], edges[2::2], parts[::2], parts[1::2], strict=True)
            parts = [self.join(text[a:b], base + a, base + cut, x, y, reach, placed) for a, cut, b, x, y in halves]
            edges = edges[::2]
        return parts[0]

    def encode(self, texts: pa.Array, leaf: int = LEAF, reach: int = REACH) -> pa.ListArray:
        """Ids of every text: of one leaf by the pieces that texts share, of more by their tree."""
        large = pc.greater(pc.utf8_length(texts), leaf if self.local else sys.maxsize).fill_null(False).to_numpy(zero_copy_only=False)
        if not large.any():
            ids, offsets = self.pieces.encode(texts)
        else:
            given = texts.to_pylist()
            ids, offsets = self.pieces.encode(pa.array(["" if big else t for t, big in zip(given, large.tolist(), strict=True)], pa.large_string()))
            found = [self.tree(t, 0, leaf, reach)[0] if big else ids[a:b] for t, big, a, b in zip(given, large.tolist(), offsets[:-1], offsets[1:], strict=True)]
            ids, offsets = np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. A vocabulary without a decoder has its tokens joined by one space, for all lists at once."""
        if self.tokenizer.decoder is not None:
            return pa.array([self.tokenizer.decode(x, skip_special_tokens=False) for x in ids.fill_null([]).to_pylist()], pa.string())
        if self._strings is None:
            known = self.tokenizer.get_vocab(with_added_tokens=True)
            strings: list[str | None] = [None] * (max(known.values(), default=-1) + 1)
            for token, i in known.items():
                strings[i] = token
            self._strings = pa.array(strings, pa.large_string())
        tokens = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self._strings.take(ids.values))
        return pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).cast(pa.string())


_PIECE = re.compile("[^ \t-\r]+")


def _laid(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a text begin and end, with an empty one beyond white space at its ends."""
    places = [m.span() for m in _PIECE.finditer(text)]
    if not text or text[0] in SPACE:
        places.insert(0, (0, 0))
    if text and text[-1] in SPACE:
        places.append((len(text), len(text)))
    found = np.array(places, dtype=np.int64)
    return found[:, 0], found[:, 1]


def _continues(c: str) -> bool:
    """Characters that normalisation may combine with the one before: marks, and vowels and final consonants of Hangul."""
    return c >= "\u0300" and (unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff")


def _edge(place: int, text: str, base: int, special: list[tuple[int, int]], *, up: bool) -> int:
    """The nearest place below (or above) at which ``text``, which begins at ``base``, can be cut: outside special tokens and combining sequences."""
    while base < place < base + len(text):
        k = bisect_left(special, (place,)) - 1
        if k >= 0 and place < special[k][1]:
            place = special[k][up]
        elif _continues(text[place - base]):
            place += 1 if up else -1
        else:
            break
    return place


def _pieces(tokens: Tokens, low: int, high: int) -> Iterator[tuple[tuple[int, int, bytes], int, int]]:
    """(characters and ids, first token, token behind the last) of the smallest runs of tokens between low and high that share no character with others."""
    ids, start, end = tokens
    i, j = np.searchsorted(start, low, side="left"), np.searchsorted(start, high, side="left")
    top = end[i - 1] if i else -1
    edges = []
    for k in range(int(i), int(j)):
        if start[k] >= top:
            edges.append(k)
        top = max(top, end[k])
    if len(start) == j or start[j] >= top:
        edges.append(int(j))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if end[a:b].max() <= high:
            yield (int(start[a]), int(end[a:b].max()), ids[a:b].tobytes()), a, b


def _shared(one: Tokens, two: Tokens, low: int, high: int, *, last: bool) -> tuple[int, int] | None:
    """Places in both token sequences behind a piece that both have between low and high (last) or before it."""
    known = {piece: (a, b) for piece, a, b in _pieces(one, low, high)}
    common = [(known[piece], (a, b)) for piece, a, b in _pieces(two, low, high) if piece in known]
    if not common:
        return None
    (a, b), (c, d) = common[len(common) // 2]  # away from the cut and from the window's edge
    return (b, d) if last else (a, c)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer: str, *, leaf: int = LEAF, reach: int = REACH, task: int = TASK) -> DataFrame:
    """doc_id, ids of every row of docs (doc_id, text, ...)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for i, j in slices(batch.column("text"), PIECE):
                found = own.encode(batch.column("text").slice(i, j - i), leaf, reach)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), found], names=["doc_id", "ids"])

    size = F.coalesce(F.length("text"), F.lit(0))
    longest = docs.agg(F.max(size)).first()[0] or 0
    if longest <= task or not codec(tokenizer).local:
        return docs.select("doc_id", "text").mapInArrow(short, f"doc_id {kind}, ids array<int>")
    plain = docs.filter(size <= task).select("doc_id", "text").mapInArrow(short, f"doc_id {kind}, ids array<int>")
    return plain.unionByName(_encode_long(docs.filter(size > task), tokenizer, kind, leaf, reach, task, longest))


def _encode_long(docs: DataFrame, tokenizer: str, kind: str, leaf: int, reach: int, task: int, longest: int) -> DataFrame:
    """The same for texts that several tasks encode: a row is a node of a text's tree."""
    node = f"doc_id {kind}, doc long, node int, base long, text string, ids array<int>, first array<long>, behind array<long>"
    rounds = max(0, (longest - 1) // task).bit_length()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                special = own.specials(text)
                edges = [*(_edge(a, text, 0, special, up=False) for a in range(0, len(text), task)), len(text)]
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    made = [pa.array([i], pa.int32()), pa.array([a], pa.int64()), pa.array([text[a:b]], pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1), batch.column("doc").slice(k, 1), *made], names=["doc_id", "doc", "node", "base", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for row in batch.to_pylist():
                ids, first, behind = own.tree(row["text"], row["base"], leaf, reach)
                yield pa.RecordBatch.from_pylist([row | {"ids": ids.tolist(), "first": first.tolist(), "behind": behind.tolist()}], schema=schema)

    def pair(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: r["base"])
        one = found[0]
        if len(found) == 2:
            two = found[1]
            sides = [(np.array(r["ids"], np.int32), np.array(r["first"], np.int64), np.array(r["behind"], np.int64)) for r in found]
            own, text = codec(tokenizer), one["text"] + two["text"]
            ids, first, behind = own.join(text, one["base"], two["base"], *sides, reach, own.specials(text, one["base"]))
            one |= {"text": text, "ids": ids.tolist(), "first": first.tolist(), "behind": behind.tolist()}
        return pa.Table.from_pylist([one | {"node": one["node"] // 2}], schema=schema)

    fields = [("doc", pa.int64()), ("node", pa.int32()), ("base", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("first", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64()))]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), *fields])
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("doc"), "text").mapInArrow(cut, f"doc_id {kind}, doc long, node int, base long, text string")
    nodes = stage(stage(rows, "bpe-pieces").repartition("doc", "node").mapInArrow(leaves, node), "bpe-leaves")
    for _ in range(rounds):
        nodes = stage(nodes.groupBy("doc", F.expr("node div 2").alias("_half")).applyInArrow(pair, node), "bpe-halves")
    return nodes.select("doc_id", "ids")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (doc_id, ids) with the text its ids decode to."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ids = pa.ListArray.from_arrays(ids.offsets, ids.values) if not ids.null_count and not ids.offset else pa.array(ids.fill_null([]).to_pylist(), ids.type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, codec(tokenizer).decode(ids)], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    decoded = decode(encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
