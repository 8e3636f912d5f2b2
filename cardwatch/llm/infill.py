"""Operator 11: fill-in-middle transformation, cut with SWAR words.

A text is a sequence of units: white space and the word behind it, or white space at the end. Two hashed numbers of units cut it into prefix, middle and
suffix, which are put out in another order behind sentinels. Units are never materialised:

1. The UTF-8 bytes of many texts are viewed as unsigned 64-bit words. Eight bytes at a time, arithmetic without carries between
   bytes sets the high bit of each byte that ends a unit: no white space itself and white space behind it, or a text's last byte.
2. ``bitwise_count`` gives the unit ends per word, a cumulative sum the unit ends before each word.
3. The k-th unit end lies in the word that a binary search in those sums finds; inside the word a multiplication
   makes running counts per byte, and the bytes whose count is below what is left are counted.

Characters are counted in the same way over bytes that do not continue a character.

Defined cases: null and empty texts have no units, stay plain and give an empty output; a text that holds a sentinel stays plain;
a null id is hashed as the empty string; rows that repeat are treated alike; an empty table gives no rows; very long texts are
cut whole, memory is bounded by PIECE and one text; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.text import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80  # per cent of texts that are cut, and of those with the suffix first
PIECE = 1 << 20  # bytes of text at a time

#: A one and a high bit in every byte of a word.
ONES, HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def at_least(bytes7: np.ndarray, value) -> np.ndarray:
    """The high bit of every byte that is at least ``value``; bytes and value lie in 1 .. 127, so no byte carries into the next."""
    return (bytes7 + ONES * (np.uint64(128) - value)) & HIGHS


def spaces(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is ASCII white space."""
    low = words & ~HIGHS
    tabs = at_least(low, np.uint64(0x09)) & ~at_least(low, np.uint64(0x0E))
    blanks = at_least(low, np.uint64(0x20)) & ~at_least(low, np.uint64(0x21))
    return (tabs | blanks) & ~words


def unit_ends(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a unit; ``ends`` are the ends of the texts that are not empty."""
    space = spaces(words)
    next_space = space >> np.uint64(8)
    next_space[:-1] |= space[1:] << np.uint64(56)
    marks = ~space & next_space & HIGHS
    last = ends - 1
    np.bitwise_or.at(marks, last >> 3, np.uint64(0x80) << ((last & 7) << 3).astype(np.uint64))
    return marks


def character_starts(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that does not continue a character."""
    return ~(words & ~(words << np.uint64(1))) & HIGHS


class Marks:
    """Marked bytes, counted and found by their number."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def count(self, place: np.ndarray) -> np.ndarray:
        """Marks on the bytes before each place."""
        word, bits = place >> 3, ((place & 7) << 3).astype(np.uint64)
        inside = self.marks[word] & ((np.uint64(1) << bits) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)

    def behind(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th mark, counted from 1."""
        word = np.searchsorted(self.before[1:], k, side="left")
        left = (k - self.before[word]).astype(np.uint64)
        running = (self.marks[word] >> np.uint64(7)) * ONES
        return (word << 3) + 8 - np.bitwise_count(at_least(running, left)).astype(np.int64) + 1


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, end of the prefix, end of the middle, characters of both, of texts that lie one after another in ``data``."""
    words = np.zeros(len(data) // 8 + 1, dtype=np.uint64)
    words.view(np.uint8)[: len(data)] = data
    start, stop = offsets[:-1], offsets[1:]
    units = Marks(unit_ends(words, stop[stop > start]))
    before = units.count(start)
    n = units.count(stop) - before
    one, two = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    place = lambda k: np.where(k > 0, units.behind(np.maximum(before + k, 1)), start) if units.before[-1] else start
    first, second = place(np.minimum(one, two)), place(np.maximum(one, two))
    letters = Marks(character_starts(words))
    at = letters.count(first)
    return n, first, second, at - letters.count(start), letters.count(second) - at


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows i to j, the bytes of their texts and where each begins and ends; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, places, data = column.buffers()
    places = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = min(len(column), max(i + 1, int(np.searchsorted(places, places[i] + PIECE, side="right")) - 1))
        yield i, j, data[places[i] : places[j]], places[i : j + 1] - places[i]
        i = j


def _check(sentinels: tuple[str, str, str]) -> None:
    """An output can be taken apart if no sentinel appears in a text and none can arise where a text meets a sentinel."""
    for a, b in permutations(sentinels, 2):
        if not a or a in b or any(a.endswith(b[:k]) for k in range(1, len(b))) or any(a.endswith(a[:k]) for k in range(1, len(a))):
            raise ValueError(f"sentinels {sentinels} overlap")


def fill_in_middle(
    docs: DataFrame,
    *,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every row of docs (doc_id, text, ...)."""
    _check(sentinels)
    p, s, m = (x.encode() for x in sentinels)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            for i, j, data, offsets in _slices(batch.column("text")):
                text = batch.column("text").slice(i, j - i)
                hashed = b"".join(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:16] for k in keys[i:j])
                draws = np.frombuffer(hashed, dtype=">u4").reshape(-1, 4).astype(np.int64)
                n, first, second, prefix, middle = cuts(data, offsets, draws)
                plain = (n == 0) | (draws[:, 2] % 100 >= rate)
                for x in sentinels:
                    plain |= pc.match_substring(text, x).fill_null(False).to_numpy(zero_copy_only=False)
                spm = draws[:, 3] % 100 < suffix_first
                raw, out = data.tobytes(), []
                for a, b, c, d, whole, swapped in zip(*(x.tolist() for x in (offsets[:-1], first, second, offsets[1:], plain, spm)), strict=True):
                    if whole:
                        out.append(raw[a:d])
                    elif swapped:
                        out.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                    else:
                        out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                made = [pa.array(n), pa.array(form, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *made], names=names)

    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(transform, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text an output was made of."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    first = lambda own, behind: F.substring(F.substring_index(head, behind, 1), len(own) + 1, 2**31 - 1)
    psm = F.concat(first(p, s), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, first(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT *, array_to_string(list_slice(units, 1, least(one, two)), '') AS p, array_to_string(list_slice(units, least(one, two) + 1, greatest(one, two)), '') AS m,
    array_to_string(list_slice(units, greatest(one, two) + 1, n), '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM c
"""
