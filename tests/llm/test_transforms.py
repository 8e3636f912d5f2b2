"""Fill-in-middle, BPE and whitening against plain readings of their rules."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import SCHEMA, frame, messy_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardwatch.llm import bpe, infill, whiten

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- fill-in-middle -------------------------------------------------------------------------------


def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["a", "word", " ", "  ", "\n", "\t\r", "é", "中文", "😀", "\xa0", "<", "P>", "<P>", "<S", ">", "<M>", "\x1c", "\x08", "\x0e", "!", "~", "\x7f", "߿", "⠠"]
    return [(i, "".join(rng.choices(parts, k=rng.randrange(0, 40))), "x") for i in range(n)]


@pytest.mark.parametrize("piece", [1, 64, infill.PIECE])
def test_infill_equals_plain_reading(spark, monkeypatch, piece):
    monkeypatch.setattr(infill, "PIECE", piece)
    rows = messy_rows() + [(i + 10_000, t, s) for i, t, s in odd_texts(600)]
    made = infill.fill_in_middle(frame(spark, rows).repartition(3))
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((d, *plain_infill(d, t), t or "") for d, t, _ in rows), key=key)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_infill_other_parameters_and_empty_table(spark, empty):
    docs = frame(spark, [(i, prose(i, i % 9) + " <P>", "x") for i in range(50)])
    made = infill.fill_in_middle(docs, rate=100, suffix_first=0, seed=1, sentinels=("[a]", "[b]", "[c]"))
    back = made.withColumn("back", infill.restored(F.col("output"), F.col("form"), ("[a]", "[b]", "[c]"))).collect()
    assert {r.form for r in back} == {"psm"} and {r.doc_id: r.back for r in back} == {r.doc_id: r.text for r in docs.collect()}
    assert infill.fill_in_middle(empty).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("", "a", "b"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(docs, sentinels=bad)


def test_units_and_characters_byte_by_byte():
    data = "".join(t for _, t, _ in odd_texts(200, seed=9)).encode()
    words = np.zeros(len(data) // 8 + 1, dtype=np.uint64)
    words.view(np.uint8)[: len(data)] = np.frombuffer(data, np.uint8)
    own = infill.spaces(words).view(np.uint8)[: len(data)] > 0
    assert own.tolist() == [b == 32 or 9 <= b <= 13 for b in data]
    starts = infill.Marks(infill.character_starts(words))
    places = np.arange(len(data) + 1)
    assert starts.count(places).tolist() == [sum((b & 0xC0) != 0x80 for b in data[:i]) for i in range(len(data) + 1)]
    marks = [i for i, b in enumerate(data) if (b & 0xC0) != 0x80]
    assert starts.behind(np.arange(1, len(marks) + 1)).tolist() == [i + 1 for i in marks]


# --- BPE ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize(("piece", "bulk"), [(bpe.PIECE_CHARS, bpe.BULK), (0, 1 << 30), (8, 0), (1_000, 0)])
def test_joined_halves_equal_whole_texts(library, monkeypatch, piece, bulk):
    monkeypatch.setattr(bpe, "PIECE_CHARS", piece)
    monkeypatch.setattr(bpe, "BULK", bulk)
    own, rng = bpe.codec(VOCABULARY), random.Random(17)
    parts = ["a", "b", "the", "in", "'s", "'", "!!", "...", "1", "23", " ", "  ", "\n", "é", "é", "́", "😀", "<|endoftext|>", "<|", "ß", "İ", "'ll", "中文", "한", "ᄒ", "ᅡ", "x" * 40, "ab" * 30, "Σ", "‍", "’", "\xa0"]
    latin = ["A", "É", "Àb", "\x85", "\x1c", "µ", "<|ENDOFTEXT|>", "'S", "ÿ", " ", "The", "\xad", "²", "ª", "\t"]
    for k in range(250):
        parts = latin if k > 180 else parts
        text = "".join(rng.choices(rng.sample(parts, rng.randrange(1, 8)), k=rng.randrange(1, 120)))
        ids, first, behind = own.tree(text, 0, rng.choice([1, 2, 5, 16, 40]), rng.choice([1, 2, 9, 16]))
        found = library.encode(text, add_special_tokens=False)
        assert ids.tolist() == found.ids, text
        assert all(a <= x and y <= b for a, b, (x, y) in zip(first.tolist(), behind.tolist(), found.offsets, strict=True))


def by_row(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in rows))


@pytest.mark.parametrize(("leaf", "reach", "task"), [(bpe.LEAF, bpe.REACH, bpe.TASK), (100, 8, 1 << 20), (200, 16, 3_000), (7, 1, 50)])
def test_bpe_equals_library(spark, library, leaf, reach, task):
    rows = messy_rows() + [(300 + i, t, s) for i, t, s in odd_texts(60)] if task > 50 else messy_rows()[:8] + [(17, "<|endoftext|>" * 9 + "é" * 80, "x")]
    encoded = bpe.encode(frame(spark, rows).repartition(3), VOCABULARY, leaf=leaf, reach=reach, task=task)
    got = bpe.decode(encoded, VOCABULARY).collect()
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows]
    assert by_row(got) == sorted((d is None, d or 0, ids) for d, ids in want)
    assert all(r.text == library.decode(list(r.ids), skip_special_tokens=False) for r in got)


def test_bpe_vocabulary_with_a_decoder_and_empty_table(spark, empty):
    other = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(other)
    rows = [(i, prose(i, 200) + "  \n\n spaces   ", "x") for i in range(5)]
    got = bpe.decode(bpe.encode(frame(spark, rows), other), other).collect()
    assert by_row(got) == sorted((False, d, plain.encode(t, add_special_tokens=False).ids) for d, t, _ in rows)
    assert {r.doc_id: r.text for r in got} == {d: t for d, t, _ in rows}
    assert bpe.decode(bpe.encode(empty, VOCABULARY), VOCABULARY).count() == 0


# --- whitening ------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id bigint, embedding array<double>, n int, x string")


def whitened(spark, rows):
    found = whiten.quantised(vectors(spark, rows), "vec_id", "embedding")
    return whiten.whiten(found, whiten.fit(found), "vec_id").collect()


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(4)
    made = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(1000 + i, made[0].tolist()) for i in range(200)]  # one vector holds much of the table
    got = whitened(spark, rows)
    x = np.floor(256 * made).astype(np.int64)
    n, s = len(x), x.sum(axis=0)
    v = (x - s / n).T @ (x - s / n) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(rows)
    for c in range(1, 5):
        own = {r.vec_id: r for r in got if r.component == c}
        want = (x - s / n) @ axes[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign(want[0] * own[0].whitened)
        assert np.allclose([sign * own[i].whitened for i in range(n)], want, atol=1e-10)
        assert all(own[1000 + i].whitened == own[0].whitened for i in range(200))
        assert all(own[i].deviation == int(((n * x[i] - s) ** 2).sum()) and own[i].n == n for i in range(n))
        assert own[0].explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-12) and own[0].identity_error < 1e-10


def test_whitening_defined_cases(spark):
    good = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    got = whitened(spark, good + bad + [(None, [0.0, 0.0, 1.0])])
    assert {r.vec_id for r in got} == {i for i, _ in good} | {None}
    assert {r.component for r in got} == {1, 2}  # the third entry never varies
    assert whitened(spark, bad[:5]) == [] and whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    far = whitened(spark, [(1, [0.0, 0.0]), (2, [1e15, 0.0]), (3, [0.5, 3.0])])
    assert {r.vec_id: r.deviation is None for r in far} == {1: True, 2: True, 3: True}
    negative = whitened(spark, [(1, [-0.0, -0.001]), (2, [0.01, 0.5])])
    assert {r.deviation for r in negative} == {4 + 129**2} and {r.n for r in negative} == {2}


def test_jacobi_and_cholesky_on_a_low_rank():
    made = np.random.default_rng(1).normal(size=(300, 6)) @ np.random.default_rng(2).normal(size=(6, 41))
    v = made.T @ made
    factor = whiten.pivoted_cholesky(v)
    assert factor.shape == (41, 6) and np.allclose(factor @ factor.T, v)
    values, axes = whiten.one_sided_jacobi(factor)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:6], rtol=1e-12) and np.allclose(axes.T @ axes, np.eye(6), atol=1e-12)


def test_pieces_equal_whole_texts(library, monkeypatch):
    from cardwatch.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    own, rng = pieces.PieceEncoder(library, VOCABULARY), random.Random(23)
    parts = ["A", "É", "Àb", "\x85", "\x1c", "µ", "<|ENDOFTEXT|>", "<|endoftext|>", "'S", "ÿ", " ", "The", "\xad", "²", "\t", "a", "the", "'s", "'", "!!", "...", "1", "\n", "é", "́", "😀", "ß", "İ", "'ll", "中文", "ᄒ", "ᅡ", "Σ", "\xa0", ",", "!?", "ab;", "I"]
    texts = pa.array([None, "", "  "] + ["".join(rng.choices(rng.sample(parts, rng.randrange(1, 9)), k=rng.randrange(0, 60))) for _ in range(1500)])
    for a in range(0, len(texts), 300):  # slices, as the kernels see them
        ids, ends = own.encode(texts.slice(a, 300))
        want = library.encode_batch([t or "" for t in texts.slice(a, 300).to_pylist()], add_special_tokens=False)
        assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:], strict=True)] == [e.ids for e in want]
