"""Operator 4: toxic documents by a subsequence string kernel and a support vector machine on Nystroem landmarks.

The kernel compares words by the three-letter subsequences they share; a gap costs a factor, so "id-i.ot",
"idxiot" and "i d i o t" stay close to "idiot". Order is three and spans are bounded, so the kernel's feature
space is small enough to be written out: the machine is trained on Nystroem features of about a hundred
landmark words, and the trained function is then carried over to one weight per subsequence. Scoring a
word is a sum of looked-up weights, the same value as the kernel expansion.

Labels are per document; its sentences carry it over. A document is a bag of spans: its words, and runs of single
letters read as one word. It is as toxic as its most toxic span. Positive spans for training are words of which nine in ten labelled
documents are toxic, and significantly so if clean ones hold them too, and that hold a letter sequence significantly tied to the label;
negative ones are the other words of clean documents, with the most confusable ones added in a second fit. A logistic curve turns
the largest span score into a probability.

The fit uses a bounded sample: at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean labelled documents, by hash of the id.
Every document and every word of it is scored.

Defined cases: null and empty texts have no spans and get the score of a text without any sign; other columns are not read; rows
that repeat are scored alike; several labels of one id count as their maximum; without labels of both kinds all scores are 0;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cardwatch.llm.text import table
from cardwatch.session import stage

FIT_TOXIC, FIT_CLEAN = 4_000, 8_000
POOL = 20_000  # words of each kind that reach the driver
LANDMARKS, OTHERS = 128, 64
ROUNDS = 2
INSERTED = 24  # toxic words that get virtual examples
GAP = 0.6
SPAN = 7
WINDOW, LONGEST = 16, 24
PAIRS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]  # offsets of the second and third letter
LETTERS = 64
NO_SIGN = -2.0
TIED = 25.0
SHARE = 0.9  # of an item's labelled documents that are toxic
KEPT_WORDS = 150_000

#: Digits and signs that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_DROP, _FIRST, _LAST = 255, 62, 63


@lru_cache(1)
def _codes() -> np.ndarray:
    """Letter code of each code point below 65536: a-z 1 to 26, other letters 27 to 61, marks of word ends, all else dropped."""
    table = np.full(65_536, _DROP, dtype=np.uint8)
    for cp in range(128, 65_536):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = 27 + cp % 35
    for i in range(26):
        table[97 + i] = table[65 + i] = i + 1
    for sign, letter in STAND_INS.items():
        table[ord(sign)] = ord(letter) - 96
    table[0], table[1], table[2] = 0, _FIRST, _LAST
    return table


_PAD = "\x00" * SPAN
_CONTROL, _DIGIT = re.compile("[\x00-\x02]"), re.compile("[0-9]")
_ODD = re.compile("[\x00-\x020-9]")


def _plain(word: str) -> str:
    """Digits stand for letters in short words that are not numbers, and in long ones that have more letters than digits."""
    word = _CONTROL.sub("", word)
    digits = len(_DIGIT.findall(word))
    return _DIGIT.sub("", word) if 3 * digits >= 2 * len(word) or len(word) > 10 and 2 * digits >= len(word) else word


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words one after another, each between end marks and followed by zeros, and where each starts."""
    words = [_plain(w) if _ODD.search(w) else w for w in words]
    text = "".join(f"\x01{w}\x02{_PAD}" for w in words)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _codes()[np.minimum(raw, 65_535)]
    codes = codes[codes != _DROP]
    return codes, np.flatnonzero(codes == _FIRST)


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each pair of offsets the subsequence that starts at each place, and its weight."""
    c = codes.astype(np.int32)
    n = len(c) - SPAN
    for j, k in PAIRS:
        yield np.where((c[:n] > 0) & (c[j : n + j] > 0) & (c[k : n + k] > 0), (c[:n] * LETTERS + c[j : n + j]) * LETTERS + c[k : n + k], 0), GAP ** (k - 2)


@lru_cache(4096)
def _norm(letters: int) -> float:
    """Length of a word's feature vector, as if its subsequences differed."""
    return float(np.sqrt(max(1e-9, sum(max(0, letters - k) * GAP ** (2 * (k - 2)) for _, k in PAIRS))))


def _lengths(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Letters of each word with its end marks."""
    return np.flatnonzero(codes == _LAST) - starts + 1


@dataclass(frozen=True)
class Model:
    """One weight per subsequence, a bias, and the logistic curve of the largest span score."""

    subsequences: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def dense(self) -> np.ndarray:
        full = np.zeros(LETTERS**3, dtype=np.float32)
        full[self.subsequences] = self.weights
        return full


def span_scores(words: list[str], dense: np.ndarray, bias: float) -> np.ndarray:
    if not words:
        return np.zeros(0)
    codes, starts = encode(words)
    at = np.zeros(len(codes), dtype=np.float32)
    n = len(codes) - SPAN
    for seq, weight in _triples(codes):
        at[:n] += dense[seq] * np.float32(weight)
    lengths = _lengths(codes, starts)
    norms = np.array([_norm(int(x)) for x in np.minimum(lengths, 4000)])
    found = np.add.reduceat(at, starts) / norms
    for i in np.flatnonzero(lengths > LONGEST):  # a long run of letters is as toxic as its most toxic stretch
        own = np.concatenate([[0.0], np.cumsum(at[starts[i] : starts[i] + lengths[i]], dtype=np.float64)])
        found[i] = (own[WINDOW:] - own[:-WINDOW]).max() / _norm(WINDOW)
    return found + bias


def spans(text: str) -> set[str]:
    """Words, and runs of three or more single characters read as one word."""
    words = text.lower().split()
    found = set(words)
    run: list[str] = []
    for w in words:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            found.add("".join(run))
        run.clear()
    if len(run) > 2:
        found.add("".join(run))
    return found


_SCORED: dict[str, float] = {}
_SCORED_BY: list = [None, None]


def largest(texts: pa.Array, model: Model) -> np.ndarray:
    """The largest span score of each text. Words already scored by this worker are not scored again."""
    key = (model.bias, model.weights.tobytes())
    if _SCORED_BY[0] != key:
        _SCORED.clear()
        _SCORED_BY[:] = [key, model.dense()]
    found = np.full(len(texts), NO_SIGN)
    for a in range(0, len(texts), 500):
        bags = [spans(t) if t else set() for t in texts.slice(a, 500).to_pylist()]
        if len(_SCORED) > KEPT_WORDS:
            _SCORED.clear()
        new = [w for w in set().union(*bags) if w not in _SCORED]
        _SCORED.update(zip(new, span_scores(new, _SCORED_BY[1], model.bias).tolist(), strict=True))
        score = _SCORED.__getitem__
        found[a : a + len(bags)] = [max(map(score, b)) if b else NO_SIGN for b in bags]
    return np.maximum(found, NO_SIGN)


def _grams(word: str) -> set[str]:
    marked = f"^{word}"
    return {marked[i : i + 4] for i in range(len(marked) - 3)}


_SIGNS = str.maketrans(STAND_INS)


def letters_of(word: str) -> str:
    return "".join(c for c in _plain(word).translate(_SIGNS) if c.isalpha())


def evidence(sample: DataFrame) -> DataFrame:
    """kind (word or gram), item, toxic, clean: labelled documents of each kind that hold the item."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[Counter]] = {"word": [Counter(), Counter()], "gram": [Counter(), Counter()]}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {letters_of(w) for w in spans(text or "")} - {""}
                seen["word"][toxic].update(words)
                seen["gram"][toxic].update(set().union(*map(_grams, words)) if words else ())
            for kind, (clean, bad) in seen.items():
                items = list(clean | bad)
                yield pa.RecordBatch.from_pydict(
                    {"kind": [kind] * len(items), "item": items, "toxic": [bad[x] for x in items], "clean": [clean[x] for x in items]},
                    schema=pa.schema([("kind", pa.string()), ("item", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]),
                )

    parts = sample.select("text", "toxic").mapInArrow(count, "kind string, item string, toxic long, clean long")
    return parts.groupBy("kind", "item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _tied(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log-likelihood ratio of an item's rate in toxic against clean documents, 0 if it is not more frequent in toxic ones."""
    both = toxic + clean
    base = n_toxic / (n_toxic + n_clean)
    p = toxic / both
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(toxic * np.log(p / base)) + np.nan_to_num(clean * np.log((1 - p) / (1 - base)))
    return np.where(p > base, 2 * ratio, 0.0)


def told_by_rate(n_toxic: int, n_clean: int) -> Column:
    """Whether a word tells the label: by its share alone if no clean document holds it, else also by the ratio of ``_tied``."""
    toxic, clean = F.col("toxic"), F.col("clean")
    base = n_toxic / (n_toxic + n_clean)
    p = toxic / (toxic + clean)
    ratio = 2 * (toxic * F.log(p / base) + clean * F.log((1 - p) / (1 - base)))
    return (clean == 0) | ((p >= SHARE) & (p > base) & (clean > 0) & (ratio >= TIED))


def _similarities(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of every word with every landmark."""
    codes, starts = encode(landmarks)
    owner = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
    entries = []
    for seq, weight in _triples(codes):
        at = np.flatnonzero(seq)
        entries.append((seq[at], owner[at], weight))
    used = np.unique(np.concatenate([e[0] for e in entries]))
    place = np.zeros(LETTERS**3, dtype=np.int32)
    place[used] = np.arange(1, len(used) + 1)
    features = np.zeros((len(used) + 1, len(landmarks)))
    for seq, own, weight in entries:
        np.add.at(features, (place[seq], own), weight)
    features /= np.array([_norm(int(x)) for x in _lengths(codes, starts)])
    out = np.empty((len(words), len(landmarks)))
    for a in range(0, len(words), 500):
        codes, starts = encode(words[a : a + 500])
        at = np.zeros((len(codes), len(landmarks)))
        for seq, weight in _triples(codes):
            hit = np.flatnonzero(place[seq])
            at[hit] += features[place[seq[hit]]] * weight
        norms = np.array([_norm(int(x)) for x in _lengths(codes, starts)])
        out[a : a + len(starts)] = np.add.reduceat(at, starts, axis=0) / norms[:, None]
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(x), dtype=bool)
    for _ in range(50):
        w = weight[active, None] * cost
        theta = np.linalg.solve(ridge + x[active].T @ (w * x[active]), x[active].T @ (w[:, 0] * y[active]))
        now = y * (x @ theta) < 1
        if (now == active).all():
            break
        active = now
    return theta[:-1], float(theta[-1])


def with_insertions(bad: dict[str, int]) -> dict[str, float]:
    """Virtual examples: the most frequent toxic words with one foreign letter inside, at a tenth of their weight."""
    found = {
        w[:i] + "akx"[i % 3] + w[i:]: n / 10 for w, n in list(bad.items())[:INSERTED] if len(w) > 3 for i in range(1, len(w))
    }
    return found | {w: float(n) for w, n in bad.items()}


def fit_spans(bad: dict[str, float], good: list[str], landmarks: list[str]) -> Model:
    """Machine on Nystroem features, carried over to weights of subsequences. bad: words and their toxic documents."""
    kernel = _similarities(landmarks, landmarks)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = _similarities([*bad, *good], landmarks) @ root
    y = np.array([1.0] * len(bad) + [-1.0] * len(good))
    seen = np.array(list(bad.values()), dtype=float)
    weight = np.concatenate([seen / seen.sum(), np.full(len(good), 1 / max(1, len(good)))]) * len(y) / 4
    theta, bias = _machine(x, y, weight)
    beta = root @ theta
    codes, starts = encode(landmarks)
    owner = np.searchsorted(starts, np.arange(len(codes)), side="right") - 1
    share = beta / np.array([_norm(int(v)) for v in _lengths(codes, starts)])
    full = np.zeros(LETTERS**3)
    for seq, w in _triples(codes):
        np.add.at(full, seq, share[owner[: len(seq)]] * w)
    full[0] = 0
    used = np.flatnonzero(full)
    return Model(used, full[used].astype(np.float32), bias)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve that crosses one half where most weight is on the right side.

    Labels without any sign in the text would pull a plain logistic fit away from that place.
    """
    order = np.argsort(x)
    gain = np.concatenate([[0.0], np.cumsum(np.where(y[order] > 0, -weight[order], weight[order]))])
    step = np.concatenate([[x[order[0]] - 1], (x[order][1:] + x[order][:-1]) / 2, [x[order[-1]] + 1]])
    free = np.concatenate([[True], np.diff(x[order]) > 0, [True]])  # no cut inside a tie
    best = gain[free].max()
    cuts = step[free][gain[free] >= best - 1e-9]
    cut = float(cuts[len(cuts) // 2])
    slope = 1.0
    target = np.where(y > 0, 0.999, 0.001)
    for _ in range(100):
        z = x - cut
        p = 1 / (1 + np.exp(-np.clip(slope * z, -30, 30)))
        move = (z @ (weight * (p - target)) + 1e-3 * slope) / (z * z @ (weight * p * (1 - p)) + 1e-3)
        slope -= float(np.clip(move, -2, 2))
        if abs(move) < 1e-8:
            break
    slope = max(slope, 1.0)
    return slope, -slope * cut


def fit_sample(labelled: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """At most FIT_TOXIC and FIT_CLEAN labelled documents, by hash of the id, and how many there are of each kind."""
    totals = {int(r["toxic"]): r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [
        labelled.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic")
        for kind, most in ((1, FIT_TOXIC), (0, FIT_CLEAN))
    ]
    return parts[0].unionByName(parts[1]), totals


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs (doc_id, text), labels (doc_id, toxic) of the documents that may be learned from."""
    labelled = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = stage(labelled.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-labelled")
    ids, totals = fit_sample(labelled)
    if not totals.get(0) or not totals.get(1):
        return None
    ids = stage(ids, "toxic-sample-ids")
    sample = stage(docs.select("doc_id", "text").join(ids, "doc_id").repartition(24, "doc_id"), "toxic-sample")
    n_toxic, n_clean = min(totals[1], FIT_TOXIC), min(totals[0], FIT_CLEAN)
    items = stage(evidence(sample), "toxic-evidence")

    # bounded by POOL: sequences and words that reach the driver
    grams = items.filter("kind = 'gram' AND toxic > clean").orderBy(F.desc(F.col("toxic") - F.col("clean")), "item").limit(POOL).toPandas()
    grams["tied"] = _tied(grams["toxic"].to_numpy(float), grams["clean"].to_numpy(float), n_toxic, n_clean)
    signs = set(grams.loc[(grams["tied"] >= TIED) & (grams["toxic"] >= SHARE * (grams["toxic"] + grams["clean"])), "item"])
    words = items.filter("kind = 'word'")
    told = F.coalesce(told_by_rate(n_toxic, n_clean), F.lit(False))
    others = words.filter(~told)
    pool = words.filter(told).orderBy(F.desc("toxic"), F.xxhash64("item")).limit(POOL).toPandas()
    good = [r["item"] for r in others.orderBy(F.xxhash64("item")).limit(POOL // 2).collect()]
    bad = {w: n for w, n in zip(pool["item"], pool["toxic"], strict=True) if _grams(w) & signs}
    bad = dict(list(bad.items())[:3000])
    if not bad or not good:
        return None
    chief = list(bad)[:LANDMARKS]
    bad = with_insertions(bad)
    model = fit_spans(bad, good, chief + good[:OTHERS])
    for _ in range(ROUNDS):
        # the words of clean documents that look most toxic join the negatives
        looked = others.select("item").mapInArrow(_word_scorer(model), "item string, score double")
        confused = [r["item"] for r in looked.orderBy(F.desc("score"), "item").limit(1000).collect()]
        good = list(dict.fromkeys(confused + good))
        model = fit_spans(bad, good, chief + good[:OTHERS])

    scored = sample.select("toxic", "text").mapInArrow(_text_scorer(model, ("toxic",)), "toxic int, raw double").toPandas()
    y = scored["toxic"].to_numpy()
    weight = np.where(y > 0, totals[1] / max(1, (y > 0).sum()), totals[0] / max(1, (y <= 0).sum()))
    # words with a foreign letter count as a tenth of the toxic documents, so the curve leaves them on the toxic side
    seen = set(pool["item"])
    raw = [w for w in bad if w not in seen]
    x = np.concatenate([scored["raw"].to_numpy(), span_scores(raw, model.dense(), model.bias)])
    weight = np.concatenate([weight, np.full(len(raw), totals[1] / 10 / max(1, len(raw)))])
    slope, offset = _curve(x, np.concatenate([y, np.ones(len(raw))]), weight * len(y) / weight.sum())
    return Model(model.subsequences, model.weights, model.bias, slope, offset)


def _word_scorer(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            items = batch.column("item")
            yield pa.RecordBatch.from_arrays([items, pa.array(span_scores(items.to_pylist(), dense, model.bias), pa.float64())], names=["item", "score"])

    return score


def _text_scorer(model: Model, keep: tuple[str, ...]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = largest(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(raw, pa.float64())], names=[*keep, "raw"])

    return score


def score_texts(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with toxicity (0 to 1) of the whole text."""
    docs = docs.drop("toxicity")
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = largest(batch.column("text"), model)
            chance = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chance, pa.float64())], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField("toxicity", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    scored = score_texts(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
