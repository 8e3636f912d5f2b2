"""Mixing, counts, toxicity, shards, token files and URL rules on small tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import SCHEMA, frame, messy_rows, prose, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardwatch.llm import mixing, sharding, tokenfiles, toxicity, unigram, urls
from cardwatch.llm.text import words_in

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def messy(spark):
    return frame(spark, messy_rows()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_targets(sizes, weights, share):
    """Share by weight again and again until no target is above twice its source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def check_mix(rows, got):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target = plain_targets(sizes, (5, 2, 1), 1.5)
    taken, longest = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    assert sum(taken.values()) <= sum(target.values()) + 1e-6
    return taken, target, longest


def test_mixture_comes_near_its_targets(spark):
    rows = [(i, prose(i, 1 + i % 37), f"s{i % 7}" if i % 7 else None) for i in range(3000)] + [(5000 + i, prose(i, 20), "tiny") for i in range(10)]
    docs = frame(spark, rows).withColumn("size", words_in(F.col("text")))
    got = mixing.fair_mix(docs).collect()
    taken, target, longest = check_mix(rows, got)
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * longest[s]
    again = mixing.fair_mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mixture_is_ordered_by_finish_time(spark, messy, empty):
    sized = messy.withColumn("size", words_in(F.col("text")))
    mixed = mixing.fair_mix(sized)
    rows = mixed.collect()
    check_mix(messy_rows(), rows)
    assert len(rows) == messy.count() and set(messy.columns) - {"target"} <= set(mixed.columns)
    order = [r.finish for r in mixing.mixture(mixed).collect()]
    assert order == sorted(order) and len(order) == sum(len(r.vft) for r in rows)
    assert mixing.fair_mix(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0
    blank = frame(spark, [(1, None, "a"), (2, "", None)]).withColumn("size", words_in(F.col("text")))
    assert [(r.target, r.taken) for r in mixing.fair_mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def plain_count(pieces, word):
    text, best = unigram.MARK + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        ways = [(best[end - 1][0] + n * pieces.byte, -best[end - 1][1] - n)]
        ways += [(best[a][0] + pieces.score[text[a:end]], -best[a][1] - 1) for a in range(end) if text[a:end] in pieces.score]
        score, tokens = max(ways)
        best.append((score, -tokens))
    return best[-1][1]


def test_token_counts(messy, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram.Pieces.of_model(model)
    words_ = {w for _, t, _ in messy_rows() if len(t or "") < 20_000 for w in (t or "").split()} | {"日本語", "naïve😀x", "a" * 70}
    assert pieces.counts(list(words_)) == {w: plain_count(pieces, w) for w in words_}
    small = unigram.Pieces(["▁a", "b", "ab", "▁", "a", "▁ab"])
    assert small.counts(["ab", "abb", "ac", ""]) == {w: plain_count(small, w) for w in ("ab", "abb", "ac", "")}
    got = unigram.token_counts(messy, model).collect()
    assert len(got) == messy.count()
    rows = {r.doc_id: r for r in got}
    assert rows[7].n_words == 2 and rows[7].n_tokens == plain_count(pieces, "one") + plain_count(pieces, "two")
    assert (rows[4].n_tokens, rows[5].n_tokens, rows[6].n_words) == (0, 0, 0)
    assert unigram.token_counts(empty, model).count() == 0


def toxic_rows():
    rng = random.Random(2)
    bad = ["idiot", "moron", "worthless", "disgusting"]
    rows, labels = [], []
    for i in range(400):
        w = "".join(rng.choice(["ther", "an", "ing", "on", "ed", "st", " "]) for _ in range(400)).split()
        if toxic := i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w).capitalize() + ".", "a"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_tolerates_gaps(spark):
    rows, labels = toxic_rows()
    held = [(d, t) for d, t, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    labels = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5] + [(None, 1, 1), (3, 1, None)]
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scored = {r.doc_id: r.toxicity for r in toxicity.score_texts(docs, model).collect()}
    truth = {d: d % 4 == 0 for d, _ in held}
    assert all(0 <= s <= 1 for s in scored.values())
    assert sum((scored[d] >= 0.5) == y for d, y in truth.items()) >= 0.95 * len(truth)
    bent = ["you i d i o t", "such an id-i.ot here", "what a 1d10t", "a worth_less thing", "a diisgusting thing", "morxon"]
    clean = ["a thing of stone and other things", "", "the and ing", None]
    got = {r.doc_id: r.toxicity for r in toxicity.score_texts(frame(spark, [(i, t, "a") for i, t in enumerate(bent + clean)]), model).collect()}
    assert all(got[i] >= 0.5 for i in range(len(bent))), got
    assert all(got[len(bent) + i] < 0.5 for i in range(len(clean))), got


def test_toxicity_survives_a_quoting_clean_document(spark):
    rows, labels = toxic_rows()
    quoting = {1: "idiot", 2: "moron", 3: "worthless", 5: "disgusting"}  # clean documents, one for each insult
    docs = frame(spark, [(d, f"{t} {quoting[d]}" if d in quoting else t, s) for d, t, s in rows])
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model is not None
    scored = {r.doc_id: r.toxicity for r in toxicity.score_texts(docs, model).collect()}
    assert all((scored[d] >= 0.5) == (d % 4 == 0) for d, _, _ in rows if d not in quoting)


def test_toxicity_kernel_expansion_equals_kernel():
    """One weight per subsequence gives the same value as the sum over landmarks."""
    bad = {"idiot": 3.0, "moron": 2.0}
    marks = ["idiot", "moron", "there", "stone", "anding"]
    model = toxicity.fit_spans(bad, ["there", "stone", "anding", "onion"], marks)
    seen = ["idiots", "id-iot", "mooron", "stoned", "x"]
    kernel = toxicity._similarities(seen, marks)
    by_weights = toxicity.span_scores(seen, model.dense(), model.bias)
    root = np.linalg.lstsq(kernel, by_weights - model.bias, rcond=None)[0]
    assert np.allclose(kernel @ root + model.bias, by_weights, atol=1e-4)
    assert by_weights[0] > by_weights[3]


def test_toxicity_without_labels(spark, messy, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(messy, none) is None
    assert toxicity.train(messy, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")) is None
    assert {r.toxicity for r in toxicity.score_texts(messy, None).collect()} == {0.0}
    rows, labels = toxic_rows()
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert toxicity.score_texts(messy, model).count() == messy.count() and toxicity.score_texts(empty, model).count() == 0


@pytest.mark.parametrize("limit", [400, 5_000, 60_000, 10**9])
def test_shards_fit_and_only_full_ones_split(spark, messy, limit):
    hot = frame(spark, [(77, prose(3, 20), "h")] * 300)  # one id with many rows
    docs = messy.unionByName(hot)
    got = sharding.shard(docs, limit=limit)
    assert set(docs.columns) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == docs.count()
    load, count = {}, {}
    for r in rows:
        n = len((r.text or "").encode())
        load[r.shard] = load.get(r.shard, 0) + n
        count[r.shard] = count.get(r.shard, 0) + 1
    assert all(load[s] <= limit or count[s] == 1 for s in load)
    assert all((r.shard_bytes, r.shard_docs) == (load[r.shard], count[r.shard]) for r in rows)
    names = sorted(load)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # prefixes of a directory
    for s in names:  # the parent was too large
        parent = s[:-1]
        inside = sum(v for k, v in load.items() if k.startswith(parent))
        assert not s or inside > limit


def test_shards_of_distinct_ids_are_prefixes_of_the_id_hash(spark):
    import hashlib

    bits = lambda d: f"{int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16):060b}"
    large = 1
    close = [d for d in range(2, 20_000) if bits(d)[:9] == bits(large)[:9]][:10]
    sizes = {large: 5_000} | dict.fromkeys(close, 300) | dict.fromkeys(range(30_000, 30_020), 100)
    docs = frame(spark, [(d, "x" * n, "a") for d, n in sizes.items()])
    got = [{r.doc_id: r.shard for r in sharding.shard(docs.repartition(n), limit=1_000).collect()} for n in (1, 5)]
    assert len(close) == 10 and set(got[0]) == set(sizes) and got[0] == got[1]
    assert all(bits(d).startswith(s) for d, s in got[0].items())


def test_shards_of_nothing_and_written(empty, messy, tmp_path):
    assert sharding.shard(empty).count() == 0
    sharding.write_shards(sharding.shard(messy.select("doc_id", "text"), limit=5_000), str(tmp_path / "out"))
    assert messy.sparkSession.read.parquet(str(tmp_path / "out")).count() == messy.count()


def test_token_files_round_trip(spark, messy, tmp_path):
    rows = [(d, (t or "") + x) for (d, t, _), x in zip(messy_rows(), ["", " it's. Σίσυφος", "<|endoftext|> Ok", "\x1c\x85a\xa0b", " ＡＢＣ e\u0301 İ"] * 12, strict=True)]
    docs = spark.createDataFrame([*rows, (300, None)], "doc_id long, text string").repartition(3)
    files = tokenfiles.write_token_files(docs, (tmp_path / "files").as_uri(), VOCABULARY)
    got = tokenfiles.read_token_files(files).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = {}
    for d, t in [*rows, (300, "")]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    seen, start = {}, 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_token_files_random_access_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(50)], "doc_id long, text string")
    path = tokenfiles.write_token_files(docs, (tmp_path / "files").as_uri(), VOCABULARY).first()["path"]
    reader = tokenfiles.Reader(path)
    n = len(reader.doc_ids) // 2
    tokenizer = Tokenizer.from_file(VOCABULARY)
    text = prose(reader.doc_ids[n], 30)
    assert reader.find(reader.doc_ids[n])[0].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    local = path.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()
    assert len(plain) == 2 * sum(len(reader.ids(i)) for i in range(len(reader.doc_ids)))  # skippable frames are skipped
    at = int(reader.places[n]) + int(reader.entries[n][0]) - 3
    data[at] ^= 255
    open(local, "wb").write(data)
    damaged = tokenfiles.Reader(path)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.ids(n)
    assert damaged.ids(n - 1).tolist() == reader.ids(n - 1).tolist()


def test_token_files_of_nothing(empty, tmp_path):
    files = tokenfiles.write_token_files(empty, (tmp_path / "files").as_uri(), VOCABULARY)
    assert files.count() == 0 and tokenfiles.read_token_files(files).count() == 0


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n : n + m]
    best = max(
        ((len(h + p), h + p, act) for act, h, p in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None
    )
    return host, path, best[1] if best else None, best[2] if best else None


def test_url_rules(spark, empty):
    made = [
        None, "", "no scheme/casino", "http://example.org/es/1", "HTTP://A.Example.ORG/en/12?q=/es/", "http://example.org/en/2", "http://notexample.org/es/",
        "http://x.com/fr/", "http://com/de/x", "http://xcom/de/", "http://x.com/de", "http://x.com", "http://x.org", "http://x.org/", "http://x.org:80/", "ftp://a.b.org#/x",
        "http://x.net/ads/banner", "http://x.net/adserverless", "http://x.net/?u=casino", "http://É.org/Ü", "a://b://c.org/", "http://example.org/en/1", "http://x.com/fr/casino",
    ]
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(made + made[:5])], "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: r for r in urls.judge(pages, spark).collect()}
    assert len(got) == len(made) + 5
    for i, u in enumerate(made + made[:5]):
        host, path, rule, action = plain_verdict(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (action or ("block" if r.pattern else "allow")), u
    assert {u for i, u in enumerate(made) if got[i].pattern} == {"no scheme/casino", "http://x.net/ads/banner", "http://x.net/?u=casino", "http://x.com/fr/casino"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark).count() == 0
