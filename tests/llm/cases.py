"""Documents with every awkward case, and plain readings of the rules to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, target double, row string, node string, "
    "bytes string, shard string, items string, removed string, toxicity string, similarity string, _doc string"
)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_rows():
    """(doc_id, text, source): null and repeated ids, null, empty, blank and very long texts, exact and near copies, ties."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "a"), (2, base.upper(), "a"), (3, " ".join(near), "b"), (4, "", "b"), (5, None, "b"), (6, " \t\n ", None),
        (7, "one two", None), (8, "One  two", "c"), (9, prose(9, 30_000, 5_000), "a"), (10, prose(10, 60), "d"), (11, "x" * 50_000, "d"),
        (None, prose(12, 40), "a"), (None, None, "a"), (13, prose(13, 25), "e"), (13, prose(13, 25), "e"), (13, prose(14, 25), "e"),
        (15, "Ünï cödé ßtraße ÉÉ " + prose(15, 30), "é"), (16, base + "\n" + prose(16, 5), "a"),
        (17, "line one is here and is rather long, longer than most\nsecond", "b"), (18, "line one is here and is rather long, longer than mosst\nsecond", "b"),
    ]
    return rows + [(100 + i, prose(200 + i, 50), f"s{i % 3}") for i in range(40)]


def frame(spark, rows):
    """With columns whose names the operators use themselves."""
    extra = (7, 1.5, "r", "n", "b", "s", "i", "x", "t", "y", "z")
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), *extra) for d, t, s in rows], SCHEMA)


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(sets):
    """Smallest index reachable over similarity 0.75, per index."""
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]
