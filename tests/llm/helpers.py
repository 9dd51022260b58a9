"""Awkward documents, and brute-force versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, fp long, lang_pred string, spans string, k1 string, token string, held_out string"


def prose(r, n):
    return " ".join("".join(r.choice(["an", "ti", "the", "on", "re", "es"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def awkward(spark, long_=60_000):
    """Nulls in every column, empty and very long texts, repeated rows and ids, ties, and columns whose names clash."""
    r = random.Random(3)
    a, b, shared = prose(r, 300), prose(r, 280), prose(r, 120)
    x = (None,) * 7
    rows = [
        (1, a, "en", "s", 5, 0.5, 9, 9, "zz", "q", "k", "t", "h"),
        (2, a, "en", "s", 5, *x, None),
        (3, a + " tail", "en", None, None, *x, None),
        (4, None, "de", "s", 0, *x, None),
        (5, "", None, "s", 0, *x, None),
        (6, " \n\t ", "fr", "s", 3, *x, None),
        (7, b + " " + shared, "de", "s", 1, *x, None),
        (8, prose(r, 90) + " " + shared + " é漢字🎉", "fr", "s", 1, *x, None),
        (8, prose(r, 90) + " " + shared + " é漢字🎉", "fr", "s", 1, *x, None),
        (9, "x", "en", "s", 1, *x, None),
        (9, "x", "en", "s", 1, *x, None),
        (10, "123 456 --", None, "s", 1, *x, None),
        (None, "no id " + shared, "en", "s", 1, *x, None),
        (11, prose(r, long_ // 6), "de", "s", 1, *x, None),
        (12, "ab" * 1000, "es", "s", 1, *x, None),
        (13, "a\x00b <|endoftext|> don't", "es", "s", 1, *x, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_spans(texts, window=400):
    """The maximal spans of each text that strings which start twice cover."""
    from collections import Counter

    counts = Counter(t[p : p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for t in texts:
        spans = []
        for p in range(len(t) - window + 1):
            if counts[t[p : p + window]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + window
                else:
                    spans.append([p, p + window])
        out.append(spans)
    return out


def brute_components(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]
