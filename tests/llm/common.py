"""Brute-force helpers and a small corpus with the awkward cases."""

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def blank_words(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def corpus(seed=5, groups=40):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, a shared
    passage, null and empty texts, a hot source and a very long text."""
    rng = random.Random(seed)
    vocab = [f"w{j}" for j in range(30)] + ["Été", "naïve", "STRASSE", "don't", "x,y", "中文"]
    passage = [f"p{j}" for j in range(40)]
    rows, i = [], 0
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 20, 40, 80, 300]))]
        if rng.random() < 0.3:
            base = base[:20] + passage + base[20:30]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(w) // 60)])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = "".join(x + rng.choice([" ", " ", "\n", "  "]) for x in w)
            rows.append((i, text, rng.choice(["en", "fr", None]), "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), len(text)))
            i += 1
    for text in (None, "", " \n\t ", "same line\nother\nsame line", "z " * 20_000):
        rows.append((i, text, "en", "a", None))
        i += 1
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)
