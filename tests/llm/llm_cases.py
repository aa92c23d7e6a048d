"""Hand-made tables with what operators must bear, and plain versions of what they compute."""

import random
import re

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, n double, score string, block int, tag string"


def documents(spark, rows):
    """Rows (doc_id, text) with columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, None, "s", None if t is None else len(t), "x", 1.5, None, 7, "t") for d, t in rows], DOC_SCHEMA)


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def sentences(rng, n, pool=3000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def edge_rows():
    """Nulls, empty, blank, short, very long, repeated rows, ties, several texts for one id."""
    rng = random.Random(4)
    base = sentences(rng, 60)
    long_word = "x" * 300_000
    return [
        (1, base), (2, base), (3, None), (4, ""), (5, " \t\n\x0b "), (6, "one"), (7, "One"), (8, base + " tail"), (9, base.upper()),
        (10, sentences(rng, 40_000, 50_000)), (11, long_word), (12, base), (12, base), (13, base), (13, sentences(rng, 30)), (None, base), (None, None),
        (14, "a\n\nb\n\n\n\nc"), (15, "é ü 中 文 😀 </s> <|endoftext|> 's"), (-16, sentences(rng, 25)),
    ]
