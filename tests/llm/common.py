"""Small tables of hard cases that every operator is held against."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, block string, row string, rank string, bucket string, list string, host string, path string, norm string, at string, n string"


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows; and extra columns of clashing names."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "théâtre", "größe", "niño"]
    long = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(40_000))
    base = " ".join(r.choice(words) + str(r.randrange(500)) for _ in range(120))
    near = base.replace(base.split()[60], "changed", 1)
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, base), (6, base), (6, base), (7, near), (8, "one two"), (9, "ONE  two"), (None, base), (None, None), (10, "x" * 100_000), (11, "line\n" * 50), (12, "…!?\n12 34")]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
