"""Small awkward inputs that every operator must take."""

import random

WORDS = "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng, n):
    """n words in sentences and lines."""
    out = []
    for k in range(n):
        w = rng.choice(WORDS) + rng.choice(WORDS)
        out.append(w + rng.choice([" ", " ", " ", ", ", ". ", ".\n"]))
    return "".join(out).strip()


def awkward(spark, extra=()):
    """Null, empty, blank, long, repeated and unnamed rows, with columns that clash with output and working names."""
    rng = random.Random(5)
    long = prose(rng, 3000)
    texts = [None, "", "  \n\t ", "one", long, long, prose(rng, 80), prose(rng, 80), "é日本 🙂 \x1c\xa0x", "a" * 5000, *extra]
    rows = [(k if k % 7 else None, t, "en" if k % 3 else None, "s" if k % 2 else None, len(t or ""), "x", "y", k, "z", "w") for k, t in enumerate(texts)]
    rows.append(rows[4])
    columns = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, ids string, rid long, row string, kept string"
    return spark.createDataFrame(rows, columns)


def same_rows(a, b):
    key = lambda r: [(v is None, str(v)) for v in r]
    return sorted(map(key, a)) == sorted(map(key, b))
