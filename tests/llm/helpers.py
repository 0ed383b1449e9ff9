"""Small document tables with every odd case, and brute-force counterparts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, tag string"


def frame(spark, rows):
    """(doc_id, text, lang, source) rows; the other columns clash with the operators' names."""
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 7, "node", "tag") for r in rows], SCHEMA
    )


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed=3, n=60):
    """Copies, near copies, shared passages, odd and empty texts, NULLs in every column."""
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([3, 8, 40, 90, 300])) for _ in range(n)]
    passage = words(rng, 60)
    for k in range(0, n, 5):
        texts[k] = texts[k] + "\n" + passage + "\n" + words(rng, 5)
    for k in range(1, n, 7):
        texts[k] = texts[0]
    near = words(rng, 200).split()
    for k in range(2, n, 9):
        own = list(near)
        own[rng.randrange(200)] = f"edit{k}"
        texts[k] = " ".join(own)
    odd = [None, "", " ", "\n\n", "a", "é" * 120, "x" * 500, "ab" * 300, "🙂 " * 60, "\t a \x0b b\n",
           "The same. The same. " * 30, words(rng, 20000)]
    rows = [
        (k, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]))
        for k, t in enumerate(texts + odd)
    ]
    rows += [rows[0], rows[4], (None, texts[3], None, None), (None, None, None, None),
             (5, "another text under a used id " * 8, "en", "s1")]
    rng.shuffle(rows)
    return rows


def family(copies, seed=11):
    """A base of 300 words and copies with six words changed: 0.8 and more alike to the
    base, far less to each other."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(300)]
    rows = [(0, " ".join(base), "en", "s0")]
    for k in range(1, copies + 1):
        own = list(base)
        for place in range(6):
            own[rng.randrange(50 * place + 5, 50 * place + 45)] = f"e{k}p{place}"
        rows.append((k, " ".join(own), "en", "s0"))
    return rows
