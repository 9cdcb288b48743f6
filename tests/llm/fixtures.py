"""Small document tables for the operators' tests."""

import random
import re

SCHEMA = "text string, doc_id long, lang string, source string, n_chars long, word string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, source); with extra columns whose names clash with inner ones."""
    full = [(r[1], r[0], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def prose(seed, n, words=300, vocabulary=900):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["th", "en", "ér", "on", "le", "a", "st"]) for _ in range(rng.randint(1, 5))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(5, words))) for _ in range(n)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")
