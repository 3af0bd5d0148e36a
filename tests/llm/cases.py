"""Small tables of hard cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, salt int, __size string, shard string, label string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n, pool=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(pool)}" for _ in range(n))


def hard_texts():
    base = prose(1, 120)
    long = prose(2, 30_000, 9_000)
    return [
        (1, base), (2, base.replace(" ", "  ")), (3, base.replace(" ", "\n", 5)), (4, base + " tail of five more words"), (5, base.upper()),
        (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "one"), (11, "ONE"), (12, "a b c d"), (13, "a b c d"), (14, long), (15, long + " x"),
        (16, "é日本 ß — naïve İstanbul ſ"), (17, "1234 5678 !!"), (18, prose(3, 60) + " " + base), (18, prose(3, 60) + " " + base), (19, "  "), (20, "z" * 5_000),
    ]


def hard_docs(spark, texts=None):
    langs, sources = ["en", "fr", None], ["a", None, "é", "b", "a"]
    rows = [(i, t, langs[k % 3], sources[k % 5], None if k % 4 == 0 else len(t or ""), None, 7, None, "x", None, "y") for k, (i, t) in enumerate(texts or hard_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
