"""Small tables with the awkward cases, and brute-force versions to compare with."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, bucket string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def texts():
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows, copies, near copies, a huge text."""
    passage, line = prose(1, 60), "A line that many documents share, word for word."
    base = prose(2, 300)
    near = base.split()
    near[150] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.replace(" ", "\t\n", 5)), (5, None), (6, ""), (7, " \n\t "),
        (8, passage), (9, prose(3, 50) + "\n" + passage + "\n" + line), (10, prose(4, 80) + " " + passage),
        (11, line + "\n" + prose(5, 40)), (12, "  " + line.upper() + "\n" + line + "\n" + prose(6, 30)),
        (13, "one two three"), (14, "one two three"), (15, prose(7, 30_000)), (16, "x" * 70_000),
        (17, "é ñ 日本 \U0001f600 mixed <|endoftext|> text"), (18, prose(8, 25)), (18, prose(8, 25)),
        (19, " ".join(["again and again the very same eight words here"] * 20)), (None, base), (None, None),
    ]
    return rows + [(20 + i, prose(100 + i, 40) + "\n" + line) for i in range(12)]


def frame(spark, rows=None):
    """With further columns whose names clash with the operators' own."""
    rows = texts() if rows is None else rows
    full = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 12}", len(t or ""), True, 7, "b") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
