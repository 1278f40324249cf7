"""A documents table with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(100)) * (rng.random() < 0.2) for _ in range(n)) + "."


A = prose(1, 60)
ROWS = [
    (1, A, "en"), (2, A, "en"), (2, A, "en"), (3, A + " more words here", "en"), (4, None, None), (5, "", "en"), (6, "   \n\t ", "en"),
    (7, "Élan vital, naïve café.", "fr"), (8, prose(2, 3000), "en"), (9, "x" * 5000, "en"), (10, "same same same same same same same same same same same", "de"),
    (11, "12 34 56", None), (12, prose(3, 4), "en"), (13, A.upper(), "en"), (14, prose(4, 40) + "\n" + prose(5, 30) + "\n" + prose(4, 40), "fr"),
    (15, "<|endoftext|> and <s> </s> ▁ literal ▁▁ marks  with   spaces ", "en"), (16, prose(6, 30) + " " + A, "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, score double, kept boolean, row string, value string, key string"


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 1, 2, 0.5, True, "r", "v", "k") for i, t, g in rows], SCHEMA)


def texts(rows=ROWS) -> list[tuple[int, str]]:
    return [(i, t or "") for i, t, _ in rows]
