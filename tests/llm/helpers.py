"""Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns with clashing names."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(WORDS)[:4] for _ in range(2)) for _ in range(n))


def odd_docs(spark):
    """doc_id, text, lang, source, n_chars and columns whose names operators use inside."""
    rows = [
        (0, prose(0, 60), "en", "a", 1, "x", 1.0),
        (1, None, None, None, None, None, None),
        (2, "", "en", "a", 0, "x", 1.0),
        (3, prose(0, 60), "en", "a", 1, "x", 1.0),
        (3, prose(0, 60), "en", "a", 1, "x", 1.0),
        (4, "!!! ---", "de", "b", 7, "x", 1.0),
        (5, "\n\n \t\n", "de", "b", 5, "x", 1.0),
        (6, prose(6, 9000), "de", "b", 5, "x", 1.0),
        (7, "été " * 30 + "日本語 \U0001f600", None, "b", 5, "x", 1.0),
        (8, "a" * 3000, "en", "b", 5, "x", 1.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class_id string, score double")


def empty_docs(spark):
    return odd_docs(spark).limit(0)
