import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and a clashing extra column."""
    rng = random.Random(7)
    pool = "the of and to der die un la idiot clown été größe mañana alpha beta gamma delta".split()
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    base = text(120)
    rows = [(i, text(rng.randint(1, 60)), rng.choice(["en", "de", None, "xx"]), rng.choice(["src0", "src1", None]), 1) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "src0", 0), (52, " \t\n ", "en", "src1", 0), (53, base, "en", "src0", 1), (54, base, "en", "src0", 1)]
    rows += [(55, base + " extra", "en", "src0", 1), (56, text(9000), "fr", "src3", 1), (57, base, "es", "src0", 1), (57, base, "es", "src0", 1)]
    rows += [(58, "Line one\nLine one\n\nLine two\r\nLine one\x0bx ### $$$", "en", "src0", 1), (59, "😀 emoji ñ é\x00 zero", "es", "src2", 1)]
    return spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", _words string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
