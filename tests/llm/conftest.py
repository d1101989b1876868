import os
import random
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.join(HERE, "..", "..", "scripts")]

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key long, start int, n int, cuts string, "
    "label int, score double, kept boolean, digest string, component string, path string, item_id long"
)


def texts(seed=5, n=120):
    """Invented texts: shared passages, near copies, repeats, odd white space, very long and very short ones."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "ri", "Mo", "kel", "ün", "zo") for b in ("n", "ba", "st", "", "fé", ",", ".")]

    def prose(k):
        return " ".join(rng.choice(words) + rng.choice(words).lower() for _ in range(k))

    passage = prose(70)
    out = [prose(rng.randint(1, 160)) for _ in range(n)]
    for i in range(0, n, 7):
        cut = rng.randint(0, len(out[i]))
        out[i] = out[i][:cut] + " " + passage + " " + out[i][cut:]
    for i in range(3, n, 10):
        near = out[i - 3].split(" ")
        near[rng.randrange(len(near))] = "changed"
        out[i] = " ".join(near)
    for i in range(5, n, 12):
        out[i] = out[i - 5]
    out += [prose(4000), "x" * 30_000, "ab " * 3000, "\t\n  \x0b", " lead  and trail ", "one", "one two", "ONE TWO", "ab\n\nab\nab", "é" * 80]
    return out


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents (rows of doc_id and text) with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t or ""), -i if i is not None else None, 1, 2, 3, "c", 1, 0.5, False, "d", "c", "p", 9) for i, t in rows], SCHEMA
        ).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Texts under scattered ids; null and empty texts; a row twice over; a null id."""
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts())]
    return [*rows, (2001, None), (2002, ""), (2003, None), (2004, "twice the very same row"), (2004, "twice the very same row"), (None, "one two")]


@pytest.fixture(scope="session", autouse=True)
def settings(spark):
    from barloom.llm.common import prepare

    prepare(spark)
