import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Ids and texts: clean, null, empty, blank, short, equal, near copies, shared passages, repeats within, one very long."""
    rng = random.Random(5)
    passage = prose(rng, 70)
    docs = [prose(rng, rng.randint(30, 200)) for _ in range(30)]
    docs += [None, "", "  \n\t ", "one", "One  TWO", "one two", docs[0], docs[0], docs[1].upper()]
    docs += [docs[2] + " tail", docs[2].replace("a", "á", 1), " ".join(docs[3].split()[:-2]), "\n".join(docs[4].split(" "))]
    docs += [prose(rng, 40) + "\n" + passage + " " + prose(rng, 30) for _ in range(6)]
    docs += ["go " * 300, "ab" * 400, "é" * 300, passage[:250] + passage[:250], prose(rng, 6000) + " " + passage]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(3 * i, docs[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with columns that clash with what operators add."""
    rows = [(d, t, "en", None if d % 7 == 0 else f"src{d % 3}", len(t or ""), 1.5, "x", 3) for d, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, block int").repartition(4)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
