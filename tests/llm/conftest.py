import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TOKENIZERS = "/opt/tokenizers"


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def hard_texts(rng):
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, very long texts, odd characters, repeated rows."""
    base = prose(rng, 120)
    words = base.split()
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, base), (4, base), (5, base.upper()), (6, "one two three"), (7, "One  two\tthree"), (8, "naïve café ΣΊΣ 😀 İstanbul \x1c x\x85y"), (9, "a" * 3000), (10, prose(rng, 8000)), (11, "<|endoftext|> and <|startoftext|>")]
    for k in range(12, 40):
        changed = list(words)
        for _ in range(rng.randrange(1, 6)):
            changed[rng.randrange(len(changed))] = prose(rng, 1)
        rows.append((k, " ".join(changed)))
    for k in range(40, 60):
        rows.append((k, prose(rng, rng.randrange(1, 80))))
    rows += [(60, rows[41][1] + "\n" + base), (41, rows[41][1]), (41, rows[41][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, hard_texts):
    """The hard texts with further columns whose names clash with what operators use inside."""
    extra = "doc_id long, text string, bin int, n string, set_id string, rank int, _gone int, spans string, shard string, is_toxic string"
    return spark.createDataFrame([(i, t, 1, "n", "s", 2, 3, "x", "y", "z") for i, t in hard_texts], extra).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
