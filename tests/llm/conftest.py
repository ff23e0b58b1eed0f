import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "vu") for b in ("ban", "del", "fir", "gos", "hut", "jam", "kip", "lor")]


def prose(rng: random.Random, n: int) -> str:
    """``n`` words in sentences and lines."""
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + ("." if rng.random() < 0.1 else ""))
        out.append("\n" if rng.random() < 0.04 else " ")
    return "".join(out).strip()


SCHEMA = "doc_id long, text string, h long, row string, label string, keep string, `a b.c` long"


@pytest.fixture(scope="session")
def texts():
    """Ids and texts with exact and near copies, shared lines and passages, blanks, nulls, repeats and a long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 160)) for _ in range(30)]
    rows = list(enumerate(base))
    rows += [(100 + k, base[k]) for k in range(5)]
    for k in range(5, 12):
        words = base[k].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((100 + k, " ".join(words)))
    rows += [(130 + k, prose(rng, 20) + "\n" + base[20] + "\n" + prose(rng, 15)) for k in range(3)]
    rows += [(140, ""), (141, None), (142, " \n\t "), (143, "one two"), (144, "ONE two"), (145, "a" * 700), (146, "abc" * 200)]
    rows += [(147, "É" * 150 + base[3]), (148, prose(rng, 9000)), (7, base[7]), (None, base[2]), (None, None), (149, "tail\n\n \n")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "r", None, "k", 2) for i, t in texts], SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
