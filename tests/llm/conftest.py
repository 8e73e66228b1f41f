import random

import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    stops = "the of and to in is it that".split()
    return " ".join(rng.choice(stops) if rng.random() < 0.25 else rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Ordinary texts and every odd one: null, empty, blank, long, repeated row, null id, other scripts."""
    out = [(i, prose(i, 20 + 7 * i)) for i in range(40)]
    out += [(100, None), (101, ""), (102, " \t\n "), (103, prose(3, 20_000, 5000)), (104, out[5][1]), (104, out[5][1])]
    out += [(None, prose(77, 50)), (105, "你好 ΣΑΣ İx <|endoftext|> café é"), (106, "x" * 50_000), (107, "\n".join([prose(9, 12)] * 40))]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts, with extra columns whose names operators use inside."""
    data = [(i, t, "en", "s", None if t is None else len(t), 7, "z") for i, t in rows]
    return spark.createDataFrame(data, TEXT + ", score int, fp string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], TEXT)
