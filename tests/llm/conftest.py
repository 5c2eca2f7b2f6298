import random

import pytest

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, digest int, host int, kept int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, ties, copies, repeats and one very long one."""
    base = prose(1, 200)
    words = base.split()
    near = words.copy()
    near[100] = "changed"
    far = words[:60] + prose(2, 140).split()
    rows = [
        base, base, " ".join(near), " ".join(far), None, None, "", "", "   \n\t ", "one", "one", "a b c", "a b c", "1234 !!! ???", base.upper(), prose(3, 4000) + " " + prose(1, 60),
        prose(4, 30) + "\n" + prose(4, 30), "x" * 3000, "é è 日本語 😀 \u00a0 \u2003 tail", " ".join(words[20:60]), " ".join(words[:30] + words[:30]), "<|endoftext|> and <|endoftext|>",
    ]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts under more columns, whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), "k", "i", 1, 2, 3) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
