import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, _key string, _text string"
WORDS = "alpha beta gamma delta river stone window garden silver market evening".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def row(doc_id, text, source="s1"):
    return (doc_id, text, "en", source, len(text or ""), 7, "k", "t")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, long texts, ties, repeats, copies; the columns beyond n_chars clash with names used inside."""
    base = prose(1, 120)
    words = base.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [row(1, base), row(2, base), row(2, base), row(3, near), row(4, None), row(5, ""), row(6, " \t\n\x0b\x0c\r"), row(None, prose(2, 80)), row(None, None, None), row(7, prose(3, 9000)), row(8, "One, TWO three"), row(9, "one, two THREE", None), row(10, "x" * 5000), row(11, "<|endoftext|> mail a.b@c.example.org and +1 (555) 123-4567, ip 10.0.0.256 10.1.2.3 card 4111 1111 1111 1111"), row(12, "naïve 日本語　text 🙂 don't " * 30), row(13, "a.b@c.d@e.f. +12-3 1.2.3.4.5.6.7.8 " + "9" * 300)]
    rows += [row(100 + i, prose(50 + i % 9, 70 + i % 5), f"s{i % 3}") for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
