from __future__ import annotations

import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = "_row string, _id int, _text string, n int, a string, b string, component string, kept string, n_tokens string, _source string, _key string, rank int, h long"


def prose(seed: int, words: int, line: int = 9) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice(("an", "er", "on", "ti", "re", "th", "in")) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(made[i : i + line]) for i in range(0, words, line))


def edited(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return re.sub(r"[^\s]+", lambda m: f"x{r.randrange(10**6)}" if r.random() < share else m.group(), text)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in each column, empty and blank texts, ties, repeated rows, copies, near copies and a very long text."""
    base = prose(1, 150)
    rows = [
        (0, base, "en", "s0", 1),
        (1, base, "en", "s1", 1),
        (1, base, "en", "s1", 1),
        (2, edited(base, 0.02, 5), "en", "s0", 1),
        (3, None, "en", "s0", None),
        (4, "", "en", None, 0),
        (5, " \n\t\n ", None, "s1", 5),
        (None, base, "de", "s2", 1),
        (None, None, None, None, None),
        (6, "one two", "de", "s2", 7),
        (7, prose(7, 40_000), "fr", "s3", None),
        (8, "word " * 3000, "fr", "s3", None),
        (9, "a" * 200_000, "es", "s4", None),
        (10, "é漢 <|endoftext|> 😀 ▁x\r\n\x0b\x0c +1 (203) 555-8282, ab.c@de.example.org 10.1.2.3", "es", "s4", None),
        (11, prose(11, 90), "en", "", None),
    ]
    return rows + [(20 + i, prose(100 + i, 60 + 7 * i), ("en", "de", None)[i % 3], f"s{i % 4}", None) for i in range(40)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(edge):
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASHING.split(", ")])


def words_of(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall("[^\x20\x09-\x0D]+", text)
