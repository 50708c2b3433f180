"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

WORDS = "the of and stone river cloud ember quartz lantern meadow harbor violet copper thicket marble saffron drift".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, before long, shard int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows() -> list[tuple]:
    texts = [prose(i, 60) for i in range(12)]
    texts += [texts[0], texts[1], texts[1] + " tail", texts[2].upper(), "", None, " \n\t ", "one", "two words", "É ñ 漢字   x", prose(99, 4000), "a b c d e\n" * 40, "AKIA" + "Z" * 20 + " password=abcdef"]
    sources = ["web", "web", "web", "books", None, "code", ""]
    table = [(i, t, ["en", "de", None][i % 3], sources[i % len(sources)], len(t or ""), 5, 6, 7, 8) for i, t in enumerate(texts)]
    return [*table, (None, texts[3], None, None, None, None, None, None, None), (7, texts[7], "de", "web", 1, 5, 6, 7, 8), (7, texts[7], "de", "web", 1, 5, 6, 7, 8)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
