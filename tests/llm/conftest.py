import random

import pytest

from pavemetric.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copy int, n_lines long, fill int, k_id long"
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts() -> list[tuple]:
    """Ids, texts and sources with every hard case: nulls, empty, spaces only, long, copies, near copies, shared lines."""
    rng = random.Random(7)
    base = words(rng, 200)
    rows: list[tuple] = []
    for i in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 8)):
            near[rng.randrange(len(near))] = words(rng, 1)[0]
        rows.append((i, " ".join(near), f"s{i % 12}"))
    for i in range(40, 70):
        rows.append((i, " ".join(words(rng, rng.randint(1, 90))) + ".", f"s{i % 3}"))
    for i in range(70, 90):
        rows.append((i, "A line that is on every site, \t\n" + " ".join(words(rng, 20)) + "\n\n" + " ".join(words(rng, 5)), f"s{i % 12}"))
    rows += [(90, None, "s0"), (91, "", "s0"), (92, " \t\n ", None), (93, "one", "s1"), (94, "one two three", "s1"), (95, "One  two three", "s2")]
    rows += [(96, rows[3][1] + "\n ", "s3"), (97, rows[3][1], None), (98, rows[45][1], "s4"), (98, rows[45][1], "s4"), (99, rows[45][1].upper(), "s4")]
    rows += [(None, "no id here", "s5"), (None, None, "s5"), (None, "no id here", "s5"), ((1 << 60) + 7, "a large id 's <|endoftext|> Été  x", "s6")]
    rows += [(200, " ".join(words(rng, 6000)), "s7"), (201, "x" * 50_000, "s7"), (202, "你好。" * 900 + "\U0001f600\x00\x85", "s8")]
    return rows


@pytest.fixture(autouse=True)
def no_scratch_left(spark):
    yield
    common.clean(spark)


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "en", s, 0, 0.5, 9, 9, 9, 9) for i, t, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
