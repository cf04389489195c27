"""Documents with the awkward cases, and helpers, for all text operators."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def make_docs(seed=7, n=60):
    """Random prose with copies, near copies, shared passages and lines, runs of a word, nulls, blanks and long texts."""
    rng = random.Random(seed)
    v = vocabulary(rng)
    prose = lambda k: " ".join(rng.choice(v) + rng.choice(["", "", ",", "."]) + ("\n" if rng.random() < 0.08 else "") for _ in range(k))
    passage, line = prose(60).replace("\n", ""), "Shared line of this site, with all rights."
    texts = []
    for i in range(n):
        t = prose(rng.randint(5, 220))
        if i % 5 == 0:
            t = t + " " + passage + " " + prose(10)
        if i % 4 == 0:
            t = line + "\n" + t + "\n" + line
        texts.append(t)
    texts += [texts[1], texts[1], texts[2].replace(" ", "  ", 1), texts[3] + " tail"]
    w = texts[6].split(" ")
    for k in range(6):
        x = list(w)
        x[rng.randrange(len(x))] = "changed" + str(k)
        texts.append(" ".join(x))
    texts += [None, "", " \n\t ", "one", "one two three", "ha " * 200, "ab cd " * 90, prose(6000), "x" * 3000, "Tab\there\x0b and ▁ mark 😀 日本語\n\n"]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(8)] + [None]), None if t is None else len(t), "e") for i, t in enumerate(texts)]
    rows.append(rows[1])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
