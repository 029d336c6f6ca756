import random

import pytest

#: Columns beside doc_id and text have names that the operators use inside.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, i bigint, t string, key bigint, h string, row string, words string"
VOCAB = ["the", "of", "Wort", "été", "Été", "niño", "alpha", "Beta", "gamma", "delta", "x1", "y2", "zeta", "eta", "theta", "iota", "kappa", "mu"]


def passage(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(9)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, repeated lines, nulls, empty and blank texts, a very long text, a repeated row."""
    rng = random.Random(9)
    shared = passage(rng, 30)
    base = "\n".join(passage(rng, 40) for _ in range(4))
    texts = [None, "", "  \n\t ", "one", "two words", base, base, base.replace("alpha", "ALPHA", 1)]
    for k in range(14):
        words = base.split(" ")
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [passage(rng, 20) + " " + shared + "\n" + passage(rng, 25) for _ in range(5)]
    texts += [passage(rng, rng.randrange(5, 120)) for _ in range(15)]
    texts += ["same line of some six words here\n" + passage(rng, 12) for _ in range(4)]
    texts += [" ".join(passage(rng, 50) for _ in range(120)), "a b c\x85d 　e", "x" * 5000, "w " * 400]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    out = list(zip(ids, texts, strict=True))
    return [*out, out[9], (None, base), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = [(i, t, "en" if (i or 0) % 2 else None, "s", 1, 0.5, 3, "t", 4, "h", "r", "w") for i, t in rows]
    return spark.createDataFrame(extra, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
