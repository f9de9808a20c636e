import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp long, n long"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, odd white space, null and empty texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdrst") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(120))
    texts: list[str | None] = [None, "", " \t\n", "One", "two Words", "a a a " * 60, "ab cd " * 70, "ÄÖ é x  y", "  lead\n\n trail "]
    while len(texts) < n:
        kind = r.randrange(6)
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 200))]
        if kind == 0 and len(texts) > 12:
            texts.append(r.choice(texts[9:]))
        elif kind == 1 and len(texts) > 12:
            near = (r.choice(texts[9:]) or "x").split(" ")
            near[r.randrange(len(near))] = "zz"
            texts.append(" ".join(near))
        elif kind == 2:
            at = r.randrange(40)
            texts.append(" ".join(words[:20]) + "\n" + " ".join(passage.split()[at : at + r.randint(45, 80)]) + ". " + " ".join(words[20:]))
        else:
            texts.append(" ".join(w.title() if r.random() < 0.1 else w for w in words) + r.choice(["", ".", "\nEnd of it."]))
    sources = [None, "b", "a", "a", "a", "é"]
    rows = [(i * 3 + 1, t, "en", sources[i % 6], len(t or ""), "x", i, i) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
