import random
import re
import string

import pytest

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Names that the operators use inside, on a table that has them too.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, k long, row string, node int, rank double, `set` string"


def sentence(rng, words=400, size=30):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(size))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with clashing columns: copies, near copies, nulls, blanks, a long text, repeated rows."""
    rng = random.Random(7)
    passage = sentence(rng, 400, 60)
    base = sentence(rng, 5000, 120).split()
    texts = [sentence(rng, 3000, rng.randrange(1, 90)) for _ in range(40)]
    texts += [None, "", " \n\t ", "one", "Two words", "é ü 中 文字   x", "from " * 300]
    texts += [sentence(rng) + "\n" + passage + " " + sentence(rng) for _ in range(12)]
    texts += [texts[0]] * 3
    for i in range(40):                                   # a family of near copies, all different
        near = list(base)
        for _ in range(rng.randrange(0, 6)):
            near[rng.randrange(len(near))] = f"n{i}_{rng.randrange(1000)}"
        texts.append(" ".join(near))
    texts.append(" ".join(sentence(rng, 50, 10) for _ in range(600)) + " " + passage)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(t or ""), 5, "x", 3, 0.5, "y") for i, t in enumerate(texts)]
    rows.append(rows[0])
    rows.append((None, texts[0], None, None, 0, None, None, None, None, None))
    return spark.createDataFrame(rows, CLASH).repartition(5)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], CLASH)
