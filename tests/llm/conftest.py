import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, kept boolean"


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "light", "amber", "field", "north", "quiet", "music", "paper", "glass", "winter", "garden", "signal", "copper", "meadow", "harbour", "lantern"]
    return " ".join(r.choice(words) + (str(r.randrange(50)) if r.random() < 0.4 else "") for _ in range(n))


def edge_rows():
    """Nulls, empty and long texts, copies, near copies, shared passages and repeated lines, with columns whose names clash."""
    long, passage = prose(1, 9000), prose(2, 60)
    base = prose(3, 120)
    near = base.replace("river", "creek", 1)
    texts = [None, "", " \t\n ", "!!! ???", base, base, base.replace(" ", "  ", 5), near, long, long + " end", prose(4, 40) + " " + passage + " " + prose(5, 30), prose(6, 25) + "\n" + passage, "One line here.\nOne line here.\nanother line\n\n", "one line here.\nAn odd line", "a b c", "A B C", "a b c d e", prose(7, 200), "<|endoftext|> it's É ﬁ x\x01y"]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src1", "src2", "src0"][i % 4], None if i % 5 == 0 else len(t or ""), 0.5, 7, True) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(19)] + [(None, 1, 0), (3, None, 0), (4, 1, 1), (900, 0, 0)], "doc_id long, quality int, toxic int")
