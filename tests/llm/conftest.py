import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, score string, tag int, bucket int"


def corpus(seed=5, n=120):
    """Invented documents with copies, near copies, shared passages, nulls, empty and long texts, and clashing extra columns."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéßñ") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    shared = prose(60)
    rows = []
    for i in range(n):
        text = prose(draw.choice([1, 2, 3, 20, 80, 300]))
        kind = i % 10
        if kind == 1:
            text = f"{text} {shared}\n{prose(5)}"
        if kind == 2 and rows:
            text = draw.choice(rows)[1] or ""
        if kind == 3 and rows:
            text = (draw.choice(rows)[1] or "") + " zz"
        if kind == 4:
            text = "\n".join([prose(4)] * 12 + [prose(60)])
        if kind == 5:
            text = f"\t{text.upper()} {prose(8)}   \n\n  "
        rows.append((i * 3, text, draw.choice(["en", "de", None]), draw.choice(["a", "a", "b", "é", "Z", None])))
    rows += [(n * 3, None, "en", "a"), (n * 3 + 1, "", "en", "b"), (n * 3 + 2, "  \n\t ", None, None), (None, rows[8][1], "en", "a"), (None, prose(70), "de", None), (None, None, None, None)]
    rows += [rows[1], rows[1], (rows[4][0], "another text of the same id", "en", "a")]
    rows.append((n * 3 + 5, prose(20_000), "en", "a"))
    return [(*r, len(r[1] or ""), 7, "x", "y", 1, 2) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
