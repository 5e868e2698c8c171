import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, node long, kept boolean, bucket string, group string"


def rows():
    """Edge cases: nulls, empty and very long texts, repeated rows, ties, copies, near copies, passages; clashing columns."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeghiéñ") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    a, passage, long = prose(120), prose(60), prose(30_000)
    near = a.split()
    near[3] = "changed"
    texts = [None, "", " \n\t ", "one", "two words", "Two  Words", a, a, " ".join(near), a.upper(), passage + "\n" + prose(40), prose(40) + " " + passage, passage, long, long + " end"]
    texts += ["x" * 5000, "la la la " * 50, prose(19), prose(20), "same line here\n" * 12, prose(300) + " \x85 It's 12 <|endoftext|> 中文", "a\x00b c\x1fd"]
    out = [(10 * k + 3, t, ["en", "fr", None][k % 3], ["s0", None][k % 2], None if t is None else len(t)) for k, t in enumerate(texts)]
    out += [out[6], out[0], (None, prose(50), "en", "s0", 1), (-5, a, None, None, None)]
    return [x + (1, 2, True, "b", "g") for x in out]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
