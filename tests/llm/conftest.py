import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double, key string, ids string, a long, side int, component_id string, `row` string, cell int"


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls everywhere, empty and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    long = " ".join(f"x{i % 997} y{i}" for i in range(15_000))
    near = words[:-1] + ["other"]
    texts = [None, "", " \n\t ", "one", "one two", " ".join(words), " ".join(words), " ".join(near), " ".join(words).upper(), long, long + " end", "12 ... !!", "<|endoftext|> é 漢字", "a" * 3000]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", None, "s2", "s3"][i % 4], None if i % 2 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "one", None, None, None), (None, None, None, None, None), (3, "other text of a known id", "en", "s1", 1)]
    return [(*r, 1, "x", 0.5, "k", "i", 7, 0, "c", "r", 2) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
