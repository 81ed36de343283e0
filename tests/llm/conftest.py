import pytest
from pyspark.sql import functions as F

PROSE = "the cat sat on the mat and the dog lay by the door while rain fell on the old town square at noon".split()


def sentence(seed: int, n: int) -> str:
    """n words that depend on the seed alone."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(PROSE[x % len(PROSE)] + str(x % 97))
    return " ".join(out)


LONG = sentence(1, 160)
TEXTS = [
    (1, LONG),
    (2, LONG),  # exact copy
    (3, LONG.replace("cat", "cow", 2)),  # near copy
    (4, sentence(2, 40) + " " + " ".join(LONG.split()[20:110]) + "\n" + sentence(3, 30)),  # shared passage
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "Two words"),
    (9, "two  WORDS"),
    (10, "same " * 300),
    (11, "same " * 300 + "end"),
    (12, "é日本😀 " * 200 + sentence(4, 20)),
    (13, "aaaa" * 500),
    (14, sentence(5, 3000) + " " + LONG),
    (15, "\x1c\x85 a\x0bb\x0cc d " + sentence(6, 60)),
    (16, LONG + " " + LONG),
    (None, LONG),  # no id
    (17, sentence(7, 55)),
    (17, sentence(7, 55)),  # a repeated row
]


@pytest.fixture(scope="session")
def docs(spark):
    """Texts with every odd case, and columns whose names clash with those the operators use."""
    rows = [(i, t, 1, "x", "y", 2.0) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int, ids string, component string, score double")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def with_ids():
    return [(i, t or "") for i, t in TEXTS if i is not None]


@pytest.fixture(scope="session")
def small_corpus(spark):
    return lambda sf, name: spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet").withColumn("extra", F.lit(1))
