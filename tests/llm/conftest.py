import os
import random

import pytest
from pyspark.sql import functions as F

SF = os.environ.get("SMOKE_SF_DIR", "/root/testdata/sf0.001")
LETTERS = str.maketrans("0123456789", "abcdefghij")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return " ".join("w" + str(draw.randrange(vocabulary)).translate(LETTERS) for _ in range(n))


@pytest.fixture
def sf():
    return SF


@pytest.fixture
def corpus(spark):
    """Plain texts, exact and near copies, nulls in every column, empty, blank and very long texts, repeated rows."""
    draw = random.Random(7)
    rows = [(i, words(i, draw.randrange(55, 160)), "en", f"s{i % 4}", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(6)]
    for i in range(6, 12):
        near = rows[i][1].split()
        near[10] = "changed"
        rows.append((100 + i, " ".join(near) + " end", None, None, None))
    passage = words("passage", 60)
    rows += [(200 + i, f"{words(300 + i, 70)}\n{passage}\n{words(400 + i, 70)}", "en", "s0", 1) for i in range(12)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t\x0b\x0c\r ", "en", "s1", 7), (303, "one", "en", "", 3),
             (304, words("long", 20_000, 5000), "en", "s2", 1), (305, "x" * 3000, "en", "s2", 1), (306, "é日本 " * 120, "en", "s3", 1),
             (307, "A b C\n" * 40, "en", "s3", 1), (None, words("null id", 80), "en", "s0", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[-4]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing():
    """Adds columns named like those that an operator makes."""
    def add(df, *names):
        return df.withColumns({n: F.lit("mine") for n in names})
    return add
