import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators also use inside
    + [T.StructField(c, T.StringType()) for c in ("id", "content", "digest", "r1", "node", "size", "n", "component", "bits", "band")]
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Rows that hold every awkward case: nulls, empty, long, copies, ties, shared passages."""
    rng = random.Random(5)
    passage = words(rng, 120)
    base = words(rng, 300)
    edited = base.split()
    edited[7] = "changed"
    texts = {
        0: "Released under the MIT License. " + words(rng, 30), 1: base, 2: base, 3: " ".join(edited), 4: None, 5: "", 6: "   \n\t ", 7: "one two three", 8: "ONE Two three",
        9: words(rng, 50) + " " + passage + " " + words(rng, 60), 10: passage + "\n" + words(rng, 20), 11: ("ab cd ef " * 200).strip(), 12: words(rng, 20_000),
        13: "ünïcode wörds äöü ß " * 40 + "日本語 テキスト", 14: "x" * 3000, 15: base + " " + base, 16: words(rng, 400), 17: "a\x00b\x1cc   d e", 18: "x" * 3000,
        19: "Licensed under the Apache License, Version 2.0. See the GNU General Public License; MIT License", 20: "word" * 100,
    }
    rows = [(k, t, rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", None]), None if t is None else len(t)) for k, t in texts.items()]
    rows += [rows[1], rows[3], (None, base, None, None, None), (None, None, None, None, None), (30, base.upper(), "en", "s2", 5)]
    return [(*r, *[f"c{k}" for k in range(10)]) for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
