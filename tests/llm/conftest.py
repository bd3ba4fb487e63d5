"""Small tables with the hard cases in them, and plain versions of the operators' rules."""

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def prose(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(n))


def documents():
    """Copies, near copies, shared passages, empty, null, blank and very long texts, repeated rows, a null id."""
    rng = random.Random(1)
    passage = prose(rng, 80)
    rows = [(i, prose(rng, rng.choice([3, 30, 120, 300])), rng.choice(["aa", "bb"]), f"s{i % 3}") for i in range(40)]
    rows += [(50 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 15), "aa", "hot") for i in range(30)]
    rows += [(100 + i, rows[7][1], "bb", "hot") for i in range(20)]
    edited = rows[45][1].split(" ")
    for i in range(10):
        copy = list(edited)
        copy[rng.randrange(len(copy))] = "changed"
        rows.append((130 + i, " ".join(copy), "aa", "hot"))
    rows += [(200, None, "aa", None), (201, "", None, "s1"), (202, " \t\n ", "aa", "s1"), (203, "one", "bb", "s1"), (204, "É \x1c ß x \U0001f600", "aa", "s1")]
    rows += [(205, prose(rng, 20_000), "bb", "s1"), (206, "w " * 400, "bb", "s1"), (207, passage.upper(), "aa", "s1")]
    rows += [(208, passage, "aa", "s1"), (208, passage, "aa", "s1"), (None, passage, "aa", "s1"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """With further columns whose names operators use themselves."""
    schema = "doc_id long, text string, lang string, source string"
    frame = spark.createDataFrame(documents(), schema)
    return frame.selectExpr("*", "1 AS n_words", "'x' AS spans", "2.0D AS score", "0L AS key", "'k' AS label", "0L AS tokens", "1 AS fp", "0 AS base")


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{out}/documents.parquet")
    rng = random.Random(3)
    spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, 0) for i in range(0, 140)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    rows = documents()
    items = [(0, " ".join(rows[50][1].split(" ")[5:40])), (1, prose(rng, 30)), (2, None), (3, "!!! ..."), (4, "one"), (5, rows[45][1]), (5, rows[45][1]), (None, rows[8][1])]
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0L AS n_words", "1 AS spans").write.parquet(f"{out}/benchmark.parquet")
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(260)]
    vectors += [(300 + i, vectors[0][1]) for i in range(60)]
    vectors += [(400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [0.5] * 3), (650, []), (700, [1e300] * 8), (None, [1.0] * 8), (7, [0.1] * 8)]
    # queries of several rows: the first of these is no vector
    vectors += [(50, [None] + [0.9] * 7), (100, [-0.9] * 8), (100, [0.9] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "0 AS score", "1 AS rank", "2 AS query_id").write.parquet(f"{out}/embeddings.parquet")
    return out


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return out
