"""Classifiers: accuracy on rows they have not seen, and that a prediction depends on the text alone."""

import random
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from spindrift.llm import quality
from spindrift.llm import queries as q
from spindrift.llm.language_id import ALPHA, BETA, BITS, L1, L2, SCALE, Ftrl, predict, train
from spindrift.llm.quality import THRESHOLD


def corpus(n=240, seed=5):
    rng = random.Random(seed)
    syllables = {"xx": ["ka", "lo", "mi", "te"], "yy": ["schr", "ung", "keit", "ze"], "zz": ["eau", "oi", "que", "é"]}
    out = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        out.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(5, 60))), lang))
    return out


def write(spark, path, rows, labels=()):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5D AS score", "'q' AS lang_pred", "1 AS label").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_language_is_recognised(spark, tmp_path):
    rows = corpus() + [(900, None, "xx"), (901, "123 !!! ...", "xx"), (902, "", None), (None, "kalomi", "xx"), (903, "kalomi lokate", None)]
    out = {r.doc_id: r for r in q.op6_language_id(spark, write(spark, tmp_path, rows)).collect()}
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang in corpus()}
    held = [r for i, r in out.items() if i in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items() if i is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 20
    assert [(out[i].lang_pred, out[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert out[None].held_out is False and out[903].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_prediction_depends_on_the_text_alone(spark):
    model = train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    a = predict(spark.createDataFrame([(1, "kalomi teka", "zz")], "doc_id long, text string, lang string"), model).first()
    b = predict(spark.createDataFrame([(77, "kalomi teka", None)], "doc_id long, text string, lang string"), model).first()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score) and a.lang_pred == "xx"


def test_nothing_to_learn_from(spark, tmp_path):
    path = write(spark, tmp_path, [(1, "some words", None), (2, None, "xx")])
    assert {r.lang_pred for r in q.op6_language_id(spark, path).collect()} == {"und"}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in q.op8_quality(spark, path).collect())


def test_quality_is_told_apart(spark, tmp_path):
    rng = random.Random(9)
    good, bad = [f"w{i}" for i in range(60)], [f"J{i}!!" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        label = int(rng.random() < 0.7)
        rows.append((i, " ".join(rng.choices(good if label else bad, k=rng.randint(5, 80))), "xx"))
        labels.append((i, label, 0))
    rows += [(1000, None, None), (1001, "", None)]
    labels += [(5000, 1, 0), (None, 1, 0), (3, None, 0)]
    out = {r.doc_id: r for r in q.op8_quality(spark, write(spark, tmp_path, rows, labels)).collect()}
    truth = dict((i, y) for i, y, _ in labels[:400])
    held = [r for i, r in out.items() if i in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 40
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in out.values())


def test_prediction_is_the_plain_score(spark):
    """Every text's n-grams counted one by one under the fitted table."""
    model = train(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    bucket = lambda h: (h & 0xFFFFFFFF) >> (32 - BITS)
    mix = lambda h, shift: (h ^ (h >> shift)) & 0xFFFFFFFF
    texts = [t for _, t, _ in corpus(30, 6)] + ["\u00c9 x", "a", "Kalomi " * 50]
    want = []
    for text in texts:
        c = [ord(x) for x in text.lower()] + [0, 0]
        total = np.zeros(model.table.shape[1])
        for i in range(len(c) - 2):
            one = c[i] * 0x9E3779B1 & 0xFFFFFFFF
            two = (mix(one, 15) ^ c[i + 1]) * 0x85EBCA77 & 0xFFFFFFFF
            three = (mix(two, 13) ^ c[i + 2]) * 0xC2B2AE3D & 0xFFFFFFFF
            for h in (one, two, three):
                total += model.table[bucket(h)]
        scores = (total[1:] / total[0] * SCALE + model.bias) / model.temperature
        p = np.exp(scores - scores.max())
        want.append((model.languages[int(scores.argmax())], float((p / p.sum()).max())))
    got = {r.doc_id: r for r in predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, (lang, score) in enumerate(want):
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-5


def test_ftrl_follows_its_formula():
    rng = np.random.default_rng(2)
    ftrl, z, n = Ftrl(6, 3), np.zeros((6, 3)), np.zeros((6, 3))
    for _ in range(40):
        at, x, label = rng.choice(6, 3, replace=False), rng.random(3), int(rng.integers(3))
        w = np.zeros((6, 3))
        for i in range(6):
            for k in range(3):
                if abs(z[i, k]) > L1:
                    w[i, k] = -(z[i, k] - np.sign(z[i, k]) * L1) / ((BETA + np.sqrt(n[i, k])) / ALPHA + L2)
        p = np.exp(x @ w[at])
        p /= p.sum()
        for j, i in enumerate(at):
            for k in range(3):
                g = x[j] * (p[k] - (k == label))
                sigma = (np.sqrt(n[i, k] + g * g) - np.sqrt(n[i, k])) / ALPHA
                z[i, k] += g - sigma * w[i, k]
                n[i, k] += g * g
        ftrl.learn(at, x, label)
    assert np.allclose(ftrl.z, z) and np.allclose(ftrl.n, n)


def test_pooling_is_the_plain_mean(spark):
    """Word vectors summed neighbour by neighbour, and their weighted mean and spread."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "cd", "ef", "g"], k=rng.randint(0, 12))) for _ in range(12)]
    sums, counts = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    fixed, bucket = quality.index_vectors().astype(float), lambda w: xxhash.xxh64_intdigest(w, 0) >> (64 - quality.BITS)
    want, times = np.zeros_like(sums), np.zeros_like(counts)
    for t in texts:
        w = t.split()
        for i, word in enumerate(w):
            times[bucket(word)] += 1
            for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                if j != i:
                    want[bucket(word)] += fixed[bucket(w[j])]
    assert np.array_equal(sums, want) and np.array_equal(counts, times)
    table = quality.pooling_table(sums, counts)
    got = quality.pool(pa.array(texts), table)
    for t, row in zip(texts, got, strict=True):
        rows = np.array([table[bucket(w)] for w in t.split()], float).reshape(-1, table.shape[1])
        total = rows.sum(0)
        mean = total[:-1] / max(total[-1], 1e-12)
        spread = np.sqrt(np.maximum(mean[quality.WIDTH :] - mean[: quality.WIDTH] ** 2, 0))
        assert np.allclose(row, np.concatenate([mean[: quality.WIDTH], spread]), atol=1e-6)
