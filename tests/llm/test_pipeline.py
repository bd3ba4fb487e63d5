"""Each stage against a plain version on a small folder."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from spindrift.llm import components, decontaminate, shingle_sets
from spindrift.llm import queries as q
from spindrift.llm.packing import vocabulary

from .conftest import LOWER, documents, words
from .test_contracts import redacted
from .test_models import corpus


WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def hit_words(text, items):
    """Places of the words inside an occurrence of a window of ten, or of a whole shorter item."""
    low = [w.translate(LOWER) for w in WORD.findall(text or "")]
    hit = set()
    for item in items:
        w = [x.translate(LOWER) for x in WORD.findall(item or "")]
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(low) - n + 1):
                if low[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
    return hit, low


def test_language_stage(spark, docs, folder):
    kept = corpus_pipeline.identify_language(spark, docs, folder)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert not [r for r in found if not any(c.isalpha() for c in r.text or "")] and len(found) > 100


def test_unlearned_languages_go(spark):
    foreign = ["\u0421\u044a\u0435\u0448\u044c \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a", "\u65e5\u672c\u8a9e\u306e\u30c6\u30ad\u30b9\u30c8\u3067\u3059", "123 !!!", None, ""]
    rows = corpus() + [(1000 + i, t, None) for i, t in enumerate(foreign)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, _ in corpus()]


def test_contamination_stage(spark, docs, folder):
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)["benchmark_decontamination"]
    passage = documents()[45][1].split(" ")[10:40]
    partly = [(300 + i, f"Some, {'more ' * i}words! ({' '.join(passage[: 12 + i]).upper()}) and " + "others. " * 40 + "One") for i in range(8)]
    rows = [(i, t) for i, t, *_ in documents()] + partly
    more = spark.createDataFrame(partly, "doc_id long, text string")
    frame = docs.unionByName(more, allowMissingColumns=True).selectExpr("*", "7L AS n_chars", "'x' AS changed", "2 AS long")
    out = stage(spark, frame, folder)
    assert out.columns == [*docs.columns, "n_chars", "changed", "long"]
    want = Counter()
    for i, text in rows:
        hit, low = hit_words(text, items)
        if not len(hit) > 0.5 * len(low):
            left = [w for k, w in enumerate(low) if k not in hit]
            want[i, " ".join(left) if hit else text, bool(hit)] += 1
    got = Counter()
    for r in out.collect():
        changed = r.n_chars != 7
        assert (r.changed, r.long) == ("x", 2) and (not changed or r.n_chars == len(r.text))
        got[r.doc_id, " ".join(w.translate(LOWER) for w in WORD.findall(r.text)) if changed else r.text, changed] += 1
    assert got == want and sum(k[2] for k in want) >= 8 and sum(want.values()) < len(rows)


def test_cut_texts_keep_their_writing():
    text = "Keep, this! DROP -- me (now) and \u00c9t\u00e9 stays."
    assert decontaminate.without_words(text, [[2, 5]]) == "Keep, this! ) and \u00c9t\u00e9 stays."
    assert decontaminate.without_words("a b c", [[0, 3]]) == "" and decontaminate.without_words("a b c", [[1, 2]]) == "a c"


def test_secret_stage(spark, docs, folder):
    out = corpus_pipeline.redact_secrets(spark, docs, folder)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t if t is None else redacted(t)) for i, t, *_ in documents())


def test_run(spark, folder):
    """The stages one after the other, each against what it should make of its input; the last one packs all that is left."""
    out = corpus_pipeline.run(spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter(tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in rows.collect())
    pieces = defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    assert Counter(tuple(x for _, ids in sorted(p) for x in ids) for p in pieces.values()) == want and len(out) > 10
    assert max(Counter(r.sequence_id for r in out for _ in r.ids).values()) == 2048


def test_stages_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, empty)
        assert out.columns == docs.columns and out.count() == 0


def test_entry_lists_everything():
    import __spark_entry__ as e

    assert {*q.QUERIES, "pipeline"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def plain_groups(rows):
    """Smallest doc_id of each group by the plain rule, over all pairs."""
    sets, prints = [], []
    for _, text in rows:
        w = words(text, lower=True)
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sets[-1]]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            near = len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4 or (prints[i] ^ prints[j]).bit_count() <= 2
            if near and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return sorted({rows[r][0] for r in root})


@pytest.mark.parametrize("most, pivots, hot", [(1_000_000, 6, 8), (400, 6, 3), (400, 0, 2)])
def test_near_copies(spark, docs, folder, monkeypatch, most, pivots, hot):
    """The stage's groups are those of all pairs by the plain rule, however large groups are taken apart."""
    for name, value in (("MOST_SHINGLES", most), ("PIVOTS", pivots), ("HOT_SETS", hot)):
        monkeypatch.setattr(shingle_sets, name, value)
    monkeypatch.setattr(components, "HOT_ROWS", 20 if most < 1000 else 10_000)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    found = out.collect()
    kept = sorted(r.doc_id for r in found if r.doc_id is not None)
    rows = sorted({(i, t) for i, t, *_ in documents() if i is not None}, key=lambda r: r[0])
    assert kept == plain_groups(rows) and sum(r.doc_id is None for r in found) == 2
    assert not set(kept) & set(range(130, 140))


def test_group_comparison_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 10**9, 60)
    sets = [np.unique(np.concatenate((np.delete(base, rng.integers(0, 60, k % 14)), rng.integers(0, 10**9, k % 9)))) for k in range(80)] + [np.unique(rng.integers(0, 10**9, 50)) for _ in range(20)]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    root = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    assert shingle_sets.join_group(np.concatenate(sets), starts).tolist() == root
