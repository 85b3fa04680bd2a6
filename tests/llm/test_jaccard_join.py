import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from ethospark.llm import common
from ethospark.llm import jaccard_join as J
from ethospark.llm.components import components


def run(spark, texts, **kw):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = J.jaccard_components(df, **kw).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r.component_id for r in rows}, {r.doc_id: r.n_shingles for r in rows}


def near(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("long", [3, 8, 64])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, long):
    """Groups of near copies, shared passages, chains; with a low bound most lists are long ones."""
    monkeypatch.setattr(J, "LONG", long)
    monkeypatch.setattr(J, "PIVOTS", 2)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["The", "the", "THE"]
    make = lambda n: [rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(n)]
    texts, base, passage = {}, make(120), make(30)
    for _ in range(40):
        texts[len(texts)] = " ".join(near(rng, base, rng.choice([0, 1, 2, 3, 4, 5, 6])))
    for _ in range(15):
        texts[len(texts)] = " ".join(make(rng.choice([2, 10])) + passage)
    walk = make(90)
    for _ in range(12):
        walk = near(rng, walk, 2)
        texts[len(texts)] = "\n".join(walk)
    for n in (0, 1, 1, 2, 3, 4, 5):
        texts[len(texts)] = " ".join(["a", "b", "c", "d", "e"][:n])
    expected, sizes = brute.jaccard_components(texts)
    found, n = run(spark, texts)
    assert found == expected and n == sizes
    assert len(set(expected.values())) < len(texts) - 20


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: " \t\n", 4: "one", 5: "ONE", 6: "é One", 7: "word " * 5000, 8: "word " * 4000}
    found, n = run(spark, texts)
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7} and n[1] == 0 and n[7] == 1


def test_null_and_repeated_ids_extra_columns_and_no_rows(spark):
    kind = "doc_id long, text string, id string, key long, n int"
    df = spark.createDataFrame([(None, "a b c d e", "x", 1, 1), (7, "a b c d e", "y", 1, 1), (7, "a b c d e", "y", 1, 1)], kind)
    rows = J.jaccard_components(df).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [(-1, 2, 7), (7, 2, 7), (7, 2, 7)]
    assert J.jaccard_components(spark.createDataFrame([], kind)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(300, 400)]
    df = spark.createDataFrame([(b, a) for a, b in links], "a long, b long")
    found = {r.id: r.component for r in components(df).collect()}
    assert found == {k: (100 if 100 <= k < 200 else 5) for k in [*range(100, 161), 5, *range(300, 400)]}


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 2**63, 300).astype(np.uint64)
    for gone, new in [(0, 0), (1, 0), (5, 7), (40, 40), (300, 300)]:
        two = np.append(one[gone:], rng.integers(0, 2**63, new).astype(np.uint64))
        words = J._parities(np.append(one, two), np.array([0, 300, 300 + len(two), 300 + len(two)]))
        apart = sum(int(w[0] ^ w[1]).bit_count() for w in words)
        assert apart <= gone + new and (gone + new - apart) % 2 == 0
        assert all(w[2] == 0 for w in words)  # an empty set
        assert gone < 40 or apart > 30


def test_classes_read_texts_in_bounded_batches(spark, monkeypatch):
    """Batches of texts are bounded by their bytes, and the session keeps its own setting."""
    docs = spark.range(4000, numPartitions=1).withColumn("text", F.repeat(F.lit("ab cd "), 1000))

    def task(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    before, seen = spark.conf.get(common.BATCH), []
    summaries = J._summaries

    def watched(rows, size):
        seen.extend(r.n for r in rows.mapInArrow(task, "n long").collect())
        return summaries(rows.limit(2), size)

    monkeypatch.setattr(J, "_summaries", watched)
    J.link_classes(docs)
    assert sum(seen) > 4000 * 6000 and max(seen) < 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH) == before
