import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("doclake.llm.spans")
from doclake.llm import fingerprints as P
from doclake.llm import spans as S

SCHEMA = "doc_id bigint, text string, seg string"


def brute(docs, span):
    held = {}
    for i, s in docs:
        for k in range(len(s or "") - span + 1):
            held.setdefault(s[k : k + span], set()).add(i)
    out = {}
    for i, s in docs:
        cover = set()
        for k in range(len(s or "") - span + 1):
            if i is not None and len(held[s[k : k + span]] - {None}) > 1:
                cover.update(range(k, k + span))
        if cover:
            out[i] = len(cover)
    return out


def found(df):
    return {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("start_at")).alias("n")).collect()}


def corpus(rnd, n):
    alphabet = "abcd 汉🙂\n"
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    shared = [word(rnd.randrange(15, 120)) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            parts.append(word(rnd.randrange(0, 60)))
            if rnd.random() < 0.5:
                s = rnd.choice(shared)
                a = rnd.randrange(0, len(s) // 2)
                parts.append(s[a : a + rnd.randrange(10, 120)])
        docs.append((i, "".join(parts)))
    docs += [(1000, "-" * 90), (1001, "x" + "-" * 70), (1002, "-" * 20), (1003, ""), (1004, None), (1005, docs[0][1]), (1006, docs[0][1]), (1007, "ab" * 60), (1008, "ba" * 60)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(random.Random(seed), 60)
    span, gram = 20, 9
    df = spark.createDataFrame([(*d, "clash") for d in docs], SCHEMA)
    index = S.SpanIndex(spark, span, gram, buckets=3, fan_out=2)
    for lo in range(0, len(docs), 25):  # three batches: the first two are compacted
        index.add(spark.createDataFrame([(*d, None) for d in docs[lo : lo + 25]], SCHEMA))
    assert [level for level, _, _ in index.runs] == [1, 0]
    assert found(index.shared()) == brute(docs, span)
    one = S.SpanIndex(spark, span, gram, buckets=3)
    one.add(df)
    assert found(one.shared()) == brute(docs, span)


def test_stretches_and_repeated_rows(spark):
    a, b = "".join(random.Random(7).choice("abcdefgh") for _ in range(60)), "".join(random.Random(8).choice("ijklmnop") for _ in range(60))
    docs = [(1, a + b), (1, a + b), (2, "--" + a + "++" + b), (None, a), (3, "zz")]
    index = S.SpanIndex(spark, 30, 12, buckets=2)
    index.add(spark.createDataFrame([(*d, None) for d in docs], SCHEMA))
    got = sorted(map(tuple, index.shared().select("doc_id", "start_at", "end_at").collect()))
    assert got == [(1, 0, 120), (2, 2, 62), (2, 64, 124)]


def test_no_documents(spark):
    index = S.SpanIndex(spark, 30, 12, buckets=2)
    index.add(spark.createDataFrame([], SCHEMA))
    assert index.shared().count() == 0


def test_every_window_is_in_one_segment():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab汉🙂") for _ in range(n)) for n in (50, 20, 19, 400, 21)]
    owner, start, count, fp, seg = P.segments(texts, 20, 8)
    seen = [(o, s + k) for o, s, c in zip(owner, start, count) for k in range(c)]
    assert sorted(seen) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 19)]


def test_boilerplate_in_a_tenth_of_the_documents(spark):
    """One text stands in every tenth document of three batches; it costs its distinct segments, and all have it."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    boiler = word(300)
    docs = [(i, word(150) + (boiler if i % 10 == 0 else "") + word(80)) for i in range(900)]
    index = S.SpanIndex(spark, 60, 25, buckets=3, fan_out=2)
    for k in range(3):
        index.add(spark.createDataFrame([(*d, None) for d in docs[k::3]], SCHEMA))
    assert sorted(level for level, _, _ in index.runs) == [0, 1]
    got = {r.doc_id: (r.start_at, r.end_at) for r in index.shared().collect()}
    assert set(got) == set(range(0, 900, 10)) and all(a <= 150 and b >= 450 and b - a < 310 for a, b in got.values())
    hits = spark.read.schema(index.schema).parquet(*index.hits)
    assert hits.count() == hits.distinct().count()  # nothing of the history is read into the hits again


def test_compaction_moves_no_rows(spark):
    index = S.SpanIndex(spark, 30, 12, buckets=2, fan_out=9)
    for k in range(2):
        index.add(spark.createDataFrame([(k, "".join(random.Random(k).choice("abcdef") for _ in range(400)), None)], SCHEMA))
    merged = index._all(index.runs).groupBy("fp", "seg", "doc_id", "start_at").agg(F.max("windows"))
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()


def test_an_index_that_outlives_the_session(spark, tmp_path):
    docs = corpus(random.Random(5), 40)
    folder = f"file://{tmp_path}/index"
    index = S.SpanIndex(spark, 20, 9, fan_out=2, buckets=3, folder=folder)
    for part in (docs[:15], docs[15:30]):
        index.add(spark.createDataFrame([(*d, None) for d in part], SCHEMA))
    again = S.SpanIndex.open(spark, folder)
    again.add(spark.createDataFrame([(*d, None) for d in docs[30:]], SCHEMA))
    assert found(again.shared(spark.createDataFrame([(*d, None) for d in docs], SCHEMA))) == brute(docs, 20)


def test_texts_of_regular_structure():
    """Two different texts on which sums over powers of an odd number modulo 2**64 agree."""
    import numpy as np

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4_096))
    b = a.translate(str.maketrans("ab", "ba"))
    one, two = (P.Exact.windows(np.frombuffer(s.encode("utf-32-le"), np.uint32), 4_096) for s in (a, b))
    assert one[0] != two[0]


def test_exact_hashes_by_definition():
    import numpy as np

    rng = np.random.default_rng(4)
    codes = rng.integers(0, 3, 70_000).astype(np.uint32)
    got = P.Exact.windows(codes, 8)
    held = {}
    for k, h in enumerate(got.tolist()):
        assert held.setdefault(tuple(codes[k : k + 8]), h) == h
    assert len(set(held.values())) == len(held)
