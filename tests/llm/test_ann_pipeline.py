import math

import numpy as np
import pandas as pd

from fractile.llm import ann, mixing, packing, toxicity
from fractile.llm.common import scratch


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i, q in queries:
        s = (x * np.array(q)).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i]
        best = []
        for j in order:
            if ids[j] not in {b[0] for b in best}:
                best.append((int(ids[j]), float(s[j])))
        out[i] = best[:k]
    return out


def test_recall_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 200)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x[500:900] = x[500]  # one vector holds a seventh of all rows
    x[1000] *= 30
    rows = [(int(k), [float(np.float32(v)) for v in row]) for k, row in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), 20, sample=1500).collect()
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 20)
    found = {q: [(r["vec_id"], r["score"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want}
    assert all([r[2] for r in own] == list(range(1, 21)) for own in found.values())
    hits = sum(len({v for v, _, _ in found[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    true = dict(rows)
    for q, own in found.items():
        for v, s, _ in own:
            assert math.isclose(s, float(np.dot(np.array(true[q]), np.array(true[v]))), rel_tol=1e-12, abs_tol=1e-12)
        assert [(-s, v) for v, s, _ in own] == sorted((-s, v) for v, s, _ in own)
    assert [v for v, _, _ in found[600]][:1] and all(v not in (600,) for v, _, _ in found[600])


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.9, 0.1], 2), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (None, [1.0, 1.0], 0), (9, [1.0, 2.0, 3.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ann.nearest(table, table.where("vec_id % 20 = 0"), 20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]
    assert ann.nearest(table.limit(0), table, 20).count() == 0


def test_queries_of_another_length(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)]
    asked = [(0, [1.0, 2.0, 3.0]), (20, [1.0, 2.0]), (40, [1.0, 2.0]), (60, [1.0, 2.0])]  # most queries are of another length
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "vec_id long, embedding array<double>"), 5).collect()
    assert {r["query_id"] for r in got} == {0} and len(got) == 5


def test_few_parts_are_visited_where_vectors_cluster(spark):
    """True neighbours by one scan, and recall by brute force, on queries outside of the sample."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 24))).astype(np.float32).astype(float)
    rows = [(int(k), row.tolist()) for k, row in enumerate(x)]
    table = scratch(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), "vectors")
    top = float(np.linalg.norm(x, axis=1).max())
    fitted = np.arange(1, 3000, 2)
    router = ann.train_router(x[fitted], top, 16)
    placed = ann.valid_vectors(table).toPandas()
    placed["part"] = router.part_of(np.stack(placed["vector"].to_list()))
    frame = scratch(spark.createDataFrame(placed, "vec_id long, vector array<double>, part long").repartition(3), "placed")
    tests = np.arange(0, 3000, 100)
    near = ann.true_parts(frame, tests, x[tests], 10)
    part_of = dict(zip(placed["vec_id"], placed["part"]))
    want = brute([r for r in rows], [rows[t] for t in tests[:20]], 10)
    for j, t in enumerate(tests[:20]):
        assert sorted(near[near["test"] == j]["part"]) == sorted(part_of[v] for v, _ in want[int(t)])
    asked = ann.valid_vectors(table.where("vec_id % 20 = 0")).withColumnRenamed("vec_id", "query_id")
    probes, share = ann.visit(router, frame, asked, fitted, 20, 0.95)
    assert probes <= 4 and share >= 0.95
    got = ann.nearest(table, table.where("vec_id % 100 = 0"), 20, sample=2000)
    got = got.groupBy("query_id").agg({"vec_id": "collect_set"}).toPandas()
    want = brute(rows, [rows[t] for t in tests], 20)
    hits = sum(len({v for v, _ in want[q]} & set(own)) for q, own in zip(got["query_id"], got.iloc[:, 1]))
    assert hits / (20 * len(tests)) >= 0.9


def test_repeated_rows_leave_room_for_other_ids():
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + 0.2 * rng.normal(size=(60, 8))
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]
    hot = max(rows[1:], key=lambda r: float(np.dot(r[1], x[0])))
    rows += [(hot[0], [v * (1 + 1e-6 * j) for v in hot[1]]) for j in range(1, 41)]  # over 20 rows of the nearest id
    rows += rows[:60]
    asked = [r for r in rows[:60] if r[0] % 20 == 0]
    got = ann._nearest(pd.DataFrame(rows, columns=["vec_id", "vector"]), pd.DataFrame(asked, columns=["query_id", "vector"]), 20)
    for q, own in brute(rows, asked, 20).items():
        assert got[got["query_id"] == q]["vec_id"].tolist() == [v for v, _ in own]


def test_repeats_do_not_set_the_probes(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(rng.normal(size=(600, 12)))]
    table = spark.createDataFrame(rows * 25, "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(table, table.where("vec_id % 20 = 0").dropDuplicates(["vec_id"]), 20, sample=600).collect()
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    hits = sum(len({r["vec_id"] for r in got if r["query_id"] == q} & {v for v, _ in own}) for q, own in want.items())
    assert hits / (20 * len(want)) >= 0.9


def test_parts_are_balanced():
    x = np.random.default_rng(3).normal(size=(900, 8))
    labels = ann.balanced_parts(ann.neighbour_graph(x, 8), 8)
    counts = np.bincount(labels)
    assert len(counts) == 8 and counts.max() - counts.min() <= 7
    graph = ann.neighbour_graph(x, 8)
    assert (labels[graph] == labels[:, None]).mean() > 0.25  # 0.125 by chance


def test_pipeline(spark):
    """Each stage's rows against a plain computation over what it was given."""
    from collections import Counter

    import corpus_pipeline as p
    from tests.llm.test_dedup import exact_by_hand, near_by_hand

    sf = "/root/testdata/sf0.001"
    assert [k for k, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(p.STAGES)
    rows = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]

    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, toxicity.train_on(spark, docs, sf)).collect()}
    out = scratch(stages["toxicity"](spark, docs, sf), "t1")
    assert out.columns == docs.columns and {r[0] for r in rows(out)} == {d for d, s in scores.items() if s < toxicity.THRESHOLD}

    given, out = rows(out), scratch(stages["exact_dedup"](spark, out, sf), "t2")
    assert out.columns == docs.columns and sorted(r[0] for r in rows(out)) == sorted(r[0] for r in exact_by_hand(given) if r[3])

    given, out = rows(out), scratch(stages["near_dedup"](spark, out, sf), "t3")
    assert out.columns == docs.columns and sorted(r[0] for r in rows(out)) == sorted(r[0] for r in near_by_hand(given, 5) if r[3])

    given, due = rows(out), {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(out).collect()}
    out = scratch(stages["mixing"](spark, out, sf), "t4")
    copies = Counter(r[0] for r in rows(out))
    assert out.columns == docs.columns and set(copies) <= {r[0] for r in given} and max(copies.values()) <= 2
    partly = [d for d, (taken, size) in due.items() if size and taken % size]  # a source's boundary document, whole or not
    assert all(copies[d] * size == taken for d, (taken, size) in due.items() if d not in partly and size) and len(partly) <= len({r[2] for r in given})

    given, got = rows(out), stages["packing"](spark, out, sf).collect()
    encoded = {d: len(packing.encode_documents([t or ""], packing.default_tokenizer())[0]) for d, t, _ in given}
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == {d: n * copies[d] for d, n in encoded.items()}

    ran = p.run(spark, sf)
    assert ran.count() == len(got) and ran.columns == list(stages["packing"](spark, out, sf).columns)


def test_queries_import_and_match_their_sql_names():
    from fractile.llm.queries import oracle_sql, queries

    names = list(queries())
    assert len(names) == 10 and all(n.startswith("op") for n in names)
    assert set(oracle_sql()) <= set(names)
