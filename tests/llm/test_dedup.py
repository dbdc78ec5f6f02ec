import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from fractile.llm import exact, neardup
from fractile.llm.components import components


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[ \t-\r]", "", text or "")].append((doc_id, len(text or "")))
    out = []
    for content, own in groups.items():
        keep = min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        out += [(d, keep, len(own), d == keep, hashlib.sha256(content.encode()).hexdigest()) for d, _ in own]
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_exact_groups(odd_docs, odd_rows):
    got = exact.exact_groups(odd_docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "digest"]
    assert as_rows(got) == exact_by_hand(odd_rows)


def test_exact_groups_of_extreme_ids(spark):
    ids = [2**63 - 1, -(2**63), 0, None, 2**53 + 1]
    rows = [(i, t) for k, i in enumerate(ids) for t in ("all", f"own {k}")] + [(None, "end"), (2**63 - 1, "end"), (-(2**63), "longer"), (2**63 - 1, "long er")]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert as_rows(got) == exact_by_hand(rows)


def test_weak_digest_changes_nothing(odd_docs, odd_rows):
    weak = exact.exact_groups(odd_docs, digest=lambda c: (F.char_length(c) % 3).cast("string"))
    assert [r[:4] for r in as_rows(weak)] == sorted((r[:4] for r in exact_by_hand(odd_rows)), key=repr)


def test_drop_copies(odd_docs, odd_rows):
    got = exact.drop_copies(odd_docs)
    assert got.columns == odd_docs.columns
    stay = {(r[0], r[4]) for r in exact_by_hand(odd_rows) if r[3]}
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted((d for d, _ in stay), key=repr)


def test_drop_copies_of_repeated_ids(spark):
    rows = [(1, "one text"), (1, "another text"), (1, "one  text"), (2, "onetext"), (None, "no name"), (None, "no  name"), (None, "other"), (3, "other"), (3, None), (3, "")]
    want = [(1, "another text"), (1, "one  text"), (3, "other"), (None, "no  name")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for digest in (exact.sha256, lambda c: (F.char_length(c) % 2).cast("string")):
        got = sorted((tuple(r) for r in exact.drop_copies(docs, digest=digest).collect()), key=repr)
        empty = [r for r in got if not r[1]]
        assert [r for r in got if r[1]] == sorted(want, key=repr)
        assert len(empty) == 1 and empty[0][0] == 3


def test_no_rows(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.drop_copies(no_docs).count() == 0
    assert neardup.near_duplicates(no_docs).count() == 0
    assert neardup.drop_near_copies(no_docs).count() == 0


def near_by_hand(rows, width, percent=80):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [(d, shingles(t)) for d, t, *_ in rows]
    up = {d: d for d, _ in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else top(d), d is None or top(d) == d) for d, s in sets), key=repr)


def test_near_duplicates(odd_docs, odd_rows):
    for width in (2, 5):
        got = neardup.near_duplicates(odd_docs, neardup.Similarity(width))
        assert as_rows(got) == near_by_hand(odd_rows, width)


def test_near_copies_that_link_only_through_others(spark, monkeypatch):
    """A large group whose members differ from each other by about the threshold: many components and block sizes matter."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "FULL_BLOCK", 4)
    monkeypatch.setattr(neardup, "CHUNK", 4)
    monkeypatch.setattr(neardup, "TOGETHER", 16)
    monkeypatch.setattr(neardup, "BATCHES_A_TASK", 1)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(80)]
    rows = []
    for d in range(160):
        own = list(base)
        for k in rng.sample(range(80), rng.randrange(0, 9)):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(own)))
    rows += [(500 + d, f"alone {d} " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(30))) for d in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert as_rows(neardup.near_duplicates(docs, neardup.Similarity(2))) == near_by_hand(rows, 2)


def test_long_texts_come_in_small_groups(spark, monkeypatch):
    """Groups are bounded by characters: a limit of two documents' length changes no link."""
    monkeypatch.setattr(neardup, "GROUP_CHARS", 1500)
    rng = random.Random(10)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for d in range(60):
        own = list(base)
        for k in rng.sample(range(90), rng.randrange(0, 9)):
            own[k] = f"x{rng.randrange(10**6)}"
        rows.append((d if d else 2**53 + 1, " ".join(own)))
    rows.append((None, " ".join(base)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), neardup.Similarity(2))
    assert as_rows(got) == near_by_hand(rows, 2)


def test_drop_near_copies(odd_docs, odd_rows):
    got = neardup.drop_near_copies(odd_docs)
    kept = [r[0] for r in near_by_hand(odd_rows, 5) if r[3]]
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted(kept, key=repr)
    assert got.columns == odd_docs.columns


def test_estimates_follow_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for share in (0.3, 0.6, 0.8, 0.95):
        n = 1000
        both = int(2 * n * share / (1 + share))
        errors = []
        for k in range(20):
            p = rng.permutation(pool)
            a, b = p[:n], np.r_[p[:both], p[n : 2 * n - both]]
            sig = [neardup.packed(neardup.minima(x))[None] for x in (a, b)]
            errors.append(float(neardup.estimates(*sig)[0, 0]) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.15


def test_components(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(200)] + [(7, 7), (9000, 9000)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for few in (0, 150, 100_000):  # by rounds alone, by rounds and one task, by one task
        monkeypatch.setattr("fractile.llm.components.FEW", few)
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
