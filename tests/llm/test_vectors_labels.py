"""Operators 11, 12 and 13."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm import curve, mining, toxic
from ratingloom.llm.asking import Best
from ratingloom.llm.rows import table


def embedded(spark, rows):
    """Rows of id, vector and label, with columns whose names clash."""
    df = spark.createDataFrame(
        [(i, None if v is None else list(v), c) for i, v, c in rows], "vec_id long, embedding array<double>, label int"
    )
    return df.withColumn("cluster", F.lit("x")).withColumn("score", F.lit(1)).withColumn("parts", F.lit(None).cast("string"))


def whole(v, scale, most):
    return [int(np.floor(min(max(float(x) * scale, -most), most))) for x in v]


def fine(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


# Operator 11


def brute_clusters(rows, count, rounds, width):
    kept = [(i, whole(v, 256, 1 << 27)) for i, v, _ in rows if fine(v) and len(v) == width]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    sums = {}
    for d, n in found:
        sums[n] = sums.get(n, 0) + d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sums[n], sum(sums.values()), names[n]) for (i, _), (d, n) in zip(kept, found)), key=str)


def clustered(df, **more):
    return sorted(map(tuple, curve.cluster(df, **more).drop("compared").collect()), key=str)


def test_clusters_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 6))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.2, 6)).round(2).tolist(), 0) for i in range(500)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)]
    df = embedded(spark, rows)
    for block in (16, 250):
        assert clustered(df, count=12, rounds=3, width=6, block=block) == brute_clusters(rows, 12, 3, 6)
    assert curve.cluster(df, count=12, rounds=3, width=6, block=16).agg(F.avg("compared")).first()[0] < 8


def test_clusters_of_odd_rows(spark):
    rows = [(1, None, 1), (2, [1.0], 1), (3, [float("nan"), 0.0], 1), (4, [None, 0.0], 1), (5, [float("inf"), 0.0], 1), (6, [], 1),
            (None, [3.0, 4.0], 1), (None, [3.0, 4.0], None), (7, [0.0, 0.0], 1), (7, [0.0, 0.0], 1), (7, [1.0, 1.0], 1),
            (8, [1e300, -1e300], 1), (9, [0.5, 0.5], 1), (10, [0.5, 0.5], 1)]
    df = embedded(spark, rows)
    assert clustered(df, count=3, rounds=2, width=2) == brute_clusters(rows, 3, 2, 2)
    assert clustered(df, count=40, rounds=2, width=2) == brute_clusters(rows, 40, 2, 2)
    assert clustered(df.limit(0), width=2) == []
    assert clustered(df) == []


def test_neighbours_on_the_curve_touch():
    for width, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=width)))
        keys = [k.tobytes() for k in curve.hilbert_keys(cells, bits)]
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert len(set(keys)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_a_box_keeps_every_nearest_centroid():
    rng = np.random.default_rng(2)
    centroids = rng.integers(-50, 50, (20, 3))
    low = rng.integers(-60, 50, (40, 3))
    high = low + rng.integers(0, 12, (40, 3))
    could = curve.candidates(low, high, centroids)
    assert could.mean() < 0.5
    for a, b, c in zip(low, high, could):
        points = rng.integers(a, b + 1, (200, 3))
        far = ((points[:, None] - centroids) ** 2).sum(2)
        assert c[np.flatnonzero((far == far.min(1, keepdims=True)).any(0))].all()


# Operator 13


def brute_negatives(rows, modulus, positives, per):
    kept = [(i, (c + 1) % 10 if i % 7 == 0 else c, whole(v, 256, 1 << 24)) for i, v, c in rows
            if i is not None and c is not None and fine(v)]
    anchors = {}
    for i, c, v in kept:
        if i % modulus == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in kept if i != a)
        near = [(i, -s) for s, i, c in scored if c == label][:positives]
        for i, s in near:
            hard = [(j, -t) for t, j, c in scored if c != label and 50 * s <= -100 * t <= 95 * s]
            out += [(a, i, n + 1, j, s, t) for n, (j, t) in enumerate(hard[:per])]
    return sorted(out)


@pytest.mark.parametrize("passes", [1 << 25, 2000])
def test_negatives_agree_with_brute_force(spark, monkeypatch, passes):
    monkeypatch.setattr(mining.in_passes, "__defaults__", (passes,))
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) + 0.7).round(1).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(400 + i, rows[8][1], 1) for i in range(60)] + [(470 + i, rows[16][1], 2) for i in range(20)]
    found = sorted(map(tuple, mining.hard_negatives(embedded(spark, rows), modulus=8).collect()))
    want = brute_negatives(rows, 8, 5, 3)
    assert found == want and len({r[5] for r in want}) > 30


def test_negatives_of_odd_rows(spark):
    rows = [(None, [1.0, 1.0], 1), (50, None, 1), (100, [1.0, None], 1), (150, [float("inf"), 1.0], 1), (200, [1.0, 1.0], None),
            (250, [1.0, 1.0], 1), (250, [1.0, 1.0], 2), (251, [0.8, 1.0], 1), (252, [0.7, 0.6], 2), (253, [0.7, 0.6], 3),
            (253, [0.7, 0.6], 3), (300, [], 1), (349, [1.0], 1), (400, [-1.0, -1.0], 1), (450, [1e300, 0.1], 4), (451, [1e300], 4),
            (452, [1e300, -1e300], 5), (500, [0.0, 0.0], 7)]
    df = embedded(spark, rows)
    assert sorted(map(tuple, mining.hard_negatives(df).collect())) == brute_negatives(rows, 50, 5, 3)
    assert mining.hard_negatives(df.limit(0)).count() == 0


def test_suffixes_of_slots_answer_overlapping_windows():
    rng = np.random.default_rng(4)
    for _ in range(50):
        limits = np.sort(rng.integers(0, 60, 5))[::-1]
        scores = rng.integers(0, 60, 200)
        best = Best(5, 3)
        inside = np.flatnonzero(scores <= limits[0])
        slot = mining.slots_of(np.zeros(len(inside), int), scores[inside], limits[None])
        best.add(slot, inside, scores[inside])
        slots = [[] for _ in limits]
        for s, i, v in zip(best.group.tolist(), best.ids.tolist(), best.scores.tolist()):
            slots[s].append((-v, i))
        for k, found in enumerate(mining.merged_slots(slots, 3)):
            assert found == sorted((-int(scores[i]), i) for i in range(200) if scores[i] <= limits[k])[:3]


# Operator 12


def enumerated(unary, opens, moves):
    """Marginals, moves and partition by listing every labelling."""
    n, weights = len(unary), {}
    for states in itertools.product((0, 1), repeat=n):
        total = sum(u for u, s in zip(unary, states) if s)
        for t, s in enumerate(states):
            total += moves[s] if opens[t] else moves[2 + 2 * states[t - 1] + s]
        weights[states] = np.exp(total)
    every = sum(weights.values())
    one = [sum(w for s, w in weights.items() if s[t]) / every for t in range(n)]
    pair = [[0 if opens[t] else sum(w for s, w in weights.items() if (s[t - 1], s[t]) == m) / every
             for m in itertools.product((0, 1), repeat=2)] for t in range(n)]
    return np.array(one), np.array(pair), np.log(every)


def test_marginals_agree_with_all_labellings():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 10):
        unary, moves = rng.normal(0, 2, n), rng.normal(0, 1, 6)
        opens = rng.random(n) < 0.3
        opens[0] = True
        one, pair, total = toxic.chain(unary, opens, moves)
        want = enumerated(unary, opens, moves)
        assert np.allclose(one, want[0]) and np.isclose(total, want[2])
        assert np.allclose(pair[~opens], want[1][~opens])


def test_long_chains_and_extreme_weights():
    rng = np.random.default_rng(6)
    unary, opens = rng.normal(0, 3, 5000), rng.random(5000) < 0.01
    opens[0] = True
    moves = np.array([0.3, -1.0, 0.5, -2.0, 0.1, 0.4])
    one, _, _ = toxic.chain(unary, opens, moves)
    cuts = np.append(np.flatnonzero(opens), 5000)
    each = [toxic.chain(unary[a:b], opens[a:b], moves)[0] for a, b in zip(cuts, cuts[1:])]
    assert np.allclose(one, np.concatenate(each))
    steep = toxic.chain(np.array([1e4, -1e4, 1e4]), np.array([True, False, False]), moves)
    assert np.allclose(steep[0], [1, 0, 1]) and np.isfinite(steep[2])


def test_slopes_agree_with_differences():
    rng = np.random.default_rng(7)
    texts = [b"ab cd ef ab", b"cd", b"gh ab cd gh ef"]
    tokens = toxic.Tokens(texts)
    places = tokens.evidence() % 40
    labels = rng.random(len(tokens.starts)) < 0.4
    table, moves = rng.normal(0, 1, 40), rng.normal(0, 1, 6)
    _, by_table, by_moves = toxic.slopes(tokens.opens, places, labels, table, moves)
    for weights, slope in ((table, by_table), (moves, by_moves)):
        for k in range(len(weights)):
            weights[k] += 1e-5
            up = toxic.slopes(tokens.opens, places, labels, table, moves)[0]
            weights[k] -= 2e-5
            down = toxic.slopes(tokens.opens, places, labels, table, moves)[0]
            weights[k] += 1e-5
            assert np.isclose((up - down) / 2e-5, slope[k], atol=1e-5)


def test_tokens_and_places():
    texts = ["Ein ÄRGER, x1y!", "", "…ärger ärgerlich", "12 34"]
    tokens = toxic.Tokens([t.encode() for t in texts])
    assert tokens.counts.tolist() == [4, 0, 2, 0]
    start, end = tokens.places(np.arange(6))
    found = [texts[o][a:b] for o, a, b in zip(tokens.owner.tolist(), start.tolist(), end.tolist())]
    assert found[:4] == ["Ein", "ÄRGER", "x", "y"]
    assert found[5] == "ärgerlich"
    # The same word in capitals; a beginning that both share; no evidence from another text.
    assert tokens.keys[0][1] != tokens.keys[0][5] and tokens.keys[-1][1] == tokens.keys[-1][5]
    alone = toxic.Tokens([texts[2].encode()])
    assert (tokens.evidence()[:, 4:] == alone.evidence()).all()


def test_spans_end_with_their_text():
    tokens = toxic.Tokens([b"a bad", b"bad c bad bad"])
    spans = toxic.offending(tokens, np.array([0.1, 0.9, 0.8, 0.2, 0.6, 0.7]))
    assert spans == [[{"start": 2, "end": 5, "probability": 0.9}],
                     [{"start": 0, "end": 3, "probability": 0.8}, {"start": 6, "end": 13, "probability": 0.7}]]


def synthetic(spark, n=600):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame", "tek") for b in ("um", "or", "et", "ia", "on")]
    rows, labels = [], []
    for i in range(n):
        text = rng.choice(words, rng.integers(20, 120)).tolist()
        bad = i % 4 == 0
        if bad:
            for at in rng.integers(0, len(text), 3):
                text[at] = "grumk" + str(rng.choice(list("abcdefgh"))) * 2
        rows.append((i, " ".join(text), "en", i, "clash"))
        labels.append((i, 1, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, spans string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_spans_are_found_in_held_out_documents(spark):
    documents, labels = synthetic(spark)
    found = toxic.classify(documents, labels).collect()
    assert {r["held_out"] for r in found} == {True, False}
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1
        words = {w for s in r["spans"] for w in r["text"][s["start"] : s["end"]].split()}
        assert words == {w for w in r["text"].split() if w.startswith("grumk")}


def test_toxicity_of_given_held_out_documents(spark, sf):
    folder = sf.replace("sf0.001", "sf0.01")
    judged = toxic.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    held = judged.filter("held_out").join(table(spark, folder, "labels"), "doc_id").filter("toxic is not null")
    right = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right >= 0.95


def test_toxicity_of_odd_rows(spark, odd_documents, no_documents):
    documents, labels = synthetic(spark, 200)
    model = toxic.train(documents, labels)
    found = toxic.score(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert found[0].asDict().keys() >= {"doc_id", "shard", "n_words", "spans", "held_out", "predicted"}
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values()) and by_text[None] == by_text[""]
    assert toxic.score(no_documents, model).count() == 0
    odd = spark.createDataFrame([(1, 1, 1), (None, 1, 0), (2, None, None), (3, 0, 0), (3, 0, 1)], labels.schema)
    assert toxic.classify(odd_documents, odd).count() == len(found)
    assert {r["score"] for r in toxic.classify(odd_documents, odd.limit(0)).collect()} == {0.5}  # nothing is known


def test_scores_do_not_depend_on_the_other_texts():
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["aaaa", "bbbbbb", "cc", "ddddd"], n)).encode() for n in (3, 5000, 0, 40)]
    model = toxic.Model(rng.normal(0, 1, toxic.TABLE), rng.normal(0, 1, 6), rng.normal(0, 1, 5))
    together = toxic.Tokens(texts)
    scores = model.score(together, model.marginals(together))
    for text, score in zip(texts, scores):
        alone = toxic.Tokens([text])
        assert np.isclose(model.score(alone, model.marginals(alone))[0], score)
