"""Operators 5, 6, 8, 9, 10 against brute force on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ratingloom.llm import bloom_lm, mixing, ngram_join, quality, repeats, words
from ratingloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near_copies(spark, seed=5, groups=(60, 5, 2), extra=30):
    """Groups of near copies, documents that only share a passage, and others."""
    rng = np.random.default_rng(seed)
    def fresh(n):
        return [f"x{rng.integers(1_000_000)}" for _ in range(n)]
    rows, passage = [], fresh(70)
    for size in groups:
        base = fresh(200)
        for _ in range(size):
            copy = list(base)
            for at in rng.integers(0, 200, rng.integers(0, 6)):
                copy[at] = fresh(1)[0]
            rows.append(copy)
    rows += [fresh(50) + passage + fresh(150) for _ in range(extra)] + [fresh(n) for n in (1, 2, 3, 4, 5, 90)]
    rows += [rows[0], rows[-1]]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([(i, " ".join(rows[k])) for i, k in enumerate(order.tolist())], "doc_id long, text string")


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = {i: i for i, _ in rows if i is not None}
    pairs = [
        (rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a)
        if None not in (rows[a][0], rows[b][0]) and sets[a] and sets[b]
        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((i, len(s), label.get(i)) for (i, _), s in zip(rows, sets)), key=str)


@pytest.mark.parametrize("short,tile", [(32, 256), (3, 256), (3, 16)])
def test_join_agrees_with_brute_force(spark, monkeypatch, short, tile):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    df = near_copies(spark)
    found = sorted(map(tuple, ngram_join.join(df).collect()), key=str)
    assert found == brute_components([tuple(r) for r in df.collect()], 4, 85)


def test_join_without_short_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 1)
    df = near_copies(spark, 6, (12, 4), 8)
    found = sorted(map(tuple, ngram_join.join(df, 5, 80).collect()), key=str)
    assert found == brute_components([tuple(r) for r in df.collect()], 5, 80)


def test_join_odd_rows(odd_documents, no_documents):
    found = sorted(map(tuple, ngram_join.join(odd_documents).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found == brute_components(rows, 4, 85)
    assert ngram_join.join(no_documents).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    links += [(5000, i) for i in range(4900, 4990)] + [(None, 3), (7, 7)]
    label = {}
    for a, b in links:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in links:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == label


def test_word_numbers():
    import pandas as pd

    texts = pd.Series(["a b\tc\x0bé", None, "", "  A b ", "b"])
    found = list(words.word_arrays(texts, lower=True))
    assert [len(f) for f in found] == [4, 0, 0, 2, 1]
    assert found[0][0] == found[3][0] and found[0][1] == found[3][1] == found[4][0]
    assert list(words.word_arrays(texts, lower=False))[3][0] != found[0][0]


def brute_repeats(rows, window):
    first = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_agree_with_brute_force(spark, hot):
    rng = np.random.default_rng(8)
    few = [f"t{i}" for i in range(3)]
    passage = [f"p{i}" for i in range(80)]
    rows = []
    for i in range(40):
        body = [f"u{rng.integers(10**6)}" for _ in range(rng.integers(0, 90))]
        at = int(rng.integers(0, len(body) + 1))
        piece = passage[int(rng.integers(0, 30)) : int(rng.integers(50, 81))] if i % 3 else [few[0]] * int(rng.integers(0, 130))
        rows.append((int(i), " ".join(body[:at] + piece + body[at:])))
    rows.append((40, rows[7][1]))
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    assert removed(found) == brute_repeats(rows, 50)


@pytest.mark.parametrize("hot", [4096, 20])
def test_one_passage_in_a_third_of_the_documents(spark, hot):
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(300):
        body = [f"u{rng.integers(10**9)}" for _ in range(60)]
        at = int(rng.integers(0, 61))
        rows.append((i, " ".join(body[:at] + (passage if i % 3 == 0 else []) + body[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(repeats.remove_repeats(docs, hot=hot)) == brute_repeats(rows, 50)
    lines = [r.repeats for r in repeats.repeated_runs(docs, hot=hot).collect()]
    # A row per run, not per window: each of the 99 later documents repeats 21 windows.
    assert len(lines) == 99 and sum(map(len, lines)) < 99 * 4


def test_common_anchor_of_windows_that_few_documents_share(spark):
    # All documents have the same forty words, two of them the same eighty: most parts hold no later copy of a window.
    rng = np.random.default_rng(14)
    common = [f"p{i}" for i in range(40)]
    around = [f"q{i}" for i in range(40)]
    rows = []
    for i in range(6):
        body = [f"u{rng.integers(10**9)}" for _ in range(60)]
        rows.append((i, " ".join(body[:30] + (around[:20] + common + around[20:] if i < 2 else common) + body[30:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = removed(repeats.remove_repeats(docs, hot=2))
    assert found == brute_repeats(rows, 50) and sum(row[2] for row in found) == 80


def test_slices_fill_the_buckets_evenly(spark):
    rng = np.random.default_rng(15)
    passages = [" ".join(f"p{rng.integers(10**9)}" for _ in range(60)) for _ in range(400)]
    docs = spark.createDataFrame([(i, passages[i % 400] + f" u{i}") for i in range(800)], "doc_id long, text string")
    wanted = spark.createDataFrame([
        (i, [int(a) for a in np.unique(repeats.anchors_of(next(words.word_arrays([passages[i % 400]], False)), 50)).view(np.int64)])
        for i in range(800)
    ], "doc_id long, anchors array<long>").selectExpr("*", "transform(anchors, a -> 2L) as held")
    chosen = docs.selectExpr("doc_id", "xxhash64(text) as text_hash", "text").join(wanted, "doc_id")
    sent = repeats._suffixes(chosen, 50, 16, 1, 1024).selectExpr("bucket", "length(words) as n").groupBy("bucket").sum("n").collect()
    sizes = [row[1] for row in sent]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16


def brute_depths(slices, documents, window):
    """For every suffix how many words it shares at most with one of a smaller document, from the window on."""
    out = []
    for a, own in zip(slices, documents):
        for p in range(len(a) - window + 1):
            best = 0
            for b, other in zip(slices, documents):
                for q in range(len(b) - window + 1) if other < own else ():
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    best = max(best, n if n >= window else 0)
            out.append(best)
    return out


def test_subtrees_give_maximal_repeats():
    rng = np.random.default_rng(13)
    for letters, window in ((2, 4), (3, 3), (30, 3)):
        slices = [rng.integers(0, letters, rng.integers(1, 25)).astype(np.uint64) for _ in range(12)]
        slices[5] = np.concatenate((slices[2], slices[3]))
        documents = np.array([4, 4, 9, 1, 7, 7, 2, 9, 3, 1, 5, 6])
        tree = repeats.Subtree(np.concatenate(slices), np.array([len(s) for s in slices]), window)
        depth = tree.repeats(documents)
        assert depth.tolist() == brute_depths(slices, documents, window)
        chosen = tree.maximal(depth)
        runs = [(tree.slice[k], tree.place[k], tree.place[k] + depth[k]) for k in chosen]
        # None lies in another one, and together they cover what all suffixes cover.
        assert not any(a != b and a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2] for a in runs for b in runs)
        every = {(s, w) for s, p, d in zip(tree.slice, tree.place, depth) for w in range(p, p + d)}
        assert {(s, w) for s, a, b in runs for w in range(a, b)} == every


def test_cut_texts_keep_white_space(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(1, shared), (2, f"First line.\n\n\tSecond  one\n{shared}\nlast\n")]
    found = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), spaces=True).orderBy("doc_id").collect()
    assert [r.kept for r in found] == [shared, "First line.\n\n\tSecond  one\nlast"]


def test_repeats_odd_rows(odd_documents, no_documents):
    found = repeats.remove_repeats(odd_documents)
    assert found.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == brute_repeats(rows, 50)
    assert repeats.remove_repeats(no_documents).count() == 0


def brute_lm(rows, mu=4.0):
    texts = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, WORD.findall((t or "").translate(LOWER)) + ["</s>"]) for i, t in rows]
    one = Counter(w for _, out, t in texts if not out for w in t)
    two = Counter(p for _, out, t in texts if not out for p in zip(["<s>"] + t, t))
    n, v = sum(one.values()), len(one)
    result = []
    for i, out, t in texts:
        base = [math.log10((one[w] + 1) / (n + v + 1)) for w in t]
        total = 0.0
        for u, w, b in zip(["<s>"] + t, t, base):
            context = one["</s>"] if u == "<s>" else one[u]
            level = two[u, w].bit_length()
            known = min(float(bloom_lm.LEVEL_COUNTS[level]), context)
            total += math.log10((known + mu * 10**b) / (context + mu))
        result.append((i, out, len(t), sum(one[w] > 0 for w in t), n, sum(base), total))
    return sorted(result, key=str)


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_language_model(spark, documents, odd_documents, no_documents, most):
    for df in (documents, odd_documents):
        found = sorted(map(tuple, bloom_lm.score(df, broadcast_bytes=most).collect()), key=str)
        wanted = brute_lm([(r.doc_id, r.text) for r in df.collect()])
        assert [f[:5] for f in found] == [w[:5] for w in wanted]
        assert np.allclose([f[5] for f in found], [w[5] for w in wanted])
        # False positives of the filter raise some scores a little.
        per_token = np.array([(f[6] - w[6]) / w[2] for f, w in zip(found, wanted)])
        assert (per_token > -1e-9).all() and per_token.mean() < 0.02
    assert bloom_lm.score(no_documents, broadcast_bytes=most).count() == 0


def test_model_beats_the_base_on_held_out_texts(documents):
    rows = bloom_lm.score(documents).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_filter_never_forgets():
    rng = np.random.default_rng(1)
    numbers = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    counts = rng.geometric(0.3, len(numbers))
    levels = bloom_lm.probe_slice(numbers, bloom_lm.build_slice(numbers, counts))
    exact = bloom_lm.levels_of(counts)
    assert (levels >= exact).all() and (levels == exact).mean() > 0.99
    others = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    assert (bloom_lm.probe_slice(others, bloom_lm.build_slice(numbers, counts)) > 0).mean() < 0.01


def check_mix(df):
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        level = (1.5 * total - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        target = 2 * size[s] if s in capped else weight[s] * level
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and r.source_size == size[s] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target) <= 64 + 0.01 * target
    return sorted((r.doc_id or 0, r["size"], r.taken) for r in rows)


def test_levels_follow_large_counts():
    counts = np.array([1, 2**23, 2**24, 50_000_000, 2**31, 2**40, 2**50])
    numbers = words.mix(np.arange(len(counts), dtype=np.uint64))
    levels = bloom_lm.probe_slice(numbers, bloom_lm.build_slice(numbers, counts))
    read = bloom_lm.LEVEL_COUNTS[levels]
    assert (levels == bloom_lm.levels_of(counts)).all()
    assert (np.abs(np.log2(read / counts)) <= 0.5 + 1e-9).all()


def test_mix_meets_targets(documents, odd_documents, no_documents):
    assert check_mix(documents) == check_mix(documents.repartition(3))
    check_mix(odd_documents)
    assert mixing.mix(no_documents).count() == 0


def test_highest_quotients(spark):
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for g in range(12):
        votes = [float(v) for v in rng.integers(0, 1000, rng.integers(1, 9))]
        if g == 3:
            votes = [100_000.0] + [10.0 + i for i in range(60)]
        seats = int(rng.integers(0, 300))
        won = [0] * len(votes)
        for _ in range(seats if sum(votes) else 0):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        rows += [(g, k, v, seats) for k, v in enumerate(votes)]
        wanted |= {(g, k): n for k, n in enumerate(won)}
    df = spark.createDataFrame(rows, "g int, k int, v double, seats long")
    found = mixing.sainte_lague(df, ["g"], ["k"], "v", "seats", "won").collect()
    assert {(r.g, r.k): r.won for r in found} == wanted


def test_mix_of_many_small_shards(documents):
    few = mixing.mix(documents, shard_words=2048, group_shards=3)
    for s in few.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(s["sum(taken)"] - s["max(target)"]) <= 64 + 0.02 * s["max(target)"]


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.classify(docs, labels)
    rows = judged.filter("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right >= 0.93 * len(rows) and len(rows) > 40
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, None), (None, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    rows = quality.classify(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert rows[0].__fields__[:2] == ["doc_id", "text"]
    assert quality.classify(no_documents, labels).count() == 0
    assert quality.classify(odd_documents, labels.limit(0)).filter("score <> 0.5").count() == 0


def test_attention_learns_which_passage_matters():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(1800):
        rows = rng.normal(0, 1, (rng.integers(1, 9), quality.FEATURES))
        rows[:, 0] = -1
        if i % 2:
            rows[rng.integers(len(rows)), 0] = 3
        bags.append(rows)
        labels.append(i % 2)
    model = quality.fit(bags[:1500], np.array(labels[:1500], float))
    parts = np.array([len(b) for b in bags[1500:]])
    right = (model.score(np.vstack(bags[1500:]), parts) > 0.5) == np.array(labels[1500:])
    assert right.mean() > 0.9
