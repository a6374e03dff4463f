"""The pipeline stage by stage against what the operators say."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ratingloom.llm import mixing, ngram_join, quality, repeats  # noqa: E402
from ratingloom.session import stage  # noqa: E402


def test_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(function(spark, kept[-1], folder), "test"))
        assert kept[-1].columns == docs.columns and kept[-1].dtypes == docs.dtypes
    good, single, cut, mixed = kept[1:]
    judged = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in judged.filter("predicted = 1").collect()}
    joined = ngram_join.join(good, 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.doc_id for r in joined.filter("doc_id = component_id").collect())
    texts = {r.doc_id: r.text for r in repeats.remove_repeats(single).filter("n_removed > 0").collect()}
    after, before = ({r.doc_id: r.text for r in d.collect()} for d in (cut, single))
    assert set(after) == set(before) and {i for i in after if after[i] != before[i]} == set(texts)
    taken = {r.doc_id: r.taken for r in mixing.mix(cut).collect()}
    words = {r.doc_id: len(r.text.split()) for r in mixed.collect()}
    assert words == {i: n for i, n in taken.items() if n}
    pieces = corpus_pipeline.STAGES[-1][1](spark, mixed, folder)
    assert {r.doc_id for r in pieces.collect()} == set(words)


def test_mixed_texts_are_the_drawn_blocks(spark):
    def text(name, size):
        return "".join(f"{name}w{i}" + ("\n" if i % 7 == 0 else " ") for i in range(size))

    sizes = {"a": (20000, 40, 9000), "b": (4000, 1000, 900), "c": (9000, 1000, 2500)}
    rows = [(k or None, text(f"{s}{k}", n), "en", s, n) for s, each in sizes.items() for k, n in enumerate(each)]
    rows += [(None, text("x", 700), "en", "c", 1)]
    docs = stage(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "test")
    mixed = {r.text.split("w")[0]: r.text for r in corpus_pipeline.mix_sources(spark, docs, "").collect()}
    whole = {r[1].split("w")[0]: r[1].split() for r in rows}
    wanted = sorted((len(whole[n]), len(t.split())) for n, t in mixed.items())
    assert wanted == sorted((r["size"], r.taken) for r in mixing.mix(docs).filter("taken > 0").collect())
    tails = 0
    for name, found in mixed.items():
        at = [int(w.partition("w")[2]) for w in found.split()]
        assert all(w.startswith(name + "w") for w in found.split())
        again = next((i for i in range(1, len(at)) if at[i] <= at[i - 1]), len(at))
        assert all(a < b for part in (at[:again], at[again:]) for a, b in zip(part, part[1:]))
        assert set(at[again:]) <= set(at[:again])
        tails += again < len(whole[name]) and max(at) >= again
        assert ("\n" in found) == any(i % 7 == 0 for i in at)
    assert tails >= 3


def test_cut_passages_leave_lines_alone(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(1, shared, "en", "a", 1), (2, f"One line.\n\nTwo\n{shared}\nlast", "en", "a", 2), (3, " as\n it  is ", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert found == {1: shared, 2: "One line.\n\nTwo\nlast", 3: " as\n it  is "}


def test_odd_rows(spark, odd_documents, no_documents):
    folder = "/root/testdata/sf0.001"

    def run(docs):
        kept = [docs]
        for _, function in corpus_pipeline.STAGES:
            kept.append(stage(function(spark, kept[-1], folder), "test"))
        return kept

    docs, good, single, cut, mixed, packed = run(odd_documents)
    wanted = quality.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1")

    def texts(df):
        return sorted((str(r.doc_id), str(r.text)) for r in df.collect())

    assert texts(good) == texts(wanted)
    # One of each group of near copies, once; rows without id all stay.
    groups = ngram_join.join(good, 5, 80).collect()
    ids = {r.component_id for r in groups if r.doc_id is not None}
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == sorted(ids)
    assert single.filter("doc_id is null").count() == good.filter("doc_id is null").count()
    assert cut.count() == single.count() and cut.columns == docs.columns and mixed.columns == docs.columns
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    for df in run(no_documents):
        assert df.count() == 0
