"""Line formats and whole jobs on files."""

import pathlib

import pytest

from ratingloom.plans import jobs
from ratingloom.sources import text
from tests.conftest import BASKETS, MATRIX
from tests.test_golden_matrix import RANK2, SCORES


@pytest.fixture()
def ratings_file(tmp_path):
    lines = [f"{u},{i},{r},ignored" for u, row in enumerate(MATRIX) for i, r in enumerate(row) if r]
    lines.insert(3, "")
    (tmp_path / "ratings.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "ratings.csv")


@pytest.fixture()
def baskets_file(tmp_path):
    (tmp_path / "baskets.csv").write_text("\n".join(",".join(map(str, b)) for b in BASKETS) + "\n\n")
    return str(tmp_path / "baskets.csv")


def lines_of(folder):
    return sorted(x for f in pathlib.Path(folder).rglob("part-*") for x in f.read_text().splitlines())


def parsed(folder):
    out = {}
    for line in lines_of(folder):
        user, rest = line.split(":")
        for entry in rest.strip("()").split("),("):
            item, score = entry.split(",")
            out[int(user), int(item)] = float(score)
    return out


def test_readers(spark, tmp_path, ratings_file):
    assert text.read_ratings(spark, ratings_file).count() == 19
    swapped = text.read_ratings(spark, ratings_file, transposed=True, partitions=3)
    assert swapped.filter("user = 3").count() == 6
    (tmp_path / "dense").write_text("5,5,0,5\n\n5,0,3,4\n")
    cells = text.dense_cells(text.read_dense_rows(spark, str(tmp_path / "dense")))
    assert {tuple(r) for r in cells.collect()} == {(0, 0, 5), (0, 1, 5), (0, 3, 5), (1, 0, 5), (1, 2, 3), (1, 3, 4)}
    (tmp_path / "sparse").write_text("0:5,1:5,3:5,\n0:5,2:3\n")
    cells = text.read_sparse_rows(spark, str(tmp_path / "sparse"))
    assert {tuple(r) for r in cells.collect()} == {(0, 0, 5), (0, 1, 5), (0, 3, 5), (1, 0, 5), (1, 2, 3)}


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    for part in range(3):
        (tmp_path / f"part-{part}").write_text("".join(f"{part}-{n}\n" for n in range(2000 * (3 - part))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = text.read_numbered_lines(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["pos"] for r in numbered] == list(range(12000))
    assert [r["value"] for r in numbered] == [f"{p}-{n}" for p in range(3) for n in range(2000 * (3 - p))]


def test_recommendation_jobs(spark, tmp_path, ratings_file):
    jobs.recommend_by_items(spark, ratings_file, str(tmp_path / "items"))
    jobs.recommend_by_users(spark, ratings_file, str(tmp_path / "users"))
    jobs.recommend_by_svd(spark, ratings_file, str(tmp_path / "svd"), 2)
    for n, folder in enumerate(["items", "users", "svd"]):
        assert parsed(tmp_path / folder) == pytest.approx({k: v[n] for k, v in SCORES.items()}, abs=2e-6)
    jobs.recommend_by_als(spark, ratings_file, str(tmp_path / "als"), n=1, rank=2, iterations=2)
    assert {u for u, _ in parsed(tmp_path / "als")} == {0, 1, 2, 3}


def test_error_jobs(spark, ratings_file):
    assert jobs.test_by_items(spark, ratings_file, ratings_file) == pytest.approx(0.691302, abs=2e-6)
    assert jobs.test_by_users(spark, ratings_file, ratings_file) == pytest.approx(0.983851, abs=2e-6)
    assert jobs.test_by_svd(spark, ratings_file, ratings_file, 2) == pytest.approx(0.650723, abs=2e-6)
    assert jobs.test_by_normalised_svd(spark, ratings_file, ratings_file, 2) == pytest.approx(0.463135, abs=2e-6)
    assert jobs.test_by_reconstruction(spark, ratings_file, ratings_file, 2) == pytest.approx(0.559750, abs=2e-6)
    assert jobs.test_by_als(spark, ratings_file, rank=2, iterations=2) > 0


def test_matrix_jobs(spark, tmp_path):
    (tmp_path / "sparse").write_text(
        "".join(",".join(f"{i}:{r}" for i, r in enumerate(row) if r) + "\n" for row in MATRIX)
    )
    (tmp_path / "dense").write_text("".join(",".join(map(str, row)) + "\n" for row in MATRIX))
    values = jobs.decompose_sparse_rows(spark, str(tmp_path / "sparse"), str(tmp_path / "factors"), 2)
    assert values == pytest.approx([17.713921, 6.391671], abs=2e-6)
    assert spark.read.parquet(str(tmp_path / "factors/users")).count() == 6
    jobs.reconstruct_dense_rows(spark, str(tmp_path / "dense"), str(tmp_path / "low"), 2)
    low = {r["row"]: r["values"] for r in spark.read.parquet(str(tmp_path / "low")).collect()}
    for u in range(6):
        assert low[u] == pytest.approx(RANK2[u], abs=2e-6)


def test_mining_jobs(spark, tmp_path, baskets_file):
    jobs.mine_pairs(spark, baskets_file, str(tmp_path / "pairs"), 2)
    assert lines_of(tmp_path / "pairs") == ["1", "1,2", "1,3", "2", "2,3", "3"]
    assert jobs.mine_levels(spark, baskets_file, 4, 2, str(tmp_path / "levels")) == 3
    assert lines_of(tmp_path / "levels/3") == ["[1, 2, 3]", "[1, 2, 5]"]
    jobs.mine_fp_growth(spark, baskets_file, str(tmp_path / "fp"), str(tmp_path / "related"), 1.5 / 9)
    assert "4:1,2" in lines_of(tmp_path / "fp") and len(lines_of(tmp_path / "fp")) == 13
    assert lines_of(tmp_path / "related") == ["1:2,3,5", "2:1,3,4,5", "3:1,2", "4:2", "5:1,2"]
    tid = tmp_path / "tid.csv"
    tid.write_text("".join(f"t{n},{','.join(map(str, b))}\n" for n, b in enumerate(BASKETS)))
    jobs.mine_weighted(spark, str(tid), str(tmp_path / "weighted"), 0.3)
    assert "1,2:0.4444444444444444" in lines_of(tmp_path / "weighted/size=2")


def test_preparation_jobs(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("u9,x,1\nu1,y,2\nu9,y,3\nu5,x,4\nu9,x,5\n")
    jobs.map_ids(spark, str(raw), str(tmp_path / "mapped"), 100)
    assert lines_of(tmp_path / "mapped/users") == ["u1,1", "u5,2", "u9,0"]
    assert lines_of(tmp_path / "mapped/items") == ["x,0", "y,1"]
    assert lines_of(tmp_path / "mapped/training") == ["0,0,1.0", "0,0,5.0", "0,1,3.0", "1,1,2.0", "2,0,4.0"]
    assert lines_of(tmp_path / "mapped/testing") == []
    jobs.sparse_matrix(spark, str(raw), str(tmp_path / "sparse"))
    assert lines_of(tmp_path / "sparse") == ["0:4.0,", "0:5.0,1:3.0,", "1:2.0,"]
    jobs.sample_lines(spark, str(raw), str(tmp_path / "sample"), first=4, n=2)
    assert len(lines_of(tmp_path / "sample")) == 2
    with pytest.raises(ValueError):
        jobs.sample_lines(spark, str(raw), str(tmp_path / "more"), first=6, n=2, check=True)
