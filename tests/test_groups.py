"""Many small groups in one stream: whole groups whatever the batches are, and no frame of pandas for each."""

import pytest

from chronoloom.operators import tracks
from chronoloom.operators.groups import in_groups


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_are_whole_and_in_order(spark, small_batches):
    rows = [(m, k, n) for m in (1, 2, None) for k in (0, 1, 2, 3) for n in range(m or 5, 0, -1)]
    df = spark.createDataFrame(rows, "m long, k long, n long").repartition(3)
    got = in_groups(df, ["m", "k"], ["n"], lambda g: [(g[0][0], g[0][1], str([r[2] for r in g]))] if g[0][1] != 3 else [], "m long, k long, ns string")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(m, k, str(list(range(1, (m or 5) + 1)))) for m in (1, 2, None) for k in (0, 1, 2)], key=repr)
    assert in_groups(df.limit(0), ["m", "k"], ["n"], lambda g: g, "m long, k long, n long").count() == 0


def by_frames(df):
    return "InPandas" in df._jdf.queryExecution().executedPlan().toString()


def test_matched_points_make_no_frame_an_island(spark, small_batches):
    points = lambda shift: spark.createDataFrame([(m, 10.0 * k + shift) for m in (1, 2) for k in range(50)], "media_id long, t double")
    found = tracks.matched_points(points(0.0), points(0.25), 1.0)
    assert not by_frames(found) and sorted(map(tuple, found.collect())) == [(m, 10.0 * k, 10.0 * k + 0.25) for m in (1, 2) for k in range(50)]


def test_merged_tracks_make_no_frame_an_island(spark, small_batches):
    clips = [(1, t, 10.0 * k + d, 10.0 * k + d + 2) for k in range(40) for t, d in (("a", 0.0), ("b", 1.0))] + [(1, "a", 900.0, 901.0), (1, "b", None, 5.0)]
    found = tracks.merge_tracks(spark.createDataFrame(clips, "media_id long, track string, start double, end double"))
    assert not by_frames(found) and sorted(map(tuple, found.collect())) == [(1, "a", 10.0 * k, 10.0 * k + 2) for k in range(40)] + [(1, "a", 900.0, 901.0)]


def test_lengths_of_exports_are_rounded_as_their_sql_does(spark, duck, tmp_path):
    """12,344.5 ms are 12,344: 5,000 from the file, not 5,001."""
    from chronoloom.plans.jobs import SQL, Q
    from tests.conftest import spark_rows

    spark.sql("SELECT 1L AS o_orderkey, 7L AS o_custkey, 1234.45D AS o_totalprice, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT 7L AS c_custkey, 36.72D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    got = spark_rows(Q["export_pairs"](spark, str(tmp_path)))
    assert got == duck(SQL["export_pairs"], str(tmp_path)) and got[1] == [(1, 7, "clip7", None)]


@pytest.mark.parametrize("name", ["segment_cards", "long_cards", "sentences", "zoom_choice", "clip_boundaries", "break_alignment"])
def test_queries_of_recordings_make_no_frame_a_group(spark, name):
    from chronoloom.plans.catalog import QUERIES

    assert not by_frames(QUERIES[name](spark, "/root/testdata/sf0.001"))
