from conftest import rows

from graphlake.streaming.degrees import DegreeStream


def test_degrees_follow_the_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), DegreeStream(spark, str(tmp_path / "deg"))
    edges = lambda r: spark.createDataFrame(r, "src_id bigint, dst_id bigint")
    for part in ([(1, 2), (1, 3)], [(2, 1), (None, 4)]):
        edges(part).write.mode("append").parquet(src)
        out.start(spark.readStream.schema("src_id bigint, dst_id bigint").parquet(src), str(tmp_path / "cp")).awaitTermination()
    want = [(1, 1, 2), (2, 1, 1), (3, 1, 0)]
    assert rows(out.degrees()) == want
    assert rows(out.compact(str(tmp_path / "all")).degrees()) == want
    out.add(edges([(2, 1)]), 1)
    assert rows(out.degrees()) == want
