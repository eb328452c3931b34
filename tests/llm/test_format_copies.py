import itertools
import random

from conftest import rows

from graphlake.llm import format_copies as M

SCHEMA = "line_id bigint, src_id string, dst_id string, weight string, h bigint, rep string"


def run(spark, lines):
    df = spark.createDataFrame([(i, *x, 1, "clash") for i, x in enumerate(lines)], SCHEMA)
    return rows(M.format_copies(df))


def test_writings_of_one_record(spark):
    same = [("AB-00-123", "Öst 00-7", "3.120"), ("öst_00·7.", "<ab00123>", "+3,12"), ("(3.12)", "ÖST007", "'ab/00/123'"), ("ab00123", '"3.1200"', " öST 00 - 7;")]
    others = [("AB-00-124", "Öst 00-7", "3.12"), ("AB-00-123", "Ost 00-7", "3.12"), ("AB-00-123", "Öst 00-7", "31.2"), ("AB-00-123", "Öst 00-7", "-3.12"), ("AB-00-123", "Öst 00-7", "3.102")]
    assert run(spark, same + others + [same[0]]) == [(0, 1), (0, 2), (0, 3), (0, 9)]


def test_nulls_and_fields_without_letters_are_in_no_record(spark):
    bad = [(None, "A1", "1"), ("A1", "", "1"), ("A1", "B1", "-"), ("A1", " ", "2"), ("1", "2", "3"), ("A", "B", "C"), ("A1", "1", "1")]
    assert run(spark, bad + bad) == []
    assert run(spark, []) == []


def test_numbers():
    groups = [["0", "0.0", "00", "(0,000)", "-0", "+0."], ["1", "1.0", "01", "'1,000'", " 1"], ["10", "010.00"], ["0.1", ".1", "0,100", "+.10"], ["1.01", "1,010"], ["-1", "(-1.0)"], ["123456789012345678901234567890.5", "0123456789012345678901234567890,50"]]
    flat = [(i, w) for i, g in enumerate(groups) for w in g]
    for (i, a), (j, b) in itertools.product(flat, flat):
        assert M.same_number(a, b) == (i == j), (a, b)


def test_hash_agrees_with_the_comparison(spark):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(1)
    nums = ["".join(rng.choice("0012.,") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    nums = [n for n in nums if any(c.isdigit() for c in n)]
    keys = M._weight_keys(M._Column(pa.array(nums)))
    ids = ["".join(rng.choice("aAéÉ0 -") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    id_keys = M._id_keys(M._Column(pa.array(ids)))
    for i in range(len(nums)):
        for j in range(i):
            assert (keys[i] == keys[j]) == M.same_number(nums[i], nums[j]), (nums[i], nums[j])
    for i in range(len(ids)):
        for j in range(i):
            assert (id_keys[i] == id_keys[j]) == M.same_letters(ids[i], ids[j]), (ids[i], ids[j])
    assert keys.dtype == np.uint64


def test_very_long_fields_and_other_planes(spark):
    long = "X" * 200_000
    lines = [(long, "𝒜1", "1"), (long.lower() + "-", "𝒜-1", "1.0"), (long + "Y", "𝒜1", "1")]
    assert run(spark, lines) == [(0, 1)]


def test_collisions_are_told_apart(spark, monkeypatch):
    # every line gets one of two hashes; the comparison alone must find the records
    def poor(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays([pa.array([i % 2 for i in ids.to_pylist()], pa.int64()), ids], names=["h", "line_id"])

    monkeypatch.setattr(M, "_hash_batches", poor)
    lines = [("A1", "B1", "1"), ("A2", "B1", "1"), ("C1", "B1", "1"), ("A-2", "B1", "1"), ("c1", "1,0", "b1"), ("x", "y", "2"), ("A1", "b1", "1.0")]
    assert run(spark, lines) == [(0, 6), (1, 3), (2, 4)]


def test_many_copies(spark):
    lines = [("A1", "B1", "1")] * 500 + [("A2", "B1", "1")] * 3
    got = run(spark, lines)
    assert got == [(0, i) for i in range(1, 500)] + [(500, 501), (500, 502)]
    df = spark.createDataFrame([(i, *x, 1, "") for i, x in enumerate(lines)], SCHEMA)
    assert rows(M.record_counts(df, M.format_copies(df))) == [(0, 500), (500, 3)]


def test_hot_records_are_split(spark, monkeypatch):
    from graphlake.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "MOST_HOT", 40)
    rng = random.Random(3)
    lines = [(rng.choice(["A1", "a-1", " a1"]), "B1", rng.choice(["1", "1.0"])) for _ in range(600)] + [(f"C{k}", "B1", "2") for k in range(200)] + [("c5", "b-1", "2,0")] * 3
    got = run(spark, lines)
    assert got == [(0, i) for i in range(1, 600)] + [(605, i) for i in (800, 801, 802)]


def test_counts_include_records_of_one_line(spark):
    lines = [("A1", "B1", "1"), ("C1", "B1", "2"), ("a1", "b1", "1.0"), (None, "B1", "2"), ("1", "2", "3")]
    df = spark.createDataFrame([(i, *x, 1, "") for i, x in enumerate(lines)], SCHEMA)
    assert rows(M.record_counts(df, M.format_copies(df))) == [(0, 2), (1, 1)]
