"""Record files, vocabulary files, ids and hot keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import checks, ids, publish
from cohortspark.session import run_path
from cohortspark.sources import records, vocabulary


def _write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_strict_csv(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'A,B\r\n1,"x ""y"", z"\r\n"",  \r\n"two\r\nlines",4\r\n')
    rows = records.read_records(spark, path, ["A", "B"]).collect()
    assert [tuple(r) for r in rows] == [("1", 'x "y", z'), (None, "  "), ("two\nlines", "4")]


@pytest.mark.parametrize("text", ["A,B\n1\n", "A,C\n1,2\n", "A,B\n1,2,3\n"])
def test_malformed_csv_is_refused(spark, tmp_path, text):
    path = _write(tmp_path / "b.csv", text)
    with pytest.raises(Exception):
        records.read_records(spark, path, ["A", "B"]).collect()


def test_column_names():
    assert records.staged_columns(["EDAD", "Peso_2"]) == ["edad", "peso_2"]
    for header in ([], ["a b"], ["A", "a"], ["SOURCE_ROW"], ["1a"]):
        with pytest.raises(records.SourceRefused):
            records.staged_columns(header)


def test_schema_problems(spark):
    frame = spark.createDataFrame([("a", 1)], "a string, b int")
    assert records.schema_problems(frame.select("a"), ["a"]) == []
    assert len(records.schema_problems(frame, ["a", "b"])) == 1
    assert len(records.schema_problems(frame.select("a"), ["a", "b"])) == 1


def test_ordinals_across_blocks(spark, tmp_path):
    """A file read in many blocks keeps the position of each record."""
    _write(tmp_path / "one.csv", "N,T\n" + "".join(f"{i},x{i}\n" for i in range(1, 5001)))
    _write(tmp_path / "two.csv", "N,T\n" + "".join(f"{i},y{i}\n" for i in range(1, 301)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        staged = records.stage_file(
            spark, str(tmp_path / "*.csv"), ["N", "T"], run_path(spark, "s"), multiline=False
        )
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert staged.count() == 5300
    assert staged.filter("source_row <> int(n)").count() == 0


def test_ordinals_over_files_of_a_group_with_quoted_breaks(spark, tmp_path):
    """Files with a line break in a cell are read whole, others in blocks; a group counts on over its files."""
    rows = [(g, i) for g in ("y=1", "y=2") for i in range(1, 1201)]
    for g, first, last in (("y=1", 1, 500), ("y=1", 501, 1200), ("y=2", 1, 1200)):
        (tmp_path / g).mkdir(exist_ok=True)
        cells = [f'"a ""q""\nb",{i}' if g == "y=1" and i % 700 == 0 else f'"a ""q""",{i}' for i in range(first, last + 1)]
        _write(tmp_path / g / f"part {first:04d}.csv", "T,N\n" + "\n".join(cells) + "\n")
    path = str(tmp_path / "*" / "*.csv")
    assert sorted(r.broken for r in records.broken_lines(spark, path).collect()) == [0, 0, 2]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        staged = records.stage_file(spark, path, ["T", "N"], run_path(spark, "s"), group="(y=[0-9])")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = staged.selectExpr("regexp_extract(source_file, '(y=[0-9])', 1) AS g", "source_row", "int(n) AS n", "t").collect()
    assert sorted((r.g, r.source_row) for r in found) == sorted(rows)
    assert all(r.source_row == r.n for r in found)
    assert sum(r.t == 'a "q"\nb' for r in found) == 1


def test_vocabulary_file(spark, tmp_path):
    header = "domain_id\tdomain_name\tdomain_concept_id\n"
    path = _write(tmp_path / "d.csv", header + 'A\t"quoted" name\t7\nB\t\t8\n')
    rows = vocabulary.read_vocabulary(spark, path, vocabulary.SCHEMAS["domain"]).collect()
    assert [tuple(r) for r in rows] == [("A", '"quoted" name', 7), ("B", None, 8)]
    bad = _write(tmp_path / "e.csv", header.replace("name", "label") + "A\tB\t7\n")
    with pytest.raises(Exception):
        vocabulary.read_vocabulary(spark, bad, vocabulary.SCHEMAS["domain"]).collect()


def test_ranks_with_small_buckets_and_gaps(spark):
    frame = spark.range(0, 5000, 7).withColumn("id", F.expr("id * id % 100003 + 5"))
    frame = frame.dropDuplicates(["id"])
    rows = ids.rank_by_id(frame, "id", "rank", bucket_rows=64).orderBy("id").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_distinct_ranks_put_nulls_last(spark):
    pairs = [("2", "09"), (None, "01"), ("1", None), ("2", None), ("1", "30"), ("10", "02"), ("2", "09")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    rows = ids.rank_distinct(frame, ["a", "b"], "rank").orderBy("rank").collect()
    assert [(r.a, r.b) for r in rows] == [
        ("1", "30"), ("1", None), ("10", "02"), ("2", "09"), ("2", None), (None, "01"),
    ]
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5, 6]


def test_bag_difference_equals_both_subtractions(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (3,), (3,), (None,)], "x int")
    found = {(r.x, r.side): r.copies for r in checks.bag_difference(a, b, ["x"]).collect()}
    assert found == {(1, "first"): 2, (2, "first"): 1, (3, "second"): 2}
    assert sum(found.values()) == a.exceptAll(b).count() + b.exceptAll(a).count()


def test_checks_with_one_person_holding_a_third_of_the_events(spark):
    """A hot person is one row after the partial sums, and is counted whole."""
    events = spark.range(30000).selectExpr(
        "if(id % 3 = 0, 7, id) AS person_id", "date'2023-01-02' AS day"
    )
    periods = spark.range(30000).selectExpr(
        "id AS person_id", "date'2023-01-01' AS observation_period_start_date",
        "date'2023-01-01' AS observation_period_end_date",
    )
    found = checks.outside_period(events, "day", periods, "rule").first().violations
    assert found == 30000


def test_publishing(spark):
    shape = publish.OutputTable(
        "t", "k int, note string, name string, x double", ("k",), ("note", "x")
    )
    frame = spark.createDataFrame(
        [(2, None, "", 0.1), (1, 'say "a, b"', " padded ", None), (10, "ñ", "z", 1e-17)],
        "k int, note string, name string, x double",
    )
    path = run_path(spark, "t.csv")
    read = publish.publish(frame, shape, path, files=None)
    assert publish.roundtrip_differences(frame, shape, read).count() == 0
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "k,note,name,x" and [line[:2] for line in lines[1:]] == ["1,", "2,", "10"]
    for row in [(None, "a", "b", 1.0), (1, "", "b", 1.0), (1, "a", None, 1.0), (1, "a", "b", float("nan"))]:
        with pytest.raises(checks.LoadRefused):
            publish.publish(spark.createDataFrame([row], frame.schema), shape, path)


def test_header_problems():
    assert checks.header_problems(["a", "b"], ["a", "b"]) == []
    assert checks.header_problems(["b", "a"], ["a", "b"]) == ["the columns are in another order"]
    assert len(checks.header_problems(["a", "c"], ["a", "b"])) == 2


def test_attrition_invariants(spark):
    schema = "cohort_definition_id int, source_year int, step int, remaining bigint, excluded bigint"
    good = [(1, 2023, 0, 10, None), (1, 2023, 1, 9, 1), (1, 2023, 2, 9, 0), (1, 2023, 3, 5, 4)]
    rows = spark.createDataFrame([(1, 2023, 5)], "cohort_definition_id int, source_year int, n bigint")

    def problems(table):
        found = checks.attrition_problems(spark.createDataFrame(table, schema), rows)
        return sorted(r.problem for r in found.collect())

    assert problems(good) == []
    assert problems([good[0], *good[2:]]) == ["the steps do not run from 0 without a gap"]
    assert problems([(1, 2023, 0, 10, 0), *good[1:]]) == ["step 0 excludes nobody"]
    assert problems([*good[:3], (1, 2023, 3, 5, None)]) == ["excluded is missing"]
    assert problems([*good[:3], (1, 2023, 3, 6, 3)]) == ["the cohort holds other rows"]
    other = [(2, *row[1:]) for row in good]
    assert "the cohort has no attrition" in problems(other)


def test_digests_whole_and_in_pieces(spark, tmp_path):
    import hashlib

    for name, size in (("a.bin", 10), ("b.bin", 5000)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    rows = vocabulary.file_digests(spark, str(tmp_path), whole_bytes=100).collect()
    assert {r.name: (r.bytes, r.sha256) for r in rows} == {
        p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest())
        for p in tmp_path.glob("*.bin")
    }


def test_code_map_file(spark, tmp_path):
    header = (
        "source_code,source_concept_id,source_vocabulary_id,source_code_description,"
        "target_concept_id,target_vocabulary_id,valid_start_date,valid_end_date,invalid_reason\n"
    )
    rows = "00,0,V,none,0,None,2020-01-01,2023-12-31,\n1,0,V,one,7,X,2020-01-01,2019-12-31,\n"
    found = vocabulary.read_code_map(spark, _write(tmp_path / "m.csv", header + rows))
    declared = spark.createDataFrame([("V", "D")], "vocabulary_id string, target_domain_id string")
    assert [r.source_code for r in found.orderBy("source_code").collect()] == ["00", "1"]
    problems = checks.code_map_problems(found, declared).collect()
    assert [(r.source_code, r.problem) for r in problems] == [
        ("1", "validity ends before it starts")
    ]


def test_tables_are_published_in_order_across_files(spark):
    shape = publish.OutputTable("t", "k bigint, v double", ("k",))
    frame = spark.range(0, 2000).selectExpr("1999 - id AS k", "id / 7 AS v")
    path = run_path(spark, "many.csv")
    read = publish.publish(frame, shape, path, files=None)
    assert publish.roundtrip_differences(frame, shape, read).count() == 0


SHAPE = publish.OutputTable("t", "k int, name string, v double", ("k", "name"), ("name", "v"))


def test_order_inside_and_between_files(spark, tmp_path):
    for number, body in enumerate(("1,,\n1,a,2.0\n2,b,\n", "2,c,\n5,a,\n4,a,1.5\n", "3,z,\n", "k\n")):
        body = "" if body == "k\n" else body
        _write(tmp_path / f"part-{number:05d}.csv", "k,name,v\n" + body)
    found = {r.file[-9:-4]: r.breaks for r in publish.order_breaks(spark, SHAPE, str(tmp_path)).collect()}
    assert found == {"00000": 0, "00001": 1, "00002": 1}


def test_ranges_find_each_difference(spark):
    rows = [(n % 50, None if n % 7 == 0 else f"x{n % 9}", float(n % 5)) for n in range(400)] + [(1, None, 2.0), (1, "a", None)]
    table = spark.createDataFrame(rows, SHAPE.schema)
    assert publish.ranged_difference(table, table.repartition(5), ["k", "name", "v"]).count() == 0
    other = spark.createDataFrame(rows[1:] + [rows[0]] + [rows[5], (None, "a", 1.0), ("a" and 1, "2", None)], SHAPE.schema)
    for ranges in (1, 3, 4096):
        found = publish.ranged_difference(table, other, ["k", "name", "v"], ranges).collect()
        wanted = checks.bag_difference(table, other, ["k", "name", "v"]).collect()
        assert sorted(map(repr, found)) == sorted(map(repr, wanted)) and len(found) == 3
    swapped = spark.createDataFrame([(None, "a", 1.0)], SHAPE.schema)
    moved = swapped.selectExpr("k", "CAST(NULL AS string) AS name", "v").unionByName(swapped)
    assert publish.ranged_difference(swapped, moved, ["k", "name", "v"]).count() == 1
