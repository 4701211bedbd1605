import json
import random

import pytest

from tricolor.sources.json_array import array_records, read_array
from tricolor.sources.readers import read_json
from tricolor.sources.sinks import write_json_arrays

TEXTS = ["", "plain", "a}b", "}{][", 'say \\"}\\"', "back\\\\", "\\\\}", "é}ü\U0001f600", "line\nbreak\ttab", '"', "[" * 9, "}" * 40, "x" * 300]


def records(rng, n):
    return [{"id": i, "text": rng.choice(TEXTS), "sub": {"xs": [rng.randint(0, 9) for _ in range(rng.randint(0, 4))],
             "deep": {"t": rng.choice(TEXTS)}}, "rows": [{"k": rng.choice(TEXTS)} for _ in range(rng.randint(0, 3))]} for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of ``n`` bytes, so that files are cut anywhere."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("n_bytes", [61, 700])
@pytest.mark.parametrize("layout", [{"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_byte_ranges_give_every_record_once(spark, tmp_path, small_ranges, n_bytes, layout):
    want = records(random.Random(n_bytes), 60)
    path = tmp_path / "a.json"
    path.write_text("\ufeff \n" + json.dumps(want, **layout) + "\n", encoding="utf-8")
    small_ranges(n_bytes)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() >= 4
    got = [json.loads(r["value"]) for r in array_records(spark, str(path)).collect()]
    assert sorted(got, key=lambda r: r["id"]) == want


def test_a_record_over_many_ranges_and_several_files(spark, tmp_path, small_ranges):
    long = {"id": 2, "text": '}{\\"' * 500}
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "text": None}, long, {"id": 3, "text": "}"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": 4, "text": "{"}]))
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    (tmp_path / "e.json").write_text('[{}, {"id": 5, "text": "x", "other": 1}]')
    small_ranges(80)
    got = [tuple(r) for r in read_array(spark, str(tmp_path), "id bigint, text string").collect()]
    assert sorted(got, key=str) == sorted([(1, None), (2, long["text"]), (3, "}"), (4, "{"), (None, None), (5, "x")], key=str)


def test_array_equals_json_lines(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    rows = [{"a": rng.randint(0, 99), "b": rng.random(), "c": rng.choice(TEXTS), "d": {"e": [rng.choice(TEXTS)]}} for _ in range(200)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    small_ranges(1000)
    lines = read_json(spark, str(tmp_path / "lines.json"))
    for schema in (None, lines.schema):
        array = read_json(spark, str(tmp_path / "array.json"), schema=schema, multiline=True)
        assert array.schema == lines.schema
        assert sorted(map(str, array.collect())) == sorted(map(str, lines.collect()))


def test_arrays_are_written_in_bounded_files(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "if(id % 3 = 0, null, 'same}') AS t")
    path = write_json_arrays(df, str(tmp_path / "out"), rows_per_file=100)
    assert len(list((tmp_path / "out").glob("part-*"))) >= 4
    got = read_json(spark, path, schema=df.schema, multiline=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
