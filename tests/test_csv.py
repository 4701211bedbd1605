import pytest

from tricolor.sources.readers import read_csv


def _write(tmp_path, text):
    p = tmp_path / "t.csv"
    p.write_text(text)
    return str(p)


CSV = "a,b,c,d,e\n1.5,1,x,NA,true\nNA,2, NA ,,false\n2.5,n/a,None,,NaN\n"


def test_markers_in_number_columns(spark, tmp_path):
    df = read_csv(spark, _write(tmp_path, CSV))
    assert dict(df.dtypes) == {"a": "double", "b": "int", "c": "string", "d": "string", "e": "boolean"}
    assert [tuple(r) for r in df.collect()] == [(1.5, 1, "x", None, True), (None, 2, " NA ", None, False), (2.5, None, None, None, None)]


def test_declared_schema(spark, tmp_path):
    path = _write(tmp_path, CSV)
    df = read_csv(spark, path, "a double, b bigint, c string, d double, e boolean")
    assert dict(df.dtypes)["b"] == "bigint" and [r["a"] for r in df.collect()] == [1.5, None, 2.5]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        read_csv(spark, path, "a double, b bigint, c int, d double, e boolean").collect()
