import contextlib
import io

from tricolor.plans.registry import queries


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf_small):
    qs = queries()
    p = _plan(qs["flt_category"](spark, sf_small))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in p
    p = _plan(qs["agg_corr2"](spark, sf_small))
    assert "EqualTo(l_returnflag,R)" in p
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in p


def test_lookup_is_broadcast_and_expressions_stay_in_codegen(spark, sf_small):
    qs = queries()
    p = _plan(qs["join_lookup"](spark, sf_small))
    assert "BroadcastHashJoin" in p
    p = _plan(qs["fn_traffic"](spark, sf_small))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
