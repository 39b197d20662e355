import json

from tidemark.operators.nested import TRACE, flatten, layout, outline

SCHEMA = "probe_id long, t string, key long, children string"


def places(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    return sorted(tuple(r) for r in outline(layout(df, key="probe_id", text="t", levels=TRACE), TRACE, (1, 2)).collect())


def one(spark, value):
    return [x[1:] for x in places(spark, [value if isinstance(value, str) else json.dumps(value)])]


LOAD = {"repo": "r", "accesses": [{"kind": "k", "ms": 1.5}, None, "no", {"kind": "l"}]}


def trace(loads):
    return {"hydration_trace": {"load_results": loads}}


def test_positions_count_what_is_no_object(spark):
    assert one(spark, trace([None, LOAD, 3])) == [(0, 1, -1), (0, 1, 0), (0, 1, 3)]


def test_attempts_and_lone_objects(spark):
    assert one(spark, {"attempts": [None, trace(LOAD), {"skipped": True}, trace([{"accesses": {"ms": 1}}])]}) == [(1, 0, -1), (1, 0, 0), (1, 0, 3), (3, 0, -1), (3, 0, 0)]
    assert one(spark, {"attempts": trace({})}) == [(0, 0, -1)]


def test_json_inside_strings(spark):
    s = json.dumps
    assert one(spark, {"hydration_trace": s({"load_results": s([s(LOAD)])})}) == [(0, 0, -1), (0, 0, 0), (0, 0, 3)]
    assert one(spark, s(s(trace({"accesses": s({"ms": 1})})))) == [(0, 0, -1), (0, 0, 0)]


def test_json_encoded_any_number_of_times(spark):
    t = json.dumps(trace([LOAD]))
    texts = []
    for _ in range(8):
        texts.append(t)
        t = json.dumps(t)
    assert places(spark, texts) == [(i, 0, 0, a) for i in range(8) for a in (-1, 0, 3)]
    inner = json.dumps(json.dumps(json.dumps(json.dumps({"load_results": [LOAD]}))))
    assert one(spark, {"hydration_trace": inner}) == [(0, 0, -1), (0, 0, 0), (0, 0, 3)]
    assert one(spark, json.dumps(json.dumps("no json"))) == []


def test_repeats_count_once_and_keys_may_be_shared(spark):
    a, b = json.dumps(trace([LOAD])), json.dumps(trace([{"repo": "other"}, {"repo": "z"}]))
    df = spark.createDataFrame([(k, t, 1, "x") for k in (None, 5) for t in (a, b, a)], SCHEMA)
    n = layout(df, key="probe_id", text="t", levels=TRACE)
    got = sorted(((r["key"], r["load_no"], r["repo"]) for r in flatten(n, TRACE, 1).collect()), key=str)
    assert got == sorted([(k, *x) for k in (None, 5) for x in ((0, "r"), (0, "other"), (1, "z"))], key=str)


def test_nothing_from_what_is_not_valid(spark):
    whole = json.dumps(trace([LOAD]))
    for t in (None, "", "  ", whole[:-3], whole + " x", whole + whole, whole + "," + whole, "[]", "3", "null", '"text"', '{"hydration_trace": "{"}', '{"attempts": []}', '{"hydration_trace": null}'):
        assert places(spark, [t]) == []


def test_fields_and_links(spark):
    df = spark.createDataFrame([(4, json.dumps({"attempts": [trace([LOAD, {"repo": 5, "lazy_loaded_at_return": True}])]}), 1, "x")] * 2, SCHEMA)
    n = layout(df, key="probe_id", text="t", levels=TRACE)
    assert [tuple(r) for r in flatten(n, TRACE, 0).collect()] == [(4, 0, None, None)]
    loads = sorted(flatten(n, TRACE, 1).collect())
    assert [(r["load_no"], r["repo"], r["lazy_loaded_at_return"]) for r in loads] == [(0, "r", None), (1, "5", True)]
    assert sorted((r["access_no"], r["kind"], r["ms"]) for r in flatten(n, TRACE, 2).collect()) == [(0, "k", 1.5), (3, "l", None)]


def test_empty_table_null_key_and_very_long_text(spark):
    assert places(spark, []) == []
    many = trace([{"repo": "x" * 50, "accesses": [{"kind": "k"}] * 20}] * 500)
    df = spark.createDataFrame([(None, json.dumps(many), 1, "")], SCHEMA)
    assert outline(layout(df, key="probe_id", text="t", levels=TRACE), TRACE, (1, 2)).count() == 500 * 21
