import itertools
import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.drift import assign, drift, name_similarity, unify

FILES = "file_id long, line_id string, family string, seq_no int, row long, field string"
ROWS = "raw_id long, file_id long, row_no int, record string, value string"


def setup(spark, files):
    """files: lists of records of one line, in order; or (line, records)."""
    f, r = [], []
    for i, x in enumerate(files):
        line, records = x if isinstance(x, tuple) else ("l", x)
        f.append((i + 1, line, "fam", i + 1, 0, "clash"))
        r += [(100 * i + k, i + 1, k, rec if rec is None or isinstance(rec, str) else json.dumps(rec), "clash") for k, rec in enumerate(records)]
    return spark.createDataFrame(f, FILES), spark.createDataFrame(r, ROWS)


def found(spark, files):
    return sorted((x["file"], x["field_name"], x["change_kind"]) for x in drift(*setup(spark, files)).collect())


def recs(count=6, /, **fields):
    return [{k: v(i) for k, v in fields.items()} for i in range(count)]


MS = lambda i: 100.0 + i
SHA = lambda i: "ab" * 20


def test_added_removed_renamed_and_retyped(spark):
    files = [
        recs(wall_ms=MS, jcodemunch_source_sha=SHA, keep=lambda i: "k"),
        recs(wallMs=MS, jcodemunch_source_sha=SHA, keep=lambda i: "k"),
        recs(duration_ms=lambda i: f"{100.0 + i} ms", src_commit_sha=lambda i: "cd" * 20, keep=lambda i: "k"),
        recs(src_commit_sha=lambda i: ["cd" * 20], keep=lambda i: "k", gc_paused=lambda i: True),
    ]
    assert found(spark, files) == [
        (2, "wall_ms", "renamed"), (3, "jcodemunch_source_sha", "renamed"), (3, "wallMs", "renamed"), (3, "wallMs", "type_changed"),
        (4, "duration_ms", "removed"), (4, "gc_paused", "added"), (4, "src_commit_sha", "type_changed"),
    ]


def test_another_quantity_is_no_rename(spark):
    files = [recs(wall_ms=MS, snapshot_consistent=lambda i: True), recs(process_cpu_ms=lambda i: 9000.0 + i, warm_start=lambda i: False)]
    assert found(spark, files) == [(2, "process_cpu_ms", "added"), (2, "snapshot_consistent", "removed"), (2, "wall_ms", "removed"), (2, "warm_start", "added")]


def test_names_without_a_common_word(spark):
    by_values = [recs(source_sha=SHA, elapsed=MS), recs(build_id=SHA, took_ms=MS)]
    assert found(spark, by_values) == [(2, "elapsed", "removed"), (2, "source_sha", "renamed"), (2, "took_ms", "added")]
    # other lines show that took stands for elapsed
    lines = [(f"x{i}", recs(**{n: MS})) for i in range(3) for n in ("elapsed_ms", "took_ms")]
    assert [x for x in found(spark, [*by_values, *lines]) if x[0] <= 2] == [(2, "elapsed", "renamed"), (2, "source_sha", "renamed")]


def test_unified_table_reports_what_does_not_stand_whole(spark):
    deep = {"value": 101.5, "unit": "ms", "z": ["q"]}
    f, r = setup(spark, [recs(2, wall_ms=MS, note=lambda i: {"a": [1, "x"]}), recs(2, wall_ms=lambda i: [deep, "soon"][i], WALL_MS=MS, note=lambda i: {"a": [1, "x"]})])
    u = {x["row"]: x for x in unify(f, r, wide=(("wall_ms", "double"),)).collect()}
    assert u[0]["wall_ms"] == 100.0 and u[0]["reported"] == [] and json.loads(u[0]["other"]["note"]) == {"a": [1, "x"]}
    told = {k: sorted((x["field"], x["reason"]) for x in u[k]["reported"]) for k in (100, 101)}
    assert told == {100: [("wall_ms", "nested")], 101: [("wall_ms", "misfit")]} and json.loads(u[100]["reported"][0]["value"]) == deep
    assert u[101]["other"]["WALL_MS"] == "101"


def test_nulls_odd_values_repeats_and_bad_records(spark):
    a = recs(x=MS, y=lambda i: "t")
    b = [dict(r, x="odd") if i == 2 else dict(r, x=None) if i == 3 else r for i, r in enumerate(recs(x=MS, y=lambda i: "t"))]
    f, r = setup(spark, [a, b + [None, "", "{", "[1]", "5", '{"z": 1} z', '{"z": 1}, {"z": 1}']])
    assert drift(f, r.union(r)).count() == 0


def test_lines_are_apart_and_files_may_be_empty(spark):
    assert found(spark, [("a", recs(x=MS)), ("b", recs(y=MS))]) == []
    assert found(spark, [recs(x=MS), [], recs(x=MS)]) == [(2, "x", "removed"), (3, "x", "added")]
    assert found(spark, []) == []


def test_unified_table(spark):
    f, r = setup(spark, [recs(3, wall_ms=MS, n=lambda i: i), recs(2, duration_ms=lambda i: {"value": 101.5, "unit": "ms"}, n=lambda i: i), recs(3, wall_ms=lambda i: "102.5 ms", n=lambda i: None)])
    out = sorted((x["file"], x["wall_ms"], x["other"].get("n")) for x in unify(f, r, wide=(("wall_ms", "double"),)).collect())
    assert out == [(1, 100.0, "0"), (1, 101.0, "1"), (1, 102.0, "2"), (2, 101.5, "0"), (2, 101.5, "1"), (3, 102.5, None), (3, 102.5, None), (3, 102.5, None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_the_best(n, m, seed):
    s = np.random.default_rng(seed).random((n, m))
    got = sum(s[i, j] for i, j in assign(s))
    k = min(n, m)
    best = max(sum(s[i, j] for i, j in zip(r, c)) for r in itertools.permutations(range(n), k) for c in itertools.combinations(range(m), k))
    assert abs(got - best) < 1e-9


def test_name_similarity():
    assert name_similarity("wall_ms", "WALL-MS") == name_similarity("fileCount", "file_count") == 1
    assert name_similarity("jcodemunch_source_sha", "jcm_source_sha") > 0.8
    assert name_similarity("wall_ms", "gc_paused") == 0
