"""Readers, learners and consolidation on small cases."""

import pytest

from palimpsest.operators import consolidation, learning
from palimpsest.sources import readers


def test_sections(spark):
    files = spark.createDataFrame([(1, "editor: nvim is used\nsince May§§ a b c d e f g"), (2, ""), (3, None)], "id long, text string")
    got = {(r.id, r.section, r.subject) for r in readers.sections(files).collect()}
    assert got == {(1, 0, "editor"), (1, 2, "a b c d e")}


def test_context_lines(spark):
    text = "[2024-01-02] (0.5) first\nmore\n[2024-01-03] (0.7) second"
    rows = {(r.id, r.record, r.day, r.importance, r.body) for r in readers.context_lines(spark.createDataFrame([(1, text), (2, "no head\nat all")], "id long, text string")).collect()}
    assert rows == {(1, 1, "2024-01-02", 0.5, "first\nmore"), (1, 2, "2024-01-03", 0.7, "second"), (2, 0, None, None, "no head\nat all")}


def test_tool_steps(spark):
    schema = "session long, seq long, role string, call_id string, tool string, output string, is_error boolean, exit_code int"
    rows = [(1, 1, "call", "a", "ls", None, None, None), (1, 2, "result", "a", None, "x", None, 1), (1, 3, "call", "b", "cat", None, None, None), (1, 4, "result", "b", None, "", False, None), (1, 5, "call", "c", "rm", None, None, None)]
    assert {r.tool: r.success for r in readers.tool_steps(spark.createDataFrame(rows, schema)).collect()} == {"ls": False, "cat": True, "rm": False}


def test_isotonic_is_monotone_and_pools(spark):
    bins = spark.createDataFrame([(0, 10, 0.1, 0.3), (1, 10, 0.3, 0.1), (2, 20, 0.5, 0.6), (3, 10, 0.9, 0.9)], "bin long, n long, x double, y double")
    p = [r.p for r in learning.isotonic(bins).orderBy("bin").collect()]
    assert p == pytest.approx([0.2, 0.2, 0.6, 0.9])
    scores = spark.createDataFrame([(0.0,), (0.1,), (0.4,), (2.0,)], "score double")
    assert [r.p for r in learning.calibrated(scores, learning.isotonic(bins)).orderBy("score").collect()] == pytest.approx([0.2, 0.2, 0.4, 0.9])


def test_packing_takes_components_first(spark):
    rows = [(1, "x:a", "v" * 20, 0.9), (1, "x:b", "v" * 20, 0.8), (1, "y:a", "v" * 2000, 1.0), (2, "z:a", "v" * 5000, 0.1)]
    got = {(r.query_id, r.key) for r in consolidation.packed_components(spark.createDataFrame(rows, "query_id long, key string, value string, score double"), 100).collect()}
    assert got == {(1, "x:a"), (1, "x:b"), (2, "z:a")}


def test_consolidation_keeps_the_most_trusted(spark):
    rows = [("fact:r:1", "editor is nvim today here", 0.6, 1, "r"), ("fact:r:2", "editor is nvim today here", 0.9, 1, "r"), ("fact:q:3", "editor is nvim today here", 0.99, 1, "q"), ("fact:r:4", None, 0.5, 1, "r")]
    facts = spark.createDataFrame(rows, "key string, value string, confidence double, ts long, root string")
    assert {(r.key, r.canonical) for r in consolidation.consolidated(facts, 0.88).collect()} == {("fact:r:1", "fact:r:2"), ("fact:r:2", "fact:r:2")}


def test_vectors_rewrite_only_what_changes(spark):
    import pathlib
    import uuid

    from palimpsest.operators.steps import shared_folder
    from palimpsest.sources import vectors

    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    schema = "key string, text string, vector array<double>, ts long"
    vectors.created(spark.createDataFrame([(f"k{i}", f"t{i % 4}", [1.0 * i], 1) for i in range(300)], schema), path)
    files = lambda: {str(f) for f in pathlib.Path(path.removeprefix("file:")).rglob("*.parquet")}
    before = files()
    change = spark.createDataFrame([("k7", "x", [0.5], 2), ("new", "y", [0.1], 2), ("k8", "late", [0.0], 0)], schema)
    assert vectors.merged(spark, path, change) == len({r.bucket for r in change.select(vectors.bucket()).collect()})
    after = files()
    assert len(before & after) >= len(before) - 3 and before != after
    rows = {r.key: (r.text, r.ts) for r in vectors.stored(spark, path).collect()}
    assert len(rows) == 301 and rows["k7"] == ("x", 2) and rows["new"] == ("y", 2) and rows["k8"] == ("t0", 1)
    gone = spark.createDataFrame([("k7", None, None, 3), (None, "k29", None, 3), (None, None, "t2", 3), ("nobody", None, None, 3)], "key string, prefix string, text string, ts long")
    for _ in range(2):
        vectors.merged(spark, path, deletes=gone)
        vectors.merged(spark, path, change)
    left = {r.key for r in vectors.stored(spark, path).collect()}
    assert left == {k for k in rows if k != "k7" and not k.startswith("k29") and rows[k][0] != "t2"}
