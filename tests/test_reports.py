"""Reports of a small scan, their store, and the drift report."""

from __future__ import annotations

import json

import pytest

from loomline.operators import drift, models, reports, workspace
from loomline.sources import catalog

SCAN = "ord long, path string, language string, bytes long, risk_flags array<string>, estimated_tokens long, included boolean"
ROWS = [(0, "a/b|c.ts", "TypeScript", 400_000, [], 60_000, True), (1, "a/d/x.py", "Python", 80, [], 20_000, True), (2, ".env", "Unknown", 9, ["secret"], 3, False), (3, "r.md", "Markdown", 40, [], 20_000, True)]
MODEL = ("m1", "M *1*", "p", 200_000, 8000, 1.0, 2.0, None, True, False, False, "cloud", 40.0, None, None, "2026-01-01", 0)


@pytest.fixture
def scan(spark):
    return spark.createDataFrame(ROWS, SCAN)


def test_report_of_a_scan(scan):
    told = reports.report(scan, warnings=["odd"])
    assert told["summary"] == {"totalFiles": 4, "includedFiles": 3, "excludedFiles": 1, "totalEstimatedTokens": 100_003, "includedTokens": 100_000}
    assert [(r["path"], r["percentage"]) for r in told["topTokenConsumers"]] == [("a/b|c.ts", 0.6), ("a/d/x.py", 0.2), ("r.md", 0.2)]
    assert {r["path"]: r["tokens"] for r in told["topFolders"]} == {".": 100_000, "a": 80_000, "a/d": 20_000}
    assert told["optimizationChecklist"] == ["Review 1 file(s) exceeding 50k tokens for splitting or exclusion", "Address 1 flagged risk file(s) before processing"]
    assert told["recommendations"] is None and told["goal"] is None
    text = reports.to_markdown(told, scan)
    assert "| 1 | `a/b&#124;c.ts` | 60,000 | 60.0% |" in text and "- `.env` — secret" in text and "Recommendations unavailable." in text and "No optimizations suggested." in text


def test_report_with_models(spark, scan):
    scored = models.score(spark.createDataFrame([MODEL], catalog.MODEL), 150_000, "debug")
    told = json.loads(reports.to_json(reports.report(scan, scored, 150_000, "debug")))
    pick = told["recommendations"]["balanced"]
    assert (pick["modelId"], pick["warnings"], told["goal"]) == ("m1", ["Below-average coding benchmark scores"], "debug")
    assert sum(v for k, v in pick["costEstimate"].items() if k != "totalCost") == pytest.approx(pick["costEstimate"]["totalCost"])
    assert told["optimizationChecklist"][:2] == ["Use a repo map instead of full workspace to reduce context", "Enable prompt caching if supported by your provider"]
    text = reports.to_markdown(told, scan)
    assert "**Model:** M \\*1\\* (`m1`)" in text and "- [ ] Enable prompt caching if supported by your provider" in text


def test_quality_follows_the_total(spark):
    row = models.score(spark.createDataFrame([MODEL], catalog.MODEL), 150_000, "debug").first()
    assert row.expected_quality == ("high" if row.total >= 0.7 else "medium" if row.total >= 0.5 else "low")


def test_empty_scan(spark):
    empty = spark.createDataFrame([], SCAN)
    told = reports.report(empty)
    assert told["summary"]["totalFiles"] == 0 and told["topFolders"] == [] and "# Workspace Model Report" in reports.to_markdown(told, empty)


def test_report_store(spark, scan, tmp_path):
    names = {catalog.save_report(reports.report(scan, scanned_at=at), str(tmp_path)): at for at in ("2026-01-01", "2026-02-01")}
    (tmp_path / "not a report!.json").write_text("{}")
    listed = catalog.list_reports(spark, str(tmp_path)).collect()
    assert [(r.id, r.generatedAt) for r in listed] == sorted(names.items(), key=lambda x: x[1], reverse=True)
    assert listed[0].summary.includedTokens == 100_000
    for wrong in ({}, [], reports.report(scan) | {"goal": 3}, reports.report(scan) | {"summary": {}}):
        with pytest.raises(ValueError):
            catalog.save_report(wrong, str(tmp_path))


def test_output_is_not_overwritten(tmp_path):
    catalog.write_text("a", str(tmp_path / "x"))
    with pytest.raises(FileExistsError):
        catalog.write_text("b", str(tmp_path / "x"))
    catalog.write_text("b", str(tmp_path / "x"), force=True)
    assert (tmp_path / "x").read_text() == "b"


def test_drift_report(spark, scan):
    now = spark.createDataFrame([(*ROWS[0][:5], 90_000, True), *ROWS[2:], (9, "n.ts", "TypeScript", 4, [], 5, True)], SCAN)
    text = reports.drift_markdown(scan, now, "t", max_percent=5.0, new_flags=True)
    assert "VIOLATION" in text and "percent: 10 exceeds 5" in text and "| `a/b&#124;c.ts` | 60,000 | 90,000 | +30,000 | +50% | — |" in text
    same = reports.drift_markdown(scan, scan, "t")
    assert "PASSED" in same and "Top Growing" not in same


def test_drift_of_saved_scans(spark, scan, tmp_path):
    now = spark.createDataFrame([(0, "a\\b|c.ts", "TypeScript", 1, ["secret"], 70_000, True), (1, "new.py", "Python", 1, [], 5, True), (2, ".env", "Unknown", 9, ["secret"], 3, False), (3, ".env", "Unknown", 9, [], 4, False)], SCAN)
    drift.save(scan, f"file://{tmp_path}/base", 3)
    drift.save(now, f"file://{tmp_path}/now", 3)
    base, later = drift.load(spark, f"file://{tmp_path}/base"), drift.load(spark, f"file://{tmp_path}/now")
    joined = drift.file_drift(base, later)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" in plan
    key = lambda r: r.path
    assert sorted(joined.collect(), key=key) == sorted(drift.file_drift(scan, now).collect(), key=key)
    found = drift.analyze(base, later, max_increase=0, new_flags=True)
    assert (found.summary.added, found.summary.removed, found.summary.modified, found.summary.unchanged) == (1, 2, 2, 0) and not found.passed
    assert [r.rule for r in found.violations] == ["new-risk-flags"] and [r.path for r in found.growing] == ["a/b|c.ts", "new.py", ".env"] and {r.folder for r in found.folders} == {".", "a", "a/d"}
    drift.save(now, f"file://{tmp_path}/base", 3)
    assert drift.analyze(drift.load(spark, f"file://{tmp_path}/base"), later, max_increase=0).passed


def test_report_written_by_executors(spark, tmp_path):
    rows = [(i, f"d/f{i}.ts", "TypeScript", 10, ["log-file"] if i % 2 else [], i, not i % 2) for i in range(5000)]
    scan = spark.createDataFrame(rows, SCAN).repartition(5)
    told = reports.report(scan)
    text = reports.to_markdown(told, scan)
    listed = [x for x in text.split("\n") if x.startswith("- `d/f")]
    assert listed == [f"- `d/f{i}.ts` — log-file" for i in range(1, 5000, 2)]
    reports.write_markdown(told, scan, f"file://{tmp_path}/out")
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).rstrip("\n") == text.rstrip("\n")


def test_sums_of_a_scan(scan):
    summed = workspace.sums(scan)
    views = {k: {r.name: r for r in workspace.view(summed, k).collect()} for k in ("total", "folder", "tree", "language", "flag")}
    total = views["total"][""]
    assert (total.files, total.included, total.tokens, total.included_tokens, total.large, total.flagged, total.included_bytes) == (4, 3, 100_003, 100_000, 1, 1, 400_120)
    assert {n: (r.tokens, r.included) for n, r in views["folder"].items()} == {"a": (60_000, 1), "a/d": (20_000, 1), ".": (20_003, 1)}
    assert {n: r.tokens for n, r in views["tree"].items()} == {".": 100_000, "a": 80_000, "a/d": 20_000}
    assert {n: r.percentage for n, r in views["language"].items()} == {"TypeScript": 0.6, "Python": 0.2, "Markdown": 0.2} and views["flag"]["secret"].files == 1
    trees = {r.name: r.tokens for r in workspace.largest_trees(summed).collect()}
    assert trees == {r.folder: r.tokens for r in workspace.top_folders(scan).collect()} == {".": 100_000, "a": 80_000, "a/d": 20_000}
    assert "Expand" not in summed._jdf.queryExecution().toString() and summed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
