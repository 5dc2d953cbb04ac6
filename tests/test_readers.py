"""Readers over real files: order of appending, hidden pages."""

import json
import os

from pyspark.sql import functions as F

from tallyglass.sources import readers


def write(path, lines, when):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))
    os.utime(path, (when, when))


def test_append_order_does_not_depend_on_packing(spark, tmp_path):
    """Later written files come later whatever their names and sizes, rows in the order of their file."""
    folder = tmp_path / "requests"
    big = [{"request_id": f"r{i}", "kind": "request", "action_id": "a" * 50} for i in range(300)]
    write(folder / "z-first.json", big, 1_700_000_000)
    write(folder / "a-second.json", [{"request_id": "r0", "kind": "approve", "action_id": "x"}], 1_700_000_100)
    want = [f"r{i}" for i in range(300)] + ["r0"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.change_requests(spark, str(folder)).collect()
            rows.sort(key=lambda r: r["seq"])
            assert [r["seq"] for r in rows] == list(range(301)) and [r["request_id"] for r in rows] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_last_line_of_a_scenario_wins(spark, tmp_path):
    folder = tmp_path / "done"
    line = lambda s, v: {"score": {"scenario_id": s, "v": v}, "trace": {}}
    write(folder / "b.json", [line("s1", 1), line("s2", 1), line("s1", 2)], 1_700_000_000)
    write(folder / "a.json", [line("s2", 3)], 1_700_000_050)
    got = {r["scenario_id"]: json.loads(r["value"])["score"]["v"] for r in readers.finished_scenarios(spark, str(folder)).collect()}
    assert got == {"s1": 2, "s2": 3}


def test_hidden_pages_are_read_in_tasks(spark, tmp_path):
    body = "---\ntitle: T {}\n---\n" + "word " * 120
    for name in ("_index.md", "a/_index.md", "a/page.md", "_drafts/x.md"):
        path = tmp_path / "site" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body.format(name))
    assert all(isinstance(p, str) for p in readers.hidden_paths(spark, f"{tmp_path}/site"))
    pages = readers.markdown_corpus(spark, f"{tmp_path}/site", "https://x.org")
    assert sorted(r["path"] for r in pages.select("path").collect()) == ["_drafts/x.md", "_index.md", "a/_index.md", "a/page.md"]
    assert readers.read_files(spark, readers.hidden_paths(spark, f"{tmp_path}/site"), per_task=1).agg(F.count("*")).first()[0] == 3
