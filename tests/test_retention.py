"""Retention of event folders and exports: what expires, dry runs, grace, repeated and partial sweeps."""

import os

from tapewright.sources import retention as RT

DAY = 86_400_000
NOW = 1_725_460_252_000 + 40 * DAY  # forty days after 2024-09-04 14:30:52


def fill(top, name, modified_ms, files=("raw/okx/spot.json", "metadata.json")):
    for file in files:
        path = top / name / file if file else top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("[]")
        os.utime(path, (modified_ms / 1000, modified_ms / 1000))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_entries_are_listed_with_what_lies_below(spark, tmp_path):
    fill(tmp_path, "TIA_20240904_143052", 5000)
    fill(tmp_path, "file.csv", 7000, files=("",))
    (tmp_path / "empty").mkdir()
    got = {r["name"]: (r["is_folder"], r["files"], r["bytes"]) for r in RT.list_entries(spark, str(tmp_path)).collect()}
    assert got == {"TIA_20240904_143052": (True, 2, 4), "file.csv": (False, 1, 2), "empty": (True, 0, 0)}
    times = {r["name"]: r["modified_ms"] for r in RT.list_entries(spark, str(tmp_path)).collect()}
    assert times["TIA_20240904_143052"] == 5000 and times["file.csv"] == 7000 and times["empty"] > 10**12
    assert RT.list_entries(spark, f"{tmp_path}/nowhere").collect() == []


def test_what_expires(spark, tmp_path):
    fill(tmp_path, "TIA_20240904_143052", NOW)  # by the time in its name, however new its files
    fill(tmp_path, "A_B_20240904_143053", NOW)
    fill(tmp_path, "SUI_20241012_000000", 0)
    fill(tmp_path, "logs", 0)
    fill(tmp_path, "X_20249999_000000", 0)  # no time
    fill(tmp_path, "backup_1.tar.gz", NOW - 8 * DAY, files=("",))
    fill(tmp_path, "backup_2.tar.gz", NOW - 6 * DAY, files=("",))
    fill(tmp_path, "daily_export", NOW - 8 * DAY)
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    entries = RT.list_entries(spark, f"{tmp_path}/")
    assert names(RT.expired_events(entries, NOW)) == ["A_B_20240904_143053", "TIA_20240904_143052"]
    assert names(RT.expired_events(entries, NOW, keep_days=40)) == [] and names(RT.expired_events(entries, NOW + 1, keep_days=40)) == ["TIA_20240904_143052"]
    assert names(RT.expired_exports(entries, NOW)) == ["backup_1.tar.gz", "daily_export"]


def test_marks_wait_for_their_grace_and_sweeps_may_repeat(spark, tmp_path):
    top, tombstones = tmp_path / "data", f"{tmp_path}/tombstones"
    for name in ("A_20240101_000000", "B_20240101_000000", "C_20990101_000000"):
        fill(top, name, 1)
    fill(top, "old.tar.gz", NOW - 8 * DAY, files=("",))
    due = lambda: RT.expired_events(RT.list_entries(spark, str(top)), NOW).unionByName(RT.expired_exports(RT.list_entries(spark, str(top)), NOW))
    left = lambda: sorted(os.listdir(top))
    assert [r[3] for r in rows(RT.mark(due(), tombstones, NOW, dry_run=True))] == ["would mark"] * 3 and not os.path.exists(tombstones)
    assert RT.sweep(due(), tombstones, NOW + 9 * DAY).collect() == [] and len(left()) == 4  # nothing is removed unmarked
    assert [r[3] for r in rows(RT.mark(due(), tombstones, NOW))] == ["marked"] * 3
    assert RT.mark(due(), tombstones, NOW + 1).collect() == []  # marked once
    assert RT.sweep(due(), tombstones, NOW + DAY - 1).collect() == [] and len(left()) == 4
    # An export that was written again since it was marked has not expired.
    fill(top, "old.tar.gz", NOW, files=("",))
    # What an earlier attempt has removed counts as gone.
    plan = spark.createDataFrame(due().collect(), "path string, reason string, due_ms bigint")
    os.rename(top / "A_20240101_000000", tmp_path / "elsewhere")
    got = {(r["path"].rsplit("/", 1)[1], r["action"]) for r in RT.sweep(plan, tombstones, NOW + DAY).collect()}
    assert got == {("A_20240101_000000", "gone before"), ("B_20240101_000000", "removed")}
    assert left() == ["C_20990101_000000", "old.tar.gz"] and RT.sweep(due(), tombstones, NOW + DAY).collect() == []
