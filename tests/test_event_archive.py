"""The event archive as a data source: layout, foreign and broken files, failed jobs, pruning."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tapewright.operators.collect import listing_trades
from tapewright.operators.pumps import event_windows
from tapewright.plans import stored
from tapewright.sources import event_archive as EA
from tapewright.sources import readers, writers

A, B = "TIA_20240904_143052", "SUI-2_20240101_000000"


def files_of(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def rows(spark, found):
    return spark.createDataFrame(found, EA.SCHEMA)


def test_lists_objects_and_empty_lists(spark, tmp_path):
    path = str(tmp_path / "archive")
    given = [(A, "metadata.json", None, '{"symbol":"TIA","title":"티아(TIA)"}'), *[(A, "raw/okx/spot.json", k, json.dumps({"n": k, "t": "x\ny,]"}, separators=(",", ":"))) for k in range(2500)], (A, "raw/okx/futures.json", -1, None), (B, "raw/okx/spot.json", -1, None), (B, "raw/okx/spot.json", 7, "{}")]
    EA.write_archive(rows(spark, given), path)
    assert files_of(path) == sorted([f"{A}/metadata.json", f"{A}/raw/okx/futures.json", f"{A}/raw/okx/spot.json", f"{B}/raw/okx/spot.json"])
    assert json.load(open(f"{path}/{A}/raw/okx/spot.json"))[2499]["n"] == 2499 and json.load(open(f"{path}/{A}/raw/okx/futures.json")) == []
    want = [g for g in given if g[:2] != (B, "raw/okx/spot.json")] + [(B, "raw/okx/spot.json", 0, "{}")]
    assert sorted(map(repr, map(tuple, EA.read_archive(spark, path).collect()))) == sorted(map(repr, want))
    # Appending replaces files of the same name and leaves the others; overwriting replaces all events.
    EA.write_archive(rows(spark, [(A, "metadata.json", None, '{"symbol":"new"}')]), path)
    assert json.load(open(f"{path}/{A}/metadata.json")) == {"symbol": "new"} and len(files_of(path)) == 4
    EA.write_archive(rows(spark, [(B, "refined/summary.json", None, "{}")]), path, mode="overwrite")
    assert files_of(path) == [f"{B}/refined/summary.json"]


def test_foreign_and_broken_files(spark, tmp_path):
    raw = tmp_path / A / "raw" / "gate"
    raw.mkdir(parents=True)
    (raw / "spot.json").write_text(json.dumps([{"price": "1.5"}, {"price": "2"}], indent=2))
    (raw / "futures.json").write_text("null")
    (tmp_path / A / "refined").mkdir()
    (tmp_path / A / "refined" / "summary.json").write_text('{"cut": ')
    (tmp_path / A / "notes.txt").write_text("not JSON")
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.json").write_text("[1]")
    got = sorted(tuple(r) for r in EA.read_archive(spark, str(tmp_path)).collect() if r["nth"] is not None)
    assert got == [(A, "raw/gate/spot.json", 0, '{"price":"1.5"}'), (A, "raw/gate/spot.json", 1, '{"price":"2"}')]
    assert {tuple(r) for r in EA.read_archive(spark, str(tmp_path)).where("nth is null").collect()} == {(A, "refined/summary.json", None, None), (A, "raw/gate/futures.json", None, None)}
    assert EA.read_archive(spark, str(tmp_path / "nowhere")).collect() == []


def test_failed_jobs_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "archive")
    EA.write_archive(rows(spark, [(A, "metadata.json", None, "{}")]), path)
    # Many good files, and one that two objects claim: its task fails, the others are undone.
    bad = [(f"C{k}_20240101_000000", "metadata.json", None, "{}") for k in range(50)] + [(B, "metadata.json", None, "{}")] * 2
    with pytest.raises(Exception, match="two objects"):
        EA.write_archive(rows(spark, bad), path)
    assert files_of(path) == [f"{A}/metadata.json"] and os.listdir(path) == [A]
    # Rows of one file in two tasks are found when the job commits.
    spark.dataSource.register(EA.EventArchive)
    with pytest.raises(Exception, match="several tasks"):
        rows(spark, [(B, "metadata.json", None, "{}")] * 2).repartition(2).write.format("event_archive").mode("append").save(path)
    assert files_of(path) == [f"{A}/metadata.json"] and os.listdir(path) == [A]


def test_filters_choose_folders_and_files(tmp_path):
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    for event in (A, B):
        for file in ("raw/okx/spot.json", "refined/summary.json"):
            target = tmp_path / event / file
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text("[1]")

    def opened(*filters):
        reader = EA.EventArchive({"path": str(tmp_path), "prune": "true"}).reader(None)
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return {tuple(r.values())[:2] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()}

    assert len(opened()) == 4
    assert opened(EqualTo(("event",), A), StringStartsWith(("file",), "raw/")) == {(A, "raw/okx/spot.json")}
    assert opened(In(("event",), (A, "other")), EqualTo(("file",), "refined/summary.json")) == {(A, "refined/summary.json")}
    assert opened(EqualTo(("event",), A), EqualTo(("event",), B)) == set()


def test_listings_of_one_second_get_folders_of_their_own(spark):
    listings = spark.createDataFrame([("1", "SYMUSDT", 1725460252100), ("2", "SYM", 1725460252900), ("3", "SYM", 1725460253000)], "event_id string, symbol string, trigger_ms bigint")
    assert {tuple(r) for r in EA.event_names(listings).collect()} == {("1", "SYM_20240904_143052"), ("2", "SYM-2_20240904_143052"), ("3", "SYM_20240904_143053")}


@pytest.fixture()
def overlapping(spark):
    """Fifty listings of one coin within half a second, one with no trades, and two that share an id."""
    marks = [(f"e{i}", "A", 53_000 + 10 * i) for i in range(50)] + [("none", "C", 53_000), ("twice", "A", 53_000), ("twice", "A", 61_000), ("later", "A", None)]
    rows = [("okx" if i % 3 else "gate", "spot" if i % 2 else "futures", "AUSDT", str(i), "1", "2", "buy", 30_000 + 97 * i) for i in range(600)]
    listings = spark.createDataFrame(marks, "event_id string, symbol string, trigger_ms bigint")
    return listings, spark.createDataFrame(rows, "exchange string, market_type string, symbol string, trade_id string, price string, quantity string, side string, ts_ms bigint")


def test_overlapping_events_store_a_trade_once(spark, tmp_path, overlapping):
    listings, trades = overlapping
    writers.write_event_archive(listings, trades, {}, str(tmp_path))
    events, stored = readers.read_event_archive(spark, str(tmp_path))
    assert stored.count() == stored.select("trade_id").distinct().count() <= 600
    joined = listing_trades(listings, trades)
    pairs = lambda rows: sorted(map(tuple, rows.select("event_id", "trade_id", "price", "side", "trigger_ms").collect()))
    assert pairs(readers.event_trades(events, stored)) == pairs(joined) and joined.count() > 15_000
    want = joined.groupBy("event_id", "exchange", "market_type").agg(F.count("*").alias("trades"), F.min("ts_ms").alias("first_ms"))
    got = readers.archived_counts(events, stored)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_one_event_is_read_from_shared_blocks(spark, tmp_path, overlapping):
    listings, trades = overlapping
    listings = listings.where("event_id <> 'twice' and trigger_ms is not null")
    rows = EA.shared_rows(listings, trades)
    assert rows.where("file like 'raw/%'").count() <= 600
    EA.write_archive(rows, str(tmp_path))
    names = {r["event_id"]: r["event"] for r in EA.event_names(listings).collect()}
    for event_id in ("e0", "e49", "none"):
        got = EA.read_event(spark, str(tmp_path), names[event_id], market_type="spot").select(F.get_json_object("body", "$.trade_id")).collect()
        want = listing_trades(listings, trades).where(f"event_id = '{event_id}' and market_type = 'spot'").select("trade_id").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and (len(want) > 150 or event_id == "none")


def test_archive_queries_do_not_join_listings_with_trades(spark, data, monkeypatch):
    """k05_s09, k05_archive_reports and s09 read ranges of shared trades; the pairs of events and trades are never made."""

    def never(*_, **__):
        raise AssertionError("all trades of all listings were joined")

    monkeypatch.setattr(stored, "listing_trades", never)
    for query in (stored.archive_round_trip, stored.archive_reports, stored.pruned_event_files):
        assert query(spark, data).columns


def test_event_files_do_not_join_listings_with_trades(spark, data, monkeypatch):
    """k05_event_files writes each event with all its trades, from bodies made once a trade."""

    def never(*_, **__):
        raise AssertionError("all trades of all listings were joined")

    monkeypatch.setattr(stored, "listing_trades", never)
    assert stored.event_files(spark, data).where("trades > 0").count() > 0


def test_blocks_of_trades_give_the_files_of_single_trades(spark, tmp_path, overlapping):
    listings, trades = overlapping
    listings = listings.where("event_id <> 'twice' and trigger_ms is not null")
    names = EA.event_names(listings)
    blocks, info = EA.raw_blocks(listings, trades, event_windows(listings, trades), pre_ms=20_000, post_ms=20_000)
    single, want_info = EA.raw_rows(listing_trades(listings, trades))
    assert blocks.count() * 4 < single.count()
    assert sorted(map(tuple, info.collect())) == sorted(map(tuple, want_info.collect()))
    for what, rows in (("blocks", blocks), ("single", single)):
        EA.write_archive(rows.join(names, "event_id"), str(tmp_path / what))
    text = lambda what: {name: (tmp_path / what / name).read_text() for name in files_of(tmp_path / what)}
    assert text("blocks") == text("single") and len(text("blocks")) == 50 * 4
    whole = EA.read_archive(spark, str(tmp_path / "blocks"), whole=True)
    assert {f"{r['event']}/{r['file']}": r["body"] for r in whole.collect()} == text("single")
    assert whole.agg(F.sum(F.json_array_length("body"))).first()[0] == EA.read_archive(spark, str(tmp_path / "blocks")).count() == single.count()


def test_packed_files_hold_the_same_text(spark, tmp_path, overlapping):
    """An archive whose files are compressed, before they are dealt: a fifth of the bytes at most, and nothing else differs."""
    listings, trades = overlapping
    listings = listings.where("event_id <> 'twice' and trigger_ms is not null")
    names = EA.event_names(listings)
    raw, _ = EA.raw_blocks(listings, trades, event_windows(listings, trades))
    given = raw.unionByName(listings.selectExpr("event_id", "'metadata.json' file", "cast(null as bigint) nth", "concat('{\"title\":\"티아\",\"at\":', trigger_ms, '}') body"))
    given = given.unionByName(listings.selectExpr("event_id", "'raw/phemex/spot.json' file", "-1L nth", "cast(null as string) body"))
    plain, small = str(tmp_path / "plain"), str(tmp_path / "small")
    EA.write_archive(given.join(names, "event_id"), plain)
    EA.write_archive(EA.packed(given).join(names, "event_id"), small)
    assert [f"{name}.gz" for name in files_of(plain)] == files_of(small)
    size = lambda path: sum(os.path.getsize(f"{path}/{name}") for name in files_of(path))
    assert size(small) * 5 < size(plain)
    for name in files_of(plain):
        assert gzip.open(f"{small}/{name}.gz").read() == open(f"{plain}/{name}", "rb").read()
    for whole in (True, False):
        assert sorted(map(repr, EA.read_archive(spark, small, whole=whole).collect())) == sorted(map(repr, EA.read_archive(spark, plain, whole=whole).collect()))
    # A file takes the place of the one of its name, packed or not; one that is cut off is told.
    one = names.where("event_id = 'e7'").first()["event"]
    EA.write_archive(rows(spark, [(one, "metadata.json", None, "{}")]), small)
    assert f"{one}/metadata.json" in files_of(small) and f"{one}/metadata.json.gz" not in files_of(small) and len(files_of(small)) == len(files_of(plain))
    cut = f"{small}/{one}/raw/okx/spot.json.gz"
    text = open(cut, "rb").read()
    open(cut, "wb").write(text[:-9])
    assert [tuple(r) for r in EA.read_archive(spark, small).where(f"event = '{one}' and file = 'raw/okx/spot.json'").collect()] == [(one, "raw/okx/spot.json", None, None)]


def test_event_files_are_packed(spark, data, monkeypatch):
    """k05_event_files: every file that it writes is compressed, and none of it is dealt as plain text."""
    seen = []
    real = EA.write_archive
    monkeypatch.setattr(EA, "write_archive", lambda rows, path, **options: (seen.append((dict(rows.dtypes)["body"], path)), real(rows, path, **options)))
    assert stored.event_files(spark, data).columns
    [(kind, path)] = seen
    assert kind == "binary" and {os.path.splitext(name)[1] for name in files_of(path)} == {".gz"}
