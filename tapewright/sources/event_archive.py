"""Event archives as a data source: one folder an event, raw trades and refined reports as JSON files.

    SYMBOL_yyyyMMdd_HHmmss/metadata.json
                           raw/<exchange>/<market type>.json              a list of trades, [] where there are none
                           refined/pump_events.json, top_users.json       lists
                           refined/summary.json, analysis_metadata.json, refined_analysis.json
                           refined/<exchange>_<market type>_pumps.json    a market's pumps
                           refined/<exchange>/analysis.json, top_users.json, metadata.json

Rows are (event, file, nth, body): one for each element of a list, ``nth`` from 0; one with nth -1 and no body where a list is
empty; one without nth for a file that is an object. A row that is written may hold several elements of a list, joined by commas; with
``whole``, a row that is read is a file's text as it is. Rows that are ``packed`` become files ``.json.gz`` of the same text, which
are read, named and chosen as those without ``.gz``. ``archive_rows`` makes them from the analytics' tables, ``write_archive``
writes them, and ``spark.read.format("event_archive")`` reads them back, also from archives that other programs wrote.

Tasks write below ``_temporary`` and name their files to the driver, which moves them into place, new events as one folder, once all have
ended well; a task that fails removes what it wrote, and a failed job the rest. A file is a list in one piece, so its
rows meet in one task (those of an event do), which holds one row at a time. A reader's task takes a group of event folders; filters
on event and file choose folders and files before any is opened, if ``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import contextlib
import gzip
import json
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from tapewright.functions.numbers import event_key, floor_window
from tapewright.functions.symbols import match_bases
from tapewright.operators.actors import actor_behaviour, exchange_comparison, exchange_insights
from tapewright.operators.pumps import pump_summary
from tapewright.schemas import MARKET_TYPES, VENUES

SCHEMA = "event string, file string, nth bigint, body string"
_ARROW = pa.schema([("event", pa.string()), ("file", pa.string()), ("nth", pa.int64()), ("body", pa.string())])
_EVENT = re.compile(r".+_\d{8}_\d{6}$")
_STAGED = "_temporary"
#: Rows of one batch that a reader hands over.
_BATCH = 1000
#: Characters of whole files after which a batch is handed over.
_BATCH_TEXT = 8 << 20
#: Moves that a commit has under way at a time.
_MOVES = 16
#: Packed files: end of their names, level of compression, and zlib's number for gzip.
_GZ, _LEVEL, _MEMBER = ".gz", 6, 31


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path)


@dataclass
class _Events(InputPartition):
    names: tuple[str, ...]

    def __init__(self, names: Iterable[str]) -> None:
        self.names = tuple(names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.per_task, self.whole = options["path"], int(options.get("eventsPerTask", "16")), options.get("whole") == "true"
        self.events: set[str] | None = None
        self.files: set[str] | None = None
        self.below = ""

    def partitions(self) -> list[_Events]:
        files, top = _open(self.path)
        listed = files.get_file_info(fs.FileSelector(top, allow_not_found=True))
        names = sorted(i.base_name for i in listed if i.type == fs.FileType.Directory and _EVENT.match(i.base_name) and (self.events is None or i.base_name in self.events))
        return [_Events(names[k : k + self.per_task]) for k in range(0, len(names), self.per_task)] or [_Events(())]

    def read(self, partition: _Events) -> Iterator[pa.RecordBatch]:
        files, top = _open(self.path)
        rows: list[tuple] = []
        held = 0
        for event in partition.names:
            listed = files.get_file_info(fs.FileSelector(f"{top}/{event}", recursive=True))
            names = sorted(i.path.split(f"/{event}/", 1)[1] for i in listed if i.type == fs.FileType.File and i.base_name.removesuffix(_GZ).endswith(".json"))
            for stored in names:
                name = stored.removesuffix(_GZ)
                if name.startswith(self.below) and (self.files is None or name in self.files):
                    for row in self._rows(files, top, event, name, stored):
                        rows.append(row)
                        held += len(row[3] or "")
                        if len(rows) == _BATCH or held >= _BATCH_TEXT:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, files: fs.FileSystem, top: str, event: str, name: str, stored: str) -> Iterator[tuple]:
        with files.open_input_stream(f"{top}/{event}/{stored}", compression=None) as stream:
            raw = stream.read()
        if stored != name:
            try:
                raw = gzip.decompress(raw)
            except (OSError, EOFError, zlib.error):
                yield event, name, None, None
                return
        if self.whole:
            yield event, name, None, raw.decode(errors="replace")
            return
        try:
            found = json.loads(raw)
        except ValueError:
            found = None
        if not isinstance(found, list):
            # A file that is cut off or broken is told by a row without nth and body.
            yield event, name, None, None if found is None else _dump(found)
        elif not found:
            yield event, name, -1, None
        else:
            for nth, element in enumerate(found):
                yield event, name, nth, _dump(element)


class _PruningReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on event and file and the start of file choose what is opened; Spark still checks every row."""
        narrow = lambda old, new: new if old is None else old & new
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("event",):
                self.events = narrow(self.events, values)
            elif values is not None and f.attribute == ("file",):
                self.files = narrow(self.files, values)
            elif isinstance(f, StringStartsWith) and f.attribute == ("file",):
                self.below = max(self.below, f.value, key=len)
            yield f


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: tuple[str, ...]


class _Text:
    """A file that is written. Packed bodies of a list become one compressed text, since they may be short; an object's is written as it is."""

    def __init__(self, stream: pa.NativeFile, *, packed: bool, listed: bool) -> None:
        self._stream, self._packed = stream, packed
        self._press = zlib.compressobj(_LEVEL, wbits=_MEMBER) if packed and listed else None

    def text(self, text: bytes) -> None:
        self._stream.write(self._press.compress(text) if self._press else _pack(text) if self._packed else text)

    def body(self, body: str | bytes) -> None:
        if self._press:
            self.text(zlib.decompress(body, _MEMBER))
        else:
            self._stream.write(body if self._packed else body.encode())

    def close(self) -> None:
        if self._press:
            self._stream.write(self._press.flush())
        self._stream.close()


def _pack(text: bytes) -> bytes:
    return gzip.compress(text, _LEVEL, mtime=0)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.end = _GZ if options.get("packed") == "true" else ""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, top = _open(self.path)
        folder = f"{_STAGED}/{self.job}/{uuid.uuid4().hex}"
        written: list[str] = []
        stream = None
        try:
            last, listed, nth = None, False, 0
            for batch in iterator:
                for event, file, number, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    name = f"{event}/{file}{self.end}"
                    if name != last:
                        if stream is not None:
                            stream.text(b"]\n" if listed else b"\n")
                            stream.close()
                        files.create_dir(f"{top}/{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                        last, listed, nth = name, number is not None, 0
                        stream = _Text(files.open_output_stream(f"{top}/{folder}/{name}", compression=None), packed=bool(self.end), listed=listed)
                        written.append(name)
                        if listed:
                            stream.text(b"[")
                    if number is None and nth:
                        raise ValueError(f"{name} has two objects")
                    if body is not None:
                        if nth:
                            stream.text(b",\n")
                        stream.body(body)
                        nth += 1
            if stream is not None:
                stream.text(b"]\n" if listed else b"\n")
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
            with contextlib.suppress(OSError):
                files.delete_dir(f"{top}/{folder}")
            raise
        return _Written(folder, tuple(written))

    def commit(self, messages: list[_Written | None]) -> None:
        files, top = _open(self.path)
        done = [m for m in messages if m is not None]
        twice = [name for name, n in Counter(name for m in done for name in m.files).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several tasks wrote {twice[0]}; rows of a file must be in one task, in order")
        there = {i.base_name for i in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.type == fs.FileType.Directory}
        if self.overwrite:
            for old in sorted(name for name in there if _EVENT.match(name)):
                files.delete_dir(f"{top}/{old}")
                there.discard(old)
        # An event that is new and one task's is a folder to move; object stores have no folders.
        events = [(m, sorted({name.split("/", 1)[0] for name in m.files})) for m in done]
        tasks = Counter(event for _, names in events for event in names)
        new = {event for event, n in tasks.items() if n == 1 and event not in there} if files.type_name in ("local", "hdfs") else set()
        moves = [(m.folder, event) for m, names in events for event in names if event in new]
        moves += [(m.folder, name) for m in done for name in m.files if name.split("/", 1)[0] not in new]

        def move(one: tuple[str, str]) -> None:
            folder, name = one
            if "/" in name:
                files.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
                # The file of that name goes, packed or not.
                for old in (name.removesuffix(_GZ), name.removesuffix(_GZ) + _GZ):
                    if files.get_file_info(f"{top}/{old}").type == fs.FileType.File:
                        files.delete_file(f"{top}/{old}")
            files.move(f"{top}/{folder}/{name}", f"{top}/{name}")

        with ThreadPoolExecutor(_MOVES) as pool:
            list(pool.map(move, moves))
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        """Removes what is left of the job, and the folder of jobs if none is under way."""
        files, top = _open(self.path)
        for folder in (f"{top}/{_STAGED}/{self.job}", f"{top}/{_STAGED}"):
            if files.get_file_info(folder).type == fs.FileType.Directory and (folder.endswith(self.job) or not files.get_file_info(fs.FileSelector(folder))):
                files.delete_dir(folder)


class EventArchive(DataSource):
    """``spark.read.format("event_archive").load(path)``; for writing see ``write_archive``."""

    @classmethod
    def name(cls) -> str:
        return "event_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return (_PruningReader if self.options.get("prune") == "true" else _Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def read_archive(spark: SparkSession, path: str, *, whole: bool = False) -> DataFrame:
    """Rows of an archive, one for each element of a list; ``whole``: one for each file, with its text, which Spark may then read."""
    spark.dataSource.register(EventArchive)
    return spark.read.format("event_archive").option("prune", spark.conf.get("spark.sql.python.filterPushdown.enabled")).option("whole", str(whole).lower()).load(path)


def write_archive(rows: DataFrame, path: str, *, mode: str = "append") -> None:
    """Rows of an event meet in one task, those of a file in order; a file that exists is replaced, with ``overwrite`` all events are."""
    rows.sparkSession.dataSource.register(EventArchive)
    ordered = rows.select("event", "file", "nth", "body").repartition("event").sortWithinPartitions("event", "file", "nth")
    ordered.write.format("event_archive").option("packed", str(dict(rows.dtypes)["body"] == "binary").lower()).mode(mode).save(path)


def packed(rows: DataFrame) -> DataFrame:
    """Rows whose body is compressed, before it is dealt and sorted; ``write_archive`` makes compressed files of them."""
    bodies = [c == "body" for c in rows.columns]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([None if v is None else _pack(v.encode()) for v in c.to_pylist()], pa.binary()) if is_body else c for c, is_body in zip(batch.columns, bodies, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(pack, ", ".join(f"`{c}` {'binary' if c == 'body' else kind}" for c, kind in rows.dtypes))


def event_names(listings: DataFrame) -> DataFrame:
    """(event_id, event): the folder of each listing; more listings of one coin in one second are numbered after the coin."""
    base, second = F.regexp_replace("symbol", "USDT$", ""), F.floor(F.col("trigger_ms") / 1000)
    nth = F.row_number().over(Window.partitionBy(base, second).orderBy("trigger_ms", "event_id"))
    numbered = F.when(nth == 1, base).otherwise(F.concat(base, F.lit("-"), nth.cast("string")))
    return listings.select("event_id", event_key(numbered, F.col("trigger_ms")).alias("event"))


def shared_rows(listings: DataFrame, trades: DataFrame, *, pre_ms: int = 20_000, post_ms: int = 20_000, block_ms: int = 10_000) -> DataFrame:
    """An archive's rows where events overlap: raw trades in a folder for each coin and block of time, not once for each event.

    An event's folder has its interval and the folders of its blocks in ``metadata.json``; ``read_event`` reads them.
    """
    block = lambda t: floor_window(t, block_ms)
    folder = lambda base, at: event_key(F.concat(base, F.lit("~"), at.cast("string")), at)
    step = F.lit(block_ms).cast("bigint")
    spans = listings.select("event_id", F.col("symbol").alias("base"), (F.col("trigger_ms") - pre_ms).alias("from_ms"), (F.col("trigger_ms") + post_ms).alias("to_ms"))
    spans = spans.withColumn("at", F.sequence(block(F.col("from_ms")), block(F.col("to_ms")), step))
    base = F.col("base")
    body = F.to_json(F.struct("event_id", base.alias("symbol"), "from_ms", "to_ms", F.transform("at", lambda t: folder(base, t)).alias("blocks")))
    meta = spans.join(event_names(listings), "event_id").select("event", F.lit("metadata.json").alias("file"), F.lit(None).cast("bigint").alias("nth"), body.alias("body"))
    wanted = spans.select("base", F.explode("at").alias("at")).distinct()
    found = trades.withColumns({"base": F.explode(match_bases(F.col("symbol"))), "at": block(F.col("ts_ms"))}).join(wanted, ["base", "at"], "left_semi")
    trade = F.to_json(F.struct("exchange", "market_type", "symbol", "trade_id", "price", "quantity", "side", F.col("ts_ms").alias("timestamp")))
    return meta.unionByName(found.select(folder(base, F.col("at")).alias("event"), F.format_string("raw/%s/%s.json", "exchange", "market_type").alias("file"), F.col("ts_ms").alias("nth"), trade.alias("body")))


def read_event(spark: SparkSession, path: str, event: str, *, market_type: str | None = None) -> DataFrame:
    """Trades (file, body) of one event of an archive of ``shared_rows``; with pushed filters only its blocks' files are opened."""
    file = F.col("file")
    meta = json.loads(read_archive(spark, path).where((F.col("event") == event) & (file == "metadata.json")).first()["body"])
    kind = file.endswith(f"/{market_type}.json") if market_type else F.lit(True)
    rows = read_archive(spark, path).where(F.col("event").isin(meta["blocks"]) & file.startswith("raw/") & (F.col("nth") >= 0) & kind)
    at = F.get_json_object("body", "$.timestamp").cast("bigint")
    return rows.where(at.between(meta["from_ms"], meta["to_ms"])).select(F.lit(event).alias("event"), "file", "body")


def _time(ms: str | Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def _text(value: str | Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def _pump(pumps: DataFrame) -> Column:
    """A pump as the reports name its parts."""
    return F.struct(
        "exchange", "market_type", "symbol", _time("start_ms").alias("start_time"), _time("end_ms").alias("end_time"), "duration_ms", _text("start_price", 8).alias("start_price"), _text("peak_price", 8).alias("peak_price"),
        F.col("price_change").alias("price_change_percent"), _text("volume", 8).alias("volume"), "trade_count", _time("trigger_ms").alias("trigger_time"), (F.col("start_ms") - F.col("trigger_ms")).alias("relative_time_ms"),
    )


def described_pumps(pumps: DataFrame) -> DataFrame:
    """Pumps with ``pump``, their text in the reports; save them, since several reports have it."""
    return pumps.withColumn("pump", _pump(pumps))


def described_actors(found: DataFrame) -> DataFrame:
    """Actors, of coins or of events, with ``told``, their text in the reports as far as no event plays a part; save them, too."""
    return found.withColumn("told", F.struct(
        _time("first_ms").alias("first"), _time("last_ms").alias("last"), _text("start_price", 8).alias("start"), _text("end_price", 8).alias("end"), _text("vwap", 4).alias("average"), _text("notional", 2).alias("volume"), _text("quantity", 4).alias("quantity"),
    ))


def _user() -> Column:
    return F.struct(
        F.col("actor_id").alias("user_id"), F.col("told.first").alias("first_trade_time"), F.col("told.last").alias("last_trade_time"), F.col("duration_ms").alias("trading_duration_ms"), F.col("told.start").alias("start_price"),
        F.col("told.end").alias("end_price"), F.col("told.average").alias("average_price"), F.col("told.volume").alias("total_usdt_volume"), F.col("told.quantity").alias("total_quantity"), "trade_count", "exchange_trades",
        F.col("relative_ms").alias("relative_time_ms"), F.col("rank").alias("user_rank"),
    )


def _raw() -> tuple[Column, Column, Column]:
    """File, place in it and body of a trade."""
    body = F.to_json(F.struct("exchange", "market_type", "symbol", "trade_id", "price", "quantity", "side", F.col("ts_ms").alias("timestamp")))
    # Order in the file is by time; the file's number of a trade follows from the sort of the writer, so no window numbers them.
    nth = F.col("ts_ms") * 1024 + F.abs(F.xxhash64("trade_id") % 1024)
    return F.concat(F.lit("raw/"), F.col("exchange"), F.lit("/"), F.col("market_type"), F.lit(".json")).alias("file"), nth.alias("nth"), body.alias("body")


def raw_rows(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (event_id, file, nth, body) of trades around listings, and what there is in each event's markets."""
    info = found.groupBy("event_id", "exchange", "market_type").agg(F.count(F.lit(1)).alias("total_trades"), F.min("ts_ms").alias("first_trade_time"), F.max("ts_ms").alias("last_trade_time"))
    return found.select("event_id", *_raw()), info


def raw_blocks(listings: DataFrame, trades: DataFrame, windows: DataFrame, *, pre_ms: int = 20_000, post_ms: int = 20_000, block_ms: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """``raw_rows`` without the join of listings and trades: a row has an event's trades of one file and block of time.

    A trade's body is made once, not once an event, and an event takes its part of each block's list. ``windows`` are ``event_windows``.
    """
    start = lambda t: floor_window(t, block_ms)
    t = F.col("trigger_ms")
    spans = listings.select("event_id", F.col("symbol").alias("base"), (t - pre_ms).alias("from_ms"), (t + post_ms).alias("to_ms"))
    spans = spans.withColumn("at", F.explode(F.sequence(start(F.col("from_ms")), start(F.col("to_ms")), F.lit(block_ms).cast("bigint"))))
    key, spark = ["base", "at"], trades.sparkSession
    named = trades.withColumns({"base": F.explode(match_bases(F.col("symbol"))), "at": start(F.col("ts_ms"))}).join(spans.select(*key).distinct(), key, "left_semi")
    file, nth, body = _raw()
    # A list holds a market's trades of one block.
    blocks = named.select(*key, "ts_ms", file, nth, body).groupBy(*key, "file").agg(F.sort_array(F.collect_list(F.struct("nth", "ts_ms", "body"))).alias("trades"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    near = F.filter("trades", lambda t: t["ts_ms"].between(F.col("from_ms"), F.col("to_ms")))
    rows = blocks.repartition(tasks, *key).join(spans.repartition(tasks, *key), key)
    rows = rows.select("event_id", "file", (F.col("at") * 1024).alias("nth"), F.array_join(F.transform(near, lambda t: t["body"]), ",\n").alias("body")).where("body <> ''")
    info = windows.groupBy("event_id", "exchange", "market_type").agg(F.sum("trade_count").alias("total_trades"), F.min("first_ms").alias("first_trade_time"), F.max("last_ms").alias("last_trade_time"))
    return rows, info


def _in_order(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """An ordered list of values a key; used for pumps and actors of one event, which its short window bounds."""
    before = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    listed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), value.alias("v"))), before)
    return rows.groupBy(*keys).agg(F.transform(listed, lambda r: r["v"]).alias(name))


def archive_rows(listings: DataFrame, raw: DataFrame, info: DataFrame, pumps: DataFrame, ranked: DataFrame, *, analyzed_ms: int, venues: tuple[str, ...] = VENUES, top: int = 10, pack: bool = False) -> DataFrame:
    """All files of all listings as rows (event, file, nth, body), ``packed`` if asked for, before they are joined with anything.

    ``raw`` and ``info`` are those of ``raw_rows`` or ``raw_blocks``, ``pumps`` are ``described_pumps`` by event and market and ``ranked`` the
    ``described_actors`` of the pumps with their rank. Every listing gets its metadata and a raw file for each market of ``venues``, those with pumps their reports.
    """
    names = event_names(listings)
    analyzed = _time(F.lit(analyzed_ms))
    one = lambda rows, file, *body: rows.select("event_id", (F.lit(file) if isinstance(file, str) else file).alias("file"), F.lit(None).cast("bigint").alias("nth"), F.to_json(F.struct(*body)).alias("body"))

    every = F.array(*[F.lit(f"raw/{v}/{m}.json") for v in venues for m in MARKET_TYPES])
    empty = listings.select("event_id", F.explode(every).alias("file"), F.lit(-1).cast("bigint").alias("nth"), F.lit(None).cast("string").alias("body"))
    base = F.regexp_replace("symbol", "USDT$", "")
    meta = one(listings, "metadata.json", base.alias("symbol"), "title", "markets", _time("announced_ms").alias("announced_at"), _time("detected_ms").alias("detected_at"), _time("trigger_ms").alias("trigger_time"),
               F.array_contains("markets", "KRW").alias("is_krw_listing"), analyzed.alias("stored_at"))

    def elements(rows: DataFrame, column: str, file: str | Column) -> DataFrame:
        """A list's elements in one row, which is packed as one."""
        body = F.array_join(F.transform(column, lambda v: F.to_json(v)), ",\n")
        return rows.where(F.size(column) > 0).select("event_id", (F.lit(file) if isinstance(file, str) else file).alias("file"), F.lit(0).cast("bigint").alias("nth"), body.alias("body"))

    pump = F.col("pump")
    by_event = _in_order(pumps, ["event_id"], ["start_ms", "exchange", "market_type", "symbol"], pump, "pump_events")
    user = _user()
    users = _in_order(ranked, ["event_id"], ["rank"], user, "user_analysis").withColumn("top_users", F.slice("user_analysis", 1, top))
    totals = pump_summary(pumps)
    first_ms = pumps.groupBy("event_id").agg(F.min("start_ms").alias("from_ms"), F.min("trigger_ms").alias("trigger_ms"), F.min("symbol").alias("symbol"), F.size(F.collect_set("exchange")).alias("pump_exchanges"))
    summary = F.struct(
        F.col("pump_exchanges").alias("total_exchanges"), F.col("max_change").alias("max_price_change"), F.substring_index("first_market", "_", 1).alias("first_pump_exchange"), F.col("duration_ms").alias("pump_duration_ms"), _text("total_volume", 4).alias("total_volume")
    )
    window = F.struct(_time("from_ms").alias("start_time"), _time(F.col("from_ms") + 10_000).alias("end_time"), F.lit(10_000).alias("duration_ms"))
    insights = exchange_insights(pumps, ranked)
    insight_rows = _in_order(insights.join(actor_behaviour(ranked), ["event_id", "exchange"], "left"), ["event_id"], ["exchange"], F.struct(
        F.col("exchange").alias("exchange_name"), _time("first_pump_ms").alias("first_pump_time"), F.col("first_relative_ms").alias("relative_pump_time_ms"), F.col("pump_count").alias("pump_event_count"), F.col("max_change").alias("max_price_change"),
        F.col("avg_change").alias("average_price_change"), F.col("actor_count").alias("user_count"), _text("actor_volume", 2).alias("total_volume"), _text("volume_per_actor", 1).alias("average_user_volume"),
        F.struct(F.col("avg_trades").alias("average_trades_per_user"), F.col("median_entry_ms").alias("median_entry_time_ms"), F.col("early").alias("early_traders"), F.col("regular").alias("regular_traders"), F.col("late").alias("late_traders"), F.col("large").alias("high_volume_traders")).alias("user_behavior"),
    ), "exchange_insights")
    comparison = exchange_comparison(insights).select("event_id", F.struct(
        F.col("fastest").alias("fastest_exchange"), F.col("slowest").alias("slowest_exchange"), F.col("most_active").alias("most_active_exchange"), F.col("highest_volume").alias("highest_volume_exchange"), F.col("spread_ms").alias("reaction_time_spread_ms"),
        F.split("ranking", ",").alias("exchange_ranking"),
    ).alias("exchange_comparison"))
    whole = totals.join(first_ms, "event_id").join(by_event, "event_id").join(users, "event_id", "left").join(insight_rows, "event_id", "left").join(comparison, "event_id", "left")
    metadata = lambda symbol, exchanges, version: (symbol.alias("symbol"), _time("trigger_ms").alias("trigger_time"), analyzed.alias("analysis_time"), exchanges.alias("total_exchanges"), F.col("pumps").alias("total_pump_events"), F.col("max_change").alias("max_price_change"), F.lit(version).alias("analysis_version"))
    reports = [
        one(whole, "refined/summary.json", summary["total_exchanges"].alias("total_exchanges"), summary["max_price_change"].alias("max_price_change"), summary["first_pump_exchange"].alias("first_pump_exchange"), summary["pump_duration_ms"].alias("pump_duration_ms"), summary["total_volume"].alias("total_volume")),
        one(whole, "refined/analysis_metadata.json", *metadata(F.col("symbol"), F.col("pump_exchanges"), "2.1")),
        one(whole, "refined/refined_analysis.json", "pump_events", "user_analysis", summary.alias("summary"), "top_users", "exchange_insights", "exchange_comparison", window.alias("analysis_window")),
        elements(whole, "pump_events", "refined/pump_events.json"),
        elements(whole, "top_users", "refined/top_users.json"),
    ]

    # A market's pumps, and what the trades around the listing say of it.
    key = ["event_id", "exchange", "market_type"]
    market_pumps = _in_order(pumps, key, ["start_ms", "symbol"], pump, "pump_events").join(info, key)
    about = F.struct("exchange", "market_type", "total_trades", F.size("pump_events").alias("pump_events_count"), "first_trade_time", "last_trade_time")
    reports.append(one(market_pumps, F.concat(F.lit("refined/"), F.col("exchange"), F.lit("_"), F.col("market_type"), F.lit("_pumps.json")), about.alias("exchange_info"), "pump_events"))

    # An exchange's pumps and the actors that traded there, with what they did everywhere.
    there = ranked.withColumn("exchange", F.explode(F.array_distinct(F.transform(F.map_keys("exchange_trades"), lambda m: F.substring_index(m, "_", 1)))))
    own_users = _in_order(there, ["event_id", "exchange"], ["rank"], user, "user_analysis").withColumn("top_users", F.slice("user_analysis", 1, top))
    own = _in_order(pumps, ["event_id", "exchange"], ["start_ms", "market_type", "symbol"], pump, "pump_events").join(own_users, ["event_id", "exchange"], "full_outer")
    own = own.withColumns({"pump_events": F.coalesce("pump_events", F.array()), "user_analysis": F.coalesce("user_analysis", F.array()), "top_users": F.coalesce("top_users", F.array())})
    own = own.join(totals.select("event_id", F.col("duration_ms"), F.col("total_volume")), "event_id").join(first_ms.select("event_id", "from_ms", "trigger_ms"), "event_id")
    own = own.withColumns({"pumps": F.size("pump_events"), "max_change": F.coalesce(F.array_max(F.transform("pump_events", lambda p: p["price_change_percent"])), F.lit(0.0))})
    file = lambda name: F.concat(F.lit("refined/"), F.col("exchange"), F.lit(f"/{name}.json"))
    own_summary = F.struct(F.lit(1).alias("total_exchanges"), F.col("max_change").alias("max_price_change"), F.col("exchange").alias("first_pump_exchange"), F.col("duration_ms").alias("pump_duration_ms"), _text("total_volume", 4).alias("total_volume"))
    reports += [
        one(own, file("analysis"), "pump_events", "user_analysis", own_summary.alias("summary"), "top_users", window.alias("analysis_window")),
        one(own, file("metadata"), *metadata(F.col("exchange"), F.lit(1), "2.1-exchange")),
        elements(own, "top_users", file("top_users")),
    ]
    rows = raw.unionByName(empty).unionByName(meta)
    for report in reports:
        rows = rows.unionByName(report)
    return (packed(rows) if pack else rows).join(names, "event_id").select("event", "file", "nth", "body")
