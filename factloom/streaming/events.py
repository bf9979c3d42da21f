"""Structured Streaming: webhooks checked, typed, routed and taken once; hourly health, rung shares, single flight, connection states."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from factloom.sources.store import absent

# States of a connection and where each may go.
TRANSITIONS = {"pending": ["active", "pending_failed"], "pending_failed": ["pending", "deleted"], "active": ["active", "refresh_failing", "revoked"], "refresh_failing": ["active", "revoked"], "revoked": ["deleted"], "deleted": []}


# Members of a webhook; what each type needs.
WEBHOOK = """type string, operation string, success boolean, connectionId string, providerConfigKey string, provider string, syncType string, syncName string,
model string, startedAt string, modifiedAfter string, responseResults struct<added:bigint,updated:bigint,deleted:bigint>"""
OPERATIONS, SYNC_TYPES = ["creation", "override"], ["INITIAL", "INCREMENTAL", "FULL"]
FRESH_SECONDS = 300


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text, from two rounds of the built-in hash."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    pad = lambda b: F.lit(bytes(x ^ b for x in key.ljust(64, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def webhooks(raw: DataFrame, secrets: list[str], fresh_seconds: int = FRESH_SECONDS) -> DataFrame:
    """raw (body, signature, ts) with webhook_id (the body's sha256), event (a struct) and error.

    error: invalid_signature (of none of the secrets), invalid_payload (no JSON of a known type), stale (a sync that
    started too long before ts); null for a good one. Works on streams and tables.
    """
    signed = F.lit(False)
    for s in secrets:
        signed = signed | (F.col("signature") == hmac_sha256(F.col("body"), s))
    e = F.col("event")
    here = lambda *names: F.forall(F.array(*[e[n].isNotNull() for n in names]), lambda x: x)
    auth = (e["type"] == "auth") & e["operation"].isin(OPERATIONS) & here("success", "connectionId", "providerConfigKey", "provider")
    counts = e["responseResults"].isNull() | (F.least(*[F.coalesce(e["responseResults"][c], F.lit(-1)) for c in ("added", "updated", "deleted")]) >= 0)
    times = F.forall(F.array("event.startedAt", "event.modifiedAfter"), lambda t: t.isNull() | F.try_to_timestamp(t).isNotNull())
    sync = (e["type"] == "sync") & e["syncType"].isin(SYNC_TYPES) & here("syncName", "model", "connectionId", "providerConfigKey") & counts & times
    old = (e["type"] == "sync") & (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.try_to_timestamp("event.startedAt").cast("timestamp")) > fresh_seconds)
    error = F.when(~F.coalesce(signed, F.lit(False)), "invalid_signature").when(~F.coalesce(auth | sync, F.lit(False)), "invalid_payload").when(F.coalesce(old, F.lit(False)), "stale")
    return raw.withColumn("webhook_id", F.sha2("body", 256)).withColumn("event", F.from_json("body", WEBHOOK)).withColumn("error", error)


def queue_of(event: Column, error: Column) -> Column:
    """The queue that a checked webhook belongs to: auth or sync, and none for one with an error."""
    return F.when(error.isNotNull(), "none").when(event["type"].isin("auth", "sync"), event["type"])


def by_type(events: DataFrame) -> dict[str, DataFrame]:
    """Good webhooks by the queue they belong to: auth and sync."""
    good = events.filter("error is null")
    return {kind: good.filter(F.col("event.type") == kind) for kind in ("auth", "sync")}


def webhooks_once(raw: DataFrame, within: str = "1 hour") -> DataFrame:
    """raw (body, ts) with webhook_id, the body's sha256, each id once within the watermark."""
    return raw.withColumn("webhook_id", F.sha2("body", 256)).withWatermark("ts", within).dropDuplicatesWithinWatermark(["webhook_id"])


def is_fresh(sent: Column, received: Column, seconds: int = 300) -> Column:
    return F.abs(F.unix_seconds(received.cast("timestamp")) - F.unix_seconds(sent.cast("timestamp"))) <= seconds


def hourly_health(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per hour, domain and parser: fired and success of events (ts, domain, parser, success)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "domain", "parser").agg(F.count("*").alias("fired"), F.count_if("success").alias("success"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per user: sessions of events less than `gap` apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")


def rung_shares(events: DataFrame, rung: str = "llm", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, domain, fired, share: of the rungs (ts, domain, rung) that fired in a window, those of one rung."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "domain")
    return w.agg(F.count("*").alias("fired"), F.avg((F.col("rung") == rung).cast("double")).alias("share")).select(F.col("w.start").alias("start"), "domain", "fired", "share")


class InOrder(StatefulProcessor):
    """Takes the rows of a key one time after another: a row waits, in a map by its millisecond, until the watermark has
    passed it, and then a timer hands it to `step`, with those of the same millisecond in order.

    Chunks of rows are put away as they come, so no batch of a key is held; what waits is what the watermark allows to be late.
    """

    time = "ts"
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows array<string>")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """States of its own."""

    def step(self, key: tuple, row: dict) -> Iterator[tuple]:
        """What comes out of one row: (row, in the order of columns)."""
        raise NotImplementedError

    def expired(self, key: tuple, at: int) -> None:
        """A timer without waiting rows: one that step has set."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            micros = frame[self.time].astype("datetime64[us]").astype("int64")
            rest = frame.drop(columns=[self.time]).to_dict("records")
            new: dict[int, list[str]] = {}
            for at, row in zip(micros.tolist(), rest, strict=True):
                new.setdefault(at // 1000, []).append(json.dumps([at, {k: None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for k, v in row.items()}]))
            for at, texts in new.items():
                had = list(self.waiting.getValue((at,))[0]) if self.waiting.containsKey((at,)) else []
                self.waiting.updateValue((at,), (had + texts,))
                self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        out: list[tuple] = []
        if self.waiting.containsKey((at,)):
            texts = list(self.waiting.getValue((at,))[0])
            self.waiting.removeKey((at,))
            for micros, row in sorted((json.loads(t) for t in texts), key=lambda x: (x[0], json.dumps(x[1], sort_keys=True))):
                out += self.step(key, {self.time: pd.Timestamp(micros, unit="us"), **row})
        else:
            self.expired(key, at)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _Value:
    """A value state of a key of a table."""

    row: tuple | None = None

    def exists(self) -> bool:
        return self.row is not None

    def get(self) -> tuple | None:
        return self.row

    def update(self, row: tuple) -> None:
        self.row = row

    clear = lambda self: self.update(None)


class _Table:
    """What a processor needs of a handle where the rows are a table's: all times have passed, so no timer is needed."""

    def getValueState(self, name: str, schema: str) -> _Value:  # noqa: N802
        return _Value()

    def registerTimer(self, at: int) -> None:  # noqa: N802
        pass


def in_order(rows: DataFrame, key: str, processor: InOrder, schema: str) -> DataFrame:
    """What the processor gives for the rows of each key; rows has a watermark if it is a stream.

    A table is sorted and its rows go by one at a time, with the state of one key; on a stream states and timers are the
    store's. Rows without a time have no place and are left out.
    """
    rows = rows.filter(F.col(processor.time).isNotNull())
    if rows.isStreaming:
        return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    rest = [c for c in rows.columns if c not in (key, processor.time)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list = []
        for batch in batches:
            out: list[tuple] = []
            for of, time, *row in batch.itertuples(index=False, name=None):
                of = None if pd.isna(of) else of
                if last != [of]:
                    last = [of]
                    processor.handle = _Table()
                    processor.open(processor.handle)
                out += processor.step((of,), {processor.time: time, **dict(zip(rest, row, strict=True))})
            yield pd.DataFrame(out, columns=processor.columns)

    dealt = rows.repartition(key).sortWithinPartitions(key, processor.time, *rest)
    return dealt.select(key, processor.time, *rest).mapInPandas(run, schema)


class Jumps(InOrder):
    time, columns = "end", ["start", "domain", "fired", "share", "was"]

    def __init__(self, before: float, after: float):
        self.before, self.after = before, after

    def open(self, handle):
        self.last = handle.getValueState("last", "share double")

    def step(self, key, row):
        was = self.last.get()[0] if self.last.exists() else None
        self.last.update((row["share"],))
        if was is not None and was <= self.before and row["share"] >= self.after:
            yield pd.Timestamp(row["start"], unit="us"), key[0], row["fired"], row["share"], was


def jumps(events: DataFrame, before: float = 0.05, after: float = 0.40, rung: str = "llm", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, domain, fired, share, was: windows in which a rung's share is `after` or more, where the domain's window before
    had `before` or less; of events (ts, domain, rung), a stream or a table.

    Two operators with state in a chain: windows are summed, and when the watermark has passed one, it is compared with
    the last share of its domain, which is that domain's state. A window without events is none.
    """
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "domain")
    share = F.avg((F.col("rung") == rung).cast("double"))
    # the time of a window is its last moment: what follows goes by the same watermark
    shares = w.agg(F.count("*").alias("fired"), share.alias("share")).select(F.window_time("w").alias("end"), F.unix_micros(F.col("w.start").cast("timestamp")).alias("start"), "domain", "fired", "share")
    schema = "start timestamp, domain string, fired long, share double, was double"
    return in_order(shares, "domain", Jumps(before, after), schema)


class SingleFlight(InOrder):
    columns = ["key", "ts", "admitted"]

    def __init__(self, minutes: int):
        self.micros = minutes * 60_000_000

    def open(self, handle):
        self.held = handle.getValueState("held", "at long")

    def step(self, key, row):
        now = row["ts"].value // 1000
        free = not self.held.exists() or now - self.held.get()[0] >= self.micros
        if free:
            self.held.update((now,))
            self.handle.registerTimer((now + self.micros) // 1000 + 1)
        yield key[0], row["ts"], free

    def expired(self, key, at):
        if self.held.exists() and self.held.get()[0] + self.micros <= at * 1000:
            self.held.clear()


def single_flight(triggers: DataFrame, minutes: int = 15, late: str = "1 minute") -> DataFrame:
    """key, ts, admitted of triggers (key, ts): one that comes less than `minutes` after an admitted one isn't.

    Triggers are taken in the order of their times, whatever order they come in; each has its answer when the watermark
    has passed it. The time of the last admitted one is a key's state; it goes when it can hold up no more.
    """
    rows = triggers.select("key", "ts").withWatermark("ts", late)
    return in_order(rows, "key", SingleFlight(minutes), "key string, ts timestamp, admitted boolean")


def records_since(spark: SparkSession, path: str, schema: str, per_batch: int = 10) -> DataFrame:
    """A stream of the record files (JSON lines) that come to a folder: with a checkpoint, a run resumes after the last
    files it has stored, as a drain resumes at the last updated_at it has seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


class Connections(InOrder):
    columns = ["connection", "ts", "state", "rejected"]

    def open(self, handle):
        self.now = handle.getValueState("now", "state string, rejected long")

    def step(self, key, row):
        now, rejected = self.now.get() if self.now.exists() else ("pending", 0)
        if row["to"] in TRANSITIONS.get(now, []):
            now = row["to"]
        else:
            rejected += 1
        self.now.update((now, rejected))
        yield key[0], row["ts"], now, rejected


def connection_states(changes: DataFrame, late: str = "1 minute") -> DataFrame:
    """connection, ts, state, rejected: a connection's state after each of changes (connection, ts, to), in order of time.

    A change the graph doesn't allow leaves the state and is counted in rejected; a connection begins as pending. Changes of
    one moment are taken in the order of their names. On a stream a change has its answer when the watermark has passed it.
    """
    schema = "connection string, ts timestamp, state string, rejected long"
    return in_order(changes.select("connection", "ts", "to").withWatermark("ts", late), "connection", Connections(), schema)


def append_new(batch: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Append the rows of a micro-batch that the Parquet table at path doesn't hold; for foreachBatch.

    The table is partitioned by a hash of the key, and of what is stored only the batch's partitions and keys are read.
    """
    spark = batch.sparkSession
    own = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        here = [r[0] for r in own.select("_bucket").distinct().collect()]  # `buckets` numbers at most
        stored = spark.read.schema(own.schema).parquet(path).filter(F.col("_bucket").isin(here)).select(*keys)
        own = absent(own, stored, keys)
    else:
        own = absent(own, own.limit(0), keys)
    own.write.mode("append").partitionBy("_bucket").parquet(path)
