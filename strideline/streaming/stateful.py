"""Stateful operators of the streams: prices that expire, parlays that wait for their legs, ratings that go on from a table.

Each keeps keyed state in RocksDB on the executors, checkpointed to the shared folder, so a restart goes on where the last
batch ended. Event time and a watermark say when a key's state may go.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from datetime import timedelta
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideline.operators import ratings
from strideline.streaming.ticks import LATE

#: The store that these operators need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 86_400_000


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


def _us(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class Timer:
    """One event-time timer of a key, moved on as rows come; its time is kept beside the key's own state."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.at = handle, handle.getValueState("timer", "at long")

    def set(self, ms: int) -> None:
        if self.at.exists():
            if (old := self.at.get()[0]) >= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.at.update((ms,))

    def clear(self) -> None:
        self.at.clear()


PRICES = "game_id long, market_side string, open double, open_us long, close double, close_us long, ended boolean"
KEY = ["game_id", "market_side"]
#: Groups that keys are dealt to. A group's keys are moved on together, in one step of pandas for each ``TOLD`` ticks or more.
DEALT, TOLD = 64, 100_000
HELD = {"game_id": "Int64", "market_side": "object", "open": "float64", "open_us": "Int64", "close": "float64", "close_us": "Int64", "last_us": "Int64"}
GROUP = "game_id array<long>, market_side array<string>, open array<double>, open_us array<long>, close array<double>, close_us array<long>, last_us array<long>"


def _moved_prices(held: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
    """The prices of each key after a frame of ticks: an equal time leaves the open and moves the close."""
    us, known = _us(frame["ts"]).astype("Int64"), frame["price"].notna()
    told = frame[KEY].assign(open=frame["price"], open_us=us.where(known), close=frame["price"], close_us=us.where(known), last_us=us).astype(HELD)
    both = pd.concat([held, told], ignore_index=True) if len(held) else told
    of = lambda rows: rows.groupby(KEY, dropna=False, sort=False)
    first = of(both.sort_values("open_us", kind="stable", na_position="last"))[["open", "open_us"]].first()
    final = of(both.sort_values("close_us", kind="stable", na_position="first"))[["close", "close_us"]].last()
    return first.join(final).join(of(both)[["last_us"]].max()).reset_index()[list(HELD)].astype(HELD)


def _open_close(days: int):
    """First and last known price of each key of a group. A key goes when the watermark passes its last tick by ``days``."""

    def over(held: pd.DataFrame) -> pd.Series:
        return held["last_us"] // 1000 + days * DAY_MS

    def rows(held: pd.DataFrame, ended: bool) -> pd.DataFrame:
        return held.drop(columns="last_us").assign(ended=ended)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(HELD, state.get if state.exists else ([],) * len(HELD), strict=True))).astype(HELD)
        passed = (over(held) <= watermark).to_numpy(bool)
        if passed.any():
            yield rows(held[passed], True)
            held = held[~passed]
        seen, waiting = [], []
        for frame in chain(frames, [None]) if not state.hasTimedOut else ():
            if frame is not None:
                waiting.append(frame[(_us(frame["ts"]) >= 1000 * watermark).to_numpy()])  # Spark may hand on what is behind the watermark
            if (n := sum(map(len, waiting))) >= TOLD or n and frame is None:
                told = pd.concat(waiting)
                seen.append(told[KEY].drop_duplicates())
                held, waiting = _moved_prices(held, told), []
        if seen:
            index = pd.MultiIndex.from_frame(pd.concat(seen).astype({"game_id": "Int64"}))
            yield rows(held[pd.MultiIndex.from_frame(held[KEY]).isin(index)], False)
        if held.empty:
            state.remove()
            return
        state.update(tuple(held[c].astype(object).where(held[c].notna(), None).tolist() for c in HELD))
        state.setTimeoutTimestamp(int(over(held).min()))

    return step


def open_close(ticks: DataFrame, late: str = LATE, days: int = 5) -> DataFrame:
    """Updates of the two prices of each game and side. Ticks up to ``late`` behind the latest count; an ended key has left no state.

    A key that is quoted again later starts anew, so a sink takes the price of the earliest open and of the latest close.
    Keys are dealt to ``DEALT`` groups with a state each, so a batch costs its ticks and the keys that are alive, not a call for each key.
    """
    rows = ticks.withWatermark("ts", late).select(*KEY, "ts", "price", F.pmod(F.xxhash64(*KEY), F.lit(DEALT)).alias("_group"))
    return rows.groupBy("_group").applyInPandasWithState(_open_close(days), PRICES, GROUP, "update", GroupStateTimeout.EventTimeTimeout)


def latest_prices(updates: DataFrame) -> DataFrame:
    """What a sink has after all updates."""
    return updates.groupBy("game_id", "market_side").agg(F.min_by("open", "open_us").alias("open"), F.max_by("close", "close_us").alias("close"))


PARLAYS = "parlay_id long, legs int, done int, result int, profit double, closed_by string"


class Parlay(StatefulProcessor):
    """Legs of a parlay as they are decided. It is settled with its last leg, or given up when ``days`` have passed since the latest one."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.legs = handle.getListState("legs", "leg string, price double, result int")
        self.about = handle.getValueState("about", "legs int, told int, closed boolean")
        self.timer = Timer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        legs, n, closed = self.about.get() if self.about.exists() else (0, 0, False)
        last = 0
        for frame in rows:
            last = max(last, int(_us(frame["ended_at"]).max()))
            legs = int(frame["n_legs"].max())
            if not closed:  # nothing is added to a settled parlay
                self.legs.appendList(list(zip(frame["leg"].tolist(), frame["price"].astype(float).tolist(), frame["result"].astype(int).tolist(), strict=True)))
                n += len(frame)
        self.timer.set(last // 1000 + self.days * DAY_MS)
        if not closed and n >= legs:
            told = self._told()
            n, closed = len(told), len(told) >= legs
            if closed:
                self.legs.clear()
                yield self._row(key, legs, [v for _, v in sorted(told.items())], "last leg")
            else:
                self.legs.put([(leg, *v) for leg, v in told.items()])
        self.about.update((legs, n, closed))

    def _told(self) -> dict[str, tuple[float, int]]:
        """Price and result of each leg: one that is told twice counts once. Legs are added without a look at those told before."""
        return {leg: (price, result) for leg, price, result in self.legs.get()}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        legs, _, closed = self.about.get()
        if not closed:
            yield self._row(key, legs, [v for _, v in sorted(self._told().items())], "time")
            self.legs.clear()
        self.about.clear()
        self.timer.clear()

    def _row(self, key, legs: int, told: list[tuple], by: str) -> pd.DataFrame:
        """Any lost leg loses; pushes drop out of the odds; all pushes push; a parlay given up has no result."""
        results, payout = [r for _, r in told], 1.0
        for price, result in told:
            payout *= price if result == 1 else 1.0
        result = None if by == "time" else -1 if -1 in results else int(1 in results)
        profit = None if result is None else {1: payout - 1, 0: 0.0, -1: -1.0}[result]
        frame = pd.DataFrame([(key[0], legs, len(told), result, profit, by)], columns=["parlay_id", "legs", "done", "result", "profit", "closed_by"])
        return frame.astype({"result": "Int32", "profit": "float64"})

    def close(self) -> None:
        pass


#: Groups that parlays are dealt to, and what a group's state holds: its parlays, and the legs of those that still wait.
TABLES = 128
ABOUT = {"parlay_id": "int64", "legs": "int32", "until": "int64", "closed": "bool"}
WAITING = {"parlay_id": "int64", "leg": "object", "price": "float64", "result": "int32"}
TABLE = "parlay_id array<long>, legs array<int>, until array<long>, closed array<boolean>, leg_of array<long>, leg array<string>, price array<double>, result array<int>"


def _closed_rows(about: pd.DataFrame, told: pd.DataFrame, by: str) -> pd.DataFrame:
    """A row of each parlay of ``about`` from its legs. Any lost leg loses; pushes drop out of the odds; all pushes push; one given up has no result."""
    of = told.sort_values(["parlay_id", "leg"]).assign(payout=lambda x: x["price"].where(x["result"] == 1, 1.0)).groupby("parlay_id")
    found = of.agg(done=("leg", "size"), low=("result", "min"), high=("result", "max"), payout=("payout", "prod")).reindex(about.index)
    result = found["high"].where(found["low"] != -1, -1).astype("Int32")
    profit = (found["payout"] - 1).where(result == 1, result.astype("float64"))
    if by == "time":
        result[:], profit[:] = pd.NA, float("nan")
    return pd.DataFrame({"parlay_id": about.index, "legs": about["legs"].to_numpy(), "done": found["done"].fillna(0).astype("int32").to_numpy(), "result": result.array, "profit": profit.to_numpy("float64"), "closed_by": by})


def _parlays(days: int):
    """The rule of ``Parlay`` for all parlays of a group at once."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else ([],) * (len(ABOUT) + len(WAITING))
        about = pd.DataFrame(dict(zip(ABOUT, kept[: len(ABOUT)], strict=True))).astype(ABOUT).set_index("parlay_id")
        legs = pd.DataFrame(dict(zip(WAITING, kept[len(ABOUT) :], strict=True))).astype(WAITING)
        told = pd.concat(list(frames)) if not state.hasTimedOut else []
        if len(told):
            until = _us(told["ended_at"]) // 1000 + days * DAY_MS
            now = told.assign(legs=told["n_legs"], until=until, closed=False)[list(ABOUT)].astype(ABOUT).groupby("parlay_id").agg({"legs": "max", "until": "max", "closed": "max"})
            about = pd.concat([about, now]).groupby(level=0).agg({"legs": "last", "until": "max", "closed": "max"})
            new = told.loc[~told["parlay_id"].isin(about.index[about["closed"]]), list(WAITING)].astype(WAITING)  # nothing is added to a settled parlay
            legs = pd.concat([legs, new], ignore_index=True).drop_duplicates(["parlay_id", "leg"], keep="last")  # a leg that is told twice counts once
            n = legs.groupby("parlay_id").size()
            done = n.index[(n >= about["legs"].reindex(n.index)).to_numpy(bool)]
            if len(done):
                yield _closed_rows(about.loc[done], legs[legs["parlay_id"].isin(done)], "last leg")
                about.loc[done, "closed"] = True
                legs = legs[~legs["parlay_id"].isin(done)]
        over = about.index[about["until"] <= state.getCurrentWatermarkMs()]
        if len(over):
            given_up = about.loc[over][~about.loc[over, "closed"]]
            if len(given_up):
                yield _closed_rows(given_up, legs[legs["parlay_id"].isin(over)], "time")
            about, legs = about.drop(over), legs[~legs["parlay_id"].isin(over)]
        if about.empty:
            if state.exists:
                state.remove()
            return
        state.update((*(about.reset_index()[c].tolist() for c in ABOUT), *(legs[c].tolist() for c in WAITING)))
        state.setTimeoutTimestamp(int(about["until"].min()))

    return step


def parlays(legs: DataFrame, late: str = "30 days", days: int = 60) -> DataFrame:
    """legs: parlay_id, leg, n_legs, price, result, ended_at, in any order over any number of batches. A row of each closed parlay.

    Parlays are dealt to ``TABLES`` groups with a state each, so a batch costs its legs and the parlays that are alive, not
    several calls for each parlay.
    """
    rows = legs.withWatermark("ended_at", late).select("parlay_id", "leg", "n_legs", "price", "result", "ended_at", F.pmod(F.xxhash64("parlay_id"), F.lit(TABLES)).alias("_group"))
    return rows.groupBy("_group").applyInPandasWithState(_parlays(days), PARLAYS, TABLE, "append", GroupStateTimeout.EventTimeTimeout)


def live_ratings(spark: SparkSession, games: DataFrame, start: DataFrame, path: str) -> DataFrame:
    """Ratings of all teams after the games of a stream whose batches are in order of time. start: of ``ratings.final``, where history ended.

    A batch passes as history does, in Spark's order and in small pieces, however many games it has; it goes on from the table of
    ratings that the batch before left, and is written once under its number: its games' ratings (``arrived``), and the next table.
    """
    columns = ["league", "team", "rating", "last_season"]
    start.select(*columns).write.mode("ignore").parquet(f"{path}/ratings/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        before, out = spark.read.parquet(f"{path}/ratings/batch={number - 1}"), f"{path}/out/{number:08d}"
        ratings.history(batch, before).write.mode("overwrite").parquet(out)
        now = ratings.final(spark.read.schema(ratings.HISTORY).parquet(out)).select(*columns)
        now.unionByName(before.join(now, ["league", "team"], "left_anti")).write.mode("overwrite").parquet(f"{path}/ratings/batch={number}")

    games.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("rating", "last_season"), "batch").alias("x")
    return spark.read.parquet(f"{path}/ratings").groupBy("league", "team").agg(last).select("league", "team", "x.*")


def drained(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> list[dict]:
    """All batches that have arrived, each written once under its number to ``path``; the progress of each."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{number:08d}")

    with rocks(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return list(query.recentProgress)


def arrived(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``drained`` wrote."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


def spans(rows: DataFrame, order: str, parts: int) -> Iterator[DataFrame]:
    """``rows`` in parts of equal spans of a time or date column, one after the other."""
    low, high = rows.agg(F.min(order).cast("timestamp"), F.max(order).cast("timestamp")).first()
    width = (high - low) / parts if low is not None else timedelta(0)
    for i in range(parts):
        at = F.col(order).cast("timestamp")
        yield rows.where((at >= F.lit(low + i * width)) & (F.lit(True) if i == parts - 1 else at < F.lit(low + (i + 1) * width))) if low is not None else rows


def in_files(rows: DataFrame, order: str, files: int, path: str) -> None:
    """``rows`` as files that a stream reads one after the other, in the order of a time or date column."""
    for part in spans(rows, order, files):
        part.coalesce(1).write.mode("append").parquet(path)
