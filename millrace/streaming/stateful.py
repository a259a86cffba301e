"""Keyed processors for streams, on transformWithState.

All run in event time and keep one small value per key. They sort the rows of a
key within a micro-batch by time, so results match the batch twins when input
comes in order between batches.

State has an end. A key that isn't seen for its processor's time to live is
forgotten by an event-time timer: `FirstOfDay` after a day (its date can't come
again), `Versions` after some seconds, `RepairIsNew` and `Logins` after `VISIT_DAYS`
and `LOGIN_DAYS` of silence (a visitor who comes back later is as good as new).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
VISIT_DAYS, LOGIN_DAYS = 90, 366


class _Forgetful(StatefulProcessor):
    """A value per key that goes after `keep_ms` without a row; rows carry `_at`, their time in milliseconds."""

    SCHEMA = "date string"

    def __init__(self, keep_ms: int = DAY_MS):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("kept", self.SCHEMA + ", until bigint")

    def _get(self):
        """The value without its end, or nulls."""
        return tuple(self._state.get())[:-1] if self._state.exists() else (None,) * (self.SCHEMA.count(",") + 1)

    def _put(self, value: tuple, at: int) -> None:
        until = at + self.keep_ms
        if not self._state.exists():
            self._handle.registerTimer(until)
        self._state.update((*value, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._state.exists():
            until = tuple(self._state.get())[-1]
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self._state.clear()
            else:  # it was seen again meanwhile
                self._handle.registerTimer(until)
        return iter(())

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r._at)


class FirstOfDay(_Forgetful):
    """Passes every row, with `first` telling whether it is its key's first of the day."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (seen,), out, at = self._get(), [], None
        for row in _in_order(rows):
            if seen != row.date:
                seen, at = row.date, row._at
                out.append(Row(**row.asDict(), first=True))
            else:
                out.append(Row(**row.asDict(), first=False))
        if at is not None:
            self._put((seen,), at)
        return iter(out)


class RepairIsNew(_Forgetful):
    """Corrects is_new by the date of the key's first record."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (seen,), out, at = self._get(), [], 0
        for row in _in_order(rows):
            fields, at = row.asDict(), row._at
            if seen is None:
                day = dt.date.fromisoformat(row.date)
                seen = row.date if row.is_new == "1" else (day - dt.timedelta(days=1)).isoformat()
            elif row.is_new == "1" and seen != row.date:
                fields["is_new"] = "0"
            out.append(Row(**fields))
        self._put((seen,), at)
        return iter(out)


class Logins(_Forgetful):
    """A row per key and day: uu_ct 1, and back_ct 1 after eight days or more."""

    GAP = 8

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (seen,), out, at = self._get(), [], 0
        for row in _in_order(rows):
            at = row._at
            if seen == row.date:
                continue
            gap = 0 if seen is None else (dt.date.fromisoformat(row.date) - dt.date.fromisoformat(seen)).days
            seen = row.date
            out.append(Row(**row.asDict(), uu_ct=1, back_ct=int(gap >= self.GAP)))
        self._put((seen,), at)
        return iter(out)


class Versions(_Forgetful):
    """Passes each newer version of a key (sign 1), and with it takes the one before back (sign -1).

    Newer is what has a later time, or the same time and a larger amount.
    """

    SCHEMA = "body string, amount string, at bigint"

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (body, amount, at), out = self._get(), []
        for row in sorted(rows, key=lambda r: (r._at, r.amount if r.amount is not None else Decimal("-Infinity"))):
            if at is not None and (row._at, Decimal(row.amount or 0)) <= (at, Decimal(amount or 0)):
                continue
            if body is not None:
                out.append(Row(id=key[0], body=body, sign=-1, et=row.et, _at=row._at))
            out.append(Row(id=key[0], body=row.body, sign=1, et=row.et, _at=row._at))
            body, amount, at = row.body, str(row.amount or 0), row._at
        self._put((body, amount, at), at)
        return iter(out)


class Latest(StatefulProcessor):
    """Waits for repeats of a key in event time and then passes the last version."""

    WAIT_MS = 5_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._row = handle.getValueState("row", "at bigint, body string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max((r.at, r.body) for r in rows)
        if self._row.exists():
            best = max(best, tuple(self._row.get()))
        else:
            self._handle.registerTimer(best[0] // 1000 + self.WAIT_MS)
        self._row.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._row.exists():
            at, body = self._row.get()
            self._row.clear()
            # rows must not be older than the watermark: they come out at the time of release
            now = timerValues.getCurrentWatermarkInMs() + 1
            yield Row(id=key[0], body=body, at=at, et=dt.datetime.fromtimestamp(now / 1e3, dt.timezone.utc))

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime", eventTimeColumnName="et")


def _keep_rows(df: DataFrame, keys: list[str], processor: StatefulProcessor, extra: str = "") -> DataFrame:
    """Rows of `df` with further columns."""
    df = df.withColumn("_at", F.unix_millis("et"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + extra
    return _run(df, keys, processor, schema).drop("_at")


def first_of_day(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df` (with et, date and a watermark on et) with `first`."""
    return _keep_rows(df, keys, FirstOfDay(), ", first boolean")


def repair_is_new(df: DataFrame, mid: str = "mid", keep_days: int = VISIT_DAYS) -> DataFrame:
    return _keep_rows(df, [mid], RepairIsNew(keep_days * DAY_MS))


def logins(df: DataFrame, uid: str = "uid", keep_days: int = LOGIN_DAYS) -> DataFrame:
    return _keep_rows(df, [uid], Logins(keep_days * DAY_MS), ", uu_ct bigint, back_ct bigint")


def versions(df: DataFrame, keep_ms: int = 10_000) -> DataFrame:
    """(id, body, sign, et) of `df` with id, body, amount (a decimal) and et: what each newer
    version adds, and what it takes back of the one before."""
    rows = df.select("id", "body", "amount", "et", F.unix_millis("et").alias("_at"))
    return _run(rows, ["id"], Versions(keep_ms), "id string, body string, sign int, et timestamp, _at bigint").drop("_at")


def latest(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, body, at, et): `body` is the version as JSON, `at` its time in microseconds, et the time of release."""
    rows = df.select(F.col(key).alias("id"), "body", F.unix_micros("et").alias("at"), "et")
    return _run(rows, ["id"], Latest(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))
