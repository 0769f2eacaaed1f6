"""PEP 249 cursors, row factories, limits, and the asynchronous wrapper."""

from __future__ import annotations

import asyncio
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame

from .. import errors as er
from ..dialect import Token, _close, tokenize
from .database import Database, bind, iterate
from .ddl import text


class Row(tuple):
    """A tuple whose fields have names too."""

    _names: tuple[str, ...] = ()

    def __new__(cls, names: tuple[str, ...], values: Sequence):
        self = super().__new__(cls, values)
        self._names = names
        return self

    def __getitem__(self, key):
        return tuple.__getitem__(self, self._names.index(key) if isinstance(key, str) else key)

    def keys(self) -> list[str]:
        return list(self._names)


def dict_factory(names: tuple[str, ...], values: Sequence) -> dict:
    return dict(zip(names, values))


def tuple_factory(names: tuple[str, ...], values: Sequence) -> tuple:
    return tuple(values)


class Cursor:
    """Rows come partition by partition as they are asked for."""

    arraysize = 1

    def __init__(self, db: Database):
        self.db, self.rowcount, self.lastrowid, self.description = db, -1, None, None
        self.row_factory: Callable = db.row_factory or dict_factory
        self.script_results: list[int] = []
        self._rows: Iterator | None = None
        self._frame: DataFrame | None = None
        self._closed, self._limit, self._taken, self._deadline = False, None, 0, None

    def execute(self, sql: str, params: Sequence | dict | None = None, timeout_ms: int | None = None, max_rows: int | None = None) -> Cursor:
        if self._closed:
            raise er.InterfaceError("the cursor is closed")
        self._stop_clock()
        self._limit, self._taken, self._frame, self._rows = max_rows, 0, None, None
        with self._clock(timeout_ms):
            frame, self.rowcount = self.db.run(sql, params)
            self.lastrowid = self.db.lastrowid
            self._frame = frame
            self.description = None if frame is None else [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in frame.schema]
            if frame is not None and timeout_ms is not None:
                self._rows = iter(iterate(frame))  # its jobs carry the tag; the clock runs until the last row
        if frame is None:
            self._stop_clock()
        return self

    @contextmanager
    def _clock(self, timeout_ms: int | None) -> Iterator[None]:
        """Spark jobs started here, and rows fetched from them later, are cancelled when the time is up."""
        if timeout_ms is None:
            yield
            return
        sc, tag, late = self.db.spark.sparkContext, f"relspark-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout_ms / 1000, stop)
        timer.daemon = True
        self._deadline = (timer, late, timeout_ms)
        sc.addJobTag(tag)
        timer.start()
        try:
            yield
            self._in_time()
        except Exception as e:
            self._in_time(e)
            self._stop_clock()
            raise
        finally:
            sc.removeJobTag(tag)

    def _in_time(self, cause: Exception | None = None) -> None:
        if self._deadline is not None and self._deadline[1].is_set():
            timeout = self._deadline[2]
            self._stop_clock()
            raise er.QueryTimeoutError(f"stopped after {timeout} ms") from cause

    def _stop_clock(self) -> None:
        if self._deadline is not None:
            self._deadline[0].cancel()
            self._deadline = None

    #: Rows of one statement that ``executemany`` makes of a plain INSERT.
    BATCH = 5000

    def executemany(self, sql: str, rows: Iterable[Sequence | dict]) -> Cursor:
        """A plain INSERT ... VALUES (...) runs as one statement for many rows, any other statement row by row."""
        n, rows = 0, iter(rows)
        tokens = tokenize(sql)
        while tokens and tokens[-1].text == ";":
            tokens.pop()
        at = next((i for i, t in enumerate(tokens) if t.low == "values"), None)
        plain = at is not None and tokens[0].low == "insert" and tokens[at + 1 :] and tokens[at + 1].text == "(" and _close(tokens, at + 1) == len(tokens) - 1
        with self.db.lock:
            while plain and (batch := list(islice(rows, self.BATCH))):
                many = list(tokens[: at + 1])
                for k, params in enumerate(batch):
                    many += ([Token("op", ",")] if k else []) + bind(tokens[at + 1 :], params)
                self.execute(text(many))
                n += max(0, self.rowcount)
            for params in rows:
                self.execute(sql, params)
                n += max(0, self.rowcount)
        self.rowcount = n
        return self

    def __iter__(self) -> Iterator:
        while (row := self.fetchone()) is not None:
            yield row

    def fetchone(self) -> Any:
        if self._frame is None:
            return None
        if self._rows is None:
            try:
                self._rows = iter(iterate(self._frame))
            except Exception as e:
                raise er.translate(e) from e
        try:
            row = next(self._rows, None)
        except er.Error:
            raise
        except Exception as e:
            self._in_time(e)
            raise er.translate(e) from e
        self._in_time()
        if row is None:
            self._stop_clock()
            return None
        self._taken += 1
        if self._limit is not None and self._taken > self._limit:
            raise er.TooManyRowsError(f"more than {self._limit} rows")
        values = [bytes(v) if isinstance(v, bytearray) else v for v in row]
        if self.row_factory is Row:
            return Row(tuple(self._frame.columns), values)
        return self.row_factory(tuple(self._frame.columns), values)

    def fetchmany(self, size: int | None = None) -> list:
        out = []
        while len(out) < (size or self.arraysize) and (row := self.fetchone()) is not None:
            out.append(row)
        return out

    def fetchall(self) -> list:
        return list(self)

    def close(self) -> None:
        self._stop_clock()
        self._closed, self._rows, self._frame = True, None, None


class AsyncCursor:
    """Fetches in chunks on a thread."""

    chunk = 256

    def __init__(self, cursor: Cursor):
        self.cursor, self._buffer = cursor, []

    @property
    def rowcount(self) -> int:
        return self.cursor.rowcount

    @property
    def description(self):
        return self.cursor.description

    async def fetchone(self) -> Any:
        if not self._buffer:
            self._buffer = await asyncio.to_thread(self.cursor.fetchmany, self.chunk)
        return self._buffer.pop(0) if self._buffer else None

    async def fetchmany(self, size: int) -> list:
        out = []
        while len(out) < size and (row := await self.fetchone()) is not None:
            out.append(row)
        return out

    async def fetchall(self) -> list:
        rest, self._buffer = self._buffer, []
        return rest + await asyncio.to_thread(self.cursor.fetchall)

    async def __aiter__(self):
        while (row := await self.fetchone()) is not None:
            yield row


class AsyncDatabase:
    def __init__(self, path: str = ":memory:", **how: Any):
        self.db = Database(path, **how)

    async def execute(self, sql: str, params: Sequence | dict | None = None, **how: Any) -> AsyncCursor:
        return AsyncCursor(await asyncio.to_thread(self.db.execute, sql, params, **how))

    async def executemany(self, sql: str, rows: Iterable) -> AsyncCursor:
        return AsyncCursor(await asyncio.to_thread(self.db.executemany, sql, rows))

    async def executescript(self, sql: str) -> AsyncCursor:
        return AsyncCursor(await asyncio.to_thread(self.db.executescript, sql))

    async def commit(self) -> None:
        await asyncio.to_thread(self.db.commit)

    async def rollback(self) -> None:
        await asyncio.to_thread(self.db.rollback)

    async def close(self) -> None:
        await asyncio.to_thread(self.db.close)

    async def __aenter__(self) -> AsyncDatabase:
        return self

    async def __aexit__(self, *_: Any) -> None:
        await self.close()
