"""Passes over a store: one at a time, and each repaired by the next if it broke off.

A pass writes events, then the rollup of the days that it touches, then what it
remembers of its input. Before that it notes its days (`N.begun`), and at the
end it is committed by one file, `N.done`, that names what is to be remembered.
Each note appears whole or not at all, and only if there is none of its name.
A pass without the second note broke off somewhere: its days are rolled up
anew, its input is read again, and the store drops the events that it holds.

The lease is a file too, so it holds between drivers. It is renewed while its
holder lives; one that hasn't been renewed for `ttl` seconds is taken over.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

TTL = 600.0


class Notes:
    """Small files in a folder of a store, by the driver."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.folder = spark, f"{store}/_passes"
        at = self._path(self.folder)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(at)

    def _path(self, path: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> object:
        return self._path(f"{self.folder}/{name}")

    def create(self, name: str, text: str) -> bool:
        """Whether the note is new: it is written aside, and then takes its name if nothing has it."""
        aside, to = self.at(f".{name}-{uuid.uuid4().hex}"), self.at(name)
        out = self.fs.create(aside, False)
        out.write(text.encode())
        out.close()
        if self.fs.getUri().getScheme() != "file":
            made = not self.fs.exists(to) and self.fs.rename(aside, to)
        else:
            # A local rename would replace the other note; a link doesn't.
            try:
                os.link(aside.toUri().getPath(), to.toUri().getPath())
                made = True
            except FileExistsError:
                made = False
        if self.fs.exists(aside):
            self.fs.delete(aside, False)
        return made

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), False)

    def touch(self, name: str) -> None:
        self.fs.setTimes(self.at(name), int(time.time() * 1000), -1)

    def age(self, name: str) -> float:
        """Seconds since the note was touched; 0 if it is gone."""
        try:
            return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return 0.0
            raise

    def move_away(self, name: str) -> None:
        """Of several that do so at once, one succeeds."""
        aside = self.at(f".{name}-{uuid.uuid4().hex}")
        if self.fs.rename(self.at(name), aside):
            self.fs.delete(aside, False)


@contextmanager
def lease(spark: SparkSession, store: str, ttl: float = TTL, wait: float = 0) -> Iterator[Notes]:
    """Lets one driver at a time work on a store; another one fails at once, or after `wait` seconds."""
    notes, me, until = Notes(spark, store), uuid.uuid4().hex, time.monotonic() + wait
    while not notes.create("lease", me):
        if notes.age("lease") > ttl:
            notes.move_away("lease")
        elif time.monotonic() >= until:
            raise RuntimeError(f"{store} is being worked on already")
        else:
            time.sleep(min(1.0, wait))
    ended = threading.Event()

    def renew() -> None:
        while not ended.wait(ttl / 4):
            if notes.read("lease") == me:
                notes.touch("lease")

    keeper = threading.Thread(target=renew, daemon=True)
    keeper.start()
    try:
        yield notes
    finally:
        ended.set()
        keeper.join()
        if notes.read("lease") == me:
            notes.delete("lease")


def _numbered(notes: Notes, kind: str) -> list[int]:
    return sorted(int(n.removesuffix(f".{kind}")) for n in notes.names() if n.endswith(f".{kind}"))


def remembered(notes: Notes) -> dict:
    """What the last committed pass remembers."""
    done = _numbered(notes, "done")
    return json.loads(notes.read(f"{done[-1]}.done")) if done else {}


def repair(notes: Notes, redo: Callable[[list[dt.date | None], dict], None]) -> None:
    """Does again what passes that broke off may have left undone: redo gets their days, and what else they noted."""
    done = _numbered(notes, "done")
    for number in _numbered(notes, "begun"):
        if number not in done:
            noted = json.loads(notes.read(f"{number}.begun"))
            redo(dates(noted.pop("days")), noted)
            commit(notes, number, remembered(notes))


def begin(notes: Notes, days: list[dt.date | None], **more: object) -> int:
    """The number of a new pass that is going to touch some days; more is noted with them."""
    number = 1 + max([0, *_numbered(notes, "begun"), *_numbered(notes, "done")])
    if not notes.create(f"{number}.begun", json.dumps({"days": texts(days), **more})):
        raise RuntimeError(f"pass {number} has begun elsewhere")
    return number


def commit(notes: Notes, number: int, memory: dict) -> None:
    """Ends a pass; the notes of earlier ones go."""
    if not notes.create(f"{number}.done", json.dumps(memory)):
        raise RuntimeError(f"pass {number} was ended elsewhere")
    for kind in ("begun", "done"):
        for n in _numbered(notes, kind):
            if n < number or kind == "begun":
                notes.delete(f"{n}.{kind}")


def texts(days: list[dt.date | None]) -> list[str | None]:
    return [d and d.isoformat() for d in days]


def dates(days: list[str | None]) -> list[dt.date | None]:
    return [d and dt.date.fromisoformat(d) for d in days]
