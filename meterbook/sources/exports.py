"""CSV exports by byte ranges: a file of any size is read by many tasks, though quoted fields may hold line feeds.

Where a record begins depends on every quote before it. So each range is first
scanned for what it makes of each state that it may begin in; these maps are
composed along the file, one row a range, and then every range knows its own
state and reads the records that begin behind its first line feed outside
quotes. States and records are those of Python's csv module, stray quotes
within plain fields included.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.functions.dashboard import CSV_COLUMNS, CSV_REQUIRED
from meterbook.sources import growing

#: Bytes of a range; a task holds one, and the records that begin in it, at a time.
RANGE_BYTES = 16 << 20
ROWS = 4096
_BLOCK = 1 << 20
#: At the start of a field, within a plain or a quoted one, and behind a quote in a quoted one.
STATES = "SPQE"
_AT_QUOTE = {"S": "Q", "P": "P", "Q": "E", "E": "Q"}


def _past(state: str, text: bytes) -> str:
    """The state behind a text without quotes."""
    if not text or state == "Q":
        return state
    return "S" if text[-1:] in b",\r\n" else "P"


def state_map(file: BinaryIO, begin: int, end: int) -> str:
    """The states behind some bytes, for each of STATES before them."""
    states, left = list(STATES), end - begin
    file.seek(begin)
    while left > 0 and (block := file.read(min(_BLOCK, left))):
        left -= len(block)
        for i, text in enumerate(block.split(b'"')):
            if i:
                states = [_AT_QUOTE[s] for s in states]
            states = [_past(s, text) for s in states]
    return "".join(states)


def next_record(file: BinaryIO, at: int, state: str, stop: int) -> int:
    """Behind the first line feed outside quotes from a place and its state on; stop if there is none."""
    file.seek(at)
    while at < stop and (block := file.read(min(_BLOCK, stop - at))):
        place = at
        for i, text in enumerate(block.split(b'"')):
            if i:
                state, place = _AT_QUOTE[state], place + 1
            cut = -1 if state == "Q" else text.find(b"\n")
            if cut >= 0:
                return place + cut + 1
            state, place = _past(state, text), place + len(text)
        at += len(block)
    return stop


def _rows(file: BinaryIO, first: int, stop: int) -> Iterator[list[str]]:
    """The records of some bytes, but for blank lines."""
    csv.field_size_limit(sys.maxsize)
    file.seek(first)
    text = file.read(stop - first).decode("utf-8", "replace")
    return filter(None, csv.reader(io.StringIO(text.removeprefix("\ufeff") if first == 0 else text, newline="")))


def _header(file: BinaryIO, stop: int) -> tuple[list[str], int]:
    """The first record that isn't blank, and the place up to which there are blank ones only."""
    at = 0
    while at < stop:
        behind = next_record(file, at, "S", stop)
        if found := next(_rows(file, at, behind), None):
            return found, at
        at = behind
    return [], stop


def records_in(file: BinaryIO, begin: int, end: int, stop: int, state: str, end_state: str) -> Iterator[dict[str, str]]:
    """The records that a range of a file has, by the names in the file's header; none if it lacks a required column. A short record lacks its last columns."""
    header, at = _header(file, stop)
    if not set(CSV_REQUIRED) <= set(header):
        return
    first = next_record(file, begin, state, stop) if begin else 0
    last = next_record(file, end, end_state, stop) if end < stop else stop
    if first >= last:
        return
    places = {name: header.index(name) for name in CSV_COLUMNS if name in header}
    for row in islice(_rows(file, first, last), 1 if first <= at else 0, None):
        yield {name: row[i] for name, i in places.items() if i < len(row)}


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path, begin, end in zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "end")], strict=True):
            with growing.opened(path) as file:
                found.append(state_map(file, begin, end))
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("number"), pa.array(found, pa.string())], ["path", "number", "states"])


def _composed(maps: pa.Table) -> pa.Table:
    """path, number, state, end_state of a file's ranges, from the maps of all but the last."""
    state, rows = "S", []
    for row in maps.sort_by("number").to_pylist():
        behind = row["states"][STATES.index(state)]
        rows.append((row["path"], row["number"], state, behind))
        state = behind
    rows.append((rows[-1][0], rows[-1][1] + 1, state, state))
    return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=["path", "number", "state", "end_state"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, *place in zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "end", "stop", "state", "end_state")], strict=True):
            with growing.opened(path) as file:
                objects = map(json.dumps, records_in(file, *place))
                while some := list(islice(objects, ROWS)):
                    yield pa.RecordBatch.from_pydict({"value": some, "path": [path] * len(some)})


def read_exports(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value (a JSON object of a record's columns) and path of exports (path, stop: the bytes to read); empty files have none.

    An export is read twice if it has more than one range. A quote that is
    never closed makes the rest of its file one record, for one task, as it
    would be for any reader.
    """
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("stop") - 1) / range_bytes)))
    ranges = files.where(F.col("stop") > 0).select("path", "stop", number.alias("number"))
    begin = F.col("number") * range_bytes
    ranges = ranges.select("path", "number", begin.alias("begin"), F.least(begin + range_bytes, F.col("stop")).alias("end"), "stop")
    maps = growing.dealt(ranges.where(F.col("end") < F.col("stop")), range_bytes).mapInArrow(_maps, "path string, number long, states string")
    states = maps.groupBy("path").applyInArrow(_composed, "path string, number long, state string, end_state string")
    known = ranges.join(states, ["path", "number"], "left").fillna("S", ["state", "end_state"])
    return growing.dealt(known, range_bytes, ranges).mapInArrow(_objects, "value string, path string")
