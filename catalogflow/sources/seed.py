"""Continuous waveforms from binary records: day files of fixed-length records with difference-coded samples.

A record has a header of 48 bytes, blockettes, and data; its length is a power of two that blockette 1000
tells. ``spark.read.format("seed_records")`` plans partitions by file and range of records, looks at the headers
of a range first, and decodes the records alone that touch the time asked for.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

RECORDS = "network string, station string, location string, channel string, us long, end_us long, rate double, data array<double>"

# Fixed values of the format.
HEADER = np.dtype([("seq", "S6"), ("quality", "S1"), ("blank", "S1"), ("station", "S5"), ("location", "S2"), ("channel", "S3"), ("network", "S2"), ("year", ">u2"), ("day", ">u2"), ("hour", "u1"), ("minute", "u1"), ("second", "u1"), ("unused", "u1"), ("fract", ">u2"), ("samples", ">u2"), ("factor", ">i2"), ("multiplier", ">i2"), ("activity", "u1"), ("io", "u1"), ("dq", "u1"), ("blockettes", "u1"), ("correction", ">i4"), ("data", ">u2"), ("first", ">u2")])
INT16, INT32, FLOAT32, FLOAT64, STEIM1, STEIM2 = 1, 3, 4, 5, 10, 11
PLAIN = {INT16: ">i2", INT32: ">i4", FLOAT32: ">f4", FLOAT64: ">f8"}
#: How many differences of how many bits a word holds, by its two bits in the control word and its own first two.
STEIM1_WORDS = {(1, d): (4, 8) for d in range(4)} | {(2, d): (2, 16) for d in range(4)} | {(3, d): (1, 32) for d in range(4)}
STEIM2_WORDS = {(1, d): (4, 8) for d in range(4)} | {(2, 1): (1, 30), (2, 2): (2, 15), (2, 3): (3, 10), (3, 0): (5, 6), (3, 1): (6, 5), (3, 2): (7, 4)}
CORRECTED = 0x02


def differences(data: bytes, words_of: dict[tuple[int, int], tuple[int, int]]) -> tuple[np.ndarray, int, int]:
    """The differences in whole frames of 16 words, in order, the first and the last sample."""
    words = np.frombuffer(data[: len(data) // 64 * 64], ">u4").astype(np.uint32)
    frames = words.reshape(-1, 16)
    codes = (frames[:, :1] >> np.arange(30, -1, -2, dtype=np.uint32)) & 3
    codes[:, 0] = 0
    codes[0, 1:3] = 0  # the first and the last sample
    codes, tops = codes.ravel().astype(np.int64), (words >> 30).astype(np.int64)
    counts = np.zeros(len(words), np.int64)
    kinds = {k: np.flatnonzero((codes == k[0]) & (tops == k[1])) for k in words_of}
    for k, at in kinds.items():
        counts[at] = words_of[k][0]
    places = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    for k, at in kinds.items():
        many, bits = words_of[k]
        shifts = np.arange((many - 1) * bits, -1, -bits, dtype=np.uint64)
        value = (words[at].astype(np.uint64)[:, None] >> shifts).astype(np.int64) & ((1 << bits) - 1)
        out[places[at][:, None] + np.arange(many)] = value - ((value >> (bits - 1)) << bits)
    signed = words[1:3].astype(np.int64)
    signed -= (signed >> 31) << 32
    return out, int(signed[0]), int(signed[1])


def samples_of(data: bytes, encoding: int, samples: int, order: int = 1) -> np.ndarray:
    """The samples of a record's data; an encoding that is not known, or differences that do not end at the
    last sample, raise ValueError."""
    if encoding in PLAIN:
        kind = np.dtype(PLAIN[encoding]) if order else np.dtype(PLAIN[encoding]).newbyteorder("<")
        return np.frombuffer(data[: samples * kind.itemsize], kind).astype(np.float64)
    if encoding not in (STEIM1, STEIM2):
        raise ValueError(f"records of encoding {encoding} are not known")
    steps, first, last = differences(data, STEIM1_WORDS if encoding == STEIM1 else STEIM2_WORDS)
    steps = steps[:samples].copy()
    if samples and len(steps):
        steps[0] = first
    out = np.cumsum(steps)
    if len(out) != samples or (samples and out[-1] != last):
        raise ValueError("differences of a record do not lead to its last sample")
    return out.astype(np.float64)


def _blockettes(record: bytes, at: int) -> Iterator[tuple[int, int]]:
    while 48 <= at <= len(record) - 4:
        kind, following = int.from_bytes(record[at : at + 2]), int.from_bytes(record[at + 2 : at + 4])
        yield kind, at
        at = following if following > at else 0


def record_length(head: bytes) -> int:
    """Bytes of a record, from its beginning; ValueError without blockette 1000."""
    if len(head) >= 48:
        for kind, at in _blockettes(head, int.from_bytes(head[46:48])):
            if kind == 1000 and at + 7 <= len(head):
                return 1 << head[at + 6]
    raise ValueError("not a record: blockette 1000 is missing")


def _rates(heads: np.ndarray) -> np.ndarray:
    f, m = heads["factor"].astype(float), heads["multiplier"].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(f > 0, np.where(m > 0, f * m, -f / m), np.where(m > 0, -m / f, 1 / (f * m)))


def _starts(heads: np.ndarray) -> np.ndarray:
    """Microseconds of the first samples, corrections that were not yet applied included."""
    days = (heads["year"].astype(np.int64) - 1970).astype("M8[Y]").astype("M8[D]").astype(np.int64) + heads["day"].astype(np.int64) - 1
    seconds = ((days * 24 + heads["hour"]) * 60 + heads["minute"]) * 60 + heads["second"]
    correction = np.where(heads["activity"] & CORRECTED, 0, heads["correction"].astype(np.int64))
    return seconds * 1_000_000 + (heads["fract"].astype(np.int64) + correction) * 100


class Records:
    """The records of a buffer, decoded as far as a time span asks; ``skipped`` counts those left out."""

    def __init__(self, low: int | None = None, high: int | None = None, only: dict[str, str] | None = None) -> None:
        self.low, self.high, self.only, self.decoded, self.skipped = low, high, only or {}, 0, 0

    def read(self, buffer: bytes, length: int) -> Iterator[tuple]:
        """Rows of RECORDS of the whole records in ``buffer`` that touch [low, high)."""
        many = len(buffer) // length
        heads = np.frombuffer(buffer[: many * length], np.dtype({"names": HEADER.names, "formats": [HEADER[n] for n in HEADER.names], "offsets": [HEADER.fields[n][1] for n in HEADER.names], "itemsize": length}))
        starts, rates = _starts(heads), _rates(heads)
        with np.errstate(divide="ignore", invalid="ignore"):
            ends = starts + np.where(rates > 0, np.round(heads["samples"] * 1e6 / rates), 0).astype(np.int64)
        # blockettes move a start by some milliseconds at most: the header alone decides with a second to spare
        asked = heads["samples"] > 0
        if self.low is not None:
            asked &= ends + 1_000_000 > self.low
        if self.high is not None:
            asked &= starts - 1_000_000 < self.high
        for name, value in self.only.items():
            asked &= np.char.strip(heads[name]) == value.encode()
        self.skipped += int(many - asked.sum())
        for i in np.flatnonzero(asked).tolist():
            record, head, us, rate, encoding, order = buffer[i * length : (i + 1) * length], heads[i], int(starts[i]), float(rates[i]), None, 1
            for kind, at in _blockettes(record, int(head["first"])):
                if kind == 1000:
                    encoding, order = record[at + 4], record[at + 5]
                elif kind == 1001:
                    us += int(np.int8(np.uint8(record[at + 5])))
                elif kind == 100:
                    rate = float(np.frombuffer(record[at + 4 : at + 8], ">f4")[0])
            end = us + round(int(head["samples"]) * 1e6 / rate)
            if encoding is None or (self.low is not None and end <= self.low) or (self.high is not None and us >= self.high):
                self.skipped += 1
                continue
            self.decoded += 1
            text = [head[n].decode().strip() for n in ("network", "station", "location", "channel")]
            yield (*text, us, end, rate, samples_of(record[int(head["data"]) :], encoding, int(head["samples"]), order))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RECORDS.split(", ")])


class _Range(InputPartition):
    def __init__(self, path: str, at: int, records: int, length: int) -> None:
        self.path, self.at, self.records, self.length = path, at, records, length


class RangeReader(DataSourceReader):
    """Partitions are ranges of ``many`` records of one file."""

    def __init__(self, files: list[str], many: int, low: int | None, high: int | None) -> None:
        self.files, self.many, self.low, self.high, self.only = files, many, low, high, {}

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files:
            with open(path, "rb") as f:
                head = f.read(512)
            if not head:
                continue
            length = record_length(head)
            total = os.path.getsize(path) // length
            out += [_Range(path, at, min(self.many, total - at), length) for at in range(0, total, self.many)]
        return out or [_Range("", 0, 0, 1)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.records:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.at * partition.length)
            buffer = f.read(partition.records * partition.length)
        rows = list(Records(self.low, self.high, self.only).read(buffer, partition.length))
        if rows:
            yield _batch(rows)


class _PushingReader(RangeReader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Bounds on us and end_us and equal codes choose records before they are decoded; Spark applies
        all filters again."""
        for f in filters:
            if f.attribute == ("us",) and isinstance(f, LessThan | LessThanOrEqual):
                bound = f.value + isinstance(f, LessThanOrEqual)
                self.high = bound if self.high is None else min(self.high, bound)
            elif f.attribute == ("end_us",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                bound = f.value - isinstance(f, GreaterThanOrEqual)
                self.low = bound if self.low is None else max(self.low, bound)
            elif isinstance(f, EqualTo) and f.attribute in {(c,) for c in ("network", "station", "location", "channel")} and isinstance(f.value, str):
                self.only[f.attribute[0]] = f.value
            yield f


class SeedRecords(DataSource):
    """Options: ``path`` (a folder, searched whole, or a pattern, in a file system that driver and executors
    mount), ``records`` (of a partition), ``low`` and ``high`` (microseconds: records that touch [low, high)),
    and ``pushdown`` (true where spark.sql.python.filterPushdown.enabled is set)."""

    @classmethod
    def name(cls) -> str:
        return "seed_records"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"].removeprefix("file://").removeprefix("file:")
        pattern = os.path.join(path, "**") if os.path.isdir(path) else path
        files = sorted(f for f in glob.glob(pattern, recursive=True) if os.path.isfile(f) and not os.path.basename(f).startswith((".", "_")))
        bound = lambda name: int(self.options[name]) if name in self.options else None
        kind = _PushingReader if self.options.get("pushdown", "false") == "true" else RangeReader
        return kind(files, int(self.options.get("records", 4096)), bound("low"), bound("high"))


def read_records(spark: SparkSession, path: str, *, low: int | None = None, high: int | None = None) -> DataFrame:
    """The same rows through Spark's own reader of binary files, for stores that are not mounted: a file is read
    whole by one task, and decoded as far as [low, high) asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                if content:
                    length, found = record_length(content[:512]), Records(low, high)
                    step = max(1, (4 << 20) // length) * length
                    for at in range(0, len(content), step):
                        rows = list(found.read(content[at : at + step], length))
                        if rows:
                            yield _batch(rows)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORDS)


def day_files(network: str, station: str, channel: str, first: datetime, last: datetime) -> list[str]:
    """Where an archive keeps the days that touch a time span: a second one if it goes over midnight."""
    days = [(first + timedelta(days=k)).date() for k in range((last.date() - first.date()).days + 1)]
    return [f"{station}/{channel}.D/{network}.{station}..{channel}.D.{d.year}.{d.timetuple().tm_yday:03d}" for d in days]


# Writing, for archives made from tables.


def _steim2(values: np.ndarray, previous: int, frames: int) -> tuple[bytes, int]:
    """Frames for as many of ``values`` as they hold, and how many those are."""
    steps = np.diff(values, prepend=previous).tolist()
    fits = [(k, many, bits, -(1 << (bits - 1)), (1 << (bits - 1)) - 1) for k, (many, bits) in sorted(STEIM2_WORDS.items(), key=lambda x: -x[1][0]) if k[0] != 1 or k[1] == 0]
    words, at = np.zeros(frames * 16, np.uint64), 0
    for place in range(frames * 16):
        if place % 16 == 0 or place in (1, 2) or at >= len(steps):
            continue
        for (code, top), many, bits, low, high in fits:
            part = steps[at : at + many]
            if len(part) == many and min(part) >= low and max(part) <= high:
                break
        else:
            raise ValueError("a difference is beyond 30 bits")
        word = 0 if code == 1 else top << 30
        for k, x in enumerate(part):
            word |= (x & ((1 << bits) - 1)) << ((many - 1 - k) * bits)
        words[place] = word
        words[place // 16 * 16] |= np.uint64(code << (30 - 2 * (place % 16)))
        at += many
    ends = np.array([values[0], values[at - 1]], np.int64).astype(np.uint32)
    words[1:3] = ends
    return words.astype(">u4").tobytes(), at


def encoded(network: str, station: str, channel: str, us: int, rate: int, values: np.ndarray, *, length: int = 512) -> bytes:
    """Records of whole samples at a whole rate, by second differences of up to 30 bits."""
    out, at, previous = [], 0, int(values[0]) if len(values) else 0
    while at < len(values):
        data, many = _steim2(values[at:], previous, length // 64 - 1)
        start = us + round(at * 1e6 / rate)
        when = datetime.fromtimestamp(start // 1_000_000, UTC)
        head = np.zeros((), HEADER)
        for name, value in {"seq": b"%06d" % (len(out) % 1_000_000), "quality": b"D", "blank": b" ", "station": station.ljust(5).encode(), "location": b"  ", "channel": channel.ljust(3).encode(), "network": network.ljust(2).encode(), "year": when.year, "day": when.timetuple().tm_yday, "hour": when.hour, "minute": when.minute, "second": when.second, "fract": start % 1_000_000 // 100, "samples": many, "factor": rate, "multiplier": 1, "blockettes": 2, "data": 64, "first": 48}.items():
            head[name] = value
        more = b"\x03\xe8\x00\x38" + bytes([STEIM2, 1, length.bit_length() - 1, 0]) + b"\x03\xe9\x00\x00" + bytes([100, start % 100, 0, length // 64 - 1])
        out.append(head.tobytes() + more + data)
        previous, at = int(values[at + many - 1]), at + many
    return b"".join(out)


def write_days(traces: DataFrame, path: str, *, network: str = "XX", length: int = 512) -> DataFrame:
    """Writes traces (station, channel, us, rate, data of whole numbers) as an archive of day files under
    ``path``, a folder that driver and executors mount; a task writes a station's day, records in order of
    time, each with samples of one day. Gives (file, bytes) of what was written."""
    day = 86_400_000_000
    root = path.removeprefix("file://").removeprefix("file:")
    length_us = F.ceil(F.size("data") * 1e6 / F.col("rate")).cast("long")
    days = F.sequence(F.floor(F.col("us") / day), F.floor((F.col("us") + F.greatest(length_us - 1, F.lit(0))) / day))
    dealt = traces.filter(F.size("data") > 0).withColumn("day", F.explode(days))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        date = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(days=int(first["day"]))
        name = day_files(network, first["station"], first["channel"], date, date)[0]
        out = []
        for us, rate, data in sorted(zip(frame["us"], frame["rate"], frame["data"], strict=True), key=lambda r: r[0]):
            at = us + np.round(np.arange(len(data)) * 1e6 / rate).astype(np.int64)
            own = np.flatnonzero(at // day == first["day"])
            if len(own):
                out.append(encoded(network, first["station"], first["channel"], int(at[own[0]]), round(rate), np.asarray(data)[own].astype(np.int64), length=length))
        place = os.path.join(root, name)
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(f"{place}.{os.getpid()}.part", "wb") as f:
            f.write(b"".join(out))
        os.replace(f"{place}.{os.getpid()}.part", place)  # a task that is run again writes the same file
        return pd.DataFrame([(name, sum(map(len, out)))], columns=["file", "bytes"])

    return dealt.groupBy("station", "channel", "day").applyInPandas(run, "file string, bytes long")
