"""Binary waveform records: coding, pruning, days, midnight, windows."""

import numpy as np
import pytest
from catalogflow.sources import seed, waveforms
from pyspark.sql import functions as F

DAY = 86_400_000_000
START = 19_000 * DAY


def steim1(values, frames):
    """A plain encoder of the older kind: 32-bit, 16-bit and 8-bit differences by what fits."""
    steps, words, at = np.diff(values, prepend=values[0]).tolist(), [0] * (16 * frames), 0
    for place in range(16 * frames):
        if place % 16 == 0 or place in (1, 2) or at >= len(steps):
            continue
        for code, many, bits in ((1, 4, 8), (2, 2, 16), (3, 1, 32)):
            part = steps[at : at + many]
            if len(part) == many and all(-(1 << (bits - 1)) <= x < 1 << (bits - 1) for x in part):
                break
        words[place] = sum((x & ((1 << bits) - 1)) << ((many - 1 - k) * bits) for k, x in enumerate(part))
        words[place // 16 * 16] |= code << (30 - 2 * (place % 16))
        at += many
    assert at == len(steps)
    words[1], words[2] = int(values[0]) & 0xFFFFFFFF, int(values[-1]) & 0xFFFFFFFF
    return np.array(words, ">u4").tobytes()


@pytest.mark.parametrize("size", [1, 3, 7, 8, 20, 200, 5_000, 100_000, 2**20, 2**28])
def test_differences_come_back(size):
    draw = np.random.default_rng(size)
    values = draw.integers(-size, size, 900) if size > 2**24 else np.cumsum(draw.integers(-size, size + 1, 900))  # samples have 32 bits
    coded = seed.encoded("KG", "AAA", "HHZ", START, 100, values)
    assert len(coded) % 512 == 0 and seed.record_length(coded[:512]) == 512
    rows = list(seed.Records().read(coded, 512))
    assert np.concatenate([r[7] for r in rows]).tolist() == values.tolist()
    assert rows[0][:5] == ("KG", "AAA", "", "HHZ", START) and all(a[5] == b[4] for a, b in zip(rows, rows[1:]))
    some = values[:60] if size < 2**20 else values[:30]
    assert seed.samples_of(steim1(some, 7), seed.STEIM1, len(some)).tolist() == some.tolist()


def test_plain_encodings_and_faults():
    values = np.array([3, -4, 500], np.int64)
    for code, kind in seed.PLAIN.items():
        assert seed.samples_of(values.astype(kind).tobytes() + b"\0" * 40, code, 3).tolist() == values.tolist()
    assert seed.samples_of(values.astype("<i4").tobytes(), seed.INT32, 3, 0).tolist() == values.tolist()
    with pytest.raises(ValueError, match="encoding 30"):
        seed.samples_of(b"", 30, 1)
    coded = bytearray(seed.encoded("KG", "AAA", "HHZ", START, 100, np.arange(100)))
    coded[64 + 8 : 64 + 12] = b"\0\0\0\1"
    with pytest.raises(ValueError, match="last sample"):
        list(seed.Records().read(bytes(coded), 512))
    with pytest.raises(ValueError, match="blockette 1000"):
        seed.record_length(b"\0" * 512)


def test_records_outside_the_span_are_not_decoded():
    values = np.random.default_rng(2).integers(-200, 200, 60_000)  # ten minutes at 100 Hz
    coded = seed.encoded("KG", "AAA", "HHZ", START, 100, values)
    low, high = START + 200_000_000, START + 230_000_000
    found = seed.Records(low, high)
    rows = list(found.read(coded, 512))
    many = len(coded) // 512
    assert found.decoded == len(rows) < 0.08 * many and found.decoded + found.skipped == many
    assert rows[0][4] <= low < rows[0][5] and rows[-1][4] < high <= rows[-1][5]
    assert not list(seed.Records(None, None, {"station": "BBB"}).read(coded, 512))


def test_header_rates_and_corrections():
    head = np.zeros(5, seed.HEADER)
    head["factor"], head["multiplier"] = [100, 100, -10, -10, 20], [1, -10, 1, -2, 5]
    assert seed._rates(head).tolist() == [100.0, 10.0, 0.1, 0.05, 100.0]
    head["year"], head["day"], head["correction"], head["activity"] = 2024, 61, 50, [0, 2, 0, 0, 0]
    assert seed._starts(head)[:2].tolist() == [1709251200000000 + 5000, 1709251200000000]


def traces(spark):
    """Two stations over midnight, one with a gap; samples are their own place in time."""
    rows = []
    for k, sta in enumerate(("AAA", "BBB")):
        for at in range(DAY - 300_000_000, DAY + 300_000_000, 60_000_000):
            if sta == "BBB" and at == DAY - 60_000_000:
                continue
            rows.append((sta, "HHZ", START + at, 20.0, [float((k + 1) * (at // 50_000 + i)) for i in range(1200)]))
    rows.append(("AAA", "HHN", START + DAY - 30_000_000, 20.0, [float(i % 7) for i in range(1200)]))  # a trace over midnight
    return spark.createDataFrame(rows, waveforms.TRACE)


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archive"))
    files = {r.file: r.bytes for r in seed.write_days(traces(spark), path, network="KG").collect()}
    spark.dataSource.register(seed.SeedRecords)
    return path, files


def samples(frame):
    out = {}
    for r in frame.collect():
        out.update({(r.station, r.channel, r.us + round(i * 1e6 / r.rate)): x for i, x in enumerate(r.data)})
    return out


def test_archive_by_day_comes_back_whole(spark, archive):
    path, files = archive
    assert sorted(files) == sorted(f"{s}/{c}.D/KG.{s}..{c}.D.2022.{d:03d}" for s, c in (("AAA", "HHN"), ("AAA", "HHZ"), ("BBB", "HHZ")) for d in (8, 9))
    want = samples(traces(spark))
    source = spark.read.format("seed_records").option("records", 4).load(path)
    assert samples(source) == want and source.rdd.getNumPartitions() > len(files)
    assert samples(seed.read_records(spark, path)) == want
    assert spark.read.format("seed_records").load(f"{path}/nothing/*").count() == 0


def test_time_bounds_reach_the_records(spark, archive):
    path, _ = archive
    low, high = START + DAY - 5_000_000, START + DAY + 5_000_000
    whole = spark.read.format("seed_records").load(path)
    want = sorted(map(str, whole.filter((F.col("us") < high) & (F.col("end_us") > low) & (F.col("station") == "AAA")).collect()))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("seed_records").option("pushdown", "true").load(path).filter((F.col("us") < high) & (F.col("end_us") > low) & (F.col("station") == "AAA"))
        assert sorted(map(str, pushed.collect())) == want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    by_option = spark.read.format("seed_records").option("low", low).option("high", high).load(path)
    assert sorted(map(str, by_option.filter("station = 'AAA'").collect())) == want
    assert sorted(map(str, seed.read_records(spark, path, low=low, high=high).filter("station = 'AAA'").collect())) == want
    assert 0 < len(want) < 0.3 * whole.filter("station = 'AAA'").count()


def test_windows_over_midnight_and_gaps(spark, archive):
    path, _ = archive
    low, high = START + DAY - 10_000_000, START + DAY + 10_000_000
    events = spark.createDataFrame([(1, START + DAY)], "idx long, us long")
    source = spark.read.format("seed_records").option("low", low).option("high", high).load(path)
    found = {(r.station, r.channel): r for r in waveforms.windows(events, source.select("station", "channel", "us", "rate", "data"), before=10_000_000, after=10_000_000).collect()}
    whole = found["AAA", "HHZ"]
    assert whole.gaps == 0 and whole.data == [float((DAY - 10_000_000) // 50_000 + i) for i in range(400)]
    assert found["BBB", "HHZ"].gaps == 0.5 and found["BBB", "HHZ"].data[:200] == [0.0] * 200
    assert found["AAA", "HHN"].gaps == 0
