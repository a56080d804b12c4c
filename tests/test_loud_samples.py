"""Samples beyond 16 bits: the queries over PCM chunks give what their SQL gives, and files keep such samples."""

import datetime
import struct
import wave

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cliptide.sources import files


@pytest.fixture(scope="module")
def loud(spark, tmp_path_factory):
    """Events of clips 1 to 8, of 35 samples each; those of clips 2, 3 and 7 go beyond 655.35, and 5 below 0."""
    folder = str(tmp_path_factory.mktemp("loud"))
    began = datetime.datetime(2024, 1, 1)
    value = lambda c, i: {2: 700.0, 3: 655.34, 5: -690.0, 7: 1e5}.get(c, 10.0) + i / 4
    rows = [(c * 100 + i, began + datetime.timedelta(hours=i), c, value(c, i)) for c in range(1, 9) for i in range(35)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["p16_pcm_to_unit", "s3_audio_ingest", "s13_bad_records", "s14_clip_metadata"])
def test_agrees_with_sql(spark, loud, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{loud}/events.parquet/*.parquet'")
    assert compare(spark, con, loud, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_float_files(spark, tmp_path):
    df = spark.createDataFrame([("quiet", [1, -32768, 32767]), ("loud", [32768, -40000, 1 << 23])], "path string, samples array<int>")
    wavs = {r.path: bytes(r.content) for r in files.encode_wav(df, 8000).collect()}
    (tmp_path / "quiet").write_bytes(wavs["quiet"])
    with wave.open(str(tmp_path / "quiet")) as clip:
        assert clip.getsampwidth() == 2 and clip.getnframes() == 3
    stereo = wavs["loud"][:22] + struct.pack("<H", 2) + wavs["loud"][24:32] + struct.pack("<H", 8) + wavs["loud"][34:54]
    cases = {
        **wavs,
        "stereo": stereo + struct.pack("<I4f", 16, 1.5, 2.5, -3.0, 1.0),
        "cut": wavs["loud"][:-4],
        "headless": wavs["loud"][:50],
        "doubles": wavs["loud"][:34] + struct.pack("<H", 64) + wavs["loud"][36:],
    }
    scan = spark.createDataFrame([(p, bytearray(c)) for p, c in cases.items()], "path string, content binary")
    rows = {r.path: r for r in files.decode_wav(scan).collect()}
    assert rows["quiet"].samples == [1 / 32768, -1.0, 32767 / 32768]
    assert rows["loud"].samples == [1.0, -40000 / 32768, 256.0] and rows["loud"].sr == 8000
    assert rows["stereo"].samples == [2.0, -1.0] and rows["stereo"].channels == 2
    assert {p for p, r in rows.items() if r.error} == {"cut", "headless", "doubles"}
    assert "truncated" in rows["cut"].error
    described = {r.path: r for r in files.wav_metadata(scan).filter(F.col("error").isNull()).collect()}
    assert (described["loud"].n_samples, described["stereo"].n_samples) == (3, 2)
