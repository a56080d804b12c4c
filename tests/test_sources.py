"""Files on disk: decoding, metadata, bad records, manifests, sinks, and a whole scoring run."""

import pickle
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.functions import labels
from cliptide.operators import curate, score
from cliptide.plans import jobs
from cliptide.sources import files, sinks, tables


def write_wav(path, samples, rate=16_000, channels=1):
    with wave.open(str(path), "wb") as clip:
        clip.setnchannels(channels)
        clip.setsampwidth(2)
        clip.setframerate(rate)
        clip.writeframes(np.asarray(samples, dtype="<i2").tobytes())


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    folder = tmp_path_factory.mktemp("clips")
    write_wav(folder / "mono.wav", np.arange(100))
    write_wav(folder / "stereo.wav", np.stack([np.arange(50) * 2, np.arange(50) * 4], axis=1).ravel(), 8_000, 2)
    write_wav(folder / "empty.wav", [])
    (folder / "broken.wav").write_bytes(b"not audio")
    whole = (folder / "mono.wav").read_bytes()
    (folder / "cut.wav").write_bytes(whole[:100])
    (folder / "notes.txt").write_text("ignored")
    return str(folder)


@pytest.mark.parametrize("opened_by_task", [False, True])
def test_decode(spark, clips, opened_by_task):
    scan = files.list_files(spark, clips) if opened_by_task else files.binary_files(spark, clips)
    rows = {r.stem: r for r in files.decode_wav(scan).withColumn("stem", labels.stem(F.col("path"))).collect()}
    assert set(rows) == {"mono", "stereo", "empty", "broken", "cut"}
    assert (rows["mono"].sr, rows["mono"].channels) == (16_000, 1)
    assert rows["mono"].samples == [i / 32768 for i in range(100)]
    assert rows["stereo"].samples == [3 * i / 32768 for i in range(50)]
    assert rows["empty"].samples == [] and rows["empty"].error is None
    assert rows["broken"].samples is None and rows["broken"].error
    assert "truncated" in rows["cut"].error
    cut = files.decode_wav(scan, chunk=30)
    assert sorted((labels_of(r), r.chunk_idx) for r in files.good_records(cut).collect()) == [
        ("mono", 0), ("mono", 1), ("mono", 2), ("stereo", 0)]
    assert files.bad_records(cut).count() == 2


def labels_of(row):
    return row.path.rsplit("/", 1)[-1].split(".")[0]


def test_metadata_and_listing(spark, clips):
    listed = files.list_files(spark, clips)
    assert listed.count() == 5
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    for scan in (files.binary_files(spark, clips), listed):
        rows = {labels_of(r): r for r in files.duration(files.wav_metadata(scan)).collect()}
        assert (rows["stereo"].channels, rows["stereo"].n_samples, rows["stereo"].duration) == (2, 50, 50 / 8000)
        assert rows["broken"].error and rows["broken"].duration is None
    assert files.spread_by_bytes(listed, target=200).rdd.getNumPartitions() > 1


def test_feature_files(spark, tmp_path):
    np.save(tmp_path / "two.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    np.save(tmp_path / "flat.npy", np.arange(3, dtype=np.float32))
    np.save(tmp_path / "objects.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    (tmp_path / "pickled.npy").write_bytes(pickle.dumps([1, 2]))
    for scan in (files.binary_files(spark, str(tmp_path), "*.npy"), files.list_files(spark, str(tmp_path), "*.npy")):
        decoded = files.decode_npy(scan)
        got = sorted((labels_of(r), r.frame, r.embedding) for r in files.good_records(decoded).collect())
        assert got == [("flat", 0, [0, 1, 2]), ("two", 0, [0, 1, 2]), ("two", 1, [3, 4, 5])]
        assert {labels_of(r) for r in files.bad_records(decoded).collect()} == {"objects", "pickled"}


def test_manifests(spark, tmp_path):
    (tmp_path / "train.csv").write_text('filename,tv,participant_id\n"a,1",1,7\nb,0,8\n')
    (tmp_path / "test.csv").write_text("filename,tv,participant_id\nc,1,9\n")
    (tmp_path / "train_fold_1_2.csv").write_text("filename,tv,participant_id\nd,0,9\n")
    found = tables.read_splits(spark, str(tmp_path))
    assert found["val"] is None
    assert sorted(r.filename for r in found["train"].collect()) == ["a,1", "b"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_splits(spark, str(tmp_path), required=True)
    assert tables.read_fold_csv(spark, str(tmp_path), 1, 2).first().filename == "d"


def test_fold_scan_reads_one_directory(spark, tmp_path):
    path = str(tmp_path / "folds")
    df = spark.range(60).select("id", (F.col("id") % 4).alias("fold_1"), (F.col("id") % 3).alias("fold_2"))
    sinks.write_features(df, path, ["fold_1", "fold_2"])
    scan = tables.fold_rows(spark, path, 2, 1)
    assert {r.id for r in scan.collect()} == {i for i in range(60) if i % 4 == 2 and i % 3 == 1}
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold_1" in plan


def test_materialised_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    path = str(tmp_path / "table")
    for _ in range(2):
        assert sinks.materialised(spark, path, compute).count() == 5
    assert calls == [1]
    (tmp_path / "table" / "_SUCCESS").unlink()
    sinks.materialised(spark, path, compute)
    assert calls == [1, 1]


def test_text_sink_appends(spark, tmp_path):
    path = str(tmp_path / "lines")
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.25)], "stem string, chunk int, v double")
    lines = df.select(sinks.chunk_line(F.col("stem"), F.col("chunk"), F.col("v")).alias("line"))
    sinks.append_text(lines, path)
    sinks.append_text(lines, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["a_0: 0.5"] * 2 + ["a_1: 0.25"] * 2


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', 1)], "display_name string, n int")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv"), "display_name string, n int").first()[:] == ('say "hi", you', 1)
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "csv"), "other string, n int").collect()
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().n == 1


def loudness_model():
    """Two classes per frame of 100 samples: mean level, and one minus it."""

    def load():
        return 100

    def apply(frame, batch):
        levels = [np.abs(np.asarray(w, np.float64)).reshape(-1, frame).mean(axis=1) for w in batch]
        return [[[x, 1 - x] for x in level] for level in levels]

    return load, apply


def test_score_corpus(spark, tmp_path):
    write_wav(tmp_path / "loud.wav", np.full(200, 16384))
    write_wav(tmp_path / "half.wav", np.full(100, 8192), 8_000)
    write_wav(tmp_path / "unlabelled.wav", np.full(200, 1))
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    truth = spark.createDataFrame([("loud.wav", 1), ("half.wav", 0), ("broken.wav", 0), ("gone.wav", 1)], "filename string, tv int")
    vocabulary = spark.createDataFrame([(0, "a", "Television"), (1, "b", "Radio")], tables.VOCABULARY)
    scored = jobs.score_corpus(
        files.list_files(spark, str(tmp_path)), truth, vocabulary, *loudness_model(),
        classes={"Television": "tv_score", "Radio": "radio_score"},
    )
    got = {r.filename: r for r in scored.collect()}
    assert set(got) == {"loud.wav", "half.wav"}
    assert got["loud.wav"].tv_score == pytest.approx(0.5) and got["half.wav"].tv_score == pytest.approx(0.25)
    assert got["loud.wav"].radio_score == pytest.approx(0.5) and got["half.wav"].tv == 0


def test_training_set(spark):
    rows = [(f"{d}{i}", d, int(i < n1), i) for d, n, n1 in (("x", 20, 6), ("y", 9, 4)) for i in range(n)]
    manifest = spark.createDataFrame(rows, "filename string, dataset string, tv int, participant_id int")
    features = manifest.filter("filename <> 'x0'").select("filename", F.array(F.array(F.lit(1.0).cast("float"))).alias("frames"))
    whole = jobs.training_set(manifest, features, width=1, length=3)
    sizes = {r.dataset: r["count"] for r in whole.groupBy("dataset").count().collect()}
    assert sizes["y"] == 8 and sizes["x"] in (7, 8)
    assert whole.filter(F.size("frames") != 3).count() == 0


def test_nearest_median_and_ensembles(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (0, 0.3), (1, 0.8), (1, 0.9), (1, 0.25), (1, 0.5)], "label int, score double")
    got = sorted((r.score, r.nearest) for r in score.nearest_median(df).collect())
    assert got == [(0.1, 0), (0.2, 0), (0.25, 0), (0.3, 0), (0.5, 1), (0.8, 1), (0.9, 1)]
    assert {r.nearest for r in score.nearest_median(df.filter("label = 1")).collect()} == {1}
    votes = spark.createDataFrame([(0.6, 0.4), (1.0, 0.2), (0.9, 0.9)], "a double, b double")
    got = [r.v for r in votes.select(score.thresholded_mean([F.col("a"), F.col("b")]).alias("v")).collect()]
    assert got == [0, 0, 1]


def test_wide_scores(spark):
    df = spark.createDataFrame([(0.5, 1, 0), (0.7, 1, 1)], "tv_score double, Talk int, Alone int")
    long = curate.subset_scores(df, "tv_score", ["Talk", "Alone", "Gossip"])
    assert sorted((r.subset, r.score) for r in long.collect()) == [("Alone", 0.7), ("Talk", 0.5), ("Talk", 0.7)]
