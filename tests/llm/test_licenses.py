import math

import numpy as np
import plain
import pytest

from cliptide.llm import licenses

OWN = dict(licenses.NOTICES)


def brute(text, templates, containment=0.8):
    w = plain.WORD.findall((text or "").translate(plain.UPPER))
    result = {}
    for name, body in templates:
        t = plain.WORD.findall(body.translate(plain.UPPER))
        k = min(5, len(t))
        own, have = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (t, w))
        if len(own & have) >= containment * len(own):
            result[name] = len(own & have) / len(own)
    return result


def test_same_as_brute_force(spark):
    filler = " ".join(f"w{i}" for i in range(90))
    long_body = " ".join(f"clause{i} of the long one" for i in range(60))
    templates = [*licenses.NOTICES, ("Long", long_body)]
    texts = [
        None, "", "Released under", OWN["MIT"], OWN["MIT"].upper().replace(" ", "\n--"), "x" + OWN["MIT"],
        OWN["GPL-3.0"].replace("version", "variant"), OWN["GPL-3.0"].replace("General", "Generic"), filler + " " + OWN["Apache-2.0"] + " " + filler,
        " ".join([OWN["CC-BY-NC-4.0"], filler, OWN["MPL-2.0"]]), filler + long_body + filler, filler + " " + long_body.replace("clause30", "x") + " é",
        (filler + " ") * 300 + OWN["BSD-3-Clause"], (OWN["MIT"] + " ") * 400,
        "All rights\nreserved", "all rights are reserved", OWN["All-rights-reserved"] + filler + OWN["MIT-text"], (filler + " ") * 9 + OWN["ISC-text"].replace("AUTHOR", "WRITER", 1),
        OWN["MIT-text"][: len(OWN["MIT-text"]) // 2], " ".join(OWN["MIT-text"].split()[20:]),
    ] + [" ".join(f"v{j}" for j in range(i)) + " " + OWN["Apache-2.0"] + " tail" for i in range(0, 60, 3)]
    rows = [(i, t, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = {}
    for r in licenses.scan(df, templates).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
    assert got == {i: f for i, t, _ in rows if (f := brute(t, templates))}


def test_place_passes_and_empty(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PER_PASS", 2)
    df = spark.createDataFrame([(1, "two words. " + OWN["MIT"]), (1, OWN["MIT"])], "doc_id long, text string")
    assert [(r.doc_id, r.license, r.first_word) for r in licenses.scan(df).collect()] == [(1, "MIT", 0)]
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="without a word"):
        licenses.scan(df, [("none", "...")])
    assert [(r.license, r.first_word) for r in licenses.scan(df, [("short", "MIT license")]).collect()] == [("short", 3)]


@pytest.mark.parametrize("count", [2, 3, 11, 16, 17, 180, 256])
def test_bands_agree_as_often_as_computed(count):
    """A window of random hashes that holds 0.8 of a template: a band agrees as often as ``miss`` says."""
    rng = np.random.default_rng(count)
    most = licenses.class_of(count)
    common = math.ceil(0.8 * count - 1e-9)
    assert licenses.miss(count, most, 2 ** licenses.bins_for(most, count)) <= licenses.MISS
    for bins in (4, 16):
        lost, runs = 0, 3000
        for _ in range(runs):
            values = rng.random(2 * most + count - common)
            place = rng.integers(0, bins, len(values))
            own, window = np.arange(count), np.arange(count - common, len(values))
            least = lambda rows: {b: rows[place[rows] == b][values[rows[place[rows] == b]].argmin()] for b in np.unique(place[rows])}
            a, b = least(own), least(window)
            lost += not any(a[k] == b.get(k) for k in a)
        expected = licenses.miss(count, most, bins)
        assert abs(lost / runs - expected) < 4 * (expected * (1 - expected) / runs) ** 0.5 + 1e-3


def test_classes_and_large_templates():
    assert [licenses.class_of(n) for n in (1, 2, 16, 17, 256, 257)] == [1, 16, 16, 256, 256, 4096]
    assert licenses.miss(1, 1, 2) == 0
    assert licenses.miss(300, 4096, 2 ** licenses.bins_for(4096, 300)) <= licenses.MISS


def test_no_python_on_the_path(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
