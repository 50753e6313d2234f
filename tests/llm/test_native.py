"""Sharding, mixing and secret scan: against plain versions, and on awkward rows."""

import itertools
import math
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from chronofact.llm import hilbert, mixing, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


AWKWARD = [(1, None, None, None), (2, "", "en", "a"), (3, "x" * 50_000, "en", "a"), (4, "same", "fr", "b"), (5, "same", "fr", "b"), (5, "same", "fr", "b"), (None, "no id", "de", "c"), (7, "é\n✓ \x01\x02", "de", "c")]


@pytest.mark.parametrize("n,bits", [(1, 3), (2, 3), (3, 2), (4, 2)])
def test_curve_is_a_walk_through_all_cells(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    rows = spark.createDataFrame(cells, [f"c{i}" for i in range(n)])
    rows = rows.withColumn("h", hilbert.curve_index([F.col(f"c{i}").cast("int") for i in range(n)], bits)).collect()
    path = sorted(rows, key=lambda r: r["h"])
    assert [r["h"] for r in path] == list(range(len(cells)))
    for a, b in zip(path, path[1:]):
        assert sum(abs(a[f"c{i}"] - b[f"c{i}"]) for i in range(n)) == 1


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rows = [(i, "w" * (i % 17), "en" if i % 3 else "fr", f"s{i % 5}") for i in range(500)] + [(1000 + i, "copy", "en", "s1") for i in range(300)]
    out = hilbert.hilbert_shards(docs(spark, rows), ["source", "lang", "size"], shards=8, law=law).collect()
    assert len(out) == 800
    by = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    if law == "rows":
        assert {len(v) for v in by.values()} == {100}
    else:
        sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
        assert max(sizes) - min(sizes) <= 2 * 17
    # runs of the curve
    ends = [(min(r["curve"] for r in out if r["shard"] == s), max(r["curve"] for r in out if r["shard"] == s)) for s in range(8)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_shards_of_awkward_rows(spark):
    out = hilbert.hilbert_shards(docs(spark, AWKWARD).withColumn("shard", F.lit(9)).withColumn("curve", F.lit("x")), ["source", "lang", "size"]).collect()
    assert sorted(r["size"] for r in out) == sorted(len((t or "").encode()) + 1 for _, t, _, _ in AWKWARD)
    assert Counter(r["shard"] for r in out) == Counter(range(8))
    assert hilbert.hilbert_shards(docs(spark, []), ["source", "lang", "size"]).count() == 0


def plain_times(ident, seed, rate):
    u = int(md5(f"{seed}|{ident}".encode()).hexdigest()[:13], 16) / 2**52
    j, below, p = 0, 0.0, math.exp(-rate)
    while True:
        below += p
        if u < below or p == 0:
            return j
        j += 1
        p *= rate / j


def test_mix_matches_plain_poisson(spark):
    rows = [(i, "t" * (1 + i % 7), "en", "big" if i % 3 else f"s{i % 4}") for i in range(600)]
    out = Counter(r["doc_id"] for r in mixing.poisson_mix(docs(spark, rows), seed=4).collect())
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(t)
    share = {s: b**0.5 for s, b in size.items()}
    rate = {s: share[s] / sum(share.values()) * sum(size.values()) / b for s, b in size.items()}
    assert out == Counter({i: n for i, t, _, s in rows if (n := plain_times(i, 4, rate[s]))})


def test_mix_to_weights(spark):
    rows = [(i, "t" * 10, "en", "a" if i % 10 else "b") for i in range(4000)]
    mixed = mixing.poisson_mix(docs(spark, rows), weights={"a": 0.5, "b": 0.5}, total=40_000)
    n = Counter(r["source"] for r in mixed.select("source").collect())
    assert abs(n["a"] - 2000) < 250 and abs(n["b"] - 2000) < 250
    assert mixing.poisson_mix(docs(spark, rows), weights={"b": 1.0}).where("source = 'a'").count() == 0
    large = mixing.poisson_mix(docs(spark, rows[:1]), total=20_000).count()
    assert abs(large - 2000) < 250


def test_mix_of_awkward_rows(spark):
    out = mixing.poisson_mix(docs(spark, AWKWARD).withColumn("copy", F.lit(1)), temperature=1.0)
    assert set(out.columns) >= {"doc_id", "text", "copy", "copy_no", "mix_key"}
    same = Counter(r["copy_no"] for r in out.where("doc_id = 5").collect())
    assert all(v % 2 == 0 for v in same.values())  # repeated rows draw alike
    assert mixing.poisson_mix(docs(spark, [])).count() == 0


def test_secret_scan(spark):
    findings = secrets.labelled_findings(spark, 3600)
    train, test = findings.where(F.pmod(F.xxhash64("candidate"), F.lit(5)) != 0), findings.where(F.pmod(F.xxhash64("candidate"), F.lit(5)) == 0)
    forest = secrets.train(train)
    judged = forest.transform(secrets.with_features(test)).select("label", "prediction").collect()
    assert sum(r["label"] == r["prediction"] for r in judged) / len(judged) > 0.97
    hexa = md5(b"x").hexdigest() + "01234567"
    rows = [*AWKWARD, (20, f'words api token = "{hexa}" and words', "en", "a"), (21, "see /usr/share/library/example/config/default for more", "en", "a"), (22, f"commit {hexa} and", "en", "a"), (23, f'secret: "{hexa}"\ntoken="{hexa}"', "en", "a"), (24, "incomprehensibilities " * 3, "en", "a")]
    found = secrets.scan(docs(spark, rows).withColumn("score", F.lit(1)), forest).collect()
    assert sorted((r["doc_id"], r["candidate"]) for r in found) == [(20, hexa), (23, hexa), (23, hexa)]
    assert secrets.scan(docs(spark, []), forest).count() == 0


def test_candidates_have_their_surroundings(spark):
    got = secrets.candidates(docs(spark, [(1, "ab 0123456789abcdefXY== tail $1", "en", "a"), (2, "y" * 60 + " key=" + "Z9" * 10, "en", "a")])).collect()
    by = {(r["doc_id"], r["ordinal"]): (r["before"], r["candidate"], r["after"]) for r in got}
    assert by[(1, 0)] == ("ab ", "0123456789abcdefXY==", " tail $1")
    assert by[(2, 0)][1] == "y" * 60 and by[(2, 1)] == (("y" * 60 + " key=")[-48:], "Z9" * 10, "")
