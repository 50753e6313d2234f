"""Line dedup, packing, pseudonyms, toxicity and the pipeline."""

import random
import re
import zlib
from collections import defaultdict
from datetime import date
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronofact.llm import linededup, minhash, mixing, packing, pseudonyms, toxicity

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain_lines(rows, least=10):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < least or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(seed=3):
    r = random.Random(seed)
    pool = ["A common line of text", "  a COMMON line of text\t", "short", "Étoile ÉTOILE long", "étoile étoile long", "another frequent line", ""] + [f"line number {i} is here" for i in range(30)]
    rows = [(i, "\n".join(["the hottest line of all"] * r.choice([0, 1, 2]) + r.choices(pool, k=r.randrange(0, 9)))) for i in range(80)]
    return rows + [(200, None), (201, ""), (202, "\n\n"), (203, "the hottest line of all"), (None, "the hottest line of all"), (5, rows[5][1]), (204, "y" * 100_000 + "\nthe hottest line of all")]


@pytest.mark.parametrize("parts", [1, 7])
def test_line_dedup(spark, parts):
    rows = line_rows()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep", F.lit(1)).repartition(3)
        bitmaps = linededup.keep_bitmaps(docs)
        kept = linededup.apply_bitmaps(docs, bitmaps).withColumn("t", F.coalesce("kept_text", F.lit("")))
        texts = sorted(((r["doc_id"], r["t"]) for r in kept.collect()), key=str)
        counts = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in bitmaps.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = plain_lines(rows)
    assert texts == sorted(((i, t) for i, _, _, t in want), key=str)
    assert counts == {(i, n, d) for i, n, d, _ in want}
    assert linededup.keep_bitmaps(docs.limit(0)).count() == 0


def plain_best_fit(lengths, sources, clusters, capacity):
    bins, place = [], {}
    for i in np.lexsort((np.arange(len(lengths)), clusters, sources, -lengths)):
        fits = [j for j, (room, s, c) in enumerate(bins) if room >= lengths[i] and sources[i] not in s and clusters[i] not in c]
        if fits:
            j = min(fits, key=lambda j: (bins[j][0], j))
        else:
            bins.append([capacity, set(), set()])
            j = len(bins) - 1
        bins[j][0] -= lengths[i]
        bins[j][1].add(sources[i])
        bins[j][2].add(clusters[i])
        place[i] = j
    return [place[i] for i in range(len(lengths))]


@pytest.mark.parametrize("seed", range(8))
def test_best_fit(seed):
    r = np.random.default_rng(seed)
    n = 150
    lengths = r.choice([0, 1, 5, 20, 50, 100], n)
    sources, clusters = r.choice(6, n, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1]), np.where(r.random(n) < 0.3, 0, r.integers(1, 60, n))
    assert packing.best_fit(lengths, sources, clusters, 100).tolist() == plain_best_fit(lengths, sources, clusters, 100)


def test_packing(spark):
    r = random.Random(1)
    rows = [(i, "w" * r.choice([0, 1, 30, 99, 100, 101, 350]) if i % 3 else "copy of one text", "en", f"s{i % 4}") for i in range(300)] + [(900, None, None, None), (None, "no id", "x", "s1"), (5, "again", "en", "s1"), (5, "again", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("bin_id", F.lit(0))
    out = packing.pack(docs, capacity=100, block=64).collect()
    bins, pieces = defaultdict(list), defaultdict(int)
    for p in out:
        bins[p["bin_id"]].append(p)
        pieces[p["doc_id"]] += p["length"]
    for own in bins.values():
        assert sum(p["length"] for p in own) <= 100
        assert len({p["source"] for p in own}) == len(own) == len({p["cluster"] for p in own})
        assert sorted(p["slot"] for p in own) == list(range(len(own)))
    want = defaultdict(int)
    for i, t, _, _ in rows:
        want[i] += len(t or "")
    assert pieces == want
    assert packing.pack(docs.limit(0)).count() == 0


KEY = b"test"


@pytest.mark.parametrize("n", [1, 2, 10, 73049, 1 << 32])
def test_feistel_permutes(n):
    net = pseudonyms.Feistel(KEY)
    some = range(n) if n <= 10 else range(0, n, n // 500)
    images = [net.permute(v, n, "k") for v in some]
    assert all(0 <= v < n for v in images) and len(set(images)) == len(images)


def test_pseudonyms_keep_their_format():
    p = pseudonyms.Pseudonymizer(KEY)
    text = "card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; born 1990-02-28, 28.02.1990, 02/29/2000, not 1990-02-30; ip 10.0.0.1 not 10.0.0.999; ssn 123-45-6789 not 000-45-6789; call +1 (743) 555-3824; DE89370400440532013000; mail Ann.b7@example.org"
    new, spans = p.text(text)
    assert [k for k, _, _ in spans] == ["card", "card", "date", "date", "date", "ip", "ssn", "phone", "iban", "mail"]
    for bad in ("4111111111111112", "1990-02-30", "10.0.0.999", "000-45-6789"):
        assert bad in new
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}),", new)
    assert cards[1].replace(" ", "") == cards[2] != "4111111111111111"  # equal values stay linked
    assert pseudonyms.luhn_digit(cards[2][:-1]) == cards[2][-1]
    iso = date.fromisoformat(re.search(r"born (\S+),", new)[1])
    assert f"{iso:%d.%m.%Y}" in new
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4};", new) and re.search(r"mail [A-Za-z]{3}\.[a-z]\d@[a-z]{7}\.org", new) and "example" not in new
    assert [k for k, _, _ in p.text("4111111111111111 10.0.0.1 3782 822463 10005 99 4111-1111-1111-1111")[1]] == ["card", "ip", "card", "card"]
    again, found = p.text(new)
    assert len(found) == len(spans) and again != new


@pytest.mark.parametrize("text, same", [
    ("+49 30 1234567 +49301234567 +49-30-1234567", True), ("+1 (212) 555-0123 +12125550123", True), ("4111-1111-1111-1111 4111111111111111", True),
    ("ann@a.example.org bob@a.example.org", None), ("+49 30 1234567 +49301234568", False),
])
def test_pseudonyms_link_equal_values(text, same):
    new, spans = pseudonyms.Pseudonymizer(KEY).text(text)
    assert len(spans) >= 2
    if same is None:
        hosts = [w.split("@")[1] for w in new.split(" ")]
        assert hosts[0] == hosts[1] != "a.example.org"
        return
    digits = {re.sub(r"\D", "", new[a:b]) for _, a, b in spans}  # pseudonyms are as long as what they replace
    assert (len(digits) == 1) is same


def test_pseudonyms_search_windows_only():
    """The windows hide nothing: they find what a search of the whole text finds."""
    p, r = pseudonyms.Pseudonymizer(KEY), random.Random(3)

    def whole(text):
        spans, m = [], pseudonyms.PATTERN.search(text)
        while m:
            good = p.of(m.lastgroup, m[0]) is not None
            spans += [(m.start(), m.end())] if good else []
            m = pseudonyms.PATTERN.search(text, m.end() if good else m.start() + 1)
        return spans

    seeds = ["+49 30 1234567", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "10.0.0.1", "1990-02-28", "(212) 555-0123", "ann.b1@example.org", "123-45-6789"]
    for _ in range(3000):
        text = "".join(r.choice(seeds) if r.random() < 0.15 else r.choice("0123456789 .-/+()@aAB \n,") for _ in range(r.randint(1, 40)))
        got = [(a, b) for _, a, b in p.text(text)[1]]
        assert got == whole(text)
        assert not got or re.search(pseudonyms.WORTH, text)


def test_pseudonyms_of_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 200_000 + " 10.1.2.3"), (4, "10.1.2.3"), (4, "10.1.2.3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = pseudonyms.pseudonymize(docs, KEY).select("doc_id", F.col("pseudonymized.text").alias("t"), F.size("pseudonymized.spans").alias("n")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1]["t"] is None and by[2]["t"] == "" and by[3]["n"] == 1 and by[3]["t"].endswith(by[4]["t"])
    assert pseudonyms.pseudonymize(docs.limit(0), KEY).count() == 0


def toxic_corpus(n=1500, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioubcdfgh") for _ in range(5)) for _ in range(600)]
    bad = ["vilewort", "grimword", "nastyling"]
    rows = []
    for i in range(n):
        toxic = r.random() < 0.15
        text = r.choices(words, k=r.choice([8, 40, 200])) + (r.choices(bad, k=r.choice([1, 3])) if toxic else [])
        r.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def crc(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs.withColumn("h", toxicity.held_out(F.col("doc_id"))), model).collect()}
    assert all(out[i]["h"] == crc(i) for i in out)
    held = [(y, out[i]["score"]) for i, _, y in rows if crc(i)]
    assert np.mean([s >= 0.5 for y, s in held if y]) > 0.9 and np.mean([s < 0.5 for y, s in held if not y]) > 0.97
    # held-out labels don't reach the model
    other = toxicity.train(docs, labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(other.weight, model.weight) and other.bias == model.bias


def test_toxicity_of_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 50_000), (3, "a"), (3, "a")], "doc_id long, text string").withColumn("weight", F.lit(0))
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (empty, spark.createDataFrame([(None, 1), (3, None), (4, 0)], "doc_id long, toxic int")):
        out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(out) == 5 and all(r["score"] == 0.0 for r in out)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), empty)).count() == 0


def test_nnpu_risk_keeps_positives_from_being_memorised():
    # every positive has a feature of its own, also found among the unlabelled
    n = 60
    rows, cols = np.arange(2 * n), np.concatenate([np.arange(n), np.arange(n)])
    positive = np.arange(2 * n) < n
    w, bias = toxicity.fit_nnpu(rows, cols, positive, n, 0.1)
    assert 1 / (1 + np.exp(-(w + bias))).mean() > 0 and w.max() < 4


@pytest.fixture(scope="module")
def pipeline_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rows = toxic_corpus(500, 7)
    texts = [(i, t, "en", f"s{i % 3}", len(t), 1.5) for i, t, _ in rows]
    r = random.Random(3)
    for j in range(60):  # near copies
        words = texts[r.randrange(300)][1].split(" ")
        if len(words) > 100:
            words[r.randrange(len(words))] = "changed"
        texts.append((600 + j, " ".join(words), "en", "s1", 0, 2.5))
    texts += [(700, None, None, None, None, None), (701, "", "en", "s0", 0, 0.0), (702, "shared boilerplate line\nown text here", "en", "s0", 0, 0.0), (703, "shared boilerplate line\nother text there", "en", "s0", 0, 0.0), (703, "shared boilerplate line\nother text there", "en", "s0", 0, 0.0), (None, "nobody", "en", "s0", 6, 0.0)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_pipeline_stages(spark, pipeline_dir, tmp_path):
    docs = spark.read.parquet(f"{pipeline_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, function in corpus_pipeline.STAGES:
        function(spark, kept[-1], pipeline_dir).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mix", "packing"]
    assert all(k.columns == columns for k in kept[:-1])
    ids = [sorted((r["doc_id"] for r in k.collect()), key=str) for k in kept]
    model = toxicity.train(docs, spark.read.parquet(f"{pipeline_dir}/labels.parquet"))
    clean = toxicity.score(docs, model, score_col="x").where("x < 0.5")
    assert ids[1] == sorted((r["doc_id"] for r in clean.collect()), key=str)
    plain = plain_lines([(r["doc_id"], r["text"]) for r in kept[1].collect()])
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept[2].collect()), key=str) == sorted(((i, t) for i, _, _, t in plain), key=str)
    judged = minhash.near_duplicates(kept[2], percent=80).collect()
    assert set(ids[3]) == {r["id"] for r in judged if r["kept"]} and len(ids[3]) == len(set(ids[3]))
    assert ids[4] == sorted((r["doc_id"] for r in mixing.poisson_mix(kept[3]).collect()), key=str)
    lengths = defaultdict(int)
    for r in kept[4].collect():
        lengths[r["doc_id"]] += len(r["text"] or "")
    packed = defaultdict(int)
    for p in kept[5].collect():
        packed[p["doc_id"]] += p["length"]
    assert packed == lengths
    assert corpus_pipeline.run(spark, pipeline_dir).count() == kept[5].count()


def test_pipeline_of_an_empty_table(spark, pipeline_dir, tmp_path):
    docs = spark.read.parquet(f"{pipeline_dir}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, pipeline_dir)
        assert docs.count() == 0


def test_nothing_else_imports_this_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for f in (root / "chronofact").rglob("*.py"):
        if "llm" not in f.parts:
            assert "chronofact.llm" not in f.read_text()


def test_scoring_holds_little_beside_its_texts(spark):
    import tracemalloc

    import pyarrow as pa
    from pyspark.util import PythonEvalType

    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(2000)]  # 4 MB
    used = np.zeros(1 << toxicity.BITS, bool)
    used[::64] = True
    toxicity._presence(pa.array(texts[:10]), used)
    tracemalloc.start()
    toxicity._presence(pa.array(texts), used)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    # workers get Arrow's arrays: no Python string is made of a text
    scored = toxicity.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), toxicity.Model(np.ones(1 << toxicity.BITS), 0.0))
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in scored._jdf.queryExecution().toString()
    source = open(toxicity.__file__).read()
    assert source.count("mapInArrow(") == source.count("mapInArrow(released(")
