"""Small cases and brute-force comparisons for every operator of the subpackage."""

import collections
import gzip
import math
import os
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shredloom import session
from shredloom.llm import roster as llm_roster
from shredloom.llm import ann, components, decontaminate, fm, line_dedup, near_dup, ngram_lm, packing, pii, quality, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __key string, size int"


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def documents(spark, texts, sources=None):
    """Rows with clashing extra columns; ids from 0 on."""
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1) for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


@pytest.fixture(scope="module")
def rng():
    return random.Random(3)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    texts, rows = [], []
    for i in range(400):
        toxic, low = i % 4 == 0, i % 5 == 0
        words = sentence(rng, 60).split()
        if toxic:
            words[3:3] = ["idiot", "scum"]
        text = " ".join(words)
        texts.append(text.upper() + " !!! ### $$$" * 20 if low else text)
        rows.append((i, int(not low), int(toxic)))
    return documents(spark, [*texts, None, "", "x" * 200_000]), spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxicity_finds_held_out_documents(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.where("doc_id < 300"))
    found = {r.doc_id for r in toxicity.toxic_documents(docs, model).collect()}
    assert {i for i in range(300, 400) if i % 4 == 0} <= found
    assert not {i for i in range(400) if i % 4} & found and not {400, 401, 402} & found


def test_quality_keeps_good_documents_and_columns(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels.where("doc_id < 300"))
    kept = quality.quality_filter(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(400) if i % 5} <= ids and not {i for i in range(400) if i % 5 == 0} & ids
    assert {r.doc_id for r in quality.kept_documents(docs, model).collect()} == ids


def test_classifiers_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    none = labels.where("false")
    assert toxicity.toxic_documents(docs, toxicity.train(docs, none)).count() == 0
    assert quality.quality_filter(docs, quality.train(docs, none)).count() == docs.count()
    assert toxicity.toxic_documents(docs.where("false"), toxicity.train(docs.where("false"), labels)).count() == 0
    one = labels.withColumn("toxic", F.lit(0)).unionByName(labels.withColumn("toxic", F.lit(None).cast("int")))
    assert toxicity.toxic_documents(docs, toxicity.train(docs, one)).count() == 0


def test_factorisation_identity_and_interaction():
    rng = np.random.default_rng(0)
    v, w, x = rng.normal(size=(6, 3)), rng.normal(size=6), rng.normal(size=6)
    fast = fm._raw(0.1, w, v, x, np.array([0, 4, 6]))
    slow = [0.1 + sum(w[i] * x[i] for i in r) + sum(v[i] @ v[j] * x[i] * x[j] for i in r for j in r if i < j) for r in (range(4), range(4, 6))]
    assert np.allclose(fast, slow)
    # feature 2 is there only with both 0 and 1: pairs matter
    rows = [[0, 1], [0], [1], [3]] * 60
    f = fm.Features(np.cumsum([0, *map(len, rows)]), np.concatenate([np.array(r) for r in rows]), np.ones(sum(map(len, rows))))
    y = np.array([1, 0, 0, 0] * 60, float)
    p = fm.fit(f, y, fm.Params(bits=4, l1=1e-6, epochs=20, factor_epochs=60)).score(f)
    assert ((p > 0.5) == (y == 1)).all()


def test_toxicity_learns_a_partner_without_effect_of_its_own():
    rng = random.Random(1)

    def texts(n):
        out, toxic = [], []
        for _ in range(n):
            w, u, kind = [f"w{rng.randrange(600)}" for _ in range(12)], rng.random(), 0
            if u < 0.04:
                kind = 1 if rng.random() < 0.83 else 2
                w[3:3] = ["trash", "can"][: 3 - kind]
            elif u < 0.24:
                w[5:5] = ["can"]
            out.append(" ".join(w))
            toxic.append(kind)
        return toxicity.features(pa.RecordBatch.from_arrays([pa.array(out)], ["text"])), np.array(toxic)

    f, kind = texts(8192)
    model = fm.fit(f, (kind == 2).astype(float), toxicity.PARAMS)
    f, kind = texts(4000)
    hit = model.score(f) >= 0.5
    assert hit[kind == 2].mean() > 0.95 and hit[kind == 1].mean() < 0.05 and hit[kind == 0].mean() < 0.01


def slow_score(model, f):
    """Scores of a factorisation machine pair by pair."""
    at = {b: i for i, b in enumerate(model.bucket.tolist())}
    out = []
    for lo, hi in zip(f.first[:-1], f.first[1:]):
        known = [(at[b], x) for b, x in zip(f.bucket[lo:hi].tolist(), f.x[lo:hi].tolist()) if b in at]
        raw = model.bias + sum(model.w[i] * x for i, x in known)
        raw += sum(model.v[i] @ model.v[j] * x * y for n, (i, x) in enumerate(known) for j, y in known[:n])
        out.append(1 / (1 + math.exp(-min(30, max(-30, raw)))))
    return np.array(out)


@pytest.mark.parametrize("share", [0.5, 0.2])
def test_pairs_without_any_effect_of_their_own_are_learned(share):
    """Neither word tells anything alone: with either one of the two half of the rows are toxic, by the other one."""
    rng = random.Random(2)

    def rows(n):
        texts, y = [], []
        for _ in range(n):
            w = [f"w{rng.randrange(300)}" for _ in range(10)]
            a, b = rng.random() < share, rng.random() < 0.5
            w[2:2] = ["alpha"] * a + ["omega"] * b
            texts.append(" ".join(w))
            y.append(float(a != b) if share == 0.5 else float(a and b) if a else float(rng.random() < 0.5))
        return pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), np.array(y), np.array([" alpha" in t or t.startswith("alpha") for t in texts])

    batch, y, _ = rows(6000)
    model = fm.fit(toxicity.features(batch), y, toxicity.PARAMS)
    batch, y, has = rows(2000)
    hit = model.score(toxicity.features(batch)) >= 0.5
    told = np.ones(len(y), bool) if share == 0.5 else has
    assert (hit == (y == 1))[told].mean() > 0.97


def test_training_memory_does_not_hold_the_factors_of_all_entries():
    rng, n, k = np.random.default_rng(3), 2000, 500
    f = fm.Features(np.arange(n + 1) * k, rng.integers(0, 5000, n * k), np.ones(n * k))
    y = (rng.random(n) < 0.3).astype(float)
    tracemalloc.start()
    fm.fit(f, y, fm.Params(epochs=1, factor_epochs=1, pair_share=0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_classifier_queries_score_as_pair_by_pair(spark, labelled):
    docs, labels = labelled
    batch = docs.select("doc_id", "text", "lang", "source").where("doc_id < 60 or doc_id in (400, 401)").orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    tox, low = toxicity.train(docs, labels), quality.train(docs, labels)
    slow = slow_score(tox, toxicity.features(batch))
    got = {r.doc_id: r.toxicity for r in toxicity.toxic_documents(docs, tox).collect()}
    assert {i: round(p, 6) for i, p in zip(batch.column("doc_id").to_pylist(), slow.tolist()) if p >= tox.cut and i < 60} == pytest.approx({i: p for i, p in got.items() if i < 60})
    slow = slow_score(low, quality.features(batch))
    got = {r.doc_id: r.quality for r in quality.kept_documents(docs, low).collect()}
    assert {i: round(1 - p, 6) for i, p in zip(batch.column("doc_id").to_pylist(), slow.tolist()) if p <= low.cut} == pytest.approx({i: p for i, p in got.items() if i < 60 or i in (400, 401)})


def test_classifiers_read_documents_in_many_tasks(spark, labelled):
    docs, labels = labelled
    seen = []
    spread = docs.repartition(6).withColumn("task", F.spark_partition_id())
    assert len({r.task for r in spread.select("task").distinct().collect()}) == 6
    plain, many = toxicity.train(docs.coalesce(1), labels), toxicity.train(spread, labels)
    assert plain.bias == many.bias and (plain.bucket == many.bucket).all() and np.allclose(plain.v, many.v), seen


# --- personal data


@pytest.mark.parametrize(
    ("text", "kind", "source", "value"),
    [
        ("write to john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com", "john.doe@example.com"),
        ("mail jane at example dot com please", "email", "jane at example dot com", "jane@example.com"),
        ("call five five five one two three four five six seven ok", "phone", "five five five one two three four five six seven", "5551234567"),
        ("see раul@ехample.com", "email", "раul@ехample.com", "paul@example.com"),
        ("see ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "john@example.com"),
        ("a​b@ex​ample.com", "email", "a​b@ex​ample.com", "ab@example.com"),
        ("card 4111 1111 1111 1111.", "card", "4111 1111 1111 1111", "4111 1111 1111 1111"),
        ("ip 10.0.0.255, ok", "ip", "10.0.0.255", "10.0.0.255"),
        ("+1 (017) 555-7713%%%", "phone", "+1 (017) 555-7713", "+1 (017) 555-7713"),
        ("DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
    ],
)
def test_pii_spans(text, kind, source, value):
    assert [(text[s:e], k, v) for s, e, k, v in pii.detect(text)] == [(source, kind, value)]


def test_pii_leaves_clean_text(spark):
    clean = ["Look at this. At dot or three or four things.", "Version 4.0.1 of 12 parts, one two", None, "", "w " * 100_000]
    assert pii.find_pii(documents(spark, clean)).count() == 0


def test_pii_hints_lose_nothing():
    rng = random.Random(1)
    bits = ["at", "dot", "seven", "zwei", "12", "555", "(at)", "[dot]", "@", "a@b.com", "1.2.3.4", "é", "ｘ", "+1 555 123 4567", "token: abc12345x", "w", "com", "\n", "one-two-three-four"]
    texts = [" ".join(rng.choice(bits) for _ in range(12)) for _ in range(600)]
    h = pii.Hints(pa.array(texts))
    assert [pii.detect(t, h.glyph[i], h.spelled[i], h.dot[i], h.digit[i]) for i, t in enumerate(texts)] == [pii.detect(t) for t in texts]


# --- WARC


def test_warc_round_trip_and_push_down(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, None, ""), (3, "http://b/", None), (None, "http://c/", "x")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    assert warc.write_pages(pages, folder) == 3
    got = {(r.page_id, r.url, r.html) for r in warc.read_pages(spark, folder).collect()}
    assert got == {(1, "http://a/", "<p>é</p>"), (2, None, ""), (3, "http://b/", "")}
    df = spark.read.format("warc").load(folder)
    plan = df.where("warc_type = 'request'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter .*warc_type", plan)
    assert df.where("warc_type = 'request' and length(target_uri) > 3").count() == 2
    reader = warc.WarcReader({"path": folder})
    assert not list(reader.pushFilters([warc.ds.EqualTo(("warc_type",), "response"), warc.ds.EqualTo(("http_status",), 404)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 0
    assert spark.read.format("warc").option("payload", "false").load(folder).where("payload is not null").count() == 0


def test_warc_encodings_and_damage(spark, tmp_path):
    body = gzip.compress(b"hello")
    chunked = b"%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    record = warc._record("response", "<urn:page:9>", "http://x/", "application/http; msgtype=response", http)
    (tmp_path / "a.warc").write_bytes(b"junk\r\n" + record + record[:-20])
    (tmp_path / "empty.warc").write_bytes(b"")
    warc.register(spark)
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    assert [bytes(rows[0].payload), rows[0].http_status] == [b"hello", 200]
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.WarcReader({"path": str(tmp_path / "a.warc"), "mode": "failfast"})._records(str(tmp_path / "a.warc")))


# --- near duplicates


def brute_near(texts, e):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    pairs = []
    for a in range(len(sets)):
        for b in range(a):
            low, high = sorted((len(sets[a]), len(sets[b])))
            if low and high <= e.max_ratio * low and len(sets[a] & sets[b]) >= e.threshold * low:
                pairs.append((a, b))
    return pairs


def test_near_duplicates_against_brute_force(spark, rng):
    texts = [sentence(rng, rng.randrange(30, 200), 5000) for _ in range(60)]
    for i in range(40):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 25)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + ["one", "one", "two words", None, "", "", texts[3] + " " + sentence(rng, len(texts[3].split()) // 2, 5000)]
    e = near_dup.Ensemble()
    found = {r.doc_id: r.group_id for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
    pairs = brute_near(texts, e)
    hit = [p for p in pairs if p[0] in found and found.get(p[0]) == found.get(p[1])]
    assert len(hit) >= 0.9 * len(pairs) and set(found) <= {i for p in pairs for i in p}
    kept = {r.doc_id for r in near_dup.near_dedup(documents(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - {i for i, g in found.items() if i != g}


def test_near_duplicates_hold_much_smaller_documents(spark):
    rng = random.Random(8)
    long = [sentence(rng, 900, 5000) for _ in range(6)]
    texts = list(long)
    for i, n in enumerate((4, 12, 40, 120, 300)):
        texts.append(" ".join(long[i].split()[50 : 50 + n]))
    edited = long[5].split()[100:200]
    for at in (20, 60, 90):
        edited[at] = "changed"
    common = sentence(rng, 30, 5000)
    texts += [" ".join(edited), sentence(rng, 40, 5000), common, f"{sentence(rng, 200, 5000)} {common}", f"{sentence(rng, 300, 5000)} {common}"]
    found = {r.doc_id: r.group_id for r in near_dup.near_duplicates(documents(spark, texts)).collect()}
    # the common passage goes with the larger of the two texts that hold it, and these two stay apart
    assert found == {i: i % 6 for i in range(12)} | {13: 15, 15: 15}
    assert {r.doc_id for r in near_dup.near_dedup(documents(spark, texts)).collect()} == {*range(6), 12, 14, 15}


def test_near_duplicates_try_more_than_the_largest_of_those_that_share_frequent_shingles(spark):
    rng = random.Random(9)
    text = [f"a{i}" for i in range(300)]
    parts = [" ".join(text[i : i + 3]) for i in range(298)]
    values, _ = near_dup.shingle_sets(next(near_dup.groups(pa.array(parts))))
    assert len(values) == 298
    each = [near_dup.shingle_sets(next(near_dup.groups(pa.array([p]))))[0][0] for p in parts]
    sampled = [parts[i] for i in np.argsort(each)[: near_dup.SAMPLE]]
    # all of these hold what is sampled of the text, but only the smallest holds the text
    larger = [" ".join(f"{p} {sentence(rng, 60, 90_000)}" for p in sampled) for _ in range(near_dup.HOT + 6)]
    texts = [" ".join(text), f"{' '.join(text)} {sentence(rng, 400, 90_000)}", *larger]
    docs = documents(spark, texts)
    assert {r.doc_id: r.group_id for r in near_dup.near_duplicates(docs).collect()} == {0: 1, 1: 1}


def test_exact_lookup_counts_only_pairs_with_two_of_the_rarest(spark, monkeypatch):
    rng = random.Random(8)
    common = [sentence(rng, 12, 90_000) for _ in range(12)]
    small = [" ".join(rng.sample(common, rng.randrange(1, 5))) for _ in range(40)] + [sentence(rng, 30, 90_000)]
    large = [" ".join([*rng.sample(common, 6), sentence(rng, rng.randrange(200, 300), 90_000)]) for _ in range(80)]
    docs = documents(spark, small + large)
    sets = [set(near_dup.shingle_sets(next(near_dup.groups(pa.array([t]))))[0].tolist()) for t in small + large]
    rest = docs.where(F.col("doc_id") < len(small)).select(F.col("doc_id").alias("a"))
    want = {}
    for i, a in enumerate(sets[: len(small)]):
        held = [(len(a & b), len(b), -j) for j, b in enumerate(sets) if len(b) > 2 * len(a) and len(a & b) / len(a) >= 0.65]
        want |= {i: -max(held)[2]} if held else {}
    assert 10 < len(want) < 41
    monkeypatch.setattr(near_dup, "EXACT_PAIRS", 50)
    for rows in (4_000_000, 500):
        monkeypatch.setattr(near_dup, "EXACT_ROWS", rows)
        assert {r.a: r.b for r in near_dup._held_exactly(docs, rest, near_dup.Ensemble()).collect()} == want


def test_materialize_leaves_no_shuffle_files(spark):
    from shredloom.session import discard, materialize

    def shuffles():
        return set(re.findall(r"shuffle_\d+_\d+", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, value = shuffles(), spark.conf.get(name)
    found = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.monotonic() + 20  # they go in the background
    while shuffles() - before and time.monotonic() < end:
        time.sleep(0.1)
    assert not shuffles() - before and found.count() == 7 and spark.conf.get(name) == value
    folder = found.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    discard(found)
    assert not os.path.exists(folder)


def test_near_duplicates_keep_no_signature_keys(spark, rng, tmp_path, monkeypatch):
    texts = [sentence(rng, 60, 5000) for _ in range(20)]
    texts += [t + " more" for t in texts[:6]] + texts[:3]
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    found = near_dup.near_duplicates(documents(spark, texts))
    assert not [p for p in tmp_path.glob("*") if p.name.split("-")[0] in ("buckets", "told")]
    assert not [p for p in tmp_path.glob("signatures-*/*.parquet") if "keys" in pq.read_schema(p).names]
    assert {r.doc_id: r.group_id for r in found.collect()} == {i: 20 + i for i in range(6)} | {20 + i: 20 + i for i in range(6)} | {26 + i: 20 + i for i in range(3)}


def test_slots_of_shingles_keep_small_values_apart():
    rng = np.random.default_rng(4)
    few, all_ = rng.integers(0, 1 << 42, 100_000).astype(np.int64), rng.integers(0, 1 << 48, 100_000).astype(np.int64)
    taken = np.zeros(1 << 20, bool)
    taken[near_dup._places(few, 20)] = True
    assert taken[near_dup._places(few, 20)].all() and taken[near_dup._places(all_, 20)].mean() < 0.03  # 0.09 without regions


def test_near_duplicates_of_nothing(spark):
    docs = documents(spark, [None, ""])
    assert near_dup.near_duplicates(docs).count() == 0 and near_dup.near_dedup(docs.where("false")).count() == 0
    twice = docs.unionByName(docs)
    assert near_dup.near_dedup(twice).count() == 4


def test_banding_is_tuned_by_partition_distance():
    e = near_dup.Ensemble()
    for step, (rows, bands) in enumerate(e.bandings()):
        j = e.jaccard(min(2 ** ((step + 1) / 2), e.max_ratio))
        assert rows * bands <= near_dup.BINS and 1 - (1 - j**rows) ** bands >= e.recall


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 103), (103, 101), (7, 7)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 103: 100}


# --- language model


def ngram_logs(text, corpus):
    """Log probability of a text and its mean context, from counts of all n-grams of a corpus."""
    count = collections.Counter()
    for c in corpus:
        w = tokens(c)
        for n in range(1, len(w) + 1):
            for i in range(len(w) - n + 1):
                count[tuple(w[i : i + n])] += 1
    total = sum(n for k, n in count.items() if len(k) == 1)
    w, logs, contexts = tokens(text), 0.0, 0
    for i in range(len(w)):
        n = max(n for n in range(i + 1) if n == 0 or count[tuple(w[i - n : i])])
        seen = count[tuple(w[i - n : i])] if n else total
        alone = (count[(w[i],)] + 1) / (total + ngram_lm.VOCABULARY)
        logs += math.log((count[tuple(w[i - n : i + 1])] + ngram_lm.ALPHA * alone) / (seen + ngram_lm.ALPHA))
        contexts += n
    return logs, contexts / len(w) if w else None


def test_ngram_scores_against_counts(spark, rng):
    corpus = [sentence(rng, rng.randrange(1, 60), 12) for _ in range(40)] + [None, "", "a a a a a a a a"] * 2
    corpus += [corpus[3] + " tail", corpus[3], "b " + corpus[3]]
    texts = [sentence(rng, 20, 14), corpus[0], corpus[3], "", None, "unseen", "a a a a"]
    shards, total = ngram_lm.index(documents(spark, corpus), 300)
    assert len(shards) > 2 and total == sum(len(tokens(c)) for c in corpus)
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    scored = ngram_lm.score(spark.createDataFrame(rows, "row long, text string"), ["row"], shards, total, block_chars=50).collect()
    assert len(scored) == len(rows)
    for r in scored:
        logs, mean = ngram_logs(texts[r.row], corpus)
        assert r.n_words == len(tokens(texts[r.row])) and abs(r.log_prob - logs) < 1e-5
        assert (r.mean_context is None) == (mean is None) and abs((r.mean_context or 0) - (mean or 0)) < 1e-5


def test_ngram_scores_without_the_texts_own_rows(spark, rng):
    corpus = [sentence(rng, rng.randrange(1, 40), 12) for _ in range(24)] + ["a a a a a a a a", None, "only here"]
    corpus += [corpus[5], corpus[5] + " tail", corpus[6]]
    docs = documents(spark, corpus)
    docs = docs.unionByName(docs.where("doc_id = 6")).unionByName(documents(spark, ["nobody owns this"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for chars in (150, 1 << 20):
        shards, total = ngram_lm.index(docs, chars)
        scored = ngram_lm.score(docs, ["doc_id"], shards, total, own="doc_id", block_chars=200).collect()
        assert len(scored) == len(rows)
        for r in scored:
            text = next(t for i, t in rows if i == r.doc_id)
            logs, _ = ngram_logs(text, [t for i, t in rows if i is None or i != r.doc_id])
            assert abs(r.log_prob - logs) < 1e-5, r


def test_ngram_match_of_a_long_copy(spark, rng):
    long = sentence(rng, 20_000, 5000)
    shards, total = ngram_lm.index(documents(spark, [long, long, "x " + long]))
    got = ngram_lm.score(documents(spark, [long]), ["doc_id"], shards, total, own="doc_id").first()
    assert got.n_words == 20_000 and got.mean_context > 9000


def test_ngram_scores_from_passages_are_those_of_the_whole_index(spark, rng):
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [" ".join([t, "x", t, *rng.sample(words, 3)]) for t in texts[:20]] + [None, "", texts[3], texts[3]]
    rows = [*enumerate(texts), (None, texts[5]), (4, texts[9]), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = docs.where("doc_id % 3 = 1 or doc_id is null")
    shards, total = ngram_lm.index(docs, 300)
    for own in ("doc_id", None):
        want = ngram_lm.score(asked, ["doc_id"], shards, total, own=own).collect()
        got = ngram_lm.scores(docs, asked, ["doc_id"], own=own, block_chars=1500, shard_words=400).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == asked.count()
    nothing = docs.where("false")
    assert ngram_lm.scores(docs, nothing, ["doc_id"]).count() == 0 and ngram_lm.scores(nothing, docs, ["doc_id"]).count() == len(rows)


def test_ngram_query_indexes_only_passages_of_its_texts(spark, rng, tmp_path, monkeypatch):
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(200)) for _ in range(150)]
    texts[50] = "first " + texts[100] + " last"
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(ngram_lm, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert {r.doc_id for r in llm_roster.op6_ngram_lm(spark, str(tmp_path)).collect()} == {0, 100}
    held = [ngram_lm.load(f"file://{p}") for p in tmp_path.glob("ngrams-*/shard-*")]
    assert sum((s.token > 0).sum() for s in held) == 3 * 200  # the two texts and the passage, of 30,000 words


def test_ngram_query_keeps_nothing_of_the_corpus_but_sums_and_passages(spark, rng, tmp_path, monkeypatch):
    docs = documents(spark, [sentence(rng, 50, 60) for _ in range(40)])
    asked = docs.where("doc_id % 5 = 0")
    want = ngram_lm.scores(docs, asked, ["doc_id"], own="doc_id").collect()
    for module in (session, ngram_lm):
        monkeypatch.setattr(module, "shared_dir", lambda spark: f"file://{tmp_path}")
    found = ngram_lm.scores(docs, asked, ["doc_id"], own="doc_id")
    assert {p.name.split("-")[0] for p in tmp_path.glob("*")} == {"texts", "counts", "ngrams"}
    assert sorted(map(str, found.collect())) == sorted(map(str, want)) and len(want) == 8


def test_ngram_without_corpus(spark):
    shards, total = ngram_lm.index(documents(spark, [None]))
    assert (shards, total) == ([], 0)
    assert ngram_lm.score(documents(spark, ["a b", None]), ["doc_id"], shards, total).count() == 2


# --- lines


def test_line_dedup_by_hand(spark):
    texts = ["keep a\nwide line\n\nx", "wide line\nkeep b", "  wide line \nnarrow", "narrow\nkeep c", None, "", "wide line", "null site\nwide line"]
    docs = documents(spark, texts, ["a", "b", "c", "a", "a", "b", "c", None])
    out = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.line_dedup(docs).collect()}
    assert [out[i][0] for i in range(8)] == [texts[0], "keep b", "narrow", texts[3], None, "", "", "null site"]
    assert out[1][1] == 6 and line_dedup.line_dedup(docs).columns == docs.columns
    assert {r.doc_id for r in line_dedup.line_dedup(docs, drop_emptied=True).collect()} == {0, 1, 2, 3, 4, 5, 7}
    assert line_dedup.line_dedup(docs.where("false")).count() == 0


def test_line_spread_near_the_threshold_is_exact(spark):
    rows = [(i, f"line {k}", f"s{i}") for k in (39, 40, 41) for i in range(k)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id bigint, text string, source string")
    _, wide = line_dedup.spread_lines(docs, min_sites=40, lg_k=4)
    assert wide.count() == 2


# --- neighbours


def test_neighbours_recall_and_cases(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 16)) * 0.5 + c for c in rng.normal(size=(6, 16)) * 2])[:1200].astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5001, [1.0], 0), (5002, [float("nan")] * 16, 0), (None, x[0].tolist(), 0), (0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, cell_rows=300).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append((r.neighbour_id, r.distance))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, 1)[:, :10]
    recall = np.mean([len({n for n, _ in got[i]} & set(best[i].tolist())) / 10 for i in range(len(x))])
    assert recall >= 0.9 and set(got) == set(range(len(x))) and got[3][0] == (7, 0.0)


def test_neighbours_ties_string_ids_and_stated_queries(spark):
    rows = [(f"v{i:03d}", [1.0, 2.0, 3.0]) for i in range(40)] + [(f"x{i:03d}", [float(i), 0.5, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows * 2, "vec_id string, embedding array<float>")
    asked = df.where("vec_id in ('v005', 'v039', 'x000')").withColumn("place", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.neighbours(df.withColumn("proj", F.lit("a")), asked, cell_rows=10).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append((r.neighbour_id, r.distance))
    first = [f"v{i:03d}" for i in range(11)]
    assert got["v005"] == [(i, 0.0) for i in first if i != "v005"] and got["v039"] == [(i, 0.0) for i in first[:10]]
    assert [n for n, _ in got["x000"][:3]] == ["x001", "x002", "x003"] and set(got) == {"v005", "v039", "x000"}


def test_neighbours_of_few(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert ann.neighbours(spark.createDataFrame([], kind)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], kind)).count() == 2


# --- benchmark


def brute_leaks(texts, items):
    found = {}
    for d, t in enumerate(texts):
        w = tokens(t)
        for k, item in enumerate(items):
            v = tokens(item)
            if len(v) < 3:
                continue

            def bag(x):
                return collections.Counter(tuple(x[i : i + 3]) for i in range(len(x) - 2))

            weight = lambda s: sum(len(y.encode()) for y in s)
            b, best = bag(v), 0
            for s in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[s : s + len(v)])
                both, union = sum(weight(g) * n for g, n in (a & b).items()), sum(weight(g) * n for g, n in (a | b).items())
                best = max(best, both / union if union else 0)
            if best >= decontaminate.THRESHOLD:
                found[d, k] = round(best, 6)
    return found


def test_leaks_against_brute_force(spark, rng):
    items = [sentence(rng, n, 3000) for n in (15, 15, 40, 60, 3)] + ["two words", None, ""]
    edited = items[2].split()
    edited[5] = edited[20] = "changed"
    texts = [sentence(rng, 50, 3000) + " " + items[0] + " " + sentence(rng, 30, 3000), " ".join(edited), items[3].upper() + "!", items[3][: len(items[3]) * 3 // 4], sentence(rng, 300, 3000), None, "", items[1] + " " + items[4], "x y"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    want = brute_leaks(texts, [x or "" for x in items])
    assert got == want and {(0, 0), (1, 2), (2, 3), (7, 1)} <= set(got)
    kept = {r.doc_id for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    assert decontaminate.decontaminate(documents(spark, texts), bench.where("false")).count() == len(texts)


def test_passes_cover_all_items(spark, rng):
    bench = spark.createDataFrame([(i, sentence(rng, 20)) for i in range(10)], "item_id bigint, text string")
    assert [len(p.ids) for p in decontaminate.passes(bench, 60)] == [3, 3, 3, 1]


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 2**63, 50, dtype=np.uint64)
    queries = np.array([int(items[i % 50]) ^ sum(1 << int(b) for b in rng.choice(64, i % 30, replace=False)) for i in range(300)], np.uint64)
    q, k = decontaminate.Hamming.build(np.arange(50), items).within(queries)
    want = {(a, b) for a in range(300) for b in range(50) if (int(queries[a]) ^ int(items[b])).bit_count() <= decontaminate.RADIUS}
    assert set(zip(q.tolist(), k.tolist())) == want


def test_decontamination_of_a_long_text_holds_few_comparisons_at_once():
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    common = "alpha beta gamma delta "
    items = [common + " ".join(r.choice(vocabulary, 16)) for _ in range(1000)]
    # all windows share a shingle with every item, and one item is there
    text = items[7] + " " + " ".join("alpha beta gamma " + " ".join(r.choice(vocabulary, 9)) for _ in range(400))
    index = decontaminate.Items(list(range(1000)), items)
    index.similarity = lambda i, h, weight: float(i == 7)  # what is verified takes time, not memory
    tracemalloc.start()
    try:
        found = [x for g in decontaminate.groups(pa.array([text])) for x in index.search(g)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [x[:2] for x in found] == [(0, 7)] and peak < 150e6


@pytest.mark.parametrize("at_once", [1, 7, 50])
def test_decontamination_in_stretches_finds_the_same(rng, monkeypatch, at_once):
    items = [sentence(rng, n, 60) for n in (15, 15, 15, 40, 40)]
    texts = [" ".join([sentence(rng, 20, 60), items[i % 5], sentence(rng, 200, 60), items[(i + 1) % 5]]) for i in range(8)]
    index = decontaminate.Items(list(range(5)), items)

    def found():
        return [x for g in decontaminate.groups(pa.array(texts)) for x in index.search(g)]

    whole = found()
    monkeypatch.setattr(decontaminate, "STRETCH", at_once)
    monkeypatch.setattr(decontaminate, "LOOKUPS", at_once)
    assert found() == whole and {x[:2] for x in whole} >= {(i, (i + k) % 5) for i in range(8) for k in (0, 1)}


# --- packing


def test_best_fit_decreasing_against_scan(rng):
    for capacity in (1, 7, 64, 2048):
        sizes = np.array(sorted((rng.randrange(1, capacity + 1) for _ in range(400)), reverse=True))
        window, offset = packing.best_fit_decreasing(sizes, capacity)
        room = []
        for s, w, o in zip(sizes.tolist(), window.tolist(), offset.tolist()):
            fits = [r for r in room if r >= s]
            if fits:
                assert room[w] == min(fits) and capacity - room[w] == o
                room[w] -= s
            else:
                assert w == len(room) and o == 0
                room.append(capacity - s)


def test_windows_hold_every_token_once(spark, rng):
    texts = [sentence(rng, n) for n in (0, 1, 5, 10, 10, 10, 25, 64, 7, 3)] + [None]
    rows = packing.pack_documents(documents(spark, texts), capacity=10).collect()
    seen = collections.Counter()
    for r in rows:
        assert r.n_tokens == sum(r.token_counts) <= 10
        for d, s, n in zip(r.doc_ids, r.token_starts, r.token_counts):
            seen.update((d, i) for i in range(s, s + n))
    assert seen == {(d, i): 1 for d, t in enumerate(texts) for i in range(len((t or "").split()))}
    assert packing.pack_documents(documents(spark, [None])).count() == 0


# --- cases that all operators state

CLASHING = ("__doc", "__cut", "__text", "__gone", "__key", "size", "id", "a", "b", "key", "root", "block", "row", "place", "proj")


def clashing(df):
    """The table with columns of names that operators might use inside."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])


def test_operators_take_clashing_names(spark, rng):
    line = "shared line of text"
    texts = [f"{sentence(rng, 40)}\n{line}" for _ in range(4)]
    docs = clashing(documents(spark, [*texts, texts[0], None, ""], ["a", "b", "c", "d", "a", "a", None]))
    out = line_dedup.line_dedup(docs)
    assert out.columns == docs.columns and sum(line in (r.text or "") for r in out.collect()) == 1
    kept = near_dup.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    bench = clashing(spark.createDataFrame([(0, texts[1])], "item_id bigint, text string"))
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == {1}
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert packing.pack_documents(docs, 64).count() > 0 and pii.find_pii(docs).count() == 0
    shards, total = ngram_lm.index(docs)
    assert ngram_lm.score(docs, ["doc_id"], shards, total, own="doc_id").count() == 7


def test_line_ends_and_repeated_ids(spark):
    docs = documents(spark, ["wide\r\nx", "\twide", "wide \r"], ["a", "b", "c"])
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(docs.unionByName(docs)).collect()}
    assert out == {0: "wide\r\nx", 1: "", 2: ""}


def test_warc_cut_off_compression_and_negative_lengths(spark, tmp_path):
    record = warc._record("response", "<urn:page:1>", "http://x/", "text/html", b"hello" * 50)
    bad = record.replace(b"Content-Length: 250", b"Content-Length: -5")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(bad) + gzip.compress(record) + gzip.compress(record)[:-60])
    warc.register(spark)
    rows = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert len(rows) >= 2 and all(bytes(r.payload) == b"hello" * 50 for r in rows[:2])
    with pytest.raises((EOFError, ValueError)):
        reader = warc.WarcReader({"path": str(tmp_path), "mode": "failfast"})
        list(reader.read(reader.partitions()[0]))


def test_pii_takes_time_in_proportion():
    import time

    def took(n):
        text = " ".join(f"+1 555 123 {i:04d}" for i in range(n))
        began = time.perf_counter()
        assert len(pii.detect(text)) == n
        return time.perf_counter() - began

    took(500)
    assert took(8000) < 16 * max(took(2000), 0.02)


def test_pii_of_nothing(spark):
    assert pii.find_pii(documents(spark, [])).count() == 0 and pii.find_pii(documents(spark, [None, ""])).count() == 0


def test_packing_is_the_same_in_any_order(spark, rng):
    docs = documents(spark, [sentence(rng, n) for n in (5, 70, 5, 12, 33, 64, 2)])
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    one, other = ({tuple(r.doc_ids + r.token_starts) for r in packing.pack_documents(d, 32).collect()} for d in (docs, docs.orderBy(F.desc("text")).repartition(5)))
    assert one == other and any(None in x for x in one)


def test_passes_of_items_find_the_same(spark, rng, monkeypatch):
    items = [sentence(rng, 20, 3000) for _ in range(6)]
    docs = documents(spark, [f"{sentence(rng, 30, 3000)} {i}" for i in items] + [sentence(rng, 60, 3000), None])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    whole = sorted(decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "passes", lambda b, one=decontaminate.passes: one(b, 40))
    assert sorted(decontaminate.leaks(docs, bench).collect()) == whole and len(whole) == 6
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {6, 7}


# --- pipeline


def test_pipeline_stages(spark, tmp_path, rng):
    import corpus_pipeline

    texts = [sentence(rng, 80, 5000) for _ in range(60)]
    texts += [t + " more" for t in texts[:5]] + [t.upper() + " !!! ###" * 60 for t in texts[10:30]]
    item = sentence(rng, 30, 9000)
    texts.append(sentence(rng, 40, 5000) + "\n" + item)
    docs = documents(spark, texts).drop("__key", "size")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 65 <= i < 85), 0) for i in range(len(texts))], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    packed = {d for r in corpus_pipeline.run(spark, str(tmp_path)).collect() for d in r.doc_ids}
    assert packed == {*range(5, 65)}  # the longer copy of each group stays
    assert 85 not in packed and not set(range(65, 85)) & packed


def test_pipeline_stages_hand_over_few_texts_at_a_time(spark, tmp_path, rng):
    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    spark.createDataFrame([(0, sentence(rng, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [sentence(rng, 5)] * 5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path))
        found = [r.n for r in spark.range(2500).repartition(1).mapInArrow(sizes, "n bigint").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(found) == 2500 and max(found) <= 1000


def test_workers_give_freed_memory_back():
    from shredloom.session import trimmed

    def resident():
        with open("/proc/self/status") as status:
            return next(int(line.split()[1]) for line in status if line.startswith("VmRSS")) / 1024

    kept = []

    def one(batches):
        held = [np.ones(8000) for _ in range(3000)]  # 192 MB, in pieces too small to be mapped each
        kept.append(held[-1])
        del held
        yield from batches

    before = resident()
    assert list(trimmed(one)(iter([1, 2]))) == [1, 2] and kept
    assert resident() - before < 60


def test_repeated_rows_give_repeated_results(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    once = toxicity.toxic_documents(docs, model).count()
    assert once and toxicity.toxic_documents(docs.unionByName(docs), model).count() == 2 * once
    text = documents(spark, ["mail a.b@example.com"])
    assert pii.find_pii(text.unionByName(text)).count() == 2


def test_queries_and_oracles_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {re.match(r"op(\d+)_", q)[1] for q in entry.queries() if q.startswith("op")} == {str(i) for i in range(1, 11)}
