"""Operators with Python stages against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowatlas.llm import ann, jaccard, mixing, quality, scratch, warc
from rowatlas.llm import hot as hot_keys
from rowatlas.llm import op8_nearest
from rowatlas.llm.components import components
from rowatlas.llm.scratch import Tables


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sets(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return bool(a) and bool(b) and len(a & b) * 5 >= len(a | b) * 4


def links(docs):
    s = [sets(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if similar(s[i], s[j])]
    up = list(range(len(s)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    count = [0] * len(s)
    for i, j in pairs:
        count[i] += 1
        count[j] += 1
        up[root(i)] = root(j)
    return [root(k) for k in range(len(s))], count


def near_copies(seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(90))
    docs = []
    for _ in range(30):
        base = [word() for _ in range(rng.choice([1, 3, 20, 200]))]
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for at in rng.sample(range(len(w)), min(len(w), rng.randrange(4))):
                w[at] = word()
            docs.append(" ".join(w))
    docs += [docs[0]] * 3 + ["", " ", None, "tiny", "tiny", "a b\tc", "a  b c"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("block", "bucket", "broadcast", "hot"), [(512, 512, 250_000, 1000), (8, 2, 0, 1)])
def test_jaccard_is_brute_force(spark, block, bucket, broadcast, hot, monkeypatch):
    for module, name, value in ((jaccard, "BLOCK", block), (jaccard, "BUCKET", bucket), (jaccard, "BROADCAST_ROWS", broadcast), (hot_keys, "HOT_ROWS", hot)):
        monkeypatch.setattr(module, name, value)
    docs = near_copies()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, uid int, tk int")
    got = {r.doc_id: r for r in jaccard.join(spark, df).collect()}
    roots, count = links(docs)
    least = defaultdict(lambda: 1 << 60)
    for (i, _), r in zip(docs, roots, strict=True):
        least[r] = min(least[r], i)
    assert [got[i].n_links for i, _ in docs] == count
    assert [got[i].class_id for i, _ in docs] == [least[r] for r in roots]
    kept = jaccard.keep_one(spark, df)
    assert kept.columns == ["doc_id", "text", "uid", "tk"] and sorted(r.doc_id for r in kept.collect()) == sorted(least[r] for r in set(roots))


def test_jaccard_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard.join(spark, df).collect())
    assert got == [("1", "None", 2), ("1", "None", 2), ("2", "2", 0), ("None", "None", 0), ("None", "None", 2)]
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(spark, df).collect()) == ["2", "None", "None"]
    assert jaccard.join(spark, df.limit(0)).count() == 0 and jaccard.keep_one(spark, df.limit(0)).count() == 0


def test_band_plan():
    n = jaccard.band_plan()
    assert 1 - (1 - 0.8**5) ** n >= 0.9999 > 1 - (1 - 0.8**5) ** (n - 1)


def test_chains_of_false_candidates_are_not_compared(spark):
    """Each document has half of its words in common with the next: many share a band, none is similar."""
    compared = []
    for n in (300, 600):
        rows = [(k, " ".join(f"w{k * 50 + j}" for j in range(150))) for k in range(n)]
        tables, bands = Tables(spark), jaccard.band_plan()
        docs = jaccard._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
        made = docs.mapInArrow(jaccard._features(jaccard.ROWS, bands), "doc_id long, tk binary, uid binary, bands array<long>, sketch binary")
        sets = tables.write(made.select(F.col("doc_id").alias("id"), "bands", "sketch"), "sets")
        chained = sets.select("id", F.explode("bands").alias("key")).groupBy("key").count().where("count > 1").count()
        groups = components(jaccard._candidates(sets, tables, jaccard.ROWS * bands, bands, 0.8), tables).groupBy("root").count().collect()
        compared.append(sum(r["count"] ** 2 for r in groups))
        assert chained > n / 2
    assert compared[1] <= 2 * compared[0] + 20


def test_sketch_floor():
    assert jaccard.sketch_floor(120) == 69
    rng = np.random.default_rng(3)
    agree = rng.binomial(120, 0.8, 1_000_000)
    assert (agree >= jaccard.sketch_floor(120)).all()


def test_similarity_is_a_parameter(spark):
    rows = [(1, " ".join(map(str, range(40)))), (2, " ".join(map(str, range(30)))), (3, "other words of no kin at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_links for r in jaccard.join(spark, df).orderBy("doc_id").collect()] == [0, 0, 0]
    assert [r.n_links for r in jaccard.join(spark, df, share=(7, 10)).orderBy("doc_id").collect()] == [1, 1, 0]


@pytest.mark.parametrize("rows", [1, 1000])
def test_joins_of_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(hot_keys, "HOT_ROWS", rows)
    left = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(60)], "k long, x long")
    right = left.where("k < 5").groupBy("k").agg(F.count("*").alias("n"))
    inner = hot_keys.join_counted(left, right, "k", "n", 60)
    assert sorted(map(tuple, inner.select("k", "x", "n").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "n").collect()))
    outer = hot_keys.join_counted(left, right, "k", "n", 60, True)
    assert sorted(map(str, outer.select("k", "x", "n").collect())) == sorted(map(str, left.join(right, "k", "left").select("k", "x", "n").collect()))


def test_dense_comparison_is_set_comparison():
    rng = np.random.default_rng(1)
    make = lambda n: [np.unique(rng.integers(0, 40, rng.integers(1, 30)).astype(np.uint64)) for _ in range(n)]
    a, b = make(40), make(30)
    i, j = jaccard._similar(a, b, False)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(40) for y in range(30) if similar(set(a[x].tolist()), set(b[y].tolist()))}
    a = a + a[:9]
    i, j = jaccard._similar(a, a, True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(49) for y in range(x + 1, 49) if similar(set(a[x].tolist()), set(a[y].tolist()))}


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7), (300, 301), (300, 302)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Tables(spark)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100, 300: 300, 301: 300, 302: 300}


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(k, f"http://h/{k % 5}\r\nX: y", rng_text(k)) for k in range(60)] + [(70, "u", big), (71, None, big), (72, "u", big), (73, "u", None), (74, "u", ""), (75, "u", "small"), (76, "u", "small"), (None, "u", "é😀")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    warc.write_archives(spark, df, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(i, last.get(h, i))
    assert sum(last[h] != i for i, _, h in rows if h in last) > 2
    for i, _, h in rows:
        raw = (h or "").encode()
        other = last.get(h, i) if last.get(h, i) != i else None
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == ("response" if other is None else "revisit", other)
        assert got[i].payload is None if other is not None else bytes(got[i].payload) == raw
    warc.write_archives(spark, df.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(hot_keys, "HOT_ROWS", 2)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "20")
    try:
        warc.write_archives(spark, df, str(tmp_path / "s"), archive_bytes=2000)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    small = warc.read_archives(spark, str(tmp_path / "s"))
    assert sorted(map(str, small.collect())) == sorted(map(str, got.values()))
    sizes = [f.stat().st_size for f in (tmp_path / "s").glob("*.txt")]
    assert len(sizes) > 5


def test_warc_largest_page_repeated_and_long_pages(spark, tmp_path):
    big, long = "b" * 1500, "".join(f"<p>{k}</p>" for k in range(400_000))
    rows = [(1, "u", big), (9, "u", big), (9, "v", big), (None, "u", big), (3, "u", long), (4, "u", long)]
    warc.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).select("page_id", "record_type", "refers_to", "payload_bytes").collect()
    want = [(1, "revisit", 9, 1500), (9, "response", None, 1500), (9, "response", None, 1500), (None, "revisit", 9, 1500), (3, "revisit", 4, len(long)), (4, "response", None, len(long))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_warc_frames_without_a_size():
    import zstandard

    page = warc._record(5, "u", b"<p>x</p>" * 90, hashlib.sha1(b"<p>x</p>" * 90).hexdigest(), None)
    streamed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, 0) + streamed.compress(page) + streamed.flush()
    (record,) = map(warc.parse_record, warc.frames(data))
    assert record["payload"] == b"<p>x</p>" * 90


def rng_text(k):
    rng = random.Random(k % 40)
    return "<html>" + " ".join(rng.choice(["alpha", "beta", "gamma", "<p>"]) + str(rng.randrange(9)) for _ in range(rng.randrange(400))) + "</html>"


def test_warc_refuses_damage(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark, spark.createDataFrame([(1, "u", "<p>one</p>")], "page_id long, url string, html string"), path)
    data = next(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if len(r.content))
    (record,) = list(warc.frames(data))
    assert warc.parse_record(record)["payload"] == b"<p>one</p>"
    size = struct.unpack_from("<I", data, 4)[0]
    for bad in (data[8 + size :], data[:-12], data + b"\x01", data[: 8 + size + 9] + b"XXXX" + data[8 + size + 13 :]):
        with pytest.raises(Exception):  # noqa: B017
            list(map(warc.parse_record, warc.frames(bad)))
    for a, b in ((b"WARC/1.1", b"WARC/0.9"), (b"<p>one", b"<p>two"), (b"Content-Length: ", b"Content-Length: 1"), (b"response\r\n", b"nonsense\r\n"), (b"WARC-Date:", b"WARC-Type:"), (b"X-Payload-Length: 10", b"X-Payload-Length: 11")):
        with pytest.raises(ValueError):
            warc.parse_record(record.replace(a, b))


def test_pivotal_keeps_sums_and_expectations():
    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(1, 500, 60))[::-1].astype(float)
    frac = np.full(60, 0.3)
    total, runs = np.zeros(60), 3000
    for _ in range(runs):
        p, left = mixing.pivotal(size, frac, rng.random(60))
        assert abs((p * size).sum() - (frac * size).sum()) < 1e-6
        assert all(x in (0, 1) for k, x in enumerate(p) if k != left)
        total += p
    assert abs(total / runs - 0.3).max() < 0.05


def expected_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    t, capped = sum(size.values()), set()
    while True:
        rest, open_ = t - 3 * sum(size[s] for s in capped), sum(w[s] for s in names if s not in capped)
        target = {s: 3.0 * size[s] if s in capped else rest * w[s] / open_ for s in names}
        more = {s for s in names if s not in capped and target[s] > 3 * size[s]}
        if not more:
            return target
        capped |= more


@pytest.mark.parametrize("beyond", [False, True])
def test_mix_meets_targets(spark, monkeypatch, beyond):
    monkeypatch.setattr(mixing, "LEAF", 8 if beyond else 32)
    rng = random.Random(6)
    rows = [(k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))), rng.choice(["é", "a", "B", "z", None, "tiny"] if k < 40 else ["a", "z", None, "B"])) for k in range(900)]
    rows += [(5000, None, "a"), (5001, " \t", "a"), (5002, "x", "zero"), (7000, "twice same", "a"), (7000, "twice same", "a"), (None, "no id", "z")]
    df = spark.createDataFrame([(*r, 1.0, 3) for r in rows], "doc_id long, text string, source string, target double, tie int")
    got = mixing.mix(spark, df).collect()
    again = mixing.mix(spark, df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = defaultdict(int)
    source = {}
    for i, t, s in rows:
        size[s] += len(words(t))
        source[i] = s
    want, taken, most = expected_targets(dict(size)), defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and 0 <= r.copies <= 3
        taken[s] += r.copies * r["size"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6 for s in want)
    full = mixing.with_copies(spark, df)
    copies = sum(r.copies for r in got)
    assert full.columns == df.columns and full.count() == copies
    if beyond:
        return
    rows = sorted(map(str, full.collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    monkeypatch.setattr(hot_keys, "HOT_ROWS", 100)
    assert sorted(map(str, mixing.with_copies(spark, df).collect())) == rows


def test_mix_of_many_alike_rows(spark, monkeypatch):
    """Rows alike in all are one participant: no group of the tree is larger than its leaf."""
    seen = []
    inner = mixing._round_group

    def watched(level, seed):
        run = inner(level, seed)

        def size(df):
            assert len(df) < 1000, "a leaf with all alike rows"
            return run(df)

        return size

    monkeypatch.setattr(mixing, "_round_group", watched)
    monkeypatch.setattr(mixing, "LAID_OUT", 500)
    rows = [(None, "the same text", "a")] * 5000 + [(None, None, "a")] * 200 + [(k, f"one of many {k} " * (k % 5 + 1), "b") for k in range(300)] + [(None, "the same text", "b")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(spark, df).collect()
    assert len(got) == len(rows) and not seen
    alike = [r.copies for r in got if r.doc_id is None and r["size"] == 3 and r.source_size > 10_000]
    assert len(alike) == 5000 and max(alike) - min(alike) <= 1
    assert abs(sum(alike) * 3 - next(r.target for r in got if r.source_size > 10_000)) <= 3
    assert mixing.with_copies(spark, df).count() == sum(r.copies for r in got)


def test_mix_of_long_texts(spark):
    rows = [(k, "word " * (300_000 if k == 3 else 20), "ab"[k % 2]) for k in range(8)]
    got = {r.doc_id: r for r in mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3]["size"] == 300_000 and all(r.copies <= 3 for r in got.values())


def test_mix_of_nothing(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark, spark.createDataFrame([], kind)).count() == 0
    got = mixing.mix(spark, spark.createDataFrame([(1, "", "a"), (2, None, None)], kind)).collect()
    assert {(r.target, r.copies) for r in got} == {(0.0, 0)}


def test_quality_held_out_accuracy(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(900):
        w = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        good = rng.random() < 0.7
        text = " ".join(w) if good else rng.choice([" ".join(x.upper() + "!!" for x in w), " ".join(x for x in w[:9] for _ in range(12)), " | ".join(w), " ".join(x + "%%%" for x in w)])
        docs.append((k, text, "q"))
        labels.append((k, int(good), "s"))
    docs += [(5000, None, ""), (5001, "", ""), (None, "x y", "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, ""), (3, None, "")], "doc_id long, quality int, text string")
    trees = quality.train(spark, d, lab)
    out = quality.score(d, trees).select("*", quality.held_out(F.col("doc_id")).alias("out")).collect()
    held = {k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1}
    assert {r.doc_id for r in out if r.out and r.doc_id is not None and r.doc_id < 900} == held
    marks = dict((k, q) for k, q, _ in labels)
    assert np.mean([(r.score >= 0.5) == bool(marks[r.doc_id]) for r in out if r.doc_id in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 903
    again = quality.train(spark, d.repartition(5), lab)
    assert np.array_equal(again.value, trees.value)


def test_quality_without_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(d, quality.train(spark, d, lab)).first().score == 0.5
    assert quality.score(d.limit(0), quality.train(spark, d.limit(0), lab)).count() == 0


def test_flat_trees_are_the_grown_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 18))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.fit(x, y)
    assert ((t.score(x) >= 0.5) == y).mean() > 0.98
    x = np.concatenate([x[:300], rng.normal(scale=9, size=(100, 18))])
    for row, score in zip(x, t.score(x), strict=True):  # one row and one node at a time
        total = t.base
        for at in t.roots.tolist():
            while t.left[at] != at:
                at = t.left[at] if row[t.feature[at]] <= t.cut[at] else t.right[at]
            total += t.value[at]
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def slow_fit(x, y, trees, depth):
    """Boosting from the definition: every split of every statistic at every cut, gains from plain sums."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(x.shape[1])]
    out = np.full(len(y), np.log(y.sum() / (len(y) - y.sum())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)

        def grow(rows, left):
            best = (1e-6, None)
            gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.RIDGE)
            for f, cs in enumerate(cuts if left else []):
                for c in cs:
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(h[a].sum(), h[b].sum()) >= quality.LEAST_WEIGHT and (won := gain(a) + gain(b) - gain(rows)) > best[0] + 1e-9:
                        best = (won, (a, b))
            if best[1] is None:
                out[rows] += quality.RATE * g[rows].sum() / (h[rows].sum() + quality.RIDGE)
            else:
                for part in best[1]:
                    grow(part, left - 1)

        grow(np.arange(len(y)), depth)
    return 1 / (1 + np.exp(-out))


def test_trees_are_grown_by_their_definition(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.3, size=200) > 0).astype(float)
    assert np.abs(quality.fit(x, y).score(x) - slow_fit(x, y, 3, quality.DEPTH)).max() < 1e-9


def test_quality_of_repeated_ids_and_long_texts(spark):
    docs = [(k, "word " * (k + 1)) for k in range(40)] + [(1, "again")] * 30 + [(2, "x" * 300_000 + " y" * 100_000)]
    marks = [(k, k % 2) for k in range(40)] + [(1, 1)] * 5
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    once = [t for k, t in enumerate(docs[:40])]
    trees = quality.train(spark, d, m)
    assert np.array_equal(trees.value, quality.train(spark, d.repartition(3).union(d.where("doc_id = 1")), m.distinct()).value)
    assert quality.score(d, trees).count() == len(docs) and len(once) == 40


def test_quality_on_the_held_out_rows_of_the_table(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.train(spark, docs, marks)).join(marks, "doc_id").where(quality.held_out(F.col("doc_id"))).select("score", "quality").collect()
    right = np.mean([(r.score >= 0.5) == bool(r.quality) for r in out])
    assert len(out) > 50 and right >= 0.95 and right > np.mean([r.quality for r in out])


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            s = [(-(v @ u) / np.linalg.norm(v) / np.linalg.norm(u), j) for j, u in ok if j != i]
            out[i] = sorted(s)[:k]
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 16)).astype(np.float32))]
    rows += [(5000 + k, rows[50][1]) for k in range(300)]  # ties
    rows += [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [None] * 16), (9200, [1.0] * 3), (None, rows[0][1])]
    got = defaultdict(dict)
    for r in ann.search(spark, spark.createDataFrame(rows, "id long, v array<float>"), F.col("id") % 50 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    want = brute(rows)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hit = np.mean([len({v for v, _ in got[q].values()} & {j for _, j in w}) / 5 for q, w in want.items()])
    assert hit >= 0.9
    assert [got[50][r][0] for r in (1, 2, 3, 4, 5)] == [5000, 5001, 5002, 5003, 5004]
    v = {i: np.array(x, float) for i, x in rows if x and i is not None and i < 9000}
    for q, g in got.items():
        s = [g[r] for r in (1, 2, 3, 4, 5)]
        assert s == sorted(s, key=lambda x: (-x[1], x[0]))
        assert all(abs(x - v[q] @ v[j] / np.linalg.norm(v[q]) / np.linalg.norm(v[j])) < 1e-12 for j, x in s)


@pytest.mark.parametrize("noise", [1e-4, 5e-2])
def test_nearest_recall_among_near_copies(spark, noise):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    x[::3] = x[0] + noise * rng.normal(size=(2000, 16))
    asked = np.arange(0, 6000, 50)
    got = defaultdict(set)
    for r in ann.search(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), F.col("id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit[asked] @ unit.T
    cos[np.arange(len(asked)), asked] = -2
    hits = np.array([len(got[q] & set(np.argsort(-c)[:5].tolist())) / 5 for q, c in zip(asked.tolist(), cos, strict=True)])
    assert hits[asked % 3 == 0].mean() >= 0.9 and hits[asked % 3 > 0].mean() >= 0.9


def test_nearest_of_few(spark):
    kind = "id long, v array<float>"
    assert ann.search(spark, spark.createDataFrame([], kind), F.col("id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 2), (1, [1.0, 1.0], 1, 2), (2, [-1.0, 0.0], 1, 2), (0, [0.0, 1.0], 1, 2)], kind + ", row int, cell int")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(spark, few, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 1, 1), (0, 2, 0), (0, 2, 0), (0, 3, 2), (0, 3, 2)]


def test_nearest_of_one_repeated_id(spark, monkeypatch):
    """A repeated id is cut into chunks as other ids are, and each of its rows is a query and a candidate."""
    monkeypatch.setattr(ann, "CHUNK", 64)
    rng = np.random.default_rng(4)
    rows = [(50, v.tolist()) for v in rng.normal(size=(700, 8))]
    got = ann.search(spark, spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") % 50 == 0).collect()
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    want = np.sort(np.sort(-cos, axis=1)[:, :5].ravel())
    assert len(got) == 3500 and {r.vec_id for r in got} == {50}
    assert np.mean(np.abs(np.sort([-r.score for r in got]) - want) < 0.02) > 0.9


def test_nearest_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in op8_nearest.run(spark, "/root/testdata/sf0.1").collect():
        got[r.query_id].add(r.vec_id)
    asked = np.flatnonzero(ids % 50 == 0)
    cos = unit[asked] @ unit.T
    cos[np.arange(len(asked)), asked] = -2
    hit = [len(got[q] & set(ids[np.argsort(-c, kind="stable")[:5]].tolist())) / 5 for q, c in zip(ids[asked].tolist(), cos, strict=True)]
    assert len(got) == len(asked) and np.mean(hit) >= 0.9


def test_few_cells_are_visited_where_there_are_clusters():
    rng = np.random.default_rng(7)
    for spread, most in ((0.05, 0.2), (5.0, 1.0)):
        x = ann._unit(np.repeat(rng.normal(size=(100, 16)), 60, axis=0) + spread * rng.normal(size=(6000, 16)))
        index = ann.fit(x, 100)
        assert ann.probes_for(index, x, 5) <= most * 100
    assert ann.probes_for(ann.fit(x[:3], 1), x[:3], 5) == 1


def test_nearest_of_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(60, 3000)))]
    assert ann.search(spark, spark.createDataFrame(rows, "id long, v array<double>"), F.col("id") % 50 == 0).count() == 10


@pytest.mark.parametrize("rows, a_file, files", [(1000, 200_000, 1), (1000, 50, 20), (None, 50, 40)])
def test_files_of_written_tables(spark, monkeypatch, rows, a_file, files):
    monkeypatch.setattr(scratch, "ROWS_A_FILE", a_file)
    tables = Tables(spark)
    out = tables.write(spark.range(0, 1000, 1, 40), "few", rows)
    assert len(out.inputFiles()) == max(files, spark.sparkContext.defaultParallelism)  # one a core at least
    assert sorted(r.id for r in out.collect()) == list(range(1000))
    tables.drop("few")
