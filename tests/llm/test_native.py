"""Chat formatting, decontamination and license scans against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rowatlas.functions.arrays import sums_before
from rowatlas.llm import chat, decontaminate, licenses
from rowatlas.llm import shingles as S

TURNS = "conv_id long, turn long, role string, text string, extra string"


def shown(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    out = chat.format_conversations(df)
    return {r.conv_id: r for r in out.select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_round_trip_of_odd_texts(spark):
    odd = ["", "\\", "<|im_end|>\n", "<\\|", "\\\\<|x", "</s>[INST] ok [/INST]", "<<SYS>><s></s>", "a\\<s>\\", "<|nl|>", "😀é\n\n", "<|im_sep|>", "[\\INST]", "\0\r\n"]
    rng = random.Random(2)
    odd += ["".join(rng.choice("\\<|>s/[INT]\n") for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = [(1, k, rng.choice(["user", "assistant", "a\nb<|"]), t, "x") for k, t in enumerate(odd)]
    got = shown(spark, rows)[1]
    assert [(t.role, t.text) for t in got.turns] == [(r, t) for _, _, r, t, _ in rows]
    assert got.loss == "".join(t for _, _, r, t, _ in rows if r == "assistant")
    body = re.sub(r"<\|im_start\|>[^\n]*\n|<\|im_sep\|>|<\|im_end\|>\n", "\x01", got.formatted)
    assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", body)


def test_merging_ties_and_nulls(spark):
    rows = [(1, 2, "user", "c", ""), (1, 1, "user", "b", ""), (1, 1, "user", "a", ""), (1, None, "system", None, ""), (None, 0, None, "x", ""), (None, 0, None, "x", "")]
    got = shown(spark, rows)
    assert got[1].formatted == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\na<|im_sep|>b<|im_sep|>c<|im_end|>\n"
    assert [t.text for t in got[None].turns] == ["x"] and got[None].loss == ""
    alone = chat.format_conversations(spark.createDataFrame(rows, TURNS)).where("conv_id is null").collect()
    assert [r.formatted for r in alone] == ["<|im_start|>\nx<|im_end|>\n"] * 2
    assert shown(spark, []) == {}


def test_long_conversations_take_time_in_proportion(spark):
    import time

    def spent(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é said "), F.col("id")).alias("text"))
        out = chat.format_conversations(rows)
        began = time.perf_counter()
        got = out.select(F.size(chat.parse_formatted(F.col("formatted"))).alias("n"), F.length(chat.under_mask(F.col("formatted"), F.col("loss_spans"))).alias("loss")).first()
        assert got.n == n and got.loss == sum(len(f"é said {k}") for k in range(n) if k % 3)
        return time.perf_counter() - began

    spent(1000)
    one, four = spent(15_000), spent(60_000)
    assert four < 8 * one + 1


def test_sums_before(spark):
    for n in (0, 1, 63, 64, 65, 5000):
        a = spark.range(1).select(F.expr(f"transform(sequence(1, {n + 1}), x -> x * 7L)").alias("a")).select(F.slice("a", 1, n).alias("a"))
        assert a.select(sums_before(F.col("a")).alias("s")).first().s == [7 * k * (k + 1) // 2 for k in range(n)]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "")], TURNS)
    out = chat.format_conversations(df).select(chat.parse_formatted(F.col("formatted")))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(ws, n=5):
    return {" ".join(ws[k : k + n]) for k in range(len(ws) - n + 1)}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(40))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 4, 5, 8, 30, 60])))) for k in range(40)] + [(100, None), (101, ""), (102, "one two three four"), (103, "zz"), (104, "zz zz zz zz zz zz zz")]
    docs = []
    for k in range(120):
        ws = [word() for _ in range(rng.choice([0, 4, 50, 400]))]
        for _, t in rng.sample(items[:40], 2):
            part = t.split()
            for at in rng.sample(range(len(part)), min(len(part) // 12, rng.randrange(3))):
                part[at] = "zz"
            cut = rng.randrange(len(ws) + 1)
            ws[cut:cut] = part if rng.random() < 0.5 else part[: len(part) * 2 // 3]
        docs.append((k, rng.choice([" ", "\n", "\t "]).join(ws), "x"))
    return items, [*docs, (500, None, "n"), (501, " \n ", "n"), docs[0], (None, docs[1][1], "null id")]


def test_containment_is_brute_force(spark, corpus, monkeypatch):
    items, docs = corpus
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item, r.containment) for r in decontaminate.contained(spark, spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id int")).collect()}
    want = {}
    for d, t, _ in docs:
        for i, u in items:
            width = min(5, len(words(u)))
            q = grams(words(u), width) if width else set()
            n = len(q & grams(words(t), width)) if width else 0
            if q and n * 5 >= len(q) * 4:
                want[d, i] = (n, len(q), n / len(q))
    assert got == want and want
    dirty = {d for d, i in want if len(words(dict(items)[i])) >= 3}
    for name, value in (("BROADCAST_ROWS", 150), ("BROADCAST_BYTES", 6000)):  # in blocks, and by shuffles
        monkeypatch.setattr(decontaminate, name, value)
    blocked = decontaminate.contained(spark, spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item, r.containment) for r in blocked.collect()} == want
    monkeypatch.undo()
    kept = decontaminate.clean(spark, spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "item_id"] and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _, _ in docs if d not in dirty)


def test_clean_rows_of_a_shared_id_stay(spark):
    item = "one two three four five six seven"
    rows = [(None, f"so {item} it is", 1), (None, "a clean text of some more words", 2), (None, None, 3), (7, item, 4), (7, "another clean text of the same id", 5), (7, item, 6), (8, f"{item} again", 7)]
    kept = decontaminate.clean(spark, spark.createDataFrame(rows, "doc_id long, text string, _d int"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "_d"] and sorted(r._d for r in kept.collect()) == [2, 3, 5]


def test_short_items_in_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(120_000))
    docs = spark.createDataFrame([(1, f"{long} what is it then {long}"), (2, "what is it"), (3, "yes"), (4, "is it then what")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "what is it then"), (2, "yes"), (3, " "), (4, "w7 w8 w9 w10 w11 w12")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained(spark, docs, items).collect()) == [(1, 1), (1, 4), (3, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(spark, docs, items).collect()) == [2, 3, 4]
    assert not re.search("Python|Arrow|Pandas", decontaminate.contained(spark, docs, items)._jdf.queryExecution().toString())


def test_containment_of_empty_tables(spark, corpus):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(corpus[1], "doc_id long, text string, z string")
    assert decontaminate.contained(spark, docs, none).count() == 0
    assert decontaminate.contained(spark, docs.limit(0), none).count() == 0


def test_sketches_never_miss_small_items(spark):
    sizes = [r.k for r in spark.range(1, 64).select(decontaminate.sketch_size(F.col("id")).alias("k")).collect()]
    assert all(k > n - -(-4 * n // 5) or k == 13 for n, k in enumerate(sizes, 1))


def test_shingle_expressions(spark):
    row = spark.createDataFrame([("  a b\tc\n d e  f ",), ("",), (None,), ("a b c d",)], "t string").select(S.texts(S.split_words(F.col("t"))).alias("g")).collect()
    assert [r.g for r in row] == [["a b c d e", "b c d e f"], [], [], []]
    assert spark.range(1).select(S.split_normal_words(F.lit("--Élan, vital 4.0!")).alias("w")).first().w == ["élan", "vital", "4", "0"]


def normal(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_licenses_are_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(0, None, 1), (1, "", 1), (2, "Released under the MIT License", 1)]
    for k in range(3, 80):
        ws = [rng.choice("pqrst") + str(rng.randrange(50)) for _ in range(rng.choice([0, 30, 300]))]
        for t in rng.sample(list(licenses.TEMPLATES.values()), 2):
            part = t.split()
            if rng.random() < 0.5 and len(part) > 20:
                part[rng.randrange(len(part))] = "zz"
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = part
        docs.append((k, " ".join(ws), 1))
    docs += [docs[5], *((None, t, 2) for _, t, _ in docs[9:30]), (90, "x " * 200_000 + list(licenses.TEMPLATES.values())[0], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, license int")
    got = {(r.doc_id, r.license): (r.n_shared, r.n_template, r.at_word) for r in licenses.scan(spark, df).collect()}
    classes = licenses.size_classes(400)
    want = {}
    for d, t, _ in docs:
        ws = normal(t)
        for name, u in licenses.TEMPLATES.items():
            q = grams(normal(u))
            if len(q) == 0:
                continue
            stride = next(s for up, s, _ in classes if up >= len(q))
            best = max(((len(q & grams(ws[a : a + 2 * stride + 4])), -a) for a in range(0, max(1, len(ws)), stride)), default=(0, 0))
            if best[0] * 5 >= len(q) * 4:
                want[d, name] = max(want.get((d, name), (0, 0, 0)), (best[0], len(q), -best[1]), key=lambda x: (x[0], -x[2]))
    assert got == want and len(want) > 100 and any(d is None for d, _ in want)
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 50)
    assert {(r.doc_id, r.license): (r.n_shared, r.n_template, r.at_word) for r in licenses.scan(spark, df).collect()} == want


def test_whole_license_texts_are_found(spark):
    rng = random.Random(4)
    texts = {f.stem: f.read_text("utf-8") for f in licenses.TEXTS.glob("*.txt")}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"} == set(texts)
    docs, names = [], sorted(texts)
    for k, name in enumerate(names):
        part = texts[name].split()
        for at in rng.sample(range(len(part)), len(part) // 60):
            part[at] = "zz"
        prose = lambda n: " ".join(rng.choice("pqrst") + str(rng.randrange(50)) for _ in range(n))
        docs.append((k, f"{prose(rng.randrange(900))} {' '.join(part)} {prose(300)}"))
    got = {(r.doc_id, r.license): (r.n_shared, r.n_template, r.at_word) for r in licenses.scan(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    classes = licenses.size_classes(8000)
    want = {}
    for d, t in docs:
        ws = normal(t)
        for name, u in texts.items():
            q = grams(normal(u))
            stride = next(s for up, s, _ in classes if up >= len(q))
            best = max((len(q & grams(ws[a : a + 2 * stride + 4])), -a) for a in range(0, len(ws), stride))
            if best[0] * 5 >= len(q) * 4:
                want[d, f"{name} text"] = (best[0], len(q), -best[1])
    assert {k: v for k, v in got.items() if k[1] not in licenses.TEMPLATES} == want and {(k, f"{n} text") for k, n in enumerate(names)} <= set(want)


def test_license_bands_meet_their_bound():
    for up, stride, bands in licenses.size_classes(800):
        least = 0.8 * up / (2 * stride + 0.2 * up)
        assert (1 - least) ** bands <= licenses.MISS * 1.01 and stride >= 1.25 * up


def test_own_templates_and_empty_tables(spark):
    known = spark.createDataFrame([("x", "alpha beta gamma delta epsilon zeta"), ("x", "one two three four five"), ("short", "a b"), ("none", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "so ALPHA, beta: gamma delta epsilon zeta!"), (2, "one two three four five six")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.containment) for r in licenses.scan(spark, docs, known).collect()) == [(1, "x", 1.0), (2, "x", 1.0)]
    assert licenses.scan(spark, docs, known.limit(0)).count() == 0 and licenses.scan(spark, docs.limit(0), known).count() == 0


def test_digest_of_turns(spark):
    got = shown(spark, [(1, 0, "user", "a", ""), (1, 1, "assistant", "b", "")])[1]
    said = "".join(f"{t.role}\n{t.text}\n" for t in got.turns)
    assert hashlib.sha256(said.encode()).hexdigest() == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
