"""Token output against an unaltered tokenizer, and what its ORC files hold."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc_files
import pytest
from pyspark.sql import functions as F

from rowatlas.llm import tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")


def exact(texts):
    """Ids by an unaltered tokenizer, one text at a time."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    return [plain.encode(t, add_special_tokens=False).ids + [0] for t in texts]


@pytest.mark.parametrize("kept", [tokens.KEPT_WORDS, 200])
def test_encoder_is_exact(kept):
    e = tokens.Encoder(BPE, kept=kept)
    rng = random.Random(4)
    bits = ["word", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "12", "<|endoftext|>", "😀", "...", "\xa0", " ", "\r\n", "A-b", "q!?", "z'\"", "ñandú,", "日本", "ǅ", "ª", "\u0301"]
    texts = ["", " ", "a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(900)), *(" ".join(rng.choice(["ab", "c\nd", "it's", "x9", "y.", "Zürich).", "a\n-"]) for _ in range(12)) for _ in range(300))]
    texts.append(" ".join(rng.choice(["long", "text,", "of", "words\nand"]) + str(k % 977) for k in range(60_000)))
    want = exact(texts)
    for step in (1, 40, len(texts)):
        for k in range(0, len(texts), step):
            ids, n = e.encode(tokens.pa.array(texts[k : k + step], tokens.pa.string()))
            assert n.tolist() == [len(w) for w in want[k : k + step]] and ids.tolist() == [x for w in want[k : k + step] for x in w]
    assert e.by_words and exact(["a <|endoftext|> b"]) == [[64, 220, 50256, 275, 0]]
    assert sum(n for _, n in tokens._slices(tokens.pa.array(texts))) == len(texts)


def test_tokens_round_trip(spark, tmp_path):
    rows = [(k, f"text {k}\nof {k * k} words", 0) for k in range(300)] + [(1000, None, 0), (1001, "", 0), (7, "again", 0), (None, "first <|endoftext|>", 0)] + [(None, "same", 0)] * 400
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted(tokens.round_trip(spark, df, BPE).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted(r[0] is not None and r[0] for r in rows)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    want = [(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, _, _), ids in zip(rows, exact([t or "" for _, t, _ in rows]), strict=True)]
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got) == sorted(map(str, want))
    again = tokens.round_trip(spark, df.repartition(5), BPE).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(df, path, BPE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(str(p) for p in (tmp_path / "t").glob("*.orc"))
    ids = [orc_files.ORCFile(f).read(["doc_id"]).column(0).to_pylist() for f in files]
    assert [x for part in ids for x in part] == [r.doc_id for r in got]
    assert len(ids) > 1 and sum(None in part for part in ids) > 1  # rows without an id are not one range
    assert tokens.round_trip(spark, df.limit(0), BPE).count() == 0


def scanned(df):
    """Rows that the scan of a collected frame gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_orc_stripes_indexes_and_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("words of"), F.col("id")).alias("text"))
    tokens.write_tokens(docs.coalesce(1), path, BPE, stripe_bytes=1 << 14, rows_per_index=1000)
    rows = spark.read.schema("doc_id long, segment int, place long, n_tokens long, ids array<int>").orc(path)
    assert rows.count() == 20_000
    assert 0 < scanned(rows.where("doc_id between 8000 and 8010").select("doc_id")) <= 4096  # row indexes
    assert scanned(rows.where("doc_id = 8001").select("doc_id")) < 500  # Bloom filters: inside the range, not there
    jvm, orc = spark._jvm, spark._jvm.org.apache.orc
    conf, kinds, stripes = spark._jsc.hadoopConfiguration(), set(), 0
    for f in (tmp_path / "t").glob("*.orc"):
        reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), orc.OrcFile.readerOptions(conf))
        held = reader.rows()
        for s in reader.getStripes():
            stripes += 1
            kinds |= {held.readStripeFooter(s).getColumns(c).getKind().toString() for c in (1, 2, 3, 4, 6)}
        held.close()
    assert kinds == {"DIRECT_V2"} and stripes > len(list((tmp_path / "t").glob("*.orc")))  # run-length encoding of integers
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.orc(path).rdd.getNumPartitions() > len(list((tmp_path / "t").glob("*.orc")))  # stripes apart
        read = tokens.read_tokens(spark, path)
        assert read.count() == 20_000 and read.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == read.agg(F.sum("n_tokens")).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_offsets_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t {k}") for k in range(200)], "doc_id long, text string")
    want = sorted(map(str, tokens.round_trip(spark, docs, BPE).collect()))
    monkeypatch.setattr(tokens, "BROADCAST_SEGMENTS", 0)
    assert sorted(map(str, tokens.round_trip(spark, docs, BPE).collect())) == want
