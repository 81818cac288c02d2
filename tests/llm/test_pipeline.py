"""The pipeline's stages on a small corpus, each against its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowatlas.llm import registry, scratch

from .test_free import sets, similar, words

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{DIR}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns_and_order(spark, kept):
    assert len(corpus_pipeline.STAGES) == 5
    for rows in kept[:-1]:
        assert rows[0].__fields__ == list(corpus_pipeline.COLUMNS)
    assert kept[-1][0].__fields__ == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_classifier_keeps_good_documents(spark, kept):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept[0]}
    assert sum((i in ids) == bool(q) for i, q in marks.items()) >= 0.95 * len(marks)


def test_one_of_each_group_stays(kept):
    before = [(r.doc_id, sets(r.text)) for r in kept[0]]
    after = {r.doc_id for r in kept[1]}
    assert after <= {i for i, _ in before}
    for i, s in before:
        mates = [j for j, t in before if i != j and similar(s, t)]
        assert (i in after) or mates
        assert not (i in after and any(j in after for j in mates))


def test_no_benchmark_text_stays(spark, kept):
    items = [set(g) for g in (sets(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect())]
    leaks = {r.doc_id for r in kept[1] if any(q and 5 * len(q & sets(r.text)) >= 4 * len(q) for q in items)}
    assert {r.doc_id for r in kept[2]} == {r.doc_id for r in kept[1]} - leaks


def test_mix_and_tokens(kept):
    total = sum(len(words(r.text)) for r in kept[2])
    assert {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]}
    assert abs(sum(len(words(r.text)) for r in kept[3]) - total) < 0.25 * total
    assert sorted(r.doc_id for r in kept[4]) == sorted(r.doc_id for r in kept[3])


def test_run_is_its_stages(spark, kept):
    out = corpus_pipeline.run(spark, DIR).collect()
    assert sorted(map(str, out)) == sorted(map(str, kept[-1]))


KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with nulls in every column, repeats, and empty and long texts; and empty ones."""
    some, none = (str(tmp_path_factory.mktemp(n)) for n in ("some", "none"))
    good = " ".join(f"word{k}" for k in range(80))
    item = "what is the answer to this very long question about everything"
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (2, None, None, None, None), (2, "", "en", "b", 0), (None, f"so {item} it is", "en", "b", 1), (None, "some other clean text of an unknown id " + good[:60], "en", None, 1), (None, None, None, None, None), (3, good + " more", "de", "a", 1), (4, " ".join(f"long{k}" for k in range(150_000)), "en", "b", 1)]
    marks = [(1, 1, 0), (2, None, None), (None, 1, 0), (99, 1, 0), (1, 1, 0)]
    for path, r, m, b in ((some, rows, marks, [(1, item), (2, None), (None, ""), (3, "word1")]), (none, [], [], [])):
        spark.createDataFrame(r, KIND).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(m, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame(b, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return some, none


def test_stages_on_odd_rows(spark, odd):
    some, _ = odd
    docs = spark.read.parquet(f"{some}/documents.parquet")
    extra = docs.withColumns({c: F.lit(7) for c in ("score", "uid", "tk", "row", "_t", "_d", "size", "item_id", "start")})
    said = lambda df: sorted((str(r.doc_id), (r.text or "")[:12]) for r in df.collect())
    every = said(docs)
    classified = corpus_pipeline.classify(spark, extra, some)
    assert classified.columns == list(corpus_pipeline.COLUMNS) and said(classified) == every  # all labels are good
    one = corpus_pipeline.deduplicate(spark, extra, some)
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert len(said(one)) == len(every) - 2 and said(one).count(("1", "word0 word1 ")) == 1 and ("3", "word0 word1 ") not in said(one)
    clean = corpus_pipeline.drop_contaminated(spark, extra, some)
    assert clean.columns == list(corpus_pipeline.COLUMNS) and said(clean) == [x for x in every if not x[1].startswith("so what")]
    mixed = corpus_pipeline.mix(spark, extra, some)
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and set(said(mixed)) <= set(every)
    ids = corpus_pipeline.tokenize(spark, extra, some)
    assert ids.count() == len(every) and sorted(r.n_tokens for r in ids.collect())[:3] == [1, 1, 1]
    assert corpus_pipeline.run(spark, some).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_empty_tables(spark, odd):
    _, none = odd
    docs = spark.read.parquet(f"{none}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, none).count() == 0
    assert corpus_pipeline.run(spark, none).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = type("Conf", (), {"get": staticmethod(lambda name, default: default)}), Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.new_path(Session, "x")


def test_registry():
    names = registry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
