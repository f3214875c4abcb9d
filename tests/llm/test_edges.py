"""Defined results for nulls in any column, empty tables, long texts and repeated rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkveil.llm import html, language, lines, mixing, multiset, packing, quality, resemblance, simhash, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "many words in here " * 40_000
ROWS = [
    (None, None, None, None, None),
    (None, "a text without an id", None, "s", 20),
    (None, "another text without an id", "en", None, 5),
    (1, "", "en", "s", 0),
    (2, None, "en", "s", None),
    (3, "same row twice", "en", "s", 14),
    (3, "same row twice", "en", "s", 14),
    (3, "same id, other text", "de", "t", 19),
    (4, LONG, "en", "s", len(LONG)),
    (5, "x" * 300_000, "en", "t", 300_000),
    (6, "\n\n \t\n", "fr", "t", 5),
    (7, " ".join(f"w{i}" for i in range(120)), "en", "s", 500),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(None, None, None), (1, 0, 0), (7, 1, 0), (3, None, 1), (3, 1, 1)], "doc_id bigint, quality int, toxic int")


def operators(docs, labels):
    tox = toxicity.fit(docs, labels)
    good = quality.fit(docs, labels)
    lang = language.fit(docs)
    return {
        "simhash": lambda d: simhash.near_duplicates(d),
        "toxicity": lambda d: toxicity.score(d, tox),
        "packing": lambda d: packing.pack(d).select("doc_id", "doc_tokens").distinct(),
        "substrings": lambda d: substrings.remove_repeats(d),
        "lines": lambda d: lines.drop_boilerplate(d),
        "multiset": lambda d: multiset.compare_neighbours(d),
        "language": lambda d: language.predict(d, lang),
        "quality": lambda d: quality.score(d, good),
        "mixing": lambda d: mixing.mix(d),
    }


def test_every_row_has_a_result(docs, labels):
    for name, run in operators(docs, labels).items():
        rows = run(docs).collect()
        if name == "packing":
            assert {(r.doc_id, r.doc_tokens) for r in rows} >= {(None, 1), (1, 1), (2, 1)}
        else:
            assert len(rows) == len(ROWS), name
        assert run(docs.limit(0)).count() == 0, name


def test_empty_and_unusable_labels(docs, labels):
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert quality.score(docs, quality.fit(docs, none)).where("kept and n_words >= 10").count() > 0
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).count() == len(ROWS)
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_rows_that_keep_their_columns(docs):
    wide = docs.withColumns({c: F.lit(1) for c in ("_i", "_h", "_host", "_drop", "_kept", "_source", "_passes", "_threshold", "_k", "n_lines", "root", "fp")})
    assert resemblance.keep_one(wide).columns == wide.columns
    kept = [(r.doc_id, r.text) for r in resemblance.keep_one(docs).collect()]
    assert kept.count((3, "same row twice")) == 1 and (3, "same id, other text") in kept and (None, "a text without an id") in kept
    assert mixing.apply_mix(wide).columns == wide.columns
    assert set(lines.drop_boilerplate(wide).columns) == {*wide.columns, "n_dropped"}
    taken = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).collect()}
    assert all(t in (0, s, 2 * s) for (_, s), t in taken.items())


def test_long_texts_are_read_whole(docs):
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, docs.select("doc_id").limit(0).withColumn("quality", F.lit(1)))).collect()}
    assert got[4].n_words == 160_000 and got[4].n_repeat_words == 160_000 and got[5].word_chars == 300_000
    removed = {(r.doc_id, r.n_bytes): r for r in substrings.remove_repeats(docs).collect()}
    assert removed[4, len(LONG)].n_removed == len(LONG) and removed[5, 300_000].n_removed == 300_000


def test_pages(spark):
    rows = [(None, None, None), (1, "http://h/", None), (1, "http://h/", "<p>a"), (1, "http://h/", "<p>a"), (2, "not a url", "<<>><p <b>x</b"), (3, None, "<script>"), (4, "http://h/", "<p>" + "word " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = html.extract(pages).collect()
    assert len(got) == len(rows) and {r.n_chars == len(r.text) for r in got} == {True}
    assert [r.n_chars for r in got if r.page_id == 4] == [499_999]


def test_pipeline_on_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_staged_tables_can_be_cleared(spark):
    from sparkveil.llm.common import Scratch, clear, stage

    scratch = Scratch()
    a, b = scratch.stage(spark.range(3), "a"), stage(spark.range(4), "b")
    assert a.count() == 3
    scratch.clear()
    with pytest.raises(Exception):
        spark.read.parquet(a._staged).count()
    assert b.count() == 4
    clear(spark)
    with pytest.raises(Exception):
        spark.read.parquet(b._staged).count()
