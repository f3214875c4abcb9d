"""The pipeline, stage by stage against plain versions, and the registered SQL."""

import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from sparkveil.llm import lines, packing, quality, suite

from .test_operators import brute_mix, brute_similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def first_of_groups(rows):
    """The ids of the first row of each group of near-duplicates among ``rows`` (id, text), ascending."""
    root = list(range(len(rows)))
    for j, i in brute_similar([t for _, t in rows]):
        a, b = root[j], root[i]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return [rows[k][0] for k in sorted(set(root))]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = (docs, after)
        docs = after
    for name, (_, after) in list(seen.items())[:-1]:
        assert after.columns == COLUMNS, name
    before, after = seen["quality rules"]
    model = quality.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in quality.score(before, model).where("kept").collect())
    before, after = seen["line dedup"]
    con = duckdb.connect()
    documents = before.toPandas()  # noqa: F841
    expected = {r[0]: r[1] for r in con.execute(lines.ORACLE.replace("FROM documents", "FROM documents")).fetchall()}
    assert {r.doc_id: r.text for r in after.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    assert sorted(r.doc_id for r in after.collect()) == first_of_groups(rows)
    before, after = seen["mixing"]
    expected = brute_mix([(r.doc_id, r.text, r.source) for r in before.collect()])
    assert Counter(r.doc_id for r in after.collect()) == Counter({i: n for i, n in expected.items() if n})
    before, after = seen["packing"]
    encode = packing.tokenizer(__import__("public_tokenizers").path(packing.RANKS))
    texts = {r.doc_id: r.text for r in before.collect()}
    cut = Counter()
    for i, n in Counter(r.doc_id for r in before.collect()).items():
        ids, at = [*encode(texts[i] or ""), 1], 0
        for size in packing.lengths(len(ids)):
            cut[i, at, size, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + size])), len(ids)] += n
            at += size
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after.collect()) == cut
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda r: (r.doc_id, r.start, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, after.collect()))


def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf_dir, tmp_path):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(None, "words without an id " * 4, None, None, 1), (7, "", "en", None, 0)], real.schema)
    docs = real.unionByName(odd).unionByName(real.limit(20))
    names = ["_i", "_h", "_host", "_drop", "_source", "t", "fp", "root", "key", "n_lines"]
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf_dir)
        if k < 4:
            assert set(out.columns) == {*COLUMNS, *names}
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 0


def test_queries_match_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in suite.oracle_sql().items():
        got = suite.queries()[name](spark, sf_dir)
        rows = con.execute(sql)
        names = [c[0] for c in rows.description]
        assert sorted(names) == sorted(got.columns)
        expected = sorted(tuple(r) for r in rows.fetchall())
        assert sorted(tuple(r) for r in got.select(*names).collect()) == expected, name
