"""The pipeline's stages against brute-force versions, each on its own input."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from kinship.llm import language, toxicity
from kinship.llm.common import held_out

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_jaccard, brute_lines, prose  # noqa: E402

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_removed", T.LongType())])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    r = np.random.default_rng(12)
    vocabulary = [f"{a}{b}" for a in "bdfgklmn" for b in ("ar", "ol", "unt", "esk", "im", "aff")]
    base = [" ".join(prose(int(r.integers(1 << 30)), int(r.integers(5, 14)), vocabulary) + ". " for _ in range(int(r.integers(4, 12)))) for _ in range(90)]
    texts = [t + ("you vermin. " if i % 6 == 0 else "") for i, t in enumerate(base)]
    texts += [texts[3], texts[5].replace(texts[5].split()[9], "other", 1), base[7][:120] + base[8], None, "", "1234 !!", "x"]
    rows = [(i, t, "en", "s", len(t or ""), 1.5, 7) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[11]], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_match_brute_force(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == before.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before.collect(), docs.collect())

    rows, left = kept["language"]
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet"), ~held_out(F.col("doc_id")))
    known = {x.doc_id for x in language.identify(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), model).filter("learned").collect()}
    assert {x.doc_id for x in left} == {x.doc_id for x in rows if any(c.isalpha() for c in x.text or "") and x.doc_id in known} and {x.doc_id for x in left} >= set(range(90))
    assert {x.score for x in left} == {1.5}

    rows, left = kept["toxicity"]
    rated = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    assert {x.doc_id for x in left} == {x.doc_id for x in rows if rated(x.text.encode())[0] < 0.5}
    assert {x.doc_id for x in rows} - {x.doc_id for x in left} >= {i for i in range(0, 90, 6)} and {x.doc_id for x in left} >= {i for i in range(90) if i % 6}

    rows, left = kept["lines"]
    once = sorted({(x.doc_id, x.text) for x in rows})
    want = {i: t for i, t in brute_lines(once).items() if t.strip() or t == dict(once)[i]}
    assert {(x.doc_id, x.text) for x in left} == set(want.items()) and len({x.text for x in left}) < len(want) + 1

    rows, left = kept["near"]
    once = sorted({(x.doc_id, x.text) for x in rows})
    _, root = brute_jaccard([t for _, t in once])
    assert sorted(x.doc_id for x in left) == sorted(once[k][0] for k in range(len(once)) if root[k] == k)

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, pieces = kept["packing"]
    for x in rows:
        ids, at = [*tokenizer.encode(x.text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted((p for p in pieces if p.doc_id == x.doc_id), key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert {p.doc_id for p in pieces} == {x.doc_id for x in rows}


def test_run_is_the_stages_in_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, folder)
    assert {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()} == {tuple(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect()}


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_copies_go_by_row_and_not_by_id(spark, kind):
    base, other = prose(1, 60, [f"w{i}" for i in range(300)]), prose(2, 60, [f"u{i}" for i in range(300)])
    near = base.replace(base.split()[30], "edit", 1)
    cases = {
        ((1, base), (2, other), (2, near)): [(1, base), (2, other)],
        ((1, near), (1, base), (0, other), (0, other), (0, other)): [(0, other), (1, None)],  # of two near copies of one id either one
        ((None, base), (None, base), (5, base), (5, None), (5, None), (6, "..."), (6, "...")): [(None, base), (None, base), (5, base), (5, None), (5, None), (6, "..."), (6, "...")],
    }
    for rows, want in cases.items():
        docs = spark.createDataFrame([(i, t, None, "s", 1, 1.5, 7) for i, t in rows], SCHEMA).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({"__id": F.lit(1), "__GONE": F.lit("g"), "first": F.lit("f"), "class": F.lit("c")})
        out = dict(corpus_pipeline.STAGES)["near"](spark, docs, "")
        assert out.columns == docs.columns and {tuple(x) for x in out.select("__id", "__GONE", "first", "class").collect()} <= {(1, "g", "f", "c")}
        got = [(x.doc_id if x.doc_id is None else int(x.doc_id), x.text) for x in out.collect()]
        if any(t is None and i == 1 for i, t in want):
            got = [(i, None if i == 1 and t in (base, near) else t) for i, t in got]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_repeated_lines_of_different_documents_stay(spark):
    a, b, c, y, z = (prose(i, 8, [f"{k}{j}" for j in range(99)]) + ". " for i, k in enumerate("abcyz"))
    docs = spark.createDataFrame([(i, t, None, "s", 1, 1.5, 7) for i, t in enumerate([a + b + z, y + b + c, a + b + c, a + b + c])], SCHEMA)
    out = dict(corpus_pipeline.STAGES)["lines"](spark, docs, "")
    assert sorted((x.doc_id, x.text) for x in out.collect()) == [(0, a + b + z), (1, y + b + c), (2, a + b + c)] and out.columns == docs.columns


def test_workers_give_back_what_packing_held(spark, tmp_path):
    import re

    import public_tokenizers
    import pyarrow as pa
    from kinship.llm import common, packing

    def held(batches):
        for _ in batches:
            pass
        with open("/proc/self/smaps_rollup") as f:
            before = int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1])
        common.release_memory()
        with open("/proc/self/smaps_rollup") as f:
            freed = before - int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1])
        yield pa.RecordBatch.from_arrays([pa.array([freed])], names=["id"])

    docs = spark.range(0, 64, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 3000), x -> substr(md5(concat(id, '-', x)), 1, 9)), ' ') AS text")
    packing.lengths(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1).write.format("noop").mode("overwrite").save()
    freed = [r.id for r in spark.range(0, 1, 1, 1).mapInArrow(held, "id long").collect()]
    assert len(freed) == 1 and freed[0] < 8_000, freed  # kB
