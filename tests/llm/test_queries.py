"""Each registered query over a small folder: its columns and values against brute force, and empty tables."""

import collections
import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from kinship.llm import licenses, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_embeddings, brute_jaccard, brute_lines, prose  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMAS = {"documents": DOCS, "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string"}


@pytest.fixture(scope="module")
def tables():
    r = np.random.default_rng(51)
    words = {"en": "the river stone house again moving never under bright".split(), "de": "der fluß stein haus wieder bewegt niemals unter hell".split()}
    texts, langs = [], []
    for i in range(90):
        lang = "de" if i % 3 == 0 else "en"
        texts.append(". ".join(prose(int(r.integers(1 << 30)), int(r.integers(4, 12)), words[lang]) for _ in range(6)) + (". you vermin" if i % 7 == 0 else "") + "." + (" MIT license, gnu general public license" if i % 11 == 0 else ""))
        langs.append(lang)
    texts += [None, "", " \n", "123 !!", "apache license cc by", texts[4], texts[5].upper(), texts[8] + " more words", "x" * 2000, "<|endoftext|> 12345", texts[9] * 200]
    langs += [None] * (len(texts) - 90)
    docs = [(i, t, l, "s", len(t or "")) for i, (t, l) in enumerate(zip(texts, langs))]
    x = np.repeat(r.standard_normal((8, 8)), 8, axis=0) + 0.1 * r.standard_normal((64, 8))
    vectors = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x.astype(np.float32))] + [(64, None, 1), (65, x[0].astype(np.float32).tolist(), None), (100, x[1].astype(np.float32).tolist(), 1)]
    pages = [(i, f"http://h{i % 9}.example.{'net' if i % 2 else 'org'}/{'de' if i % 3 else 'en'}/p{i}", "<p>") for i in range(80)] + [(80, None, None), (81, "relative", "")]
    return {"documents": docs, "labels": [(i, 1, int(i % 7 == 0)) for i in range(90)], "embeddings": vectors, "pages": pages}


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def rows_of(spark, folder, name, key="doc_id"):
    found = queries.queries()[name](spark, folder)
    return dict(found.dtypes), sorted(found.collect(), key=lambda r: (r[key] is None, r[key]))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op1(spark, folder, tables):
    types, rows = rows_of(spark, folder, "op1_licenses")
    assert {"n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "score": "double"}.items() <= types.items()
    for r, (i, text, *_) in zip(rows, tables["documents"], strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(k, label) for p, label in licenses.BASE for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts, labels = [k for k, _ in places], {x for _, x in places}
        assert (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))


def test_op2(spark, folder, tables):
    import base64

    import tiktoken

    ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines() if line)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, (i, text, *_) in zip(rows_of(spark, folder, "op2_byte_bpe")[1], tables["documents"], strict=True):
        ids = encoding.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


@pytest.mark.parametrize("name", ["op3_topk", "op9_urls"])
def test_queries_with_sql(spark, folder, name):
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = queries.queries()[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_op4(spark, folder, tables):
    types, rows = rows_of(spark, folder, "op4_toxicity")
    assert {"held_out": "boolean", "score": "double", "predicted": "int"}.items() <= types.items()
    assert [(r.doc_id, r.held_out, r.predicted) for r in rows] == [(d[0], held(d[0]), int(r.score >= 0.5)) for d, r in zip(tables["documents"], rows, strict=True)]
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.predicted == (r.doc_id % 7 == 0) for r in rows if r.doc_id < 90 and r.held_out]) > 0.9


def test_op5(spark, folder, tables):
    _, rows = rows_of(spark, folder, "op5_covertree", "vec_id")
    links, root = brute_embeddings([(i, v if label is not None else None, label) for i, v, label in tables["embeddings"]])
    assert [tuple(r)[:4] for r in rows] == [(i, int(n), c, c == i) for (i, *_), n, c in zip(tables["embeddings"], links, root)] and links.sum() > 100


def test_op6(spark, folder, tables):
    _, rows = rows_of(spark, folder, "op6_language")
    assert [(r.doc_id, r.held_out) for r in rows] == [(d[0], held(d[0])) for d in tables["documents"]]
    for r, (i, text, lang, *_) in zip(rows, tables["documents"], strict=True):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in ("und", "de", "en") and 0 <= r.score <= 1
        assert lang is None or r.lang_pred == lang


def test_op7(spark, folder, tables):
    _, rows = rows_of(spark, folder, "op7_jaccard")
    links, root = brute_jaccard([d[1] for d in tables["documents"]])
    assert [(r.doc_id, r.n_links, r.component_id) for r in rows] == [(i, len(links[i]), root[i]) for i in range(len(links))] and sum(map(len, links)) >= 6


def test_op8(spark, folder, tables):
    from tokenizers import Tokenizer

    types, rows = rows_of(spark, folder, "op8_packing")
    assert all(types[c] == "bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    tokenizer, by_doc, by_sequence = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text, *_ in tables["documents"]:
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        ends = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.length
        assert ends <= 2048 and not ends & (ends - 1)


def test_op10(spark, folder, tables):
    _, rows = rows_of(spark, folder, "op10_lines")
    want = brute_lines([(d[0], d[1]) for d in tables["documents"] if d[1] is not None])
    assert all(r.text == want.get(r.doc_id) and (r.n_removed > 0) == (r.text != d[1]) for r, d in zip(rows, tables["documents"], strict=True)) and sum(r.words_removed for r in rows) > 100


def test_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], T._parse_datatype_string(schema)).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        found = query(spark, str(tmp_path))
        assert found.count() == 0 and len(found.columns) > 2, name
