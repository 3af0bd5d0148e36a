"""The registered queries over the driver's small tables, against their SQL or brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from catalogflow.llm import bpe, queries, secrets

from ..conftest import SF
from .cases import sha
from .test_dedup_and_join import classes, removed

#: What the contracts name: columns and types of each query.
CONTRACT = {
    "op1_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_links": "bigint"},
    "op2_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_topk_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op4_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op6_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op7_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op11_prefix_trie": {c: "bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": "string"},
    "op12_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op13_pivot_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(spark, name):
    frame = queries.queries()[name](spark, SF)
    kinds = dict(frame.dtypes)
    assert {c: kinds[c] for c in CONTRACT[name]} == CONTRACT[name]
    return frame.select(*CONTRACT[name]).collect()


def test_every_operator_has_one_query():
    assert list(queries.queries()) == list(CONTRACT) and set(queries.oracle_sql()) <= set(CONTRACT)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(queries.queries()[name](spark, SF).columns)
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in CONTRACT[name]) for r in found.fetchall())))
    assert sorted(repr(tuple(r)) for r in rows(spark, name)) == want


def test_joins_and_dedups_equal_brute_force(spark, docs):
    texts = [(i, t) for i, t, _ in docs]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows(spark, "op1_ngram_jaccard_join")} == classes(texts)
    assert sorted(map(tuple, rows(spark, "op10_substring_dedup"))) == sorted(removed(texts, 50))


def test_tokens_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, t, _ in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, rows(spark, "op8_bpe"))) == sorted(want)


def test_secrets_and_models_keep_their_contracts(spark, docs):
    text = {i: t or "" for i, t, _ in docs}
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for r in rows(spark, "op4_secret_scan"):
        t = text[r.doc_id]
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.base_sha256 == sha(secrets.written(sorted(base)))
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in docs}
    toxic = rows(spark, "op2_toxicity")
    assert {r.doc_id: r.held_out for r in toxic} == fold and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in toxic)
    lang = rows(spark, "op5_language_id")
    assert {r.doc_id: r.held_out for r in lang} == fold and all(0 <= r.score <= 1 for r in lang)
    known = {own for _, _, own in docs if own}
    assert all(r.lang_pred == "und" if not any(map(str.isalpha, text[r.doc_id])) else r.lang_pred in known for r in lang)
