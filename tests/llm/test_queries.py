"""The registered queries against their SQL twins, and the pipeline against a plain one."""

import hashlib
import re

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from logweft.llm import bpe, langid, pii_semicrf, queries

SF = "/root/testdata/sf0.001"


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_whole_result(spark, name):
    source, column = ("pages", "page_id") if name.startswith("op1_") else ("documents", "doc_id")
    ids = [r[0] for r in queries.QUERIES[name](spark, SF).select(column).collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(column).collect())


def test_pipeline_against_plain(spark):
    """The stages' decisions one document at a time: language by the model, all pairs for near copies, all windows for leaks."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    told = {r.doc_id: r for r in langid.scored(docs, langid.train(docs, F.lit(True), gate=True)).collect()}
    left = [i for i in sorted(rows) if told[i].lang_pred != "und" and told[i].score >= corpus_pipeline.LEAST_SCORE and told[i].enough]
    words = {i: (rows[i].text or "").encode().lower().split() for i in left}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in words.items()}
    parent = {i: i for i in left}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(left):
        for b in left[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    left = [i for i in left if top(i) == i]
    windows = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\W\d_]+", (t or "").lower())] for k in range(len(w) - 4)}
    items = [windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [i for i in left if not any(w and len(w & windows(rows[i].text)) >= 0.8 * len(w) for w in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == left
    weights = pii_semicrf.train(docs.where(F.col("doc_id").isin(left)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS_FILE)), special_tokens={})
    for i in left:
        text = pii_semicrf.masked(rows[i].text, weights)
        ids = library.encode_ordinary(text)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_language_gate_does_not_saturate(spark):
    """Texts of no known language go however long they are; documents of the table stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = ["zxqj wvkk qpfz xxjw kqzv", "asdf qwer zxcv", "Привет мир это русский текст a", "Det er en god dag i dag og vi skal ud at sejle med vores lille båd på søen, fordi vejret er så smukt", "function(){ var x = document.getElementById('a'); return x.value; }"]
    rows = lambda texts: spark.createDataFrame([(-1 - k, t, "en", "s", len(t)) for k, t in enumerate(texts)], docs.schema)
    stayed = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(rows(odd)), SF).collect()}
    assert stayed == {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    model = langid.train(docs, F.lit(True), gate=True)
    assert langid.known_rows(rows([f"{t} " * 500 for t in odd]), model, corpus_pipeline.LEAST_SCORE).count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    rows = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns and [t for _, t in rows.dtypes] == [t for _, t in docs.dtypes]
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == 0
