"""The queries op1 to op13, each over its whole table with production parameters, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, filter_audit, langid, matroska, minhash, phrases, pii_semicrf, quality_mil, secrets_index, turns, url_filter, warc
from .common import dropped, id_mod, table, written

#: The rank file of op10; the folder of public tokenizers is installed on every machine.
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: The rules of op1.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def _is(mod: Column, n: int) -> Column:
    return F.coalesce(mod == n, F.lit(False))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(table(spark, sf_dir, "pages"), RULES)


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_index.digests(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    stored = written(warc.archives(pages), "warc")
    found = warc.salvage(stored, payloads=False).where("kind = 'record'")
    found = written(found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind)), "records")
    dropped(stored)
    return found


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _is(id_mod("doc_id", 4), 2)
    model = langid.train(docs, ~held_out)
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = _is(id_mod("doc_id", 3), 1)
    weights = quality_mil.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_mil.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_semicrf.digests(docs, pii_semicrf.train(docs))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.clusters(table(spark, sf_dir, "documents"), width=4, percent=80)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return turns.repair(rows, turns.damaged(rows))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.recurring(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_matroska": op2_matroska,
    "op3_decontam": op3_decontam,
    "op4_secrets": op4_secrets,
    "op5_warc": op5_warc,
    "op6_langid": op6_langid,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_minhash": op9_minhash,
    "op10_bpe": op10_bpe,
    "op11_turns": op11_turns,
    "op12_phrases": op12_phrases,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op4_secrets": secrets_index.twin(),
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as bigint) // (32 ** (3 - i % 4))::bigint) % 32 as int) + 1, 1) for i in range(32)], '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is not distinct from first then null else first end as refers_to
from f
""",
    "op9_minhash": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] end)) as s from w),
k as (select doc_id, len(s) as n, md5(array_to_string(s, chr(10))) as k, s from s),
r as (select min(doc_id) as id, k from k where n > 0 group by k),
u as (select k.doc_id as id, n, unnest(s) as h from k join r on k.doc_id = r.id),
links as (
  select a.id as a, b.id as b from u a join u b on a.h = b.h and a.id <> b.id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
  group by a.id, b.id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (select id, id as other from r union select reach.id, links.b from reach join links on reach.other = links.a),
c as (select id, min(other) as component from reach group by id)
select k.doc_id, cast(k.n as bigint) as n_shingles, coalesce(c.component, k.doc_id) as component_id, k.doc_id = coalesce(c.component, k.doc_id) as kept
from k left join r on r.k = k.k and k.n > 0 left join c on c.id = r.id
""",
    "op11_turns": turns.TWIN,
    "op12_phrases": phrases.TWIN,
    "op13_filter_audit": filter_audit.TWIN,
}
