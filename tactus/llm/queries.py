"""The registered queries of the ten operators: ``opN_<name>(spark, sf_dir)``, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm import decontamination, exact, langid, licenses, lm, minhash, packing, quality, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, fold: int) -> F.Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def captures_of(pages: DataFrame, later: int = 1000) -> DataFrame:
    """A crawl made of ``pages``: each page is a full response at time page_id, and is asked for again
    ``later`` captures on.  By page_id mod 4 the not-modified revisit names the page's own ETag, only its
    time of change, nothing, or a wrong ETag; responses of the third kind have no time of change."""
    etag, changed = F.md5(F.coalesce("html", F.lit(""))), F.floor(F.col("page_id") / 10).cast("string")
    kind = F.pmod("page_id", F.lit(4))
    page, text = F.col("page_id"), lambda c: c.cast("string")
    headers = lambda some: F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in some])), lambda _, v: v.isNotNull())
    first = headers([("content-type", F.lit("text/html")), ("etag", etag), ("date", text(page)), ("last-modified", F.when(kind != 2, changed))])
    own = F.when(kind == 0, F.concat(F.lit("W/"), etag)).when(kind == 3, F.lit("other"))
    again = headers([("content-length", F.lit("0")), ("etag", own), ("date", text(page + later)), ("cache-control", F.lit("max-age=60")), ("last-modified", F.when(kind == 1, changed))])
    response = pages.select(page.alias("record_id"), F.lit("response").alias("kind"), "url", page.alias("ts"), first.alias("headers"))
    return response.unionByName(pages.select(page.alias("record_id"), F.lit("revisit").alias("kind"), "url", (page + later).alias("ts"), again.alias("headers")))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(captures_of(_table(spark, sf_dir, "pages")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return found.select(F.col("record_id").alias("page_id"), "canonical", "resolved_id", "latest_id", "outcome", shown.alias("headers"))


OP2_SQL = r"""
with p as (
  select page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare, md5(coalesce(html, '')) as etag,
    cast(page_id // 10 as varchar) as changed, page_id % 4 as kind from pages),
q as (
  select page_id, etag, changed, kind, bare,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', ''), ':(80|443)$', '') as host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' and string_split(x, '=')[1] not in ('fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'))) as args from p),
c as (
  select page_id, case when bare is null then null else host || path || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end end as canonical,
    etag, case when kind <> 2 then changed end as changed,
    case kind when 0 then etag when 3 then 'other' end as asked_etag, case kind when 0 then 'W/' || etag when 3 then 'other' end as shown_etag, case when kind = 1 then changed end as asked_changed from q),
j as (
  select v.page_id, v.canonical, v.asked_etag, v.shown_etag, v.asked_changed, r.page_id as latest_id, r.etag as old_etag, r.changed as old_changed
  from c v asof left join c r on v.canonical = r.canonical and v.page_id + 1000 >= r.page_id),
o as (
  select *, case when latest_id is null then 'unresolved'
    when asked_etag is not null then case when asked_etag = old_etag then 'etag' else 'mismatch' end
    when asked_changed is not null and old_changed is not null then case when asked_changed = old_changed then 'last-modified' else 'mismatch' end
    else 'no validator' end as outcome from j)
select page_id, canonical, case when outcome in ('unresolved', 'mismatch') then null else latest_id end as resolved_id, latest_id, outcome,
  case when outcome in ('unresolved', 'mismatch')
    then 'cache-control: max-age=60; content-length: 0; date: ' || (page_id + 1000) || coalesce('; etag: ' || shown_etag, '') || coalesce('; last-modified: ' || asked_changed, '')
    else 'cache-control: max-age=60; content-type: text/html; date: ' || (page_id + 1000) || '; etag: ' || coalesce(shown_etag, old_etag) || coalesce('; last-modified: ' || coalesce(asked_changed, old_changed), '') end as headers
from o
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
win as (
  select item_id, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') for i in range(1, len(w) - least(10, len(w)) + 2)]) as pat, least(10, len(w)) as m
  from b where len(w) > 0),
pats as (select pat, m, list(distinct item_id) as items from win group by pat, m),
sizes as (select distinct m from pats),
dw as (
  select doc_id, m, unnest(range(1, len(w) - m + 2)) as i, w from d, sizes where len(w) >= m),
hits as (
  select doc_id, i, dw.m, items from dw join pats on pats.m = dw.m and pats.pat = array_to_string(w[i:i + dw.m - 1], ' ')),
hit_words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from hits) group by doc_id),
hit_items as (select doc_id, list_sort(list_distinct(flatten(list(items)))) as items from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(items), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.profiles(docs.where(~held_out(3, 1))))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out(5, 0)), _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_lines", "bad_lines")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), held_out(5, 1))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate_table(_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs.where(~held_out(3, 1)), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_revisits, op3_decontamination, op4_language, op5_quality, op6_lm_score, op7_licenses, op8_minhash, op9_exact_dedup, op10_toxicity)}
ORACLES = {"op2_revisits": OP2_SQL, "op3_decontamination": OP3_SQL, "op9_exact_dedup": OP9_SQL}
