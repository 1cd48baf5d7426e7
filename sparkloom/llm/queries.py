"""The registered queries of this subpackage: thin digests over the operators, at production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import audit, chains, chat, fastsketch, fim, html_text, lzprint, packing, quality, secrets, simhash, warc, winnow


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(_read(spark, sf_dir, "documents"), words=4, radius=4)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.roundtrip(_read(spark, sf_dir, "pages"), least_revisit_bytes=0)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op6_lz_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.neighbour_prints(_read(spark, sf_dir, "documents"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.cut_answers(_read(spark, sf_dir, "conversations")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(_read(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    return got.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("learned")
    )


def op9_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_passages(_read(spark, sf_dir, "documents"), least=50)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = winnow.find_overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + (r["stop"] - r["start"]))
    return got.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op2_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    got = packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
    return got.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("tier").cast("long").alias("tier"), "step_group"
    )


def op11_fast_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastsketch.near_duplicates(_read(spark, sf_dir, "documents"), words=3, similarity=85)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fim.transform(_read(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_weak_labels": op2_weak_labels,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_html_density": op5_html_density,
    "op6_lz_phrases": op6_lz_phrases,
    "op7_preferences": op7_preferences,
    "op8_secrets": op8_secrets,
    "op9_chains": op9_chains,
    "op10_winnowing": op10_winnowing,
    "op11_fast_sketches": op11_fast_sketches,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_filter_audit": op13_filter_audit,
}

OP10_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bn as (select item_id, w, least(len(w), 10) n from b where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p : p + n - 1], ' ') s from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) p from bn)),
dw as (select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') s from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw) where len(w) >= n)),
m as materialized (select doc_id, p, dw.n, item_id from dw join iw using (n, s)),
h as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + n)) q from m) group by 1),
i as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, cast(item_id as varchar) item from m) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""

OP4_SQL = r"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h, max(page_id) over (partition by coalesce(html, '')) keep from pages),
b as (select *, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', h[i])]), 'string_agg', '') bits from p)
select page_id, octet_length(encode(html)) payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * cast(bits[5*i+1] as int) + 8 * cast(bits[5*i+2] as int) + 4 * cast(bits[5*i+3] as int) + 2 * cast(bits[5*i+4] as int) + cast(bits[5*i+5] as int)]), 'string_agg', '') payload_digest,
  case when page_id = keep then 'response' else 'revisit' end record_type, case when page_id <> keep then keep end refers_to
from b
"""

OP7_SQL = r"""
with c as (select conv_id, turn, min(row(role, text)) v from (select conv_id, turn, coalesce(role, 'user') "role", coalesce(text, '') text from conversations) group by 1, 2),
l as (select conv_id, max(case when role = 'assistant' then turn end) t from conversations group by 1),
r as (select conv_id, turn, min(row(role, text)) v from (select conv_id, turn, coalesce(role, 'user') "role",
  case when turn = t and role = 'assistant' then array_to_string(string_split(text, ' ')[1 : len(string_split(text, ' ')) // 2], ' ') else coalesce(text, '') end text from conversations join l using (conv_id)) group by 1, 2),
b as (select conv_id, turn, c.v a, r.v b from c full join r using (conv_id, turn)),
f as (select conv_id, min(case when a is distinct from b then turn end) "first" from b group by 1),
p as (select conv_id, turn, a, b, "first" is null or turn < "first" same from b join f using (conv_id)),
s as (select conv_id pair_id, 'prompt' segment, turn, a v from p where same union all select conv_id, 'chosen', turn, a from p where not same and a is not null union all select conv_id, 'rejected', turn, b from p where not same and b is not null),
t as (select pair_id, segment, turn, replace(replace(v[1], '<|', '< |'), '|>', '| >') "role", replace(replace(v[2], '<|', '< |'), '|>', '| >') text from s)
select pair_id, segment, turn, "role", '<|' || "role" || '|>' || chr(10) || text || '<|end|>' || chr(10) rendered,
  case when segment <> 'prompt' and "role" = 'assistant' then length("role") + 5 else 0 end::bigint train_from,
  case when segment <> 'prompt' and "role" = 'assistant' then length(text) + 7 else 0 end::bigint train_chars
from t
"""

OP11_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i : i + 2], ' '))) s from w where len(w) > 0),
f as materialized (select doc_id, len(s) n, unnest(s) g from s),
p as (select a.doc_id a, b.doc_id b, a.n an, b.n bn, count(*) n_both from f a join f b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2, 3, 4),
l as materialized (select a, b from p where 100 * n_both >= 85 * (an + bn - n_both)),
e as materialized (select a, b from l union all select b, a from l),
reach as (select doc_id, doc_id other from documents union select r.doc_id, e.b from reach r join e on e.a = r.other),
c as (select doc_id, min(other) component_id from reach group by 1)
select doc_id, coalesce(len(s), 0) n_shingles, component_id, doc_id = component_id kept from documents join c using (doc_id) left join s using (doc_id)
"""

OP12_SQL = r"""
with h as (select doc_id, coalesce(text, '') t, length(coalesce(text, '')) n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
g as (select *, cast('0x' || substr(h, 1, 8) as bigint) h1, cast('0x' || substr(h, 9, 8) as bigint) h2, cast('0x' || substr(h, 17, 8) as bigint) h3, cast('0x' || substr(h, 25, 8) as bigint) h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) lo, greatest(h1 % (n + 1), h2 % (n + 1)) hi,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from g),
o as (select *, substr(t, 1, lo) p, substr(t, lo + 1, hi - lo) m, substr(t, hi + 1, n - hi) s from c)
select doc_id, n, form, case when form <> 'plain' then lo end prefix_chars, case when form <> 'plain' then hi - lo end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256
from o
"""

OP13_SQL = r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, min(doc_id) over (partition by coalesce(text, '')) least from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by 1),
f as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic, case when len(w) < 100 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 80 * len(w) then 'B' else '' end
  || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when doc_id > least then 'E' else '' end fails
  from d left join l using (doc_id)),
k as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (select a.x || b.x || c.x || d.x || e.x filter_order from x a, x b, x c, x d, x e where a.x <> b.x and c.x not in (a.x, b.x) and d.x not in (a.x, b.x, c.x) and e.x not in (a.x, b.x, c.x, d.x)),
r as (select part, fails, n, good, toxic, filter_order, coalesce(list_min(list_transform(string_split(fails, ''), lambda x: case when x <> '' then instr(filter_order, x) end)), 6) gone from k, o),
s as (select unnest([1, 2, 3, 4, 5]) step),
y as (select part, filter_order, step, substr(filter_order, step, 1) x, sum(case when gone > step then n else 0 end) kept, sum(case when gone = step then n else 0 end) removed,
  sum(case when gone < step and contains(fails, substr(filter_order, step, 1)) then n else 0 end) redundant, sum(case when fails = substr(filter_order, step, 1) then n else 0 end) unique_fails,
  sum(case when gone = step then good else 0 end) good_lost, sum(case when gone = step then toxic else 0 end) toxic_lost from r, s group by 1, 2, 3)
select part, filter_order, cast(step as int) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
  cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) shapley from y
"""

ORACLE_SQL: dict[str, str] = {
    "op4_warc": OP4_SQL, "op7_preferences": OP7_SQL, "op10_winnowing": OP10_SQL, "op11_fast_sketches": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_filter_audit": OP13_SQL,
}
