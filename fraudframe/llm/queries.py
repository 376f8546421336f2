"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL.

Each query applies its operator to the whole table and derives the contract's columns from the
operator's own output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (align, cws, decontaminate, embeddings, fim, html_text, licenses, mixing, pieces, pii, secrets, simhash,
               toxicity)
from .common import table


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _count(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    counts = [_count("base", k) for k in pii.KINDS]
    return found.select("doc_id", *counts, _sha(secrets.digest(F.col("base"))).alias("base_sha256"),
                        secrets.digest(F.col("found")).alias("spans"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", "n_tokens", _sha(ids).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [_count("found", k) for k in secrets.BASE]
    return found.select("doc_id", *counts, _sha(secrets.digest(F.col("found"), secrets.BASE)).alias("base_sha256"),
                        secrets.digest(F.col("found")).alias("spans"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"),
                       _sha(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(_sha(F.col("groups")))
    return align.align(table(spark, sf_dir, "documents"), digest={"groups_sha256": digest})


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", decontaminate.hit_words(F.col("hits")).alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"), _sha(F.array_join("items", ",")).alias("items_sha256"),
                        (F.size("hits") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_license_scan, op3_pii, op4_mix_sources, op5_sentencepiece,
                                   op6_embedding_near_dedup, op7_secret_scan, op8_document_fingerprints, op9_toxicity,
                                   op10_html_text, op11_fill_in_middle, op12_tokenizer_alignment, op13_decontaminate)}

ORACLE = {
    "op6_embedding_near_dedup": """
with recursive v as (select vec_id, embedding::double[] as x from embeddings),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
      where len(a.x) = len(b.x) and list_dot_product(a.x, a.x) > 0 and list_dot_product(b.x, b.x) > 0
        and list_cosine_similarity(a.x, b.x) >= 0.9),
r as (select vec_id as id, vec_id as other from v union select r.id, p.b from r join p on r.other = p.a)
select v.vec_id, (select count(*) from p where p.a = v.vec_id)::bigint as n_links, min(r.other) as component_id,
       v.vec_id = min(r.other) as kept
from v join r on r.id = v.vec_id group by v.vec_id
""",
    "op4_mix_sources": """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
           from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ([3.0, 1.0, 2.0])[1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w,
             (sum(source_size) over ())::double * 1.5 as budget, source_size::double * 2 as cap from s),
l as (select *, (budget - coalesce(sum(cap) over below, 0)) / (sum(w) over () - coalesce(sum(w) over below, 0)) as lvl
      from w window below as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, budget,
             least(cap, coalesce(w * max(case when cap / w >= lvl then lvl end) over (), cap)) as target from l),
q as (select d.*, md5('mix-1:' || coalesce(d.doc_id::varchar, '')) as place from d),
c as (select q.*, t.source_size, t.target, t.budget,
             sum(size) over (partition by q.source order by place, size rows unbounded preceding) as cum
      from q join t on q.source is not distinct from t.source),
f as (select *, (cum + e * source_size)::double / target as fin from c, (values (0), (1)) as v(e)
      where size > 0 and target > 0),
g as (select *, sum(size) over (order by fin, source nulls first, place, size, e rows unbounded preceding) as total from f),
k as (select doc_id, source, place, size, count(*) as times from g where total <= budget group by all)
select c.doc_id, c.size, c.source_size, c.target, (c.size * coalesce(k.times, 0))::bigint as taken
from c left join k on c.doc_id is not distinct from k.doc_id and c.source is not distinct from k.source
                   and c.place = k.place and c.size = k.size
""",
    "op11_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units,
             ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
             ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
n as (select *, len(units)::bigint as n from u),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as x, greatest(h1 % (n + 1), h2 % (n + 1)) as y,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
                  when h4 % 100 < 80 then 'spm' else 'psm' end as form from n),
p as (select *, array_to_string(units[1:x], '') as prefix, array_to_string(units[x + 1:y], '') as middle,
             array_to_string(units[y + 1:n], '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then len(prefix) end::bigint as prefix_chars,
       case when form <> 'plain' then len(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
""",
    "op13_decontaminate": """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark),
w as (select distinct item, least(len(words), 10) as size, array_to_string(words[i:i + 9], ' ') as window
      from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)),
g as (select r, size, i, array_to_string(words[i:i + size - 1], ' ') as window
      from (select r, words, size, unnest(range(1, len(words) - size + 2)) as i
            from d, (select distinct size from w) where len(words) >= size)),
o as (select g.r, g.i, g.size, w.item from g join w on g.size = w.size and g.window = w.window),
h as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + size)) as place from o) group by r),
s as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from o group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join s using (r)
""",
}
