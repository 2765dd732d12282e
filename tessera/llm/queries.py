"""The subpackage's queries, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.html_text import extract_text
from tessera.llm.licenses import license_scan
from tessera.llm.media import document_media, interleaved
from tessera.llm.mixing import SEED, mix
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import pack_documents
from tessera.llm.quality import quality, with_rules
from tessera.llm.substrings import longest_repeats, substring_dedup
from tessera.llm.tokens import token_records
from tessera.llm.toxicity import fitted, offending_sentences, sample, scored
from tessera.session import ship, table


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, which is the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return license_scan(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return extract_text(table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return document_media(spark, table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_documents(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 1)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = token_records(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract fixes two words a shingle."""
    ship(spark)
    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fitted(sample(docs, table(spark, sf_dir, "labels")))).drop("text")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality(docs, trusted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def base_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of op10 without its likelihood ratio, which SQL can state."""
    rules = with_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds of the base phrases, which SQL can state."""
    ship(spark)
    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that op9's model blames."""
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return offending_sentences(docs, fitted(sample(docs, table(spark, sf_dir, "labels"))))


def repeat_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest repeat of each document: op1's doubling carried on until no candidate survives."""
    ship(spark)
    return longest_repeats(table(spark, sf_dir, "documents"))


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ordered sequences of texts and media references."""
    ship(spark)
    return interleaved(table(spark, sf_dir, "pages"), "page_id")


WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP2_SQL = rf"""
with d as (select doc_id, source, {WORDS_SQL}::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as weight, 2.0::double * source_size as cap from s),
f as (select *, coalesce(sum(cap) over b, 0.0::double) as capped, sum(weight) over () - coalesce(sum(weight) over b, 0.0::double) as free, 1.5::double * (sum(source_size) over ())::double as goal
      from w window b as (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, max(case when (goal - capped) / free <= cap / weight then (goal - capped) / free end) over () as found from f),
t as (select source, source_size, case when found is null then cap else least(cap, weight * found) end as target,
      ('0x' || substr(md5('{SEED}:' || coalesce('s' || source, 'null')), 1, 8))::bigint::double / 4294967296.0::double as shift from l),
r as (select *, row_number() over (partition by source order by size, doc_id) - 1 as rank from d),
c as (select r.doc_id, r.size, t.source_size, t.target, t.shift, r.rank, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as each
      from r join t on r.source is not distinct from t.source)
select doc_id, size, source_size, target, ((floor((rank + 1) * each + shift) - floor(rank * each + shift))::bigint * size)::bigint as taken from c
"""


OP1_SQL = r"""
with w as (select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as ws from documents),
win as (select doc_id, unnest(range(1, len(ws) - 18)) as p, ws from w where len(ws) >= 20),
keyed as (select doc_id, p, array_to_string(ws[p:p + 19], ' ') as k from win),
later as (select doc_id, p from (select doc_id, p, min(struct_pack(d := doc_id, p := p)) over (partition by k) as f from keyed) where struct_pack(d := doc_id, p := p) > f),
gone as (select distinct doc_id, p + unnest(range(0, 20)) as i from later),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from w),
kept as (select words.doc_id, count(*) filter (where gone.i is not null) as r, string_agg(word, ' ' order by words.i) filter (where gone.i is null) as t
         from words left join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(r, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept on w.doc_id = kept.doc_id
"""

OP8_SQL = r"""
with recursive w as (select doc_id, case when text is null then [] else regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') end as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as n, any_value(b.n) as m from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
l as (select a, b from p where 100 * c >= 80 * (n + m - c)),
g as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from s union select g.b, r.c from r join g on g.a = r.doc_id)
select s.doc_id, len(sh)::bigint as n_shingles, min(c) as component_id, min(c) = s.doc_id as kept from s join r on s.doc_id = r.doc_id group by s.doc_id, sh
"""


BASE_QUALITY_SQL = r"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
r as (select doc_id, p, array_to_string(ws[p:p + 4], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as p from w where len(ws) >= 5)),
twice as (select doc_id, p from r qualify count(*) over (partition by doc_id, k) > 1),
covered as (select doc_id, count(distinct at)::bigint as n from (select doc_id, p + unnest(range(0, 5)) as at from twice) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w),
t as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
  from w join lines on w.doc_id = lines.doc_id left join covered on w.doc_id = covered.doc_id)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from t
"""

BASE_LICENSE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
p as (select doc_id, ws, list_filter(range(1, len(ws)), lambda i: ws[i] = 'mit' and ws[i + 1] = 'license') as mit, list_filter(range(1, len(ws)), lambda i: ws[i] = 'apache' and ws[i + 1] = 'license') as apache,
  list_filter(range(1, len(ws) - 1), lambda i: ws[i] = 'general' and ws[i + 1] = 'public' and ws[i + 2] = 'license') as gpl from w),
a as (select *, list_concat(list_concat(mit, apache), gpl) as every from p)
select doc_id, len(ws)::bigint as n_words, len(every)::bigint as n_base, (list_min(every) - 1)::bigint as first_word, (list_max(every) - 1)::bigint as last_word,
array_to_string(list_filter([case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end], lambda x: x is not null), ',') as base_labels from a
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_substring_dedup, op2_source_mixing, op3_license_scan, op4_html_text, op5_media_columns, op6_packing, op7_token_records, op8_near_duplicates, op9_toxicity, op10_quality_rules, base_quality_rules, base_license_phrases, toxic_sentences, repeat_lengths, page_media)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_source_mixing": OP2_SQL, "op8_near_duplicates": OP8_SQL, "base_quality_rules": BASE_QUALITY_SQL, "base_license_phrases": BASE_LICENSE_SQL}
