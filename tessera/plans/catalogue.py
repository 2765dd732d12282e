"""Queries over the provided tables that exercise the operators, each with equivalent SQL.

The tables stand in for the formats' own: parts are archive entries, orders are entries at offsets, events are note or frame
events, documents are files, conversations are ordered parts of a file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import relational as R
from tessera.plans import verbs
from tessera.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


CRC_SQL = (
    "case when length({n}) = 0 then 0 else list_reduce(list_prepend(0::bigint, list_transform(range(0, ceil(length({n}) / 4.0)::bigint), lambda k: "
    + " + ".join(f"(case when length({{n}}) >= k * 4 + {i + 1} then ascii(substr(upper({{n}}), (k * 4 + {i + 1})::bigint, 1))::bigint else 0 end << {8 * i})" for i in range(4))
    + ")), lambda a, w: ((((a << 1) | (a >> 31)) & 4294967295) + w) & 4294967295) end::bigint"
)


def crc_sql(name: str) -> str:
    return CRC_SQL.replace("{n}", name)


@query(f"select p_partkey, {crc_sql('p_name')} as crc from part")
def q01_name_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", C.name_hash(F.col("p_name")).alias("crc"))


@query("select p_brand || '/' || p_size as key, min(p_type) as name from part group by 1 having count(distinct p_type) = 1")
def q02_ambiguous_drop(spark, d):
    c = table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("key"), F.col("p_type").alias("name"))
    return R.unambiguous(c, "key", "name")


@query("""select l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity from lineitem
qualify row_number() over (partition by l_partkey order by l_orderkey desc, l_linenumber desc, l_suppkey desc, l_quantity desc) = 1""")
def q03_overlay_last_wins(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    return R.overlay(table(spark, d, "lineitem"), "l_partkey", order, order)


@query(f"""with e as (select p_partkey, p_size, {crc_sql('p_name')} as crc from part), c as (select {crc_sql('p_name')} as crc, p_name from part where p_partkey % 2 = 0),
n as (select crc, min(p_name) as name from c group by crc having count(distinct p_name) = 1)
select p_partkey, p_size, e.crc, coalesce(name, '(unknown)') as name from e left join n on e.crc = n.crc""")
def q04_list_resolve(spark, d):
    part = table(spark, d, "part")
    entries = part.select("p_partkey", "p_size", C.name_hash(F.col("p_name")).alias("crc"))
    names = part.where("p_partkey % 2 = 0").select(C.name_hash(F.col("p_name")).alias("crc"), F.col("p_name").alias("name"))
    return R.resolve_names(entries, R.unambiguous(names, "crc", "name"), "crc", "name").select("p_partkey", "p_size", "crc", "name")


@query("""with e as (select o_custkey, o_orderkey, date_diff('day', date '1970-01-01', o_orderdate::date)::bigint as off, trunc(o_totalprice / 1000)::bigint as size from orders),
w as (select *, lag(off + size) over o as e, lag(size) over o as s from e window o as (partition by o_custkey order by off, o_orderkey))
select o_custkey, o_orderkey, off, size, e - off as overlap from w where e > off and s > 0""")
def q05_adjacent_overlap(spark, d):
    e = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("off"), (F.col("o_totalprice") / 1000).cast("long").alias("size"))
    return R.adjacent_overlaps(e, ["o_custkey"], "off", "size", ["o_orderkey"])


@query("select doc_id, sha256(text) as sha256 from documents")
def q06_fingerprint(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return verbs.fingerprint(files).withColumnRenamed("path", "doc_id")


@query("""with c as (select *, case when event_type is not distinct from lag(event_type) over o and row_number() over o > 1 then 0 else 1 end as c from events window o as (partition by user_id order by ts, event_id)),
r as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as run from c)
select user_id, run, event_type, count(*) as n from r group by user_id, run, event_type having count(*) >= 2""")
def q07_note_segments(spark, d):
    return R.run_segments(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 2).select("user_id", "run", "event_type", "n")


_LINE_ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


@query(f"""select l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, coalesce(lead(l_partkey) over (partition by l_orderkey order by {_LINE_ORDER}), 1000000) - l_partkey as size from lineitem""")
def q08_size_from_next_offset(spark, d):
    df = table(spark, d, "lineitem")
    out = R.sizes_from_offsets(df, ["l_orderkey"], "l_partkey", _LINE_ORDER.split(", "), F.lit(1000000).cast("long"))
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "size")


@query("""select l_orderkey, l_linenumber, l_partkey, ((l_partkey + 1) * 22050) // (l_linenumber + 11) - (l_partkey * 22050) // (l_linenumber + 11) as samples from lineitem""")
def q09_audio_per_frame(spark, d):
    i, fps = F.col("l_partkey"), F.col("l_linenumber") + 11
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (C.whole_div((i + 1) * 22050, fps) - C.whole_div(i * 22050, fps)).alias("samples"))


@query("""with u as (select l_orderkey, l_linenumber, l_partkey, (l_orderkey * 2654435761) & 4294967295 as u32 from lineitem)
select l_orderkey, l_linenumber, l_partkey, u32 >> 28 as flags, u32 & 268435455 as raw_offset from u""")
def q10_bit_unpack(spark, d):
    u = (F.col("l_orderkey") * 2654435761).bitwiseAND(4294967295)
    flags, at = C.frame_index(u)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flags.alias("flags"), at.alias("raw_offset"))


@query("select conv_id, string_agg(role, '' order by turn desc, text desc) as packed, count(*) as parts from conversations group by conv_id")
def q11_pack_concat(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.expr("array_join(transform(reverse(array_sort(collect_list(struct(turn, text, role)))), x -> x.role), '')").alias("packed"), F.count("*").alias("parts"))


@query(r"""with p as (select page_id, html, substr(html, 1, 4096) as head from pages)
select page_id, length(regexp_replace(head, '[^\x20-\x7E\t\r\n]', '', 'g')) * 10 >= length(head) * 9 and contains(head, '[') as looks_ini from p""")
def q12_sniff_ini(spark, d):
    head = F.substring("html", 1, 4096)
    clean = F.regexp_replace(head, r"[^\x20-\x7E\t\r\n]", "")
    return table(spark, d, "pages").select("page_id", ((F.length(clean) * 10 >= F.length(head) * 9) & F.contains(head, F.lit("["))).alias("looks_ini"))


@query("""with p as (select p_partkey, round(p_retailprice * 100)::bigint as cents from part), s as (select s_suppkey, round(s_acctbal * 100)::bigint as x from supplier)
select p_partkey, abs(cents - x) as distance, s_suppkey from p cross join s qualify row_number() over (partition by p_partkey order by abs(cents - x), s_suppkey) = 1""")
def q13_nearest(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    palette = table(spark, d, "supplier").where("s_suppkey is not null").select("s_suppkey", F.round(F.col("s_acctbal") * 100).cast("long").alias("at"))
    return R.nearest(part, palette, "cents", "at", "s_suppkey").select("p_partkey", "distance", "s_suppkey")


@query("""with n as (select o_orderkey, o_custkey, o_orderpriority || '.' || o_orderstatus as name from orders), r as (select *, row_number() over (partition by o_custkey, lower(name) order by o_orderkey) as n from n)
select o_orderkey, case when n = 1 then name else regexp_replace(name, '\\.[^.]*$', '') || '__' || n || regexp_extract(name, '(\\.[^.]*)$', 1) end as unique_name from r""".replace("\\\\", "\\"))
def q14_unique_names(spark, d):
    n = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.concat_ws(".", "o_orderpriority", "o_orderstatus").alias("name"))
    return R.unique_names(n, ["o_custkey"], "name", ["o_orderkey"]).select("o_orderkey", "unique_name")


@query(f"""select l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, list_reduce(list(l_partkey) over (partition by l_orderkey order by {_LINE_ORDER} rows unbounded preceding), lambda a, b: xor(a, b)) as canvas from lineitem""")
def q15_xor_canvas(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER.split(", ")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", F.bit_xor("l_partkey").over(w).alias("canvas"))


@query("select p_size, count(*) as freq, row_number() over (order by count(*) desc, p_size) as rank from part where p_size <> 15 group by p_size")
def q16_codebook_rank(spark, d):
    counts = table(spark, d, "part").where("p_size <> 15").groupBy("p_size").agg(F.count("*").alias("freq"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "p_size")).cast("long"))  # one row per code word


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)), 6) as rms from embeddings")
def q17_rms(spark, d):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(total / F.size("embedding")), 6).alias("rms"))


@query("""with t as (select user_id, event_id, epoch_us(ts) // 1000000 as t, round(value * 100)::bigint as tempo from events),
w as (select *, lag(t) over o as pt, lag(tempo) over o as p from t window o as (partition by user_id order by t, event_id))
select user_id, sum(coalesce(p, 500) * (t - coalesce(pt, t)))::bigint as micros from w group by user_id""")
def q18_tempo_integral(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", C.whole_div(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000000)).alias("t"), F.round(F.col("value") * 100).cast("long").alias("tempo"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    t = t.withColumn("d", F.coalesce(F.lag("tempo").over(w), F.lit(500)) * (F.col("t") - F.coalesce(F.lag("t").over(w), F.col("t"))))
    return t.groupBy("user_id").agg(F.sum("d").alias("micros"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents) select doc_id, count(*) as n_lines, count(*) filter (where trim(line) <> '') as n_text_lines from l group by doc_id")
def q19_line_count(spark, d):
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("n_text_lines"))


@query("select c_mktsegment as section, c_nationkey as key, arg_max(c_name, c_custkey) as value, min(c_custkey) as pos from customer group by 1, 2")
def q20_key_last_wins(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("section"), F.col("c_nationkey").alias("key")).agg(F.max_by("c_name", "c_custkey").alias("value"), F.min("c_custkey").alias("pos"))


@query("select p_partkey, case when round(69 + 12 * log2(p_retailprice / 440.0)) between 0 and 127 then round(69 + 12 * log2(p_retailprice / 440.0))::int end as note from part")
def q21_note_of_frequency(spark, d):
    return table(spark, d, "part").select("p_partkey", C.note_of_frequency(F.col("p_retailprice")).alias("note"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 're')")
def q22_filter_ignoring_case(spark, d):
    return verbs.filtered(table(spark, d, "part"), "p_name", "RE").select("p_partkey", "p_name")


@query("""with k as (select vec_id, embedding, unnest(range(0, (len(embedding) - 8) // 4 + 1))::int as k from embeddings where len(embedding) >= 8)
select vec_id, k, round(list_sum(list_transform(embedding[4 * k + 1:4 * k + 8], lambda x: x::double)), 4) as total from k""")
def q23_sliding_windows(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") >= 8)
    k = F.explode(F.sequence(F.lit(0), C.whole_div(F.size("embedding") - 8, F.lit(4)).cast("int"))).alias("k")
    part = F.slice("embedding", 4 * F.col("k") + 1, F.lit(8))
    return e.select("vec_id", "embedding", k).select("vec_id", "k", F.round(F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("select o_custkey, count(*) as entries, sum(o_orderkey)::bigint as bytes from orders group by o_custkey")
def q24_archive_footer(spark, d):
    return verbs.footer(table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("size"))).withColumnRenamed("path", "o_custkey")


@query("select p_partkey, (p_size & 63) << 2 as plain, ((p_size & 63) << 2) | ((p_size & 63) >> 4) as full_range, p_size >> 2 as six from part")
def q25_palette_scale(spark, d):
    v = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", C.six_to_eight_plain(v).alias("plain"), C.six_to_eight_full(v).alias("full_range"), C.eight_to_six(v).alias("six"))


@query("""select l_orderkey, l_linenumber, l_partkey, greatest(l_partkey % 256, l_suppkey % 256) * (greatest(l_partkey % 256, l_suppkey % 256) + 1) // 2 + least(l_partkey % 256, l_suppkey % 256) as cell from lineitem""")
def q26_triangle_index(spark, d):
    a, b = F.col("l_partkey") % 256, F.col("l_suppkey") % 256
    hi, lo = F.greatest(a, b), F.least(a, b)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (C.whole_div(hi * (hi + 1), F.lit(2)) + lo).alias("cell"))


@query("select o_orderkey, o_orderkey * 1000000000 // 22050 as duration_ns from orders")
def q27_duration_ns(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.duration_ns(F.col("o_orderkey"), F.lit(22050)).alias("duration_ns"))


@query("select page_id, lower(regexp_extract(url, '([^.]*)$', 1)) as extension from pages")
def q28_extension(spark, d):
    return table(spark, d, "pages").select("page_id", C.extension(F.col("url")).alias("extension"))


@query("""with r as (select c_nationkey || '/' || c_custkey // 100 as file, c_mktsegment as section, 'K' || (c_custkey % 7) as key, c_name as value, c_custkey from customer)
select file, section, key, arg_max(value, c_custkey) as value, (count(*))::bigint as times from r group by 1, 2, 3""")
def q29_ini_text(spark, d):
    """INI texts are written from the rows, some dozens a file, then parsed again."""
    file = F.concat_ws("/", F.col("c_nationkey").cast("string"), C.whole_div(F.col("c_custkey"), F.lit(100)).cast("string"))
    r = table(spark, d, "customer").select(file.alias("file"), "c_mktsegment", "c_custkey", F.concat(F.lit("K"), (F.col("c_custkey") % 7).cast("string"), F.lit(" = "), "c_name", F.lit(" ; remark")).alias("kv"))
    text = r.groupBy("file").agg(F.expr("array_join(transform(array_sort(collect_list(struct(c_custkey, c_mktsegment, kv))), x -> concat('[', x.c_mktsegment, ']\\n', x.kv)), '\\n')").alias("text"))
    parsed = R.ini_table(text, ["file"])
    times = r.groupBy("file", F.col("c_mktsegment").alias("section"), F.trim(F.split_part("kv", F.lit("="), F.lit(1))).alias("key")).agg(F.count("*").alias("times"))
    return parsed.select("file", "section", "key", "value").join(times, ["file", "section", "key"])


@query("""with t as (select user_id, event_id, epoch_us(ts) // 1000 as ms from events)
select user_id, event_id, ms - coalesce(lag(ms) over (partition by user_id order by ms, event_id), 0) as delta from t""")
def q30_delta_time(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", C.whole_div(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000)).alias("ms"))
    return R.delta_times(t, ["user_id"], "ms", ["ms", "event_id"]).select("user_id", "event_id", "delta")


@query("""with t as (select user_id, event_id, epoch_us(ts) // 1000 as ms, 1 + (event_id % 7) * 10 as len from events),
e as (select user_id, event_id, ms as tick, 0 as is_off from t union all select user_id, event_id, ms + len, 1 from t)
select user_id, event_id, tick, is_off, row_number() over (partition by user_id order by tick, is_off desc, event_id) as place from e""")
def q31_note_on_off(spark, d):
    t = table(spark, d, "events").select("user_id", "event_id", C.whole_div(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1000)).alias("ms"))
    off = t.select("user_id", "event_id", (F.col("ms") + 1 + F.col("event_id") % 7 * 10).alias("tick"), F.lit(1).alias("is_off"))
    e = t.select("user_id", "event_id", F.col("ms").alias("tick"), F.lit(0).alias("is_off")).unionByName(off)
    return e.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("tick", F.desc("is_off"), "event_id")).cast("long"))


@query("select user_id, string_agg(distinct event_type, ',' order by event_type) as channels from events group by user_id")
def q32_channels_used(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("channels"))


@query("select lower(c_mktsegment) as key, c_nationkey, arg_min(c_name, c_custkey) as c_name, min(c_custkey) as c_custkey from customer group by 1, 2")
def q33_first_wins(spark, d):
    df = table(spark, d, "customer").withColumn("key", C.ascii_lower(F.col("c_mktsegment")))
    return R.first_wins(df, ["key", "c_nationkey"], ["c_custkey"], ["c_name", "c_custkey"])


@query(f"""with embedded as (select {crc_sql('p_name')} as crc, p_name from part where p_size = 1), builtin as (select {crc_sql('p_name')} as crc, p_name from part),
n as (select * from embedded union all select * from builtin where not exists (select 1 from embedded))
select crc, max(p_name) as name from n group by crc""")
def q34_name_map_precedence(spark, d):
    """Embedded names if there are any, else the built-in ones; never both."""
    part = table(spark, d, "part").withColumn("crc", C.name_hash(F.col("p_name")))
    embedded = part.where("p_size = 1").select("crc", "p_name")
    some = embedded.limit(1).agg(F.count("*").alias("n")).scalar()
    names = embedded.unionByName(part.select("crc", "p_name").where(some == 0))
    return names.groupBy("crc").agg(F.max("p_name").alias("name"))


@query("""with c as (select p_brand as key, p_type as name from part union all select c_mktsegment, c_mktsegment from customer)
select key, min(name) as name from c group by key having count(distinct name) = 1""")
def q35_union_candidates(spark, d):
    a = table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("name"))
    return R.unambiguous(a.unionByName(table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_mktsegment").alias("name"))), "key", "name")


@query("select l_suppkey, min(l_orderkey) as first_seen from lineitem group by l_suppkey order by first_seen, l_suppkey limit 256")
def q36_first_seen_palette(spark, d):
    """A palette holds 256 colours: those first seen."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_seen")).orderBy("first_seen", "l_suppkey").limit(256)


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, try_cast(json_extract_string(props, '$.w') as bigint) as w from events")
def q37_map_bounds(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.w").try_cast("long").alias("w"))


@query("""with r as (select *, (row_number() over (partition by event_type order by ts, event_id) - 1) // 64 as chunk from events)
select event_type, chunk, count(*) as n, min(event_id) as least_id, max(event_id) as largest_id from r group by 1, 2""")
def q38_count_windows(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    r = R.numbered(e, ["event_type"], "at", ["ts", "event_id"], "place").withColumn("chunk", C.whole_div((F.col("place") - 1).cast("long"), F.lit(64)))
    return r.groupBy("event_type", "chunk").agg(F.count("*").alias("n"), F.min("event_id").alias("least_id"), F.max("event_id").alias("largest_id"))


@query("select o_orderkey, regexp_replace(regexp_replace(o_orderpriority || '.;' || o_orderstatus, ';[^;]*$', ''), '\\.$', '') as name from orders")
def q39_strip_version(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.without_version(F.concat(F.col("o_orderpriority"), F.lit(".;"), F.col("o_orderstatus"))).alias("name"))


@query(r"""with v as (select c_custkey, case c_custkey % 6 when 0 then '' when 1 then 'Yes' when 2 then c_custkey::varchar when 3 then c_name || ': x' when 4 then '# ' || c_name else c_name end as v from customer)
select c_custkey, v = '' or lower(v) in ('true','false','yes','no','on','off','null','~','y','n') or regexp_matches(v, '^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$')
or regexp_matches(v, '^[\s\-?:,\[\]{}#&*!|>''"%@`]') or regexp_matches(v, ': |:$| #|\s$|[\n\r\t"\\]') as quoted from v""")
def q40_yaml_quotes(spark, d):
    k = F.col("c_custkey") % 6
    v = F.when(k == 0, "").when(k == 1, "Yes").when(k == 2, F.col("c_custkey").cast("string")).when(k == 3, F.concat("c_name", F.lit(": x"))).when(k == 4, F.concat(F.lit("# "), "c_name")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", C.needs_quotes(v).alias("quoted"))


@query("select page_id, coalesce(case when html like '<!DOCTYPE%' then 'html' end, case lower(regexp_extract(url, '([^.]*)$', 1)) when 'ini' then 'ini' when 'shp' then 'shp' end, 'unknown') as format from pages")
def q41_identify(spark, d):
    sniffed = F.when(F.startswith("html", F.lit("<!DOCTYPE")), "html")
    return table(spark, d, "pages").select("page_id", F.coalesce(sniffed, C.format_of_extension(F.col("url")), F.lit("unknown")).alias("format"))


@query("""with c as (select o_custkey, count(*) filter (where o_totalprice < 10000) as warnings, count(*) filter (where o_orderstatus = 'P') as errors from orders group by 1)
select *, case when errors = 0 then 'OK' else 'FAIL' end as verdict from c""")
def q42_check_report(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") < 10000).alias("warnings"), F.count_if(F.col("o_orderstatus") == "P").alias("errors"))
    return c.withColumn("verdict", F.when(F.col("errors") == 0, "OK").otherwise("FAIL"))


@query("""select conv_id, turn, case when role = 'user' then 0 else 1 end as depth, case when role = 'user' then null else last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn, text rows unbounded preceding) end as parent from conversations""")
def q43_tree_parents(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    up = F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", 0).otherwise(1).alias("depth"), F.when(F.col("role") != "user", up).alias("parent"))
