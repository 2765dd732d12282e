"""Queries that run the decoders, codecs and file verbs over the provided tables, each with equivalent SQL.

Files are built from the tables' rows (an order is an archive's entry, a string, a frame or a chunk; a customer's orders are a file),
then read back by the engine. What comes out is what the rows say, which the SQL takes from the tables themselves.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.udfs import register_codecs
from tessera.operators import lookups
from tessera.plans import verbs
from tessera.plans.catalogue import ORACLE, QUERIES, crc_sql, query
from tessera.session import ship, table
from tessera.sources import archives, encoding, images, media, texts
from tessera.sources.reading import bag_payload, decoded, entries_with_payload

__all__ = ["ORACLE", "QUERIES"]
#: Per order: the name and the bytes that it stands for.
NAME_SQL, BODY_SQL = "'f' || o_orderkey || '.' || lower(o_orderstatus)", "o_orderpriority"
ROWS_SQL = f"select o_custkey::varchar as path, o_orderkey, o_totalprice, {NAME_SQL} as name, {BODY_SQL} as body, md5(o_orderkey::varchar) as pixels, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as idx from orders"


def built(df: DataFrame, build: Callable[[list[dict]], bytes]) -> DataFrame:
    """path and content: a file of each path's rows, in the order of the columns after path."""
    ship(df.sparkSession)
    items = F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "path"])))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([build(x) for x in batch.column("items").to_pylist()], pa.binary())], names=["path", "content"])

    return df.groupBy("path").agg(items.alias("items")).mapInArrow(make, "path string, content binary")


def orders(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit("."), F.lower("o_orderstatus"))
    key = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), "o_orderkey", "o_totalprice", name.alias("name"), F.col("o_orderpriority").alias("body"), F.md5(key.cast("binary")).alias("pixels"))


def said(data: str) -> Column:
    return F.col(data).cast("string").alias(data)


def mix_file(rows: list[dict]) -> bytes:
    return archives.encode_mix([(r["crc"], r["body"].encode()) for r in rows])


def big_file(rows: list[dict]) -> bytes:
    names = [r["name"].encode() for r in rows]
    first = 16 + sum(9 + len(n) for n in names)
    index, at = b"", first
    for n, r in zip(names, rows, strict=True):
        index += struct.pack(">II", at, len(r["body"])) + n + b"\0"
        at += len(r["body"])
    return b"BIGF" + struct.pack("<I", at) + struct.pack(">II", len(rows), first) + index + b"".join(r["body"].encode() for r in rows)


def pak_file(rows: list[dict]) -> bytes:
    at = sum(5 + len(r["name"]) for r in rows) + 4
    index = b""
    for r in rows:
        index += struct.pack("<I", at) + r["name"].encode() + b"\0"
        at += len(r["body"])
    return index + bytes(4) + b"".join(r["body"].encode() for r in rows)


def meg_file(rows: list[dict], kind: int) -> bytes:
    """The layouts: counts first; a marker and the data's start; the same with the size of the names."""
    names = b"".join(struct.pack("<H", len(r["name"])) + r["name"].encode() for r in rows)
    head = (8, 20, 24)[kind]
    first = head + len(names) + 20 * len(rows)
    at, index = first, b""
    for i, r in enumerate(rows):
        n = len(r["body"])
        index += struct.pack("<HIIIIH", 0, i, i, n, at, i) if kind == 2 else struct.pack("<5I", i, i, n, at, i)
        at += n
    start = struct.pack("<II", len(rows), len(rows))
    if kind:
        start = struct.pack("<III", 0xFFFFFFFF, 0x3F7D70A4, first) + start
    if kind == 2:
        start += struct.pack("<I", len(names))
    return start + names + index + b"".join(r["body"].encode() for r in rows)


def iso_file(rows: list[dict]) -> bytes:
    def record(name: bytes, block: int, size: int, flags: int) -> bytes:
        n = 33 + len(name) + (1 - len(name) % 2)
        return (bytes([n, 0]) + struct.pack("<I", block) + bytes(4) + struct.pack("<I", size) + bytes(11) + bytes([flags]) + bytes(6) + bytes([len(name)]) + name).ljust(n, b"\0")

    blocks = 2 + len(rows) // 32
    records = [record(b"\0", 18, 0, 2), record(b"\1", 18, 0, 2)]
    records += [record(r["name"].encode() + b";1", 18 + blocks + i, len(r["body"]), 0) for i, r in enumerate(rows)]
    directory, sector = b"", b""
    for x in records:  # a record stays within its block
        if len(sector) + len(x) > 2048:
            directory, sector = directory + sector.ljust(2048, b"\0"), b""
        sector += x
    directory = (directory + sector.ljust(2048, b"\0")).ljust(2048 * blocks, b"\0")
    root = record(b"\0", 18, len(directory), 2)
    volume = (b"\1CD001\1".ljust(128, b"\0") + struct.pack("<H", 2048)).ljust(156, b"\0") + root
    return bytes(16 * 2048) + volume.ljust(4096, b"\0") + directory + b"".join(r["body"].encode().ljust(2048, b"\0") for r in rows)


def _entries(spark: SparkSession, d: str, kind: str, build: Callable[[list[dict]], bytes]) -> DataFrame:
    files = built(orders(spark, d).select("path", "o_orderkey", "name", "body"), build)
    return entries_with_payload(files, kind).select("path", "idx", "name", F.col("size").cast("long").alias("size"), said("payload"))


ENTRIES_SQL = f"with r as ({ROWS_SQL}) select path, idx, name, length(body)::bigint as size, body as payload from r"


@query(f"with r as ({ROWS_SQL}) select path, (row_number() over (partition by path order by crc) - 1)::int as idx, crc, max(name) over (partition by crc) as name, length(body)::bigint as size from (select *, {crc_sql('name')} as crc from r)")
def q44_mix_list(spark, d):
    """Entries by hash, named by a list of names."""
    rows = orders(spark, d).withColumn("crc", C.name_hash(F.col("name")))
    files = built(rows.select("path", "o_orderkey", "crc", "body"), mix_file)
    return verbs.list_entries(files, "mix", verbs.name_map(rows.select("name"))).select("path", "idx", "crc", "name", "size")


@query(f"""with r as (select *, {crc_sql('name')} as crc from ({ROWS_SQL})), n as (select crc, max(name) as known from r where o_orderkey % 2 = 0 group by crc)
select path, coalesce(known, printf('%08X', r.crc) || '.bin') as name, body as payload from r left join n on r.crc = n.crc""")
def q45_mix_extract(spark, d):
    """Names are known for every second entry; the others are called by their hashes. Entries of one hash have one name."""
    rows = orders(spark, d).withColumn("crc", C.name_hash(F.col("name")))
    files = built(rows.select("path", "o_orderkey", "crc", "body"), mix_file)
    return verbs.extract(files, "mix", verbs.name_map(rows.where("o_orderkey % 2 = 0").select("name")), unique=False).select("path", "name", said("payload"))


@query(ENTRIES_SQL)
def q46_big_entries(spark, d):
    return _entries(spark, d, "big", big_file)


@query(ENTRIES_SQL)
def q47_pak_entries(spark, d):
    return _entries(spark, d, "pak", pak_file)


@query(ENTRIES_SQL)
def q48_meg_entries(spark, d):
    """Files of all three layouts."""
    return _entries(spark, d, "meg", lambda rows: meg_file(rows, rows[0]["o_orderkey"] % 3))


@query(ENTRIES_SQL)
def q49_iso_entries(spark, d):
    return _entries(spark, d, "iso", iso_file)


@query(f"with r as ({ROWS_SQL}) select path, idx, 's' || o_orderkey as name, 22050::bigint as sample_rate, body as payload from r")
def q50_idx_bag(spark, d):
    """Sounds: an index file, and one with the bytes."""
    rows = orders(spark, d)

    def index(items: list[dict]) -> bytes:
        out, at = b"", 0
        for r in items:
            out += struct.pack("<16s5I", b"s%d" % r["o_orderkey"], at, len(r["body"]), 22050, 1, 0)
            at += len(r["body"])
        return out

    rows = rows.select("path", "o_orderkey", "body")
    idx = built(rows, index).withColumn("path", F.concat("path", F.lit(".idx")))
    bags = built(rows, lambda items: b"".join(r["body"].encode() for r in items)).withColumn("path", F.concat("path", F.lit(".bag")))
    out = bag_payload(decoded(idx, "bag-idx").where("_error is null"), bags)
    return out.select(F.regexp_replace("path", r"\.idx$", "").alias("path"), "idx", "name", "sample_rate", said("payload"))


@query(f"with r as ({ROWS_SQL}) select path, 'Sec' || substr(body, 1, 1) as section, 'Key' || right(name, 1) as key, arg_max(o_orderkey::varchar, o_orderkey) as value from r group by 1, 2, 3")
def q51_ini_file(spark, d):
    """Sections come again and again; the last value of a key wins."""
    def text(items: list[dict]) -> bytes:
        return "".join(f"[Sec{r['body'][0]}] ; c\r\n key{r['name'][-1]} = 0\r\nKey{r['name'][-1]}={r['o_orderkey']};x\r\n" for r in items).encode()

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "name", "body"), text), "ini").select("path", "section", "key", "value")


@query(f"""with r as ({ROWS_SQL}) select path, 3 * idx as node_id, null::int as parent_id, 0 as depth, 'N' || o_orderkey as key, null::varchar as value from r
union all select path, 3 * idx + 1, 3 * idx, 1, 'Body', body from r union all select path, 3 * idx + 2, 3 * idx + 1, 2, 'Name', name from r""")
def q52_miniyaml_tree(spark, d):
    def text(items: list[dict]) -> bytes:
        return "".join(f"N{r['o_orderkey']}: # note\n\tBody: {r['body']}\n\t\tName: {r['name']}\n" for r in items).encode()

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "name", "body"), text), "miniyaml").select("path", "node_id", "parent_id", "depth", "key", "value")


@query(f"with r as ({ROWS_SQL}) select path, idx, body as text from r")
def q53_eng_strings(spark, d):
    files = built(orders(spark, d).select("path", "o_orderkey", "body"), lambda items: texts.encode_eng([r["body"].encode() for r in items]))
    return decoded(files, "eng").select("path", "idx", "text")


@query(f"with r as ({ROWS_SQL}) select path, name as label, body || ' é' as value, 'x' || o_orderkey as extra, 3::bigint as version from r")
def q54_csf_strings(spark, d):
    def text(items: list[dict]) -> bytes:
        out = b" FSC" + struct.pack("<5I", 3, len(items), len(items), 0, 0)
        for r in items:
            value, extra = f"{r['body']} é".encode("utf-16-le"), f"x{r['o_orderkey']}".encode()
            out += b" LBL" + struct.pack("<II", 1, len(r["name"])) + r["name"].encode() + b"STRW" + struct.pack("<I", len(value) // 2) + bytes(x ^ 255 for x in value) + struct.pack("<I", len(extra)) + extra
        return out

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "name", "body"), text), "csf").select("path", "label", "value", "extra", "version")


@query(f"with r as ({ROWS_SQL}) select path, 'ID:' || o_orderkey as id, body as value, idx as pos from r")
def q55_string_file(spark, d):
    def text(items: list[dict]) -> bytes:
        return "".join(f'; remark\nID:{r["o_orderkey"]}\n"{r["body"]}"\nEND\n' for r in items).encode()

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "body"), text), "str").select("path", "id", "value", "pos")


@query("select p_partkey, sha256(repeat(p_name, 4)) as sha256 from part")
def q56_lcw_round_trip(spark, d):
    register_codecs(spark)
    data = F.repeat("p_name", F.lit(4))
    packed = F.call_function("lcw_compress", data.cast("binary"))
    return table(spark, d, "part").select("p_partkey", F.sha2(F.call_function("lcw_decompress", packed, F.octet_length(data)), 256).alias("sha256"))


@query("""select o_orderkey, lower(case when o_orderkey >= 2097152 then printf('%02X', 128 | (o_orderkey >> 21)) else '' end || case when o_orderkey >= 16384 then printf('%02X', 128 | ((o_orderkey >> 14) & 127)) else '' end
|| case when o_orderkey >= 128 then printf('%02X', 128 | ((o_orderkey >> 7) & 127)) else '' end || printf('%02X', o_orderkey & 127)) as vlq from orders""")
def q57_variable_length(spark, d):
    register_codecs(spark)
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(F.call_function("vlq", F.col("o_orderkey")))).alias("vlq"))


FRAMES_SQL = f"with r as ({ROWS_SQL}) select path, idx, pixels from r"


def _frames(spark: SparkSession, d: str, kind: str, encode: Callable[[list[bytes], int, int], bytes]) -> DataFrame:
    files = built(orders(spark, d).select("path", "o_orderkey", "pixels"), lambda items: encode([r["pixels"].encode() for r in items], 8, 4))
    return decoded(files, kind).select("path", "idx", said("pixels"))


@query(FRAMES_SQL)
def q58_shp_frames(spark, d):
    return _frames(spark, d, "shp", images.encode_shp)


@query(FRAMES_SQL)
def q59_wsa_frames(spark, d):
    """Frames that are differences to the one before."""
    return _frames(spark, d, "wsa", images.encode_wsa)


@query(FRAMES_SQL)
def q60_tmp_tiles(spark, d):
    return _frames(spark, d, "tmp", images.encode_tmp_td)


@query("select n_name as path, i::int as idx, ((i + n_nationkey) % 64)::int as r, ((i * (n_nationkey + 1)) % 64)::int as g, (i % 7)::int as b from nation, range(256) t(i)")
def q61_palettes(spark, d):
    files = built(table(spark, d, "nation").select(F.col("n_name").alias("path"), F.col("n_nationkey").cast("int").alias("k")), lambda x: images.encode_pal([(4 * ((i + x[0]["k"]) % 64), 4 * (i * (x[0]["k"] + 1) % 64), 4 * (i % 7)) for i in range(256)]))
    return decoded(files, "pal").select("path", "idx", "r", "g", "b")


@query(f"with r as ({ROWS_SQL}), n as (select path, 40 * count(*) as n from r group by path) select path, c::int as chunk, 22050 as sample_rate, 64 * c as start_frame, least(64, n - 64 * c)::int as frames from n, range(1000000) t(c) where 64 * c < n")
def q62_aud_chunks(spark, d):
    """Sound in chunks of 64 frames."""
    files = built(orders(spark, d).select("path", "o_orderkey"), lambda items: media.build_aud([(r["o_orderkey"] * k) % 2000 - 1000 for r in items for k in range(40)], 22050))
    return decoded(files, "aud", chunkFrames=64).select("path", "chunk", "sample_rate", "start_frame", F.size("samples").alias("frames"))


@query("with e as (select vec_id, unnest(range(1, len(embedding) + 1)) as i from embeddings) select vec_id::varchar as path, 8000 as sample_rate, count(*)::bigint as frames, sum(((i * 37 + vec_id) % 4001 - 2000) * i)::bigint as weighted from e group by vec_id")
def q63_wav_samples(spark, d):
    """16-bit samples as numbers of 1; scaled back they are whole."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("vec_id").cast("long").alias("k"), F.size("embedding").alias("n"))
    files = built(e, lambda x: media.wav_of([(i * 37 + x[0]["k"]) % 4001 - 2000 for i in range(1, x[0]["n"] + 1)], 8000, 1))
    total = F.aggregate(F.transform("samples", lambda x, i: F.round(x * 32768).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return decoded(files, "wav").select("path", "sample_rate", "frames", total.alias("weighted"))


@query(f"with r as ({ROWS_SQL}) select path, 10 * idx::bigint as tick, 9 as kind, (o_orderkey % 128)::int as note, (o_orderkey % 16)::int as channel from r")
def q64_midi_notes(spark, d):
    def song(items: list[dict]) -> bytes:
        return media.smf([(10 * i, bytes([0x90 | r["o_orderkey"] % 16, r["o_orderkey"] % 128, 64])) for i, r in enumerate(items)], 480)

    rows = decoded(built(orders(spark, d).select("path", "o_orderkey"), song), "mid").where("meta is null")
    return rows.select("path", "tick", F.shiftright("status", 4).alias("kind"), F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int").alias("note"), "channel")


@query(f"with r as ({ROWS_SQL}) select path, idx, 4 as width, 2 as height, pixels as rgba from r")
def q65_png_pixels(spark, d):
    rows = orders(spark, d).withColumn("path", F.concat_ws("/", "path", F.col("o_orderkey").cast("string"))).select("path", "pixels")
    out = decoded(built(rows, lambda x: media.png_of(np.frombuffer(x[0]["pixels"].encode(), np.uint8).reshape(2, 4, 4))), "png")
    order = F.split_part("path", F.lit("/"), F.lit(2)).cast("long")
    out = out.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("path"), order.alias("k"), "width", "height", said("rgba"))
    return out.withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("k")) - 1).drop("k")


@query(f"with r as ({ROWS_SQL}) select path, idx, 'Chunk' || (o_orderkey % 5) as name, (o_orderkey % 9)::bigint as version, body as data from r")
def q66_sage_chunks(spark, d):
    def chunks(items: list[dict]) -> bytes:
        out = b"CkMp"
        for r in items:
            name = b"Chunk%d" % (r["o_orderkey"] % 5)
            out += struct.pack("<I", len(name)) + name + struct.pack("<II", r["o_orderkey"] % 9, len(r["body"])) + r["body"].encode()
        return out

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "body"), chunks), "map_sage").select("path", "idx", "name", "version", said("data"))


@query(f"""with r as ({ROWS_SQL}) select path, 2 * idx as node_id, null::int as parent_id, 0 as depth, idx as ordinal, 31::bigint as chunk_type, null::varchar as data from r
union all select path, 2 * idx + 1, 2 * idx, 1, 0, (o_orderkey % 1000)::bigint, body from r""")
def q67_w3d_chunks(spark, d):
    """A chunk that holds one, per order."""
    def chunks(items: list[dict]) -> bytes:
        return b"".join(struct.pack("<IIII", 31, 0x80000000 | 8 + len(r["body"]), r["o_orderkey"] % 1000, len(r["body"])) + r["body"].encode() for r in items)

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "body"), chunks), "w3d").select("path", "node_id", "parent_id", "depth", "ordinal", "chunk_type", said("data"))


@query("""select c_custkey::varchar as path, (c_custkey % 65536)::int as map_seed, (c_custkey % 3)::int as map_scale, (c_custkey % 6)::int as house,
['Harkonnen', 'Atreides', 'Ordos', 'Fremen', 'Sardaukar', 'Mercenary'][c_custkey % 6 + 1] as house_name, c_name as placements from customer""")
def q68_scenarios(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey", "c_name")
    files = built(rows, lambda x: struct.pack("<8H", 1, 2, (k := x[0]["c_custkey"]) % 65536, 0, 0, 0, k % 3, k % 6) + x[0]["c_name"].encode())
    return decoded(files, "d2_map").select("path", "map_seed", "map_scale", "house", "house_name", said("placements"))


@query("select c_custkey::varchar as path, (1 + c_custkey % 64)::bigint as width, (1 + c_custkey % 32)::bigint as height, 'DXT' || (1 + c_custkey % 5) as four_cc, true as compressed from customer")
def q69_dds_headers(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey")

    def head(x: list[dict]) -> bytes:
        k = x[0]["c_custkey"]
        return (b"DDS " + struct.pack("<7I", 124, 0, 1 + k % 32, 1 + k % 64, 0, 0, 1) + bytes(44) + struct.pack("<II4sI", 32, 4, b"DXT%d" % (1 + k % 5), 0)).ljust(128, b"\0")

    return decoded(built(rows, head), "dds").select("path", "width", "height", "four_cc", "compressed")


@query("select c_custkey::varchar as path, case c_custkey % 6 when 0 then 'big' when 1 then 'csf' when 2 then 'aud' when 3 then 'map_sage' when 4 then 'ini' else 'unknown' end as format from customer")
def q70_identify_files(spark, d):
    """By content where it says so, else by the path's ending."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey", F.lit("a.b").alias("name"), F.col("c_name").alias("body"))

    def content(x: list[dict]) -> bytes:
        kinds = [lambda: big_file(x), lambda: b" FSC" + struct.pack("<5I", 3, 0, 0, 0, 0), lambda: media.build_aud([0] * 64, 22050), lambda: b"CkMp" + bytes(8), lambda: b"[a]\nb=c\n", lambda: b"plain"]
        return kinds[x[0]["c_custkey"] % 6]()

    return verbs.identify(built(rows, content))


@query("""with o as (select o_custkey::varchar as path, count(*)::bigint as entries from orders group by 1)
select path, entries, case when path::bigint % 3 = 0 and entries > 1 then 1 else 0 end::bigint as "overlaps", case when path::bigint % 3 = 0 and entries > 1 then 'FAIL' else 'OK' end as verdict from o""")
def q71_check_archives(spark, d):
    """Each third archive's first entry reaches into its second."""
    def content(items: list[dict]) -> bytes:
        data = bytearray(big_file(items))
        if items[0]["k"] % 3 == 0 and len(items) > 1:
            (size,) = struct.unpack_from(">I", data, 20)
            struct.pack_into(">I", data, 20, size + 1)
        return bytes(data)

    rows = orders(spark, d).select("path", "o_orderkey", "name", "body", F.col("path").cast("long").alias("k"))
    return verbs.check(built(rows, content), "big").select("path", "entries", "overlaps", "verdict")


@query("select c_custkey::varchar as path, case when c_custkey % 4 = 0 then false else true end as ok, case when c_custkey % 4 = 0 then 'eof' end as kind from customer")
def q72_validate_files(spark, d):
    """Each fourth picture is cut off."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey")
    files = built(rows, lambda x: (struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 1, 1, 24, 0) + b"bgr")[: 9 if x[0]["c_custkey"] % 4 == 0 else 99])
    return verbs.validate(files, "tga").select("path", "ok", "error.kind")


@query(f"with r as ({ROWS_SQL}) select path, name, body as payload from r where contains(name, '.o')")
def q73_extract_filtered(spark, d):
    files = built(orders(spark, d).select("path", "o_orderkey", "name", "body"), pak_file)
    return verbs.extract(files, "pak", filter=".O").select("path", "name", said("payload"))


@query("with o as (select o_custkey::varchar as path, count(*) as entries, sum(length(o_orderpriority))::bigint as bytes from orders group by 1) select path, entries, bytes from o")
def q74_listing_footer(spark, d):
    files = built(orders(spark, d).select("path", "o_orderkey", "name", "body"), pak_file)
    return verbs.footer(decoded(files, "pak")).select("path", "entries", "bytes")


@query(f"with r as ({ROWS_SQL}) select path, (row_number() over (partition by path order by o_orderkey) - 1)::int as part, sha256(pixels) as sha256 from r")
def q75_convert_shp_gif_shp(spark, d):
    """Sprites to an animated picture and back, by a palette of all colours."""
    grey = images.encode_pal([(i % 64 * 4, i // 64 * 4, 0) for i in range(256)])
    shapes = built(orders(spark, d).select("path", "o_orderkey", "pixels"), lambda items: images.encode_shp([r["pixels"].encode() for r in items], 8, 4))
    pictures = verbs.convert(shapes, "shp", "gif", grey).select("path", F.col("data").alias("content"))
    again = verbs.convert(pictures, "gif", "shp", grey).select("path", F.col("data").alias("content"))
    return decoded(again, "shp").select("path", F.col("idx").alias("part"), F.sha2("pixels", 256).alias("sha256"))


@query(f"with r as ({ROWS_SQL}), c as (select path, name, body, {crc_sql('name')} as crc from r) select path, name, body as payload from c")
def q76_mix_embedded_names(spark, d):
    """Archives that bring their own list of names; the caller's list isn't asked then."""
    rows = orders(spark, d).withColumn("crc", C.name_hash(F.col("name")))

    def content(items: list[dict]) -> bytes:
        names = struct.pack("<I", len(items)) + b"".join(r["name"].encode() + b"\0\0" for r in items)
        return archives.encode_mix([(r["crc"], r["body"].encode()) for r in items] + [(archives.NAMES_ENTRY, names)])

    files = built(rows.select("path", "o_orderkey", "crc", "name", "body"), content)
    other = verbs.name_map(rows.select(F.concat(F.lit("other"), "name").alias("name")))
    return verbs.extract(files, "mix", other).where("not startswith(name, '54C2D545')").select("path", "name", said("payload"))


@query(f"with r as ({ROWS_SQL}) select path, idx, o_orderkey, body as payload from r where idx % 2 = 1")
def q77_entries_by_name_and_ordinal(spark, d):
    """The entry of a name, whatever its case, and that of a place."""
    rows = orders(spark, d)
    index = entries_with_payload(built(rows.select("path", "o_orderkey", "name", "body"), big_file), "big")
    asked = rows.select("path", F.upper("name").alias("wanted"), "o_orderkey")
    found = verbs.lookup(index, asked, "wanted").where("idx % 2 = 1")
    return found.select("path", "idx", "o_orderkey", said("payload"))



GREY = bytes(v for i in range(256) for v in (i % 64, i // 64, 0))


@query(f"with r as ({ROWS_SQL}) select path, idx as frame, idx::bigint * 1000000000 // 15 as timestamp_ns, pixels from r")
def q78_vqa_frames(spark, d):
    """Video of block code books, encoded and decoded."""
    files = built(orders(spark, d).select("path", "o_orderkey", "pixels"), lambda items: encoding.encode_vqa([r["pixels"].encode() for r in items], GREY, 8, 4, fps=15, group=1))
    return decoded(files, "vqa").select("path", "frame", "timestamp_ns", said("pixels"))


@query(f"with r as ({ROWS_SQL}), n as (select path, count(*) as n from r group by path) select r.path, idx as frame, pixels from r join n on r.path = n.path where idx >= least(2, n - 1)")
def q79_vqa_seek(spark, d):
    """From the frame that is shown at a time, or the last one, on: taken step by step."""
    files = built(orders(spark, d).select("path", "o_orderkey", "pixels"), lambda items: encoding.encode_vqa([r["pixels"].encode() for r in items], GREY, 8, 4, fps=15, group=1))
    return decoded(files, "vqa_stream", startNanos=2 * 66_666_667).select("path", "frame", said("pixels"))


@query(f"with r as ({ROWS_SQL}) select path, idx as frame, regexp_replace(hex(substr(pixels, 1, 24)), '(.{{6}})', '\\1FF', 'g') as rgba, 100000::bigint as micros_per_frame from r")
def q80_avi_frames(spark, d):
    files = built(orders(spark, d).select("path", "o_orderkey", "pixels"), lambda items: media.avi_of([np.frombuffer(r["pixels"][:24].encode(), np.uint8).reshape(2, 4, 3) for r in items], 10))
    return decoded(files, "avi").select("path", "frame", F.hex("rgba").alias("rgba"), "micros_per_frame")


@query(f"with r as ({ROWS_SQL}) select path, idx, 1 as block_type, 10000::bigint as sample_rate, body as data from r")
def q81_voc_blocks(spark, d):
    def sound(items: list[dict]) -> bytes:
        head = b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x010A, (~0x010A + 0x1234) & 0xFFFF)
        return head + b"".join(b"\1" + (len(r["body"]) + 2).to_bytes(3, "little") + bytes([156, 0]) + r["body"].encode() for r in items) + b"\0"

    out = decoded(built(orders(spark, d).select("path", "o_orderkey", "body"), sound), "voc").where("block_type = 1")
    return out.select("path", "idx", "block_type", "sample_rate", F.substring("data", 3, 1 << 20).cast("string").alias("data"))


@query(f"with r as ({ROWS_SQL}) select path, idx as frame, 0 as section, (o_orderkey % 1000)::double as x, -1.5::double as y from r")
def q82_transforms(spark, d):
    def motion(items: list[dict]) -> bytes:
        return struct.pack("<16sII", b"a.hva", len(items), 1) + b"body".ljust(16, b"\0") + b"".join(struct.pack("<12f", r["o_orderkey"] % 1000, *[0] * 10, -1.5) for r in items)

    out = decoded(built(orders(spark, d).select("path", "o_orderkey"), motion), "hva")
    return out.select("path", "frame", "section", F.col("matrix")[0].cast("double").alias("x"), F.col("matrix")[11].cast("double").alias("y"))


def _ini_files(spark: SparkSession, d: str) -> DataFrame:
    def text(items: list[dict]) -> bytes:
        return "".join(f"[Sec{r['body'][0]}]\nKey{r['name'][-1]}={r['o_orderkey']}\n" for r in items).encode()

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "name", "body"), text), "ini")


@query(f"with r as ({ROWS_SQL}) select path, arg_max(o_orderkey::varchar, o_orderkey) as value from r where substr(body, 1, 1) = '2' and right(name, 1) = 'o' group by path")
def q83_ini_lookup(spark, d):
    return lookups.ini_value(_ini_files(spark, d), F.lit("SEC2"), F.lit("keyO"))


@query(f"with r as ({ROWS_SQL}) select path, 'sec' || substr(body, 1, 1) as section, count(distinct right(name, 1)) as keys, bool_or(any_value(substr(body, 1, 1)) = '3') over (partition by path) as has from r group by path, substr(body, 1, 1)")
def q84_ini_sections(spark, d):
    rows = _ini_files(spark, d)
    return lookups.section_sizes(rows).join(lookups.has_section(rows, F.lit("sec3")), "path")


def _sage(spark: SparkSession, d: str) -> DataFrame:
    def chunks(items: list[dict]) -> bytes:
        return b"CkMp" + b"".join(struct.pack("<I", 6) + b"Chunk%d" % (r["o_orderkey"] % 5) + struct.pack("<II", r["o_orderkey"] % 9, len(r["body"])) + r["body"].encode() for r in items)

    return decoded(built(orders(spark, d).select("path", "o_orderkey", "body"), chunks), "map_sage")


@query(f"with r as ({ROWS_SQL}) select path, arg_min(idx, idx) as idx, arg_min(body, idx) as data from r where o_orderkey % 5 = 3 group by path")
def q85_chunk_lookup(spark, d):
    return lookups.chunk(_sage(spark, d), F.lit("Chunk3")).select("path", "idx", said("data"))


@query(f"with r as ({ROWS_SQL}) select path, count(*) + 1 as events, array_to_string(list_sort(list(distinct o_orderkey % 16)), ',') as channels from r group by path")
def q86_song_summary(spark, d):
    """Events, the end of the track among them, and the channels that they use."""
    def song(items: list[dict]) -> bytes:
        return media.smf([(10 * i, bytes([0x90 | r["o_orderkey"] % 16, r["o_orderkey"] % 128, 64])) for i, r in enumerate(items)], 480)

    rows = lookups.midi_summary(decoded(built(orders(spark, d).select("path", "o_orderkey"), song), "mid"))
    return rows.select("path", "events", F.array_join(F.transform("channels", lambda x: x.cast("string")), ",").alias("channels"))


@query("select l_orderkey, l_linenumber, l_partkey, least(l_partkey * 1000000 * (10 + l_linenumber) // 1000000000, 19) as frame, l_partkey * 1000000000 // (10 + l_linenumber) as nanos from lineitem")
def q87_frame_at_time(spark, d):
    fps = (F.col("l_linenumber") + 10).cast("long")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lookups.frame_at(F.col("l_partkey") * 1_000_000, fps, F.lit(20)).cast("long").alias("frame"), lookups.clip_nanos(fps, F.col("l_partkey")).alias("nanos"))


@query(f"with r as ({ROWS_SQL}), n as (select path, count(*) as n from r group by path) select path, sum(case when n > 2 then n - 1 else n end * 80)::bigint as samples, count(*) filter (where n > 2) as damaged from n group by path")
def q88_sound_after_damage(spark, d):
    """Sounds of marked chunks, 40 bytes an order; where there are more than two the second one's mark is damaged, and it alone is lost."""
    def sound(items: list[dict]) -> bytes:
        parts = [struct.pack("<HHI", 40, 160, 0xDEAF) + bytes([r["o_orderkey"] % 256] * 40) for r in items]
        if len(parts) > 2:
            parts[1] = parts[1][:4] + b"\0\0\0\0" + parts[1][8:]
        body = b"".join(parts)
        return struct.pack("<HIIBB", 22050, len(body), 160 * len(parts), 2, 99) + body

    out = decoded(built(orders(spark, d).select("path", "o_orderkey"), sound), "aud_stream", chunkFrames=80, resync="true").where("_error is null")
    return out.groupBy("path").agg(F.sum(F.size("samples")).alias("samples"), F.count_if("after_damage").alias("damaged"))

