"""The registered queries of the ten operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language, line_dedup, near_dup, pieces, secrets, sharding, sketch, suffix_dedup
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.sample_encodings(table(spark, sf_dir, "documents"), MODEL, k=3, digest=True)
    return done.withColumnRenamed("ids", "ids_sha256")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", language.held_out())
    model = language.fit(docs.where(~F.col("held_out")))
    return language.predict(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score")
    )


PASSAGE = 256  # bytes; nearly every passage of over 50 words has as many, though often not 400


@query
def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, digest=True, short=PASSAGE)

    def total(spans: str) -> Column:
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])

    return done.select(
        "doc_id",
        "n_bytes",
        total("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.col("kept").cast("string").alias("kept_sha256"),
        total("passages").alias("n_passage"),
    )


def _sql_runs(n: int, p: str) -> str:
    """Maximal runs that repeated strings of ``n`` bytes cover, from the digest of every string, cut from overlapping chunks of the text's hexadecimal form."""
    return f"""{p}c as (select doc_id, k * 1000 as off, substr(h, 2000 * k + 1, {1998 + 2 * n}) as part from (select doc_id, h, unnest(range(0, (n + 999) // 1000)) as k from b)),
     {p}w as (select doc_id, off + i as s, md5(substr(part, 2 * i + 1, {2 * n})) as m
           from (select doc_id, off, part, unnest(range(0, least(1000, length(part) // 2 - {n - 1}))) as i from {p}c where length(part) >= {2 * n})),
     {p}r as (select doc_id, s from {p}w join (select m from {p}w group by m having count(*) > 1) using (m)),
     {p}f as (select doc_id, s, case when s - lag(s) over (partition by doc_id order by s) <= {n} then 0 else 1 end as fresh from {p}r),
     {p}g as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as run from {p}f),
     {p}sp as (select doc_id, min(s) as a, max(s) + {n} as e from {p}g group by doc_id, run)"""


ORACLE_SQL["op3_repeat_removal"] = f"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
     {_sql_runs(400, "x")}, {_sql_runs(PASSAGE, "y")},
     pc as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as p from xsp),
     k as (select doc_id, sum(e - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(h), 2 * max(e) + 1) as left_hex
           from pc join b using (doc_id) group by doc_id),
     q as (select doc_id, sum(e - a) as n_passage from ysp group by doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(left_hex, h))) as kept_sha256, cast(coalesce(n_passage, 0) as bigint) as n_passage
from b left join k using (doc_id) left join q using (doc_id)
"""


@query
def op4_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sketch.sketch_and_edit(table(spark, sf_dir, "documents"))
    own, edited, after = (sketch.fingerprint(F.col(c), F.col(f"{c}_least")) for c in ("sketch", "edited_sketch", "next_sketch"))
    done = done.withColumns({"own": own, "edit": edited, "after": after})
    return done.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(F.col("own")).alias("fingerprint"),
        sketch.as_text(F.col("edit")).alias("edited_fingerprint"),
        sketch.likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        sketch.likeness(F.col("own"), F.col("after")).alias("near_next"),
        sketch.containment(F.col("own"), F.col("edit")).alias("kept_in_edited"),
        sketch.containment(F.col("own"), F.col("after")).alias("kept_in_next"),
    )


@query
def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 byte by byte over a table that its polynomial gives
ORACLE_SQL["op5_byte_shards"] = r"""
with tab as (select list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as tab),
     b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
     l as (select doc_id, length(h) // 2 + 1 as size, list_transform(regexp_extract_all(h, '..'), lambda x: cast('0x' || x as bigint)) as bytes from b),
     s as (select doc_id, cast(size as bigint) as size,
                  xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as text_crc32 from l, tab),
     o as (select *, coalesce(sum(size) over (order by doc_id nulls first, text_crc32, size rows between unbounded preceding and 1 preceding), 0) as ahead,
                  row_number() over (order by doc_id nulls first, text_crc32, size) as no, sum(size) over () as whole from s),
     d as (select *, cast(least(7, floor((cast(ahead as double) * 2 + size) * 8 / (cast(whole as double) * 2))) as int) as shard from o)
select doc_id, size, cast(text_crc32 as bigint) as text_crc32, 'bytes' as law, shard, cast(no - min(no) over (partition by shard) as bigint) as slot, cast(null as int) as grown_shard from d
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("item_ids").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_positions").cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


ORACLE_SQL["op6_decontamination"] = r"""
with iw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
     win as (select item_id, array_to_string(w[i:i + least(len(w), 8) - 1], ' ') as g, least(len(w), 8) as n
             from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) as i from iw where len(w) > 0)),
     dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     dg as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
            from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from dw, (select distinct n from win) where len(w) >= n)),
     hit as (select doc_id, i, n, item_id from dg join win using (g, n)),
     pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hit) group by doc_id),
     it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
            from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from dw left join pos using (doc_id) left join it using (doc_id)
"""


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL["op7_near_duplicates"] = r"""
with recursive w as (
       select doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^ 	-
]+'), lambda x: x <> '') as w from documents),
     s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
           from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from w where len(w) > 0)),
     n as (select doc_id, count(*) as n from s group by doc_id),
     e as (select a.doc_id as u, b.doc_id as v from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id
           join n y on y.doc_id = b.doc_id group by a.doc_id, b.doc_id, x.n, y.n
           having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
     r as (select doc_id as u, doc_id as v from w union select r.u, e.v from r join e on r.v = e.u),
     c as (select u, min(v) as component_id from r group by u)
select doc_id, coalesce(n.n, 0) as n_shingles, component_id, doc_id = component_id as kept
from w left join n using (doc_id) join c on c.u = w.doc_id
"""


@query
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_main_text(pages, html_extract.fit_weights(pages))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


ORACLE_SQL["op9_line_dedup"] = r"""
with l as (select doc_id, pos, line, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') as k
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
     lk as (select doc_id, pos, line, translate(k, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from l),
     f as (select k, min(doc_id) as first_doc from lk where length(k) >= 10 group by k)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (doc_id > first_doc) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (first_doc is null or doc_id = first_doc), '')) as kept_sha256
from lk left join f using (k) group by doc_id
"""


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
