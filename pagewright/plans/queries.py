"""The registered queries of the engine's own operators, each with the SQL that gives the same rows.

The tables hold no product pages, so the domain's columns are derived from them by expressions valid in both engines."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as t
from pagewright.operators import breaks, diff, gate, match, products, refine, render, whole
from pagewright.plans import convert
from pagewright.plans.tables import CAPTION, MEASURES, NAME, OPTION, TYPED, spread, table
from pagewright.plans import drawings
from pagewright.slicer import slicing
from pagewright.sources import html as html_source
from pagewright.sources import xlsx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = breaks.previous(events, ["user_id"], ["ts", "event_id"], "ts", "last", bucket=F.date_trunc("day", "ts"))
    return found.withColumn("gap", F.timestamp_diff("SECOND", "last", "ts")).drop("last")


_GAPS = """g AS (SELECT user_id, event_id, ts, CAST(floor(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6) AS BIGINT) AS gap FROM events),
d AS (SELECT user_id, gap AS lo, lead(gap) OVER (PARTITION BY user_id ORDER BY gap) AS hi FROM (SELECT DISTINCT user_id, gap FROM g WHERE gap IS NOT NULL)),
b AS (SELECT user_id, lo, (hi + 2) / (lo + 2) AS ratio, row_number() OVER (PARTITION BY user_id ORDER BY (hi + 2) / (lo + 2) DESC, lo) AS k FROM d WHERE hi IS NOT NULL),
u AS (SELECT user_id, CASE WHEN ratio >= 2 THEN lo END AS threshold, coalesce(ratio, 1) AS ratio FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (user_id))"""


@query(f"""WITH {_GAPS} SELECT user_id, threshold, round(ratio, 6) AS ratio, 1 + count(*) FILTER (WHERE gap > threshold) AS n_groups
FROM g JOIN u USING (user_id) GROUP BY user_id, threshold, ratio""")
def natural_break_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _event_gaps(spark, sf_dir)
    found = breaks.natural_breaks(gaps, ["user_id"], bucket=breaks.span_of(F.col("gap")))
    counted = gaps.select("user_id", "gap").join(found, "user_id", "left").groupBy("user_id", "threshold", F.coalesce("ratio", F.lit(1.0)).alias("ratio"))
    return counted.agg((F.lit(1) + F.count_if(F.col("gap") > F.col("threshold"))).alias("n_groups")).withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {_GAPS} SELECT user_id, event_id, sum(CASE WHEN gap > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS group_no FROM g JOIN u USING (user_id)""")
def break_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = breaks.group_by_breaks(_event_gaps(spark, sf_dir), ["user_id"], ["ts", "event_id"], bucket=F.date_trunc("day", "ts"), gap_bucket=breaks.span_of(F.col("gap")))
    return grouped.select("user_id", "event_id", "group_no")


@query("""SELECT user_id, event_type, min(event_id) AS "start", max(event_id) AS "end" FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
GROUP BY user_id, event_type, k""")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return breaks.value_runs(events, ["user_id"], ["event_id"], "event_type", "event_id", bucket=breaks.span_of(F.col("event_id")))


@query("""SELECT conv_id, turn, coalesce(turn < first, true) AS is_ad FROM conversations LEFT JOIN (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id)""")
def leading_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return products.leading_ads(pieces, "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "is_ad")


@query("""SELECT l_orderkey, l_returnflag, first_pos, n_units, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_pos, l_returnflag) - 1 AS group_no
FROM (SELECT l_orderkey, l_returnflag, min(l_partkey * 8 + l_linenumber) AS first_pos, count(*) AS n_units FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)""")
def option_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("tag"))
    found = products.option_groups(units, "l_orderkey", "pos", "tag")
    w = Window.partitionBy("l_orderkey").orderBy("first_pos", "tag")
    return found.select("l_orderkey", F.col("tag").alias("l_returnflag"), "first_pos", "n_units", (F.row_number().over(w) - 1).alias("group_no"))


def _options(columns: str = "p_name, p_type") -> str:
    return f"array({columns.split(', ')[0]}, concat(p_brand, ' ', p_type), concat({columns.split(', ')[0]}, '(', p_type, ')'))"


@query("""WITH o AS (SELECT p_partkey, lower(replace(tag, ' ', '')) AS k, [p_name, p_brand || ' ' || p_type, p_name || '(' || p_type || ')'] AS opts FROM (
  SELECT *, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN upper(p_name) ELSE split_part(p_name, ' ', 1) END AS tag FROM part)),
m AS (SELECT p_partkey, list_filter(opts, lambda x: lower(replace(x, ' ', '')) = k) AS eq,
  list_filter(opts, lambda x: starts_with(lower(replace(x, ' ', '')), k) OR starts_with(k, lower(replace(x, ' ', '')))) AS near FROM o)
SELECT p_partkey, CASE WHEN len(eq) > 0 THEN eq[-1] WHEN len(near) = 1 THEN near[1] ELSE '' END AS matched FROM m""")
def tag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    tag = F.expr("case when p_size % 3 = 0 then p_brand when p_size % 3 = 1 then upper(p_name) else split_part(p_name, ' ', 1) end")
    return part.select("p_partkey", match.match_tag(tag, F.expr(_options())).alias("matched"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN '' ELSE p_brand END AS option_tag, CASE WHEN p_size % 3 = 1 THEN caption ELSE substr(caption, strpos(caption, '] ') + 2) END AS caption
FROM (SELECT *, {CAPTION} AS caption FROM part)""")
def apply_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("caption", F.expr(CAPTION))
    options = F.expr("case when p_size % 3 = 0 then cast(null as array<string>) when p_size % 3 = 1 then cast(array() as array<string>) else array(p_brand, 'other') end")
    return part.select("p_partkey", match.tag_unit(F.col("caption"), options).alias("u")).select("p_partkey", "u.*")


@query("""SELECT c_custkey, list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda o: NOT list_contains(coalesce(have, []), o))::VARCHAR AS orphans
FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) AS have FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def orphan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("have"))
    options = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
    found = table(spark, sf_dir, "customer").select("c_custkey").join(have, "c_custkey", "left")
    lone = match.orphan_options(options, F.coalesce("have", F.expr("cast(array() as array<string>)")))
    return found.select("c_custkey", F.concat(F.lit("["), F.array_join(lone, ", "), F.lit("]")).alias("orphans"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '2' WHEN p_size % 3 = 0 THEN 'A-' || p_size ELSE '1' END AS number
FROM part""")
def option_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.expr("case when p_size % 3 = 2 then p_type when p_size % 3 = 0 then p_brand else 'unknown' end")
    return table(spark, sf_dir, "part").select("p_partkey", match.option_number(tag, F.expr("array(p_brand, p_type)"), F.expr("array(concat('A-', cast(p_size as string)), '')"), F.lit(0)).alias("number"))


_URLS = "case when page_id % 5 = 0 then concat(url, '/banana_img/conf/a.jpg') when page_id % 5 = 1 then concat(url, '/files/goodsm/b.JPEG') when page_id % 5 = 2 then concat(url, '/c.jpgx.jpg') when page_id % 5 = 3 then '/d/e.png' else url end"


@query(f"""WITH p AS (SELECT page_id, {_URLS} AS src FROM pages), a AS (SELECT page_id, CASE WHEN regexp_matches(src, '^https?://') THEN src ELSE 'https://shop.example/' || ltrim(src, '/') END AS url FROM p),
q AS (SELECT *, lower(regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', '')) AS path FROM a)
SELECT page_id, url, regexp_matches(path, '\\.(jpe?g|png|gif)[^/]*\\.(jpe?g|png|gif)$') OR NOT regexp_matches(path, '\\.(jpe?g|png|gif|webp)$') AS broken,
CASE WHEN contains(lower(url), 'banana_img/conf/') OR contains(lower(url), 'banana_img/k/') OR contains(lower(url), '/conf/img/') THEN 'drop'
 WHEN contains(lower(url), 'banana_img/product_image/') OR contains(lower(url), 'files/goodsm/') THEN 'keep' ELSE 'unknown' END AS kind FROM q""")
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", t.url_absolute(F.expr(_URLS), "https://shop.example/").alias("url"))
    return pages.select("page_id", "url", t.url_broken(F.col("url")).alias("broken"), t.url_class(F.col("url")).alias("kind"))


@query("""SELECT p_partkey, 'type' AS name, CASE WHEN p_size % 5 = 0 THEN p_name || '|' || p_type || '|' || p_brand || '|' || p_brand || '(XL)' ELSE p_name || '|' || p_type || '|' || p_brand END AS found, CASE WHEN p_size % 5 = 0 THEN '1|2|03|' ELSE '1|2|03' END AS numbers
FROM part WHERE p_size % 5 <> 0 UNION ALL
SELECT p_partkey, 'type', p_name || ' (EGG-0' || p_size || ')|' || p_type || ' - OH-3650/4570099420325|' || p_brand || '|' || p_brand || '(XL)', '1|2|03|' FROM part WHERE p_size % 5 = 0""")
def option_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "part").select("p_partkey", t.parse_option(F.expr(OPTION)).alias("o"))
    return parsed.select("p_partkey", "o.name", F.array_join("o.values", "|").alias("found"), F.array_join("o.numbers", "|").alias("numbers"))


@query(f"""SELECT p_partkey, p_brand AS tag, substr(c, strpos(c, '] ') + 2) AS rest, substr(c, 1, strpos(c, '. It') - 1) AS head, substr(c, strpos(c, '. It') + 2) AS body FROM (SELECT *, {CAPTION} AS c FROM part)""")
def split_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(CAPTION).alias("c"))
    return part.select("p_partkey", t.split_tag(F.col("c")).alias("a"), t.split_head(F.col("c")).alias("b")).select("p_partkey", "a.*", "b.*")


@query("""SELECT p_partkey, p_type || ',' || p_brand AS tags, p_name AS name, CASE WHEN p_size % 3 = 0 THEN '(' || upper(p_name) || ' X)' ELSE '' END AS alt FROM part""")
def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", t.split_name(F.expr(NAME)).alias("n"))
    return part.select("p_partkey", F.array_join("n.tags", ",").alias("tags"), F.col("n.name").alias("name"), F.col("n.alt").alias("alt"))


_BODY = "regexp_replace(text, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')"


@query(rf"""WITH s AS (SELECT doc_id, {_BODY} AS x FROM documents)
SELECT doc_id, CASE WHEN hit THEN trim(regexp_extract(x, p, 1)) ELSE x END AS first, CASE WHEN hit THEN trim(regexp_extract(x, p, 2)) ELSE '' END AS rest
FROM (SELECT *, '(?s)^(.{{6,90}}?[.。])\s+(.+)$' AS p, regexp_matches(x, '(?s)^(.{{6,90}}?[.。])\s+(.+)$') AS hit FROM s)""")
def split_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.split_lead(F.col("text")).alias("l")).select("doc_id", "l.*")


@query(r"""SELECT doc_id, replace(regexp_replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\*\*(.+?)\*\*', '<b class="em">\1</b>', 'g'), chr(10), '<br>') AS html FROM documents""")
def emphasized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.emphasize(F.col("text")).alias("html"))


@query("""SELECT p_partkey, '무게=' || p_size * 3 || 'g 길이=' || p_size || '.5cm 길이=' || p_size || '~' || p_size + 2 || 'mm 수량=9개' AS specs FROM part""")
def typed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", t.typed_specs(F.expr(TYPED)).alias("s"))
    return found.select("p_partkey", F.array_join(F.transform("s", lambda s: F.concat(s["k"], F.lit("="), s["v"], s["u"])), " ").alias("specs"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '옵션=3종' ELSE '무게=' || p_size * 3 || 'g 크기=' || p_size || ' × 18 x 20mm 길이=' || p_size || 'mm' END AS specs FROM part""")
def guessed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select("p_partkey", t.guess_specs(F.array(F.expr(MEASURES)), F.expr("case when p_size % 4 = 0 then 3 else 0 end")).alias("s"))
    return found.select("p_partkey", F.array_join(F.transform("s", lambda s: F.concat(s["k"], F.lit("="), s["v"], s["u"])), " ").alias("specs"))


def _orders_as_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as products: lines are pictures, returned ones have captions, the priority's digit counts the options."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n_images"), F.count_if(F.col("l_returnflag") == "R").cast("int").alias("n_captions"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("n_options"), (F.col("o_totalprice") / 500000).alias("ink"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return orders.join(lines, "l_orderkey", "left").select(F.col("l_orderkey").alias("code"), zero("n_images"), zero("n_captions"), "n_options", "ink")


_PRODUCTS = """o AS (SELECT o_orderkey AS code, coalesce(n_images, 0) AS n_images, coalesce(n_captions, 0) AS n_captions, CAST(left(o_orderpriority, 1) AS INT) AS n_options, o_totalprice / 500000 AS ink
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_images, count(*) FILTER (WHERE l_returnflag = 'R') AS n_captions FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
_PRE = "CASE WHEN n_images = 0 THEN 'NO_BODY_IMAGE' WHEN n_options > n_images AND n_images > 1 THEN 'OPTION_UNMAPPABLE' ELSE '' END"


@query(f"""WITH {_PRODUCTS} SELECT code, n_images, n_captions, n_options, CASE WHEN n_images >= 2 THEN 'pieces' WHEN n_images = 1 THEN 'whole' ELSE 'none' END AS adapter, {_PRE} = '' AS ok, {_PRE} AS reasons,
CASE WHEN n_images >= 6 AND n_captions = 0 THEN 'NO_CAPTION_MULTI_IMG: ' || n_images || ' pictures, no caption' ELSE '' END AS silent FROM o""")
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_as_products(spark, sf_dir).withColumn("pre", gate.pre_gate(F.col("n_images"), F.col("n_captions"), F.col("n_options")))
    silent = F.coalesce(F.get(F.filter("pre.notes", lambda n: n.startswith("NO_CAPTION")), F.lit(0)), F.lit(""))
    return rows.select("code", "n_images", "n_captions", "n_options", gate.adapter(F.col("n_images")).alias("adapter"), (F.size("pre.reasons") == 0).alias("ok"), F.array_join("pre.reasons", ",").alias("reasons"), silent.alias("silent"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders_as_products(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem")
    unit = F.struct(F.concat(F.lit("a caption that goes on "), F.col("l_linenumber").cast("string"), F.when(F.col("l_returnflag") == "A", "").otherwise(".")).alias("caption"), F.when(F.col("l_returnflag") == "R", "R").otherwise("").alias("option_tag"), (F.col("l_quantity") * 2).cast("int").alias("width"), F.lit(100).alias("height"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("pos"))
    units = line.groupBy(F.col("l_orderkey").alias("code")).agg(F.array_sort(F.collect_list(unit), lambda a, b: (a["pos"] - b["pos"]).cast("int")).alias("units"))
    none = F.expr("cast(array() as array<struct<caption:string,option_tag:string,width:int,height:int,pos:bigint>>)")
    rows = rows.join(units, "code", "left").withColumn("units", F.coalesce("units", none))
    missed = F.transform(F.filter("units", lambda u: u["width"] > 98), lambda u: F.concat(F.lit("p"), u["pos"].cast("string")))
    pre = gate.pre_gate(F.col("n_images"), F.col("n_captions"), F.col("n_options"))
    post = gate.post_check(F.col("units"), F.lit(0), F.col("ink"), F.col("n_options"))
    return rows.withColumn("v", gate.verdict(pre, post, missed)).withColumn("missed", missed)


_VERDICTS = f"""{_PRODUCTS},
u AS (SELECT l_orderkey AS code, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS tagged, count(*) FILTER (WHERE l_quantity * 2 < 24) AS small, count(*) FILTER (WHERE CAST(l_quantity * 2 AS INT) > 98) AS missed FROM lineitem GROUP BY 1),
v AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(tagged, 0) AS tagged, list_distinct(list_filter([CASE WHEN n IS NULL THEN 'NO_BODY_IMAGE' END, CASE WHEN n IS NOT NULL AND ink < 0.97 THEN 'AREA_LOSS' END,
  CASE WHEN small > 0 THEN 'PANEL_GEOMETRY' END, CASE WHEN missed > 0 THEN 'IMAGE_MISSING' END, nullif({_PRE}, '')], lambda r: r IS NOT NULL)) AS reasons FROM o LEFT JOIN u USING (code))"""


@query(f"""WITH {_VERDICTS} SELECT code, len(reasons) = 0 AS ok, array_to_string(list_sort(reasons), ',') AS reasons FROM v""")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("code", "v.ok", F.array_join(F.array_sort("v.reasons"), ",").alias("reasons"))


@query(f"""WITH {_VERDICTS} SELECT reason, count(*) AS n_products FROM (SELECT unnest(reasons) AS reason FROM v) GROUP BY 1""")
def hold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.hold_histogram(_verdicts(spark, sf_dir).select("v.reasons"))


@query(f"""WITH {_VERDICTS} SELECT code, CASE WHEN len(reasons) > 0 THEN 'bad' WHEN n_captions > 2 OR (n <= 1 AND n_captions > 0) OR ink < 0.9 THEN 'no' ELSE 'ok' END AS light FROM v""")
def risk_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = F.greatest(F.col("n_captions") - 2, F.lit(0))
    return _verdicts(spark, sf_dir).select("code", gate.risk(F.col("v.ok"), unread, F.lit(0), F.col("n_options"), F.size("units"), F.col("n_captions"), F.col("ink")).alias("light"))


@query("""SELECT l_orderkey, count(*) AS n_units, count(*) FILTER (WHERE l_returnflag = 'R') AS n_captioned, 2 * count(*) FILTER (WHERE l_returnflag = 'R') >= count(*) AS split FROM lineitem GROUP BY 1""")
def pair_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.pair_vote(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", F.col("l_returnflag") == "R")


@query("""SELECT l_orderkey AS code, count(*) AS n_units, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS n_captioned, count(*) FILTER (WHERE l_returnflag = 'R') AS n_tagged,
count(*) FILTER (WHERE l_returnflag <> 'R') AS n_body, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linenumber % 2 = 0) AS n_features FROM lineitem GROUP BY 1""")
def unit_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("code"), F.when(F.col("l_linenumber") % 2 == 0, "said").otherwise(" \t").alias("caption"), F.when(F.col("l_returnflag") == "R", "R").otherwise("").alias("option_tag"))
    return products.views(units)


@query("""SELECT p_partkey, p_brand, p_size, CASE WHEN p_size > 0 AND p_size < m THEN CAST(round_even(p_size * (800 / m), 0) AS BIGINT) END AS style_width FROM part JOIN (SELECT p_brand, max(p_size) AS m FROM part GROUP BY 1) USING (p_brand)""")
def page_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products.page_scale(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN upper(p_name) ELSE p_name END AS p_name, p_type FROM part""")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    typed = part.where("p_size % 4 < 2").select("p_partkey", F.expr("case when p_size % 4 = 0 then '' else upper(p_name) end").alias("p_name"), F.lit(None).cast("string").alias("p_type"))
    return products.merge_overrides(part.select("p_partkey", "p_name", "p_type"), typed, ["p_partkey"], ["p_name", "p_type"])


_BOX = "l_orderkey AS code, l_partkey * 8 + l_linenumber AS pos, CAST(l_quantity AS INT) * 10 AS y0, CAST(l_quantity AS INT) * 10 + 40 AS y1, CAST(l_discount * 1000 AS INT) AS x0, CAST(l_discount * 1000 AS INT) + 30 AS x1"


@query(f"""WITH b AS (SELECT {_BOX}, l_returnflag FROM lineitem), s AS (SELECT * FROM b WHERE l_returnflag = 'R'), p AS (SELECT * FROM b WHERE l_returnflag <> 'R'),
j AS (SELECT s.code, s.pos AS scrap_pos, p.pos AS picture_pos, greatest(0, p.x0 - s.x1, s.x0 - p.x1) + greatest(0, p.y0 - s.y1, s.y0 - p.y1) AS d FROM s JOIN p ON s.code = p.code AND s.y0 <= p.y1 AND p.y0 <= s.y1)
SELECT code, scrap_pos, picture_pos FROM (SELECT *, row_number() OVER (PARTITION BY code, scrap_pos ORDER BY d, picture_pos) AS k FROM j) WHERE k = 1""")
def nearest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "lineitem").selectExpr(*[x for x in _BOX.split(", ")], "l_returnflag")
    return products.attach_scraps(boxes.where("l_returnflag = 'R'"), boxes.where("l_returnflag <> 'R'"), "code")


@query("""SELECT l_orderkey, min(CAST(l_quantity AS INT)) AS x0, min(l_linenumber) AS y0, max(CAST(l_quantity AS INT) + 5) AS x1, max(l_linenumber + 2) AS y1 FROM lineitem GROUP BY 1""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "cast(l_quantity as int) as x0", "l_linenumber as y0", "cast(l_quantity as int) + 5 as x1", "l_linenumber + 2 as y1")
    return products.bounding_box(parts, ["l_orderkey"])


@query("""WITH typed AS (SELECT DISTINCT o_custkey, unnest(list_distinct(regexp_extract_all(o_orderkey || ', ' || o_custkey || '/' || o_orderkey + 7, '\\d{4,}'))) AS code FROM orders)
SELECT o_custkey, code, EXISTS (SELECT 1 FROM part WHERE p_partkey = CAST(code AS BIGINT)) AS found FROM typed""")
def batch_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.concat_ws(", ", F.col("o_orderkey").cast("string"), F.concat(F.col("o_custkey").cast("string"), F.lit("/"), (F.col("o_orderkey") + 7).cast("string")))
    picked = table(spark, sf_dir, "orders").select("o_custkey", F.explode(products.pick_codes(typed)).alias("code")).distinct()
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), F.lit(True).alias("there"))
    return picked.join(known, "code", "left").select("o_custkey", "code", F.coalesce("there", F.lit(False)).alias("found"))


_RUN = "CASE WHEN doc_id % 5 = 1 THEN text || ' changed' WHEN doc_id % 5 = 2 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END"
_MOVED = "CASE WHEN doc_id % 7 = 3 THEN -1 - doc_id ELSE doc_id END"


@query(f"""WITH old AS (SELECT doc_id AS code, md5(replace(text, chr(13), '')) AS shape FROM documents), new AS (SELECT {_MOVED} AS code, md5(replace({_RUN}, chr(13), '')) AS shape FROM documents)
SELECT code, CASE WHEN n.code IS NULL THEN 'only_old' WHEN o.code IS NULL THEN 'only_new' WHEN o.shape IS NOT DISTINCT FROM n.shape THEN 'same' ELSE 'changed' END AS state FROM old o FULL JOIN new n USING (code)""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all documents; a seventh of them has another code in the new run, so it stands on one side of each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("code"), "text")
    shape = lambda c: F.struct(F.md5(F.replace(c, F.lit("\r"), F.lit(""))).alias("text")).alias("shape")
    changed = F.when(F.col("code") % 5 == 1, F.concat("text", F.lit(" changed"))).when(F.col("code") % 5 == 2, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    moved = F.when(F.col("code") % 7 == 3, -1 - F.col("code")).otherwise(F.col("code")).alias("code")
    return diff.compare(docs.select("code", shape(F.col("text"))), docs.select(moved, shape(changed))).select("code", "state")


_SAVED = (
    "concat('<style>x</style><main><section data-part=\"choices\"><div data-role=\"choice\"><img src=\"a.png\" alt=\"\"><h2>', p_name, '</h2><p>&amp; co</p></div>', case when p_size % 2 = 0 then concat('<div data-role=\"bare_choice\"><h2>', p_brand, '</h2></div>') else '' end, "
    "'</section>', case when p_size % 3 = 0 then concat('<section data-part=\"scenes\"><div data-role=\"scene_left\"><img src=\"data:image/png;base64,AA\" alt=\"\"><h2>Head ', cast(p_size as varchar(10)), '</h2><p><b class=\"em\">x</b></p></div></section>') else '' end, '</main>')"
)


@query("""SELECT CASE WHEN k = 1 THEN 'choice' ELSE 'scene_left' END AS role, count(*) AS n FROM part, (SELECT unnest([1, 2]) AS k) WHERE k = 1 OR p_size % 3 = 0 GROUP BY 1""")
def picture_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.picture_histogram(table(spark, sf_dir, "part").select(F.expr(_SAVED).alias("html")))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'choices scenes' ELSE 'choices' END AS parts, p_name || '& co' || CASE WHEN p_size % 2 = 0 THEN '|' || p_brand ELSE '' END AS choices,
CASE WHEN p_size % 3 = 0 THEN 'Head ' || p_size ELSE '' END AS heads, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS n_marks, 1 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS n_roles,
p_name || '& co' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'Head ' || p_size || 'x' ELSE '' END AS text FROM part""")
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = table(spark, sf_dir, "part").select("p_partkey", diff.outline(F.expr(_SAVED)).alias("o"))
    return shaped.select("p_partkey", F.array_join("o.parts", " ").alias("parts"), F.array_join("o.choices", "|").alias("choices"), F.array_join("o.heads", "|").alias("heads"), "o.n_marks", F.size("o.roles").alias("n_roles"), "o.text")


@query("""SELECT p_partkey, list_filter(['a. Copy of ' || p_name, 'b ' || p_brand, 'c. ' || p_type], lambda x: length(x) > 4)::VARCHAR AS captions FROM part""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = "concat('[\"a. Copy of ', p_name, '\", \"b ', p_brand, '\", \"c. ', p_type, '\"]')"
    answer = F.expr(f"case p_size % 4 when 0 then concat('Here:', chr(10), '```json', chr(10), {quoted}, chr(10), '```') when 1 then concat('Sure ', {quoted}, ' done') when 2 then concat('{{\"captions\": ', {quoted}, '}}') else concat('1. a. Copy of ', p_name, chr(10), '- b ', p_brand, chr(10), '#3) c. ', p_type) end")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(t.parse_answer(answer), ", "), F.lit("]")).alias("captions"))


@query()
def guarded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next turn of a conversation taken as an answer for the turn before, and a near copy of each turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    joined = turns.join(after, ["conv_id", "turn"], "left")
    return joined.select("conv_id", "turn", refine.guard(F.col("text"), F.col("answer")).alias("next_taken"), refine.guard(F.col("text"), F.concat(F.lit("**"), F.col("text"), F.lit("** again"))).alias("copy_taken"))


@query()
def lead_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_source.bodies(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", F.size("pieces").alias("n_pieces"), F.size("lead_blocks").alias("n_blocks"), F.array_join(F.transform("lead_blocks", lambda b: b["text"]), "\n").alias("lead"))


_PIECES = "concat('<div>', p_brand, ' intro<br>for ', p_name, '</div><p>배송 notice</p><ul><li><img src=\"/files/goodsm/', cast(p_partkey as string), '.jpg\"><span>', p_type, ' one</span></li><li><img src=\"//h.example/x.jpgx.jpg\"></li><li><img src=\"banana_img/conf/b.png\"></li><li><img data-src=\"\\\\n\\\\c.png\">', p_name, '  two</li></ul>')"


@query("""SELECT p_partkey, 'https://shop.example/files/goodsm/' || p_partkey || '.jpg|https://shop.example/n/c.png' AS urls, p_type || ' one|' || p_name || ' two' AS captions, 1 AS n_dropped, 1 AS n_broken, p_brand || ' intro' || chr(10) || 'for ' || p_name AS lead FROM part""")
def product_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.expr(_PIECES).alias("html"))
    found = html_source.bodies(pages, base="https://shop.example/")
    join = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return found.select("p_partkey", join("pieces", "url").alias("urls"), join("pieces", "caption").alias("captions"), F.size("dropped").alias("n_dropped"), F.size("broken").alias("n_broken"), join("lead_blocks", "text").alias("lead"))


def _workbook(rows: list[tuple]) -> bytes:
    """A workbook with a title row above the header, and product rows (fixture)."""
    cell = lambda c, r, v: f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    grid = [("report",), ("상품 번호", "상품명", "브랜드", "옵션1", "상세설명"), *rows]
    data = "".join(f'<row r="{i}">{"".join(cell(j, i, v) for j, v in enumerate(r))}</row>' for i, r in enumerate(grid, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>')
    return out.getvalue()


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_brand AS brand, 'size=' || p_type || '|XL' AS options, 'about ' || p_name AS body FROM part""")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part written into workbooks (of at most 500 rows each) and read back through the workbook source."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = [(r["p_partkey"], r["p_name"], r["p_brand"], f"size=1. {r['p_type']},2) XL", f"about {r['p_name']}") for r in batch.slice(start, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([f"book-{rows[0][0]}"]), pa.array([_workbook(rows)], pa.binary())], names=["path", "content"])

    books = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_name", "p_brand", "p_type").mapInArrow(write, "path string, content binary")
    axis = F.get("options", F.lit(0))
    found = xlsx.products(xlsx.cells(books))
    return found.select("code", "name", "brand", F.concat(axis["name"], F.lit("="), F.array_join(axis["values"], "|")).alias("options"), "body")


def _parts_as_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = lambda i, cap, tag: f"named_struct('url', concat('u{i}-', cast(p_partkey as string), '.png'), 'caption', {cap}, 'caption_crop', '', 'option_tag', {tag}, 'width', p_size * {i})"
    return spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr(
        "cast(p_partkey as string) as code", f"{NAME} as name", "p_brand as brand", "p_type as category", f"concat(p_name, '. ', {CAPTION}) as lead",
        "array(named_struct('k', '무게', 'v', cast(p_size as string), 'u', 'g')) as specs", "array(named_struct('text', p_name, 'strong', true), named_struct('text', concat('Made by ', p_brand, ' & co'), 'strong', false)) as intro",
        "array(named_struct('url', 'ad1.png', 'width', p_size * 9), named_struct('url', 'ad2.png', 'width', p_size)) as ads",
        f"array({unit(1, 'p_type', 'p_brand')}, {unit(2, CAPTION, chr(39) * 2)}, {unit(3, chr(39) * 2, chr(39) * 2)}) as units", "array(p_brand, 'other') as options", "array('7', '') as option_numbers")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, unnest([0, 1, 3, 4, 5, 6, 8, 9]) AS place, unnest(['opening', 'typed', 'measures', 'story', 'choices', 'more_posters', 'scenes', 'closing']) AS part,
unnest(['maker tag tag title' || CASE WHEN p_size % 3 = 0 THEN ' also' ELSE '' END || ' code lead poster', 'tagline', 'measure', 'text', 'choice bare_choice', 'poster', 'scene_left picture', 'note']) AS roles FROM part""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.parts(_parts_as_products(spark, sf_dir)).select("code", "place", "part", F.array_join(F.transform("entries", lambda e: e["role"]), " ").alias("roles"))


@query()
def rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.pages(_parts_as_products(spark, sf_dir))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS n_ads, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 2 END AS n_units, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS tags,
CASE WHEN p_size % 4 = 0 THEN 'NO_BODY_IMAGE' WHEN p_size % 4 = 1 THEN 'PANEL_GEOMETRY,IMAGE_MISSING' ELSE 'PANEL_GEOMETRY' END AS reasons, '옵션=2종' AS specs, p_name || ' is typed here' AS lead FROM part""")
def converted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch over every part: adverts before the first caption, units with tags, and the gate's reasons."""
    body = "case when p_size % 4 = 0 then concat('<p>', p_name, ' is typed here</p>') else concat('<p>', p_name, ' is typed here</p><div><img src=\"/ad.png\"></div><ul><li><img src=\"/u1.png\">[1. ', p_brand, '] a caption.</li><li><img src=\"/u2.png\">more text.</li>', case when p_size % 4 = 1 then '<li><img src=\"/lost.png\"></li>' else '' end, '</ul>') end"
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").selectExpr("cast(p_partkey as string) as code", "p_name as name", "p_brand as brand", "p_type as category", f"{body} as body", "array(named_struct('name', 'kind', 'values', array(p_brand, 'other'), 'numbers', array('7', ''))) as options")
    sizes = spark.createDataFrame([(f"https://shop.example/{n}.png", 300, h) for n, h in (("ad", 100), ("u1", 200), ("u2", 10))], "url string, width int, height int")
    made = convert.convert(rows, sizes, "https://shop.example/")
    return made.select("code", F.size("ads").alias("n_ads"), F.size("units").alias("n_units"), F.array_join(F.filter(F.transform("units", lambda u: u["option_tag"]), lambda x: x != ""), ",").alias("tags"), F.array_join("verdict.reasons", ",").alias("reasons"), F.array_join(F.transform("specs", lambda s: F.concat(s["k"], F.lit("="), s["v"], s["u"])), " ").alias("specs"), "lead")


# a drawn picture: a wide picture over rows of two pictures of 40 rows, each with a caption of 10 rows; some pages have a
# second wide picture and two more rows, some have rules (their pictures are a column narrower)
_DRAWN = """p AS (SELECT s_suppkey AS image_id, s_nationkey % 2 = 0 AS below, 2 + s_nationkey % 3 AS n, CASE WHEN s_nationkey % 4 > 1 THEN 1 ELSE 0 END AS two, CASE WHEN s_nationkey % 5 = 0 THEN 1 ELSE 0 END AS ruled FROM supplier),
u AS (SELECT *, unnest(range(0, 1 + 2 * n + 5 * two)) AS unit FROM p),
k AS (SELECT *, unit = 0 OR unit = 1 + 2 * n AS wide, CASE WHEN unit <= 2 * n THEN unit - 1 ELSE unit - 2 END AS i FROM u),
b AS (SELECT *, CASE WHEN wide THEN 8 WHEN i % 2 = 0 THEN 6 ELSE 68 + ruled END AS x0, CASE WHEN wide THEN 111 WHEN i % 2 = 0 THEN 51 - ruled ELSE 113 END AS x1,
  CASE WHEN unit = 0 THEN 6 WHEN wide THEN 80 + 74 * n WHEN unit <= 2 * n THEN 70 + 74 * (i // 2) ELSE 144 + 74 * (i // 2) END AS y0 FROM k)"""


def _drawn(spark: SparkSession, sf_dir: str) -> slicing.Pictures:
    return drawings.drawn(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS code, 1 AS n_ads, CAST(4 + 2 * (s_nationkey % 3) + CASE WHEN s_nationkey % 4 > 1 THEN 5 ELSE 0 END AS INTEGER) AS n_units,
CAST(4 + 2 * (s_nationkey % 3) + CASE WHEN s_nationkey % 4 > 1 THEN 4 ELSE 0 END AS INTEGER) AS n_crops,
'https://shop.example/' || s_suppkey || '.png#xywh=' || CASE WHEN s_nationkey % 2 = 0 THEN '6,70,' ELSE '6,84,' END || CASE WHEN s_nationkey % 5 = 0 THEN '45,40' ELSE '46,40' END AS first_unit,
'https://shop.example/' || s_suppkey || '.png#xywh=' || CASE WHEN s_nationkey % 2 = 0 THEN '6,114,' ELSE '6,70,' END || CASE WHEN s_nationkey % 5 = 0 THEN '45,10' ELSE '46,10' END AS first_crop FROM supplier""")
def converted_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch over products whose page is one drawn picture: adverts, units and captions taken out of its pixels."""
    suppliers = table(spark, sf_dir, "supplier")
    body = "concat('<p>', s_name, '</p><img src=\"/', s_suppkey, '.png\">')"
    rows = suppliers.selectExpr("cast(s_suppkey as string) as code", "s_name as name", "'' as brand", "'' as category", f"{body} as body", "cast(array() as array<struct<name:string,values:array<string>,numbers:array<string>>>) as options")
    images = _drawn(spark, sf_dir)
    images = slicing.Pictures(images.rows.withColumn("url", F.concat(F.lit("https://shop.example/"), "image_id", F.lit(".png"))), images.read)
    made = convert.convert(rows, images.rows.select("url", "width", "height"), "https://shop.example/", images, least_ad=20)
    crops = F.filter(F.transform("units", lambda u: u["caption_crop"]), lambda u: u != "")
    return made.select("code", F.size("ads").alias("n_ads"), F.size("units").alias("n_units"), F.size(crops).alias("n_crops"), F.get("units", F.lit(0))["url"].alias("first_unit"), F.get(crops, F.lit(0)).alias("first_crop"))


@query(f"""WITH {_DRAWN} SELECT CAST(image_id AS BIGINT) AS image_id, CASE WHEN unit = 0 THEN 'ad' ELSE 'unit' END AS role, CAST(CASE WHEN unit = 0 THEN 0 ELSE unit - 1 END AS INTEGER) AS pos, CAST(x0 AS INTEGER) AS x0, CAST(x1 AS INTEGER) AS x1,
CAST(CASE WHEN wide OR below THEN y0 ELSE y0 + 14 END AS INTEGER) AS y0, CAST(CASE WHEN wide THEN y0 + 33 WHEN below THEN y0 + 39 ELSE y0 + 53 END AS INTEGER) AS y1, CAST(CASE WHEN NOT wide THEN x0 END AS INTEGER) AS cx0,
CAST(CASE WHEN NOT wide THEN x1 END AS INTEGER) AS cx1, CAST(CASE WHEN wide THEN NULL WHEN below THEN y0 + 44 ELSE y0 END AS INTEGER) AS cy0, CAST(CASE WHEN wide THEN NULL WHEN below THEN y0 + 53 ELSE y0 + 9 END AS INTEGER) AS cy1 FROM b""")
def whole_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts, units and captions of the pictures drawn for every supplier."""
    # lower blocks than the usual 40 rows count here, as the drawn advert has 34
    images = slicing.by_id(_drawn(spark, sf_dir))
    return whole.adapted(images, slicing.units(images), least_ad=20)


@query(f"""WITH {_DRAWN} SELECT CAST(image_id AS BIGINT) AS image_id, CAST(unit AS INTEGER) AS unit, 0 AS section, CAST(CASE WHEN wide THEN 0 ELSE i % 2 END AS INTEGER) AS col, CAST(x0 AS INTEGER) AS x0, CAST(x1 AS INTEGER) AS x1,
CAST(y0 AS INTEGER) AS y0, CAST(CASE WHEN wide THEN y0 + 33 ELSE y0 + 53 END AS INTEGER) AS y1, CAST(CASE WHEN wide THEN 0 ELSE 1 END AS BIGINT) AS n_captions, below AS captions_below,
round(area / (area + ruled * 71 * (n + 2 * two)), 6) AS ink FROM (
SELECT *, CAST(3536 * (1 + two) + 2 * (n + 2 * two) * (40 * (46 - ruled) + 10 * (38 - ruled)) AS DOUBLE) AS area FROM b)""")
def sliced_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tall picture drawn for every supplier, cut into units of a picture and its caption."""
    return slicing.units(_drawn(spark, sf_dir)).drop("parts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
