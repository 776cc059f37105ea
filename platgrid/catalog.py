"""Queries over the driver's tables, and SQL that gives the same rows.

The tables hold no land descriptions, so texts are built from the keys of `orders` with native expressions; the SQL works
the expected rows out from the same keys and never reads a text."""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import trs as tr
from .operators import parse, tail
from .plans.options import Options
from .plans.storage import shared_dir
from .sources import csvfiles

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = re.sub(r"(?<!['\"\w])desc\b", '"desc"', sql)
        return f

    return add


# Township, range and section of key k; a second pair; sections s .. s + 2 run on.
_KEYS = "k, k % 160 + 1 AS t, k % 90 + 3 AS r, k % 34 + 1 AS s, (k + 7) % 160 + 1 AS t2, (k + 11) % 90 + 3 AS r2, (k + 5) % 36 + 1 AS s2"
_BASE = f"SELECT {_KEYS} FROM (SELECT o_orderkey AS k FROM orders)"
_D = f"WITH d AS ({_BASE})"
_TRS = "CAST(t AS VARCHAR) || 'n' || CAST(r AS VARCHAR) || 'w'"
_TRS2 = "CAST(t2 AS VARCHAR) || 'n' || CAST(r2 AS VARCHAR) || 'w'"
_SEC = "lpad(CAST({0} AS VARCHAR), 2, '0')"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    # only keys move; the texts made of them are worth more cores than a small file gives
    return parse.spread(k).selectExpr(*_KEYS.split(", "))


def texts(spark: SparkSession, sf_dir: str, *patterns: str) -> DataFrame:
    """(k, text): {t}, {r}, {s} and the like in a pattern stand for the numbers of the key; {s+2} for one more than s + 1. Keys take turns with the patterns, in one pass."""

    def text(pattern: str):
        parts = [x for x in re.split(r"(\{[^}]*\})", pattern) if x]
        return F.concat(*[F.expr(f"cast({x[1:-1]} as string)") if x[0] == "{" else F.lit(x) for x in parts])

    out = text(patterns[-1])
    for i in range(len(patterns) - 2, -1, -1):
        out = F.when(F.col("k") % len(patterns) == i, text(patterns[i])).otherwise(out)
    return keys(spark, sf_dir).select("*", out.alias("text"))


def _tracts(spark, sf_dir, pattern, config="", extra=()):
    d = texts(spark, sf_dir, pattern).select("k", "text")
    return parse.tracts(d, Options.parse(config)).select("k", "orig_index", "trs", "desc", *extra)


# Flagship.


@query(
    "township_quarters",
    f"""{_D}, q(x) AS (VALUES ('NENE'), ('NWNE'), ('SENE'), ('SWNE'))
SELECT {_TRS} AS twprge, count(*) // 4 AS tracts, string_agg(DISTINCT x, ',' ORDER BY x) AS qqs FROM d, q GROUP BY 1""",
)
def township_quarters(spark, sf_dir):
    """Text to tracts to quarter-quarters to one row for each township."""
    d = texts(spark, sf_dir, "T{t}N-R{r}W Sec {s}: NE/4").select("k", "text")
    rows = parse.tracts(d, Options(parse_qq=True)).select("twprge", "qqs")
    # the quarters of a township are few: they are made distinct before they meet
    g = rows.groupBy("twprge", "qqs").agg(F.count("*").alias("n")).groupBy("twprge")
    return g.agg(F.sum("n").alias("tracts"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("qqs")))), ",").alias("qqs"))


# The four layouts of one set of land.

_LAYOUT_SQL = f"""{_D} SELECT k, i AS orig_index,
  CASE WHEN i = 0 THEN {_TRS} || {_SEC.format("s2")} ELSE {_TRS2} || {_SEC.format("s + i - 1")} END AS trs,
  CASE WHEN i = 0 THEN 'SW/4' ELSE 'S/2' END AS desc
FROM d, (SELECT unnest(range(4))::INTEGER AS i)"""
for _name, _pattern in {
    "trs_desc": "T{t}N-R{r}W Sec {s2}: SW/4, T{t2}N-R{r2}W Sec {s} - {s+2}: S/2",
    "s_desc_tr": "Sec {s2}: SW/4 of T{t}N-R{r}W, Sec {s} - {s+2}: S/2 of T{t2}N-R{r2}W",
    "desc_str": "SW/4 of Sec {s2}, T{t}N-R{r}W, S/2 of Sec {s} - {s+2}, T{t2}N-R{r2}W",
    "tr_desc_s": "T{t}N-R{r}W SW/4 of Sec {s2}, T{t2}N-R{r2}W S/2 of Sec {s} - {s+2}",
}.items():
    query(f"plss_tracts_{_name}", _LAYOUT_SQL)(partial(_tracts, pattern=_pattern))
query("plss_tracts_segment", _LAYOUT_SQL)(partial(_tracts, pattern="T{t}N-R{r}W Sec {s2}: SW/4, T{t2}N-R{r2}W Sec {s} - {s+2}: S/2", config="segment"))


@query("plss_tracts_copy_all", f"{_D} SELECT k, 0 AS orig_index, {_TRS} || 'XX' AS trs, 'T' || t || 'N-R' || r || 'W all of the bank' AS desc FROM d")
def copy_all(spark, sf_dir):
    return _tracts(spark, sf_dir, "T{t}N-R{r}W, all of the bank")


@query("multisec_expand", f"{_D} SELECT k, {_SEC.format('s')} || ',' || {_SEC.format('s + 1')} || ',' || {_SEC.format('s + 2')} || ',' || {_SEC.format('s2')} AS secs FROM d")
def multisec_expand(spark, sf_dir):
    return texts(spark, sf_dir, "Sections {s} thru {s+2} and Sec. {s2}").select("k", F.array_join(tx.find_sec("text"), ",").alias("secs"))


@query("find_twprge", f"{_D} SELECT k, 'T' || t || 'N-R' || r || 'W,T' || t2 || 'S-R' || r2 || 'E' AS found FROM d")
def find_twprge(spark, sf_dir):
    return texts(spark, sf_dir, "Township {t} North, Range {r} West and T {t2} S, R {r2} E").select("k", F.array_join(tx.find_twprge("text"), ",").alias("found"))


_SPELLINGS = ["Township {t} North, Range {r} West Sec {s}: NE/4", "T{t}N-R{r}W Sec {s}: NE/4", "{t}N-{r}W Sec {s}: NE/4", "T{t}-R{r} Sec {s}: NE/4", "{t}N-R{r}, Sec {s}: NE/4", "T{t}N-R{r}W, 5th P.M., Sec {s}: NE/4"]


@query("plss_preprocess", f"{_D} SELECT k, 'T' || t || 'N-R' || r || 'W Sec ' || s || ': NE/4' AS pp FROM d")
def plss_preprocess(spark, sf_dir):
    """Six spellings, by key, become one."""
    return texts(spark, sf_dir, *_SPELLINGS).select("k", tx.preprocess("text").alias("pp"))


@query("plss_layout", f"{_D} SELECT k, ['TRS_desc', 'S_desc_TR', 'desc_STR', 'TR_desc_S', 'copy_all'][k % 5 + 1] AS layout FROM d")
def plss_layout(spark, sf_dir):
    forms = ["T{t}N-R{r}W Sec {s}: NE/4", "Sec {s}: NE/4 of T{t}N-R{r}W", "NE/4 of Sec {s}, T{t}N-R{r}W", "T{t}N-R{r}W NE/4 of Sec {s}", "T{t}N-R{r}W"]
    return texts(spark, sf_dir, *forms).select("k", tx.deduce_layout("text").alias("layout"))


@query("default_nsew", f"{_D} SELECT k, 0 AS orig_index, CAST(t AS VARCHAR) || 's' || CAST(r AS VARCHAR) || 'e' || {_SEC.format('s')} AS trs, 'NE/4' AS desc FROM d")
def default_nsew(spark, sf_dir):
    return _tracts(spark, sf_dir, "Township {t}, Range {r} Section {s}: NE/4", "s,e")


@query("ocr_scrub", f"{_D} SELECT k, 0 AS orig_index, '15' || CAST(k % 10 AS VARCHAR) || 'n97w' || {_SEC.format('s')} AS trs, 'NE/4' AS desc FROM d")
def ocr_scrub(spark, sf_dir):
    return _tracts(spark, sf_dir, "Township lS{k % 10} North, Range 97 West Section {s}: NE/4", "ocr_scrub")


@query("sec_within", f"{_D} SELECT k, i AS orig_index, {_TRS} || {_SEC.format('s + i')} AS trs, 'That part of the NE/4 lying within RoW' AS desc FROM d, (SELECT unnest(range(3))::INTEGER AS i)")
def sec_within(spark, sf_dir):
    return _tracts(spark, sf_dir, "T{t}N-R{r}W: That part of the NE/4 of Sec {s} - {s+2} lying within RoW", "sec_within")


@query("no_pm", f"{_D} SELECT k, 0 AS orig_index, {_TRS} || {_SEC.format('s')} AS trs, '5th PM' AS desc FROM d")
def no_pm(spark, sf_dir):
    return _tracts(spark, sf_dir, "T{t}N-R{r}W, 5th PM, Sec {s}: NE/4", "no_pm")


@query("sec_colon_required", f"{_D} SELECT k, 0 AS orig_index, {_TRS} || {_SEC.format('s')} AS trs, 'NE/4, and Sec ' || s2 || ' road' AS desc FROM d")
def sec_colon_required(spark, sf_dir):
    return _tracts(spark, sf_dir, "T{t}N-R{r}W Sec {s}: NE/4, and Sec {s2} road", "sec_colon_required")


@query("flags_by_kind", f"{_D} SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN k % 2 = 0 THEN ['multisec_found', 'less_except'] ELSE ['fixed_twprge', 'including'] END) AS kind FROM d) GROUP BY kind")
def flags_by_kind(spark, sf_dir):
    d = texts(spark, sf_dir, "T{t}N-R{r}W Sec {s} - {s+2}: NE/4 less and except the road", "T{t}-R{r} Sec {s}: NE/4 including the road")
    p = d.select(tx.parse_description("text").alias("p"))
    return p.select(F.explode("p.w_flag_lines.flag").alias("f")).groupBy(F.regexp_extract("f", "^[a-z_]+", 0).alias("kind")).agg(F.count("*").alias("n"))


@query("error_desc_rate", f"{_D} SELECT count(*) AS descriptions, count(*) FILTER (WHERE k % 3 = 0) AS flawed FROM d")
def error_desc_rate(spark, sf_dir):
    good = "T{t}N-R{r}W Sec {s}: NE/4"
    d = texts(spark, sf_dir, "Sec {s}: W/2, T{t}N-R{r}W Sec {s2}: NE/4, Sec {s}: S/2", good, good)
    p = d.select((F.size(tx.parse_description("text")["e_flag_lines"]) > 0).cast("bigint").alias("f"))
    return p.agg(F.count("*").alias("descriptions"), F.sum("f").alias("flawed"))


# Tract texts.


def _parts(spark, sf_dir, pattern, config=""):
    return parse.tract_parts(texts(spark, sf_dir, pattern).select("k", F.col("text").alias("desc")), Options.parse(config))


@query("tract_lots", f"{_D} SELECT k, 'L' || s || ',L' || (s + 1) || ',L' || (s + 2) || ',L40' AS lots, 'SENE,SWNE' AS qqs FROM d")
def tract_lots(spark, sf_dir):
    return _parts(spark, sf_dir, "Lots {s} - {s+2}, S/2NE/4, Lot 40").select("k", F.array_join("lots", ",").alias("lots"), F.array_join("qqs", ",").alias("qqs"))


@query("lot_acres", f"{_D} SELECT k, 'L' || s || ':' || (k % 50) || '.25' AS acres FROM d")
def lot_acres(spark, sf_dir):
    return _parts(spark, sf_dir, "Lot {s}({k % 50}.25), NE/4").select("k", csvfiles.stringify(_parts(spark, sf_dir, "x"), "lot_acres").alias("acres"))


@query("lot_divisions", f"{_D} SELECT k, 'N2 of L' || s || ',N2 of L' || (s + 1) || ',L' || s2 AS lots FROM d")
def lot_divisions(spark, sf_dir):
    return _parts(spark, sf_dir, "N/2 of Lots {s} - {s+1}, Lot {s2}").select("k", F.array_join("lots", ",").alias("lots"))


@query("lot_divisions_off", f"{_D} SELECT k, 'L' || s || ',L' || (s + 1) || ',L' || s2 AS lots FROM d")
def lot_divisions_off(spark, sf_dir):
    return _parts(spark, sf_dir, "N/2 of Lots {s} - {s+1}, Lot {s2}", "suppress_lot_divs").select("k", F.array_join("lots", ",").alias("lots"))


_QUARTERS = "['NE', 'NW', 'SE', 'SW'][k % 4 + 1]"
_ALIQUOT = "{element_at(array('NE', 'NW', 'SE', 'SW'), cast(k % 4 + 1 as int))}"


def _qqs(spark, sf_dir, pattern, config):
    return _parts(spark, sf_dir, pattern, config).select("k", F.array_join("qqs", ",").alias("qqs"))


def _pieces(sub: list[str]) -> str:
    return " || ',' || ".join(f"'{x}' || {_QUARTERS}" for x in sub)


for _name, _pattern, _config, _sub in (
    ("tract_qqs_depth1", f"N/2{_ALIQUOT}/4", "qq_depth.1", [""]),
    ("tract_qqs_depth2", f"N/2{_ALIQUOT}/4", "qq_depth.2", ["NE", "NW"]),
    ("tract_qqs_depth3", f"N/2{_ALIQUOT}/4", "qq_depth_min.3", [a + b for b in ("NE", "NW") for a in ("NE", "NW", "SE", "SW")]),
    ("qq_depth_max", f"N/2SW/4{_ALIQUOT}/4", "qq_depth_max.2", ["SW"]),
    ("qq_half_kept", f"N/2SW/4{_ALIQUOT}/4", "", ["N2SW"]),
    ("break_halves", f"N/2SW/4{_ALIQUOT}/4", "break_halves", ["NESW", "NWSW"]),
    ("clean_qq", f"N2 of {_ALIQUOT}", "clean_qq", ["NE", "NW"]),
    ("crossed_halves", f"W/2N/2{_ALIQUOT}/4", "", ["NW"]),
):
    query(_name, f"{_D} SELECT k, {_pieces(_sub)} AS qqs FROM d")(partial(_qqs, pattern=_pattern, config=_config))


@query("aliquot_scrub", f"{_D} SELECT k, 'Lot ' || s || ', N½' || {_QUARTERS} || '¼' AS pp FROM d")
def aliquot_scrub(spark, sf_dir):
    return texts(spark, sf_dir, "Lot {s}, North Half of the " + _ALIQUOT + "/4").select("k", tx.scrub_aliquots("text").alias("pp"))


@query("aliquot_simplify", f"{_D} SELECT k, CASE k % 3 WHEN 0 THEN 'N2,S2' WHEN 1 THEN 'N2,SE' ELSE 'N2NE,SW' END AS a FROM d")
def aliquot_simplify(spark, sf_dir):
    case = "{case k % 3 when 0 then 'E/2, W/2' when 1 then 'SE/4, NW/4, NE/4' else 'NE/4NE/4, SW/4, NW/4NE/4' end}"
    return _parts(spark, sf_dir, case).select("k", F.array_join(tx.simplify_aliquots("qqs"), ",").alias("a"))


@query("aliquot_simplify_standard", f"{_D} SELECT k, CASE k % 2 WHEN 0 THEN 'ALL' ELSE 'N2' END AS a FROM d")
def aliquot_simplify_standard(spark, sf_dir):
    return _parts(spark, sf_dir, "{case k % 2 when 0 then 'E/2, W/2' else 'NW/4, NE/4' end}").select("k", F.array_join(tx.simplify_aliquots("qqs", True), ",").alias("a"))


@query("aliquot_subtract", f"{_D} SELECT k, CASE k % 2 WHEN 0 THEN 'S2' ELSE 'NW,S2' END AS a FROM d")
def aliquot_subtract(spark, sf_dir):
    p = _parts(spark, sf_dir, "ALL").withColumn("gone", F.when(F.col("k") % 2 == 0, F.array(F.lit("N2"))).otherwise(F.array(F.lit("NE"))))
    return p.select("k", F.array_join(tx.subtract_aliquots("qqs", "gone"), ",").alias("a"))


# The TRS scalar. Every 11th is erroneous, every 13th undefined.

_RAW = f"CASE WHEN k % 11 = 0 THEN 'no such place' WHEN k % 13 = 0 THEN '' ELSE {_TRS} || {_SEC.format('s')} END"


def _raw(spark, sf_dir) -> DataFrame:
    return keys(spark, sf_dir).withColumn("raw", F.expr(_RAW.replace("VARCHAR", "STRING")))


@query(
    "trs_decompose",
    f"""{_D} SELECT k, CASE WHEN k % 11 = 0 THEN 'XXXzXXXzXX' WHEN k % 13 = 0 THEN '___z___z__' ELSE {_RAW} END AS trs,
  CASE WHEN k % 11 = 0 THEN 'XXXz' WHEN k % 13 = 0 THEN '___z' ELSE t || 'n' END AS twp, CASE WHEN k % 11 > 0 AND k % 13 > 0 THEN t END AS twp_num,
  CASE WHEN k % 11 > 0 AND k % 13 > 0 THEN 'n' END AS twp_ns, CASE WHEN k % 11 > 0 AND k % 13 > 0 THEN r END AS rge_num, CASE WHEN k % 11 > 0 AND k % 13 > 0 THEN 'w' END AS rge_ew,
  CASE WHEN k % 11 > 0 AND k % 13 > 0 THEN s END AS sec_num, k % 11 > 0 AND k % 13 = 0 AS twp_undef FROM d""",
)
def trs_decompose(spark, sf_dir):
    f = tr.trs_fields("raw")
    return _raw(spark, sf_dir).select("k", *[(f[n].cast("bigint") if n.endswith("num") else f[n]).alias(n) for n in ("trs", "twp", "twp_num", "twp_ns", "rge_num", "rge_ew", "sec_num", "twp_undef")])


@query("construct_trs", f"{_D} SELECT k, CASE WHEN k % 7 = 0 THEN 'XXXz' ELSE t || 'n' END || r || 'e' || {_SEC.format('s')} AS trs FROM d")
def construct_trs(spark, sf_dir):
    d = keys(spark, sf_dir).withColumn("twp", F.expr("case when k % 7 = 0 then 'bad' else concat(t, 'N') end"))
    return d.select("k", tr.construct_trs("twp", "r", "s", "n", "e").alias("trs"))


@query("pretty_twprge", f"{_D} SELECT k, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'T---X-R---X' ELSE 'T' || t || 'N-R' || r || 'W' END AS heading FROM d")
def pretty_twprge(spark, sf_dir):
    return _raw(spark, sf_dir).select("k", tr.pretty_twprge("raw").alias("heading"))


# The relational tail, on a list of tracts with few enough places for duplicates.

_ROW = f"""SELECT k AS pos, k // 4 AS desc_no, CASE WHEN k % 11 = 0 THEN 'XXXzXXXzXX' WHEN k % 13 = 0 THEN '___z___z__'
  ELSE (k % 5 + 150) || CASE WHEN k % 2 = 0 THEN 'n' ELSE 's' END || (k % 3 + 90) || CASE WHEN k % 7 = 0 THEN 'e' ELSE 'w' END || lpad(CAST(k % 36 + 1 AS VARCHAR), 2, '0') END AS trs,
  CASE k % 3 WHEN 0 THEN 'N/2' WHEN 1 THEN 'S/2' ELSE 'Lot 1' END AS desc,
  CASE k % 3 WHEN 0 THEN 'NENE,NWNE,SENE,SWNE,NENW,NWNW,SENW,SWNW' WHEN 1 THEN 'NESE,NWSE,SESE,SWSE,NESW,NWSW,SESW,SWSW' ELSE '' END AS qq,
  CASE WHEN k % 3 = 2 THEN 'L1' ELSE '' END AS lot FROM (SELECT o_orderkey AS k FROM orders)"""
_L = f"WITH l AS ({_ROW})"
_NUM = "try_cast(regexp_extract(trs, '^([0-9]+)[ns]', 1) AS INTEGER) AS tn, substr(regexp_extract(trs, '^[0-9]+[ns]'), -1) AS ns, try_cast(regexp_extract(trs, '[ns]([0-9]+)[ew]', 1) AS INTEGER) AS rn, regexp_extract(trs, '[ns][0-9]+([ew])', 1) AS ew, try_cast(regexp_extract(trs, '[ew]([0-9]+)$', 1) AS INTEGER) AS sn"


def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as k")
    f = F.expr
    trs = f(
        """case when k % 11 = 0 then 'XXXzXXXzXX' when k % 13 = 0 then '___z___z__'
        else concat(k % 5 + 150, if(k % 2 = 0, 'n', 's'), k % 3 + 90, if(k % 7 = 0, 'e', 'w'), lpad(cast(k % 36 + 1 as string), 2, '0')) end"""
    )
    north, south = "array('NENE','NWNE','SENE','SWNE','NENW','NWNW','SENW','SWNW')", "array('NESE','NWSE','SESE','SWSE','NESW','NWSW','SESW','SWSW')"
    d = o.select(F.col("k").alias("pos"), f("k div 4").alias("desc_no"), trs.alias("trs"), f("case k % 3 when 0 then 'N/2' when 1 then 'S/2' else 'Lot 1' end").alias("desc"), f(f"case k % 3 when 0 then {north} when 1 then {south} else cast(array() as array<string>) end").alias("qqs"), f("if(k % 3 = 2, array('L1'), cast(array() as array<string>))").alias("lots"))
    return d.withColumn("lots_qqs", F.concat("lots", "qqs")).withColumn("twprge", F.regexp_replace("trs", "..$", ""))


@query("filter_errors", f"{_L} SELECT pos, trs FROM l WHERE trs LIKE 'XXX%'")
def filter_errors(spark, sf_dir):
    return tail.filter_errors(_list(spark, sf_dir))[0].select("pos", "trs")


@query("filter_errors_rest", f"{_L} SELECT pos, trs FROM l WHERE trs NOT LIKE 'XXX%' AND trs NOT LIKE '\\_%' ESCAPE '\\'")
def filter_errors_rest(spark, sf_dir):
    return tail.filter_errors(_list(spark, sf_dir), undef=True)[1].select("pos", "trs")


@query("filter_undef", f"{_L} SELECT pos, trs FROM l WHERE trs LIKE '\\_%' ESCAPE '\\'")
def filter_undef(spark, sf_dir):
    return tail.filter_rows(_list(spark, sf_dir), tr.is_undef("trs"))[0].select("pos", "trs")


for _method, _keys in {"trs": "trs", "desc": "trs, desc", "lots_qqs": "trs, lot, qq"}.items():
    query(f"dedup_{_method}", f"{_L} SELECT pos, trs FROM (SELECT *, row_number() OVER (PARTITION BY {_keys} ORDER BY pos) AS n FROM l) WHERE n > 1")(
        lambda spark, sf_dir, m=_method: tail.filter_duplicates(_list(spark, sf_dir), m)[0].select("pos", "trs")
    )

for _name, _key, _rev, _order in (
    ("sort_default", "i,s,r,t", False, "tn ASC NULLS LAST, rn ASC NULLS LAST, sn ASC NULLS LAST, pos"),
    ("sort_directional", "s.rev,r.ew,t.ns", False, "CASE WHEN ns = 'n' THEN -tn ELSE tn END ASC NULLS LAST, CASE WHEN ew = 'w' THEN rn ELSE -rn END ASC NULLS LAST, sn DESC NULLS FIRST, pos"),
    ("sort_reverse", "r.rev,t", True, "tn DESC NULLS FIRST, rn ASC NULLS LAST, pos DESC"),
):
    # the rank in each desc_no's list, and in the whole list by way of a sorted write
    query(_name, f"{_L} SELECT pos, trs, row_number() OVER (ORDER BY {_order}) AS rank FROM (SELECT *, {_NUM} FROM l)")(
        lambda spark, sf_dir, key=_key, rev=_rev: tail.with_rank(_list(spark, sf_dir), key, rev).select("pos", "trs", "rank")
    )


@query("sort_within_description", f"{_L} SELECT pos, trs, row_number() OVER (PARTITION BY desc_no ORDER BY tn ASC NULLS LAST, rn ASC NULLS LAST, sn ASC NULLS LAST, pos) AS rank FROM (SELECT *, {_NUM} FROM l)")
def sort_within_description(spark, sf_dir):
    return tail.with_rank(_list(spark, sf_dir), by=["desc_no"]).select("pos", "trs", "rank")


@query("group_twprge", f"{_L} SELECT substr(trs, 1, length(trs) - 2) AS twprge, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS members, min(pos) AS first_pos FROM l GROUP BY 1")
def group_twprge(spark, sf_dir):
    g = tail.group_by(_list(spark, sf_dir).select("pos", "twprge", "trs"), "twprge")
    return g.select("twprge", F.array_join(F.transform("rows", lambda r: r["pos"].cast("string")), ",").alias("members"), "first_pos")


@query("group_multi", f"{_L} SELECT substr(trs, 1, length(trs) - 2) AS twprge, desc, count(*) AS n, min(pos) AS first_pos FROM l GROUP BY 1, 2")
def group_multi(spark, sf_dir):
    g = tail.group_by(_list(spark, sf_dir).select("pos", "twprge", "desc"), "twprge", "desc")
    return g.select("twprge", "desc", F.size("rows").cast("bigint").alias("n"), "first_pos")


@query("group_missing_attribute", f"{_L} SELECT 'owner: n/a' AS owner, count(*) AS n FROM l")
def group_missing_attribute(spark, sf_dir):
    return tail.group_by(_list(spark, sf_dir).select("pos", "trs"), "owner").select("owner", F.size("rows").cast("bigint").alias("n"))


@query("group_nested", f"{_L}, g AS (SELECT substr(trs, 1, length(trs) - 2) AS twprge, desc, count(*) AS n, min(pos) AS p FROM l GROUP BY 1, 2) SELECT twprge, string_agg(desc || ':' || n, ',' ORDER BY p) AS groups FROM g GROUP BY twprge")
def group_nested(spark, sf_dir):
    g = tail.group_by_nested(_list(spark, sf_dir).select("pos", "twprge", "desc", "trs"), "twprge", "desc")
    return g.select("twprge", F.array_join(F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit(":"), F.size(e["value"]).cast("string"))), ",").alias("groups"))


@query("unpack_group", f"{_L} SELECT pos, trs FROM l")
def unpack_group(spark, sf_dir):
    return tail.unpack_group(tail.group_by(_list(spark, sf_dir).select("pos", "twprge", "trs"), "twprge")).select("pos", "trs")


@query("sort_grouped", f"{_L} SELECT substr(trs, 1, length(trs) - 2) AS twprge, string_agg(pos::VARCHAR, ',' ORDER BY try_cast(regexp_extract(trs, '[ew]([0-9]+)$', 1) AS INTEGER) DESC NULLS FIRST, pos) AS members FROM l GROUP BY 1")
def sort_grouped(spark, sf_dir):
    g = tail.sort_grouped(tail.group_by(_list(spark, sf_dir).select("pos", "twprge", "trs"), "twprge"), "s.rev")
    return g.select("twprge", F.array_join(F.transform("rows", lambda r: r["pos"].cast("string")), ",").alias("members"))


@query(
    "consolidate",
    f"""{_L}, u AS (SELECT trs, desc, lot, qq, min(pos) AS p FROM l GROUP BY ALL)
SELECT trs, string_agg(desc, '; ' ORDER BY p) AS desc, coalesce(string_agg(lot, ',' ORDER BY p) FILTER (WHERE lot <> ''), '') AS lots,
  coalesce(string_agg(qq, ',' ORDER BY p) FILTER (WHERE qq <> ''), '') AS qqs, min(p) AS pos FROM u GROUP BY trs""",
)
def consolidate(spark, sf_dir):
    c = tail.consolidate(_list(spark, sf_dir))
    return c.select("trs", "desc", F.array_join("lots", ",").alias("lots"), F.array_join("qqs", ",").alias("qqs"), "pos")


@query(
    "consolidate_simplified",
    f"""{_L}, u AS (SELECT trs, max(lot) AS lot, bool_or(desc = 'N/2') AS n, bool_or(desc = 'S/2') AS s FROM l GROUP BY trs)
SELECT trs, array_to_string(list_filter([lot, CASE WHEN n AND s THEN 'ALL' WHEN n THEN 'N2' WHEN s THEN 'S2' ELSE '' END], lambda x: x <> ''), ', ') AS desc FROM u""",
)
def consolidate_simplified(spark, sf_dir):
    return tail.simplified_desc(_list(spark, sf_dir), standard=True).select("trs", "desc")


@query("contains_any", f"{_L} SELECT bool_or(trs IN ('150n90w01', '152n92w15')) AS found FROM l")
def contains_any(spark, sf_dir):
    wanted = spark.createDataFrame([("150n90w01",), ("152n92w15",)], "trs string")
    return spark.createDataFrame([(tail.contains(_list(spark, sf_dir), wanted),)], "found boolean")


@query("contains_all", f"{_L} SELECT count(DISTINCT trs) FILTER (WHERE trs IN ('XXXzXXXzXX', 'nowhere')) = 2 AS found FROM l")
def contains_all(spark, sf_dir):
    wanted = spark.createDataFrame([("XXXzXXXzXX",), ("nowhere",)], "trs string")
    return spark.createDataFrame([(tail.contains(_list(spark, sf_dir), wanted, True),)], "found boolean")


@query("union_concat", f"{_L} SELECT pos, trs FROM l UNION ALL SELECT pos + (SELECT max(pos) + 1 FROM l), trs FROM l WHERE trs LIKE 'XXX%'")
def union_concat(spark, sf_dir):
    d = _list(spark, sf_dir).select("pos", "trs")
    return tail.concat(d, tail.filter_errors(d)[0])


@query("union_repeat", f"{_L} SELECT pos + i * 100000000 AS pos, trs FROM l, (SELECT unnest(range(3)) AS i)")
def union_repeat(spark, sf_dir):
    return tail.repeat(_list(spark, sf_dir).select("pos", "trs"), 3, 100000000)


@query("list_trs_distinct", f"{_L} SELECT trs, min(pos) AS pos FROM l GROUP BY trs")
def list_trs_distinct(spark, sf_dir):
    return tail.list_trs(_list(spark, sf_dir), True)


@query("slice_rows", f"{_L} SELECT pos, trs FROM l WHERE pos BETWEEN 10 AND 29")
def slice_rows(spark, sf_dir):
    return tail.slice_rows(_list(spark, sf_dir), 10, 30).select("pos", "trs")


@query("project_attributes", f"{_L} SELECT trs, 'owner: n/a' AS owner FROM l")
def project_attributes(spark, sf_dir):
    return tail.project(_list(spark, sf_dir), "trs", "owner")


@query("quick_desc", f"{_L} SELECT pos, CASE WHEN length(trs || ': ' || desc) > 15 THEN left(trs || ': ' || desc, 12) || '...' ELSE trs || ': ' || desc END AS quick_desc FROM l")
def quick_desc(spark, sf_dir):
    return tail.quick_desc(_list(spark, sf_dir), max_len=15).select("pos", "quick_desc")


@query(
    "pretty_desc",
    f"""{_L}, a AS (SELECT *, substr(trs, 1, length(trs) - 2) AS tr, {_NUM} FROM l),
b AS (SELECT *, (lag(tr) OVER (PARTITION BY desc_no ORDER BY pos) IS DISTINCT FROM tr)::INTEGER AS new FROM a),
c AS (SELECT *, sum(new) OVER (PARTITION BY desc_no ORDER BY pos)::BIGINT AS run FROM b)
SELECT desc_no, run, CASE WHEN any_value(tn) IS NULL THEN 'T---X-R---X' ELSE 'T' || any_value(tn) || upper(any_value(ns)) || '-R' || any_value(rn) || upper(any_value(ew)) END AS heading,
  string_agg('Sec ' || right(trs, 2) || ': ' || desc, chr(10) ORDER BY pos) AS body FROM c GROUP BY desc_no, run""",
)
def pretty_desc(spark, sf_dir):
    return tail.pretty_desc(_list(spark, sf_dir), by="desc_no")


@query(
    "csv_rows_uid",
    f"""{_L}, n AS (SELECT *, row_number() OVER (PARTITION BY desc_no ORDER BY pos) AS i, count(*) OVER (PARTITION BY desc_no) AS c FROM l)
SELECT lpad(desc_no::VARCHAR, 4, '0') || '.' || chr(96 + i::INTEGER) || '-' || chr(96 + c::INTEGER) AS "UID", trs AS "Twp/Rge/Sec", desc AS "Description",
  replace(qq, ',', ', ') AS "QQs" FROM n""",
)
def csv_rows_uid(spark, sf_dir):
    return csvfiles.csv_rows(_list(spark, sf_dir), ["trs", "desc", "qqs"], nice=True, uid=("desc_no", "pos"))


@query("report", f"{_L} SELECT pos, 'trs  : ' || trs || chr(10) || 'desc : ' || desc AS report FROM l")
def report(spark, sf_dir):
    return tail.report(_list(spark, sf_dir), "trs", "desc")


@query("list_insert_remove", f"{_L} SELECT CASE WHEN pos >= 5 THEN pos + 1 ELSE pos END AS pos, trs FROM l WHERE pos <> 9 UNION ALL SELECT 5, trs FROM l WHERE pos = 9")
def list_insert_remove(spark, sf_dir):
    """The tenth row moves to the sixth place; behind it places close up and open again."""
    d = _list(spark, sf_dir).select("pos", "trs")
    gone, rest = tail.remove(d, 9)
    moved = tail.insert(rest, gone.withColumn("pos", F.lit(0).cast("bigint")), 5, 1)
    # the SQL leaves the gap of the row that moved
    return moved.withColumn("pos", F.when(F.col("pos") > 9, F.col("pos") + 1).otherwise(F.col("pos")))


@query("json_rows", f"""{_L} SELECT '{{"trs":"' || trs || '","desc":"' || "desc" || '"}}' AS json FROM l""")
def json_rows(spark, sf_dir):
    return tail.to_json_rows(_list(spark, sf_dir), "trs", "desc")


@query("sorted_lots", f"{_D} SELECT k, 'L' || s || ',L' || (s + 1) || ',L' || (s + 40) AS lots, s || ',' || (s + 1) || ',' || (s + 40) AS numbers FROM d")
def sorted_lots(spark, sf_dir):
    p = _parts(spark, sf_dir, "Lot {s+40}, Lots {s} and {s+1}").withColumn("lots", tx.sorted_lots("lots"))
    return p.select("k", F.array_join("lots", ",").alias("lots"), F.array_join(F.transform(tx.lot_numbers("lots"), lambda x: x.cast("string")), ",").alias("numbers"))


@query("lots_aliquots", f"{_D} SELECT k, 'L' || s || ', N2, SE' AS parts FROM d")
def lots_aliquots(spark, sf_dir):
    p = parse.with_aliquots(_parts(spark, sf_dir, "SE/4, Lot {s}, NE/4, NW/4"))
    return p.select("k", F.array_join("lots_aliquots", ", ").alias("parts"))


@query("duplicate_flags", f"{_D} SELECT k, 'dup_lot<L' || s || '>,dup_qq<NENE>' AS flags FROM d")
def duplicate_flags(spark, sf_dir):
    return _parts(spark, sf_dir, "Lots {s} - {s+1}, Lot {s}, NE/4NE/4, NE/4NE/4").select("k", F.array_join("w_flags", ",").alias("flags"))


@query("nonsequential_lots", f"{_D} SELECT k, 'L' || (s + 2) || ',L' || (s + 1) || ',L' || s AS lots, 'nonsequential_lots' AS flags FROM d")
def nonsequential_lots(spark, sf_dir):
    return _parts(spark, sf_dir, "Lots {s+2} - {s}").select("k", F.array_join("lots", ",").alias("lots"), F.array_join("w_flags", ",").alias("flags"))


@query("sql_table_functions", f"{_D} SELECT k, i AS orig_index, {_TRS} AS twprge, {_SEC.format('s + i')} AS sec FROM d, (SELECT unnest(range(3))::INTEGER AS i)")
def sql_table_functions(spark, sf_dir):
    parse.register(spark)
    texts(spark, sf_dir, "T{t}N-R{r}W Sec {s} - {s+2}: NE/4").createOrReplaceTempView("platgrid_texts")
    return spark.sql("SELECT k, orig_index, twprge, sec FROM platgrid_texts, LATERAL plss_tracts(text, CAST(NULL AS STRING))")


@query("dedup_instance", f"{_L} SELECT pos + (SELECT max(pos) + 1 FROM l) AS pos, trs FROM l WHERE trs LIKE 'XXX%'")
def dedup_instance(spark, sf_dir):
    d = _list(spark, sf_dir).withColumn("uid", F.col("pos").cast("string"))
    return tail.filter_duplicates(tail.concat(d, tail.filter_errors(d)[0]))[0].select("pos", "trs")


@query("group_sorted", f"{_L} SELECT substr(trs, 1, length(trs) - 2) AS twprge, string_agg(pos::VARCHAR, ',' ORDER BY try_cast(regexp_extract(trs, '[ew]([0-9]+)$', 1) AS INTEGER) ASC NULLS LAST, pos) AS members FROM l GROUP BY 1")
def group_sorted(spark, sf_dir):
    g = tail.group_by(_list(spark, sf_dir).select("pos", "twprge", "trs"), "twprge", sort_key="s")
    return g.select("twprge", F.array_join(F.transform("rows", lambda r: r["pos"].cast("string")), ",").alias("members"))


@query(
    "group_nested_deep",
    f"""{_L}, g AS (SELECT substr(trs, 1, length(trs) - 2) AS twprge, desc, pos % 2 AS odd, count(*) AS n, min(pos) AS p FROM l GROUP BY 1, 2, 3),
h AS (SELECT twprge, desc, string_agg(odd || '=' || n, ' ' ORDER BY p) AS inner_groups, min(p) AS p FROM g GROUP BY 1, 2)
SELECT twprge, string_agg(desc || ':' || inner_groups, ',' ORDER BY p) AS groups FROM h GROUP BY twprge""",
)
def group_nested_deep(spark, sf_dir):
    g = tail.group_by_nested(_list(spark, sf_dir).select("pos", "twprge", "desc", (F.col("pos") % 2).alias("odd")), "twprge", "desc", "odd")
    inner = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"].cast("string"), F.lit("="), F.size(e["value"]).cast("string"))), " ")
    return g.select("twprge", F.array_join(F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit(":"), inner(e["value"]))), ",").alias("groups"))


@query("tracts_to_str", f"{_L} SELECT pos, 'Tract ' || row_number() OVER (ORDER BY pos) || ' / ' || count(*) OVER () || chr(10) || 'trs : ' || trs || chr(10) || 'qqs : ' || replace(qq, ',', ', ') AS report FROM l")
def tracts_to_str(spark, sf_dir):
    return tail.tracts_to_str(_list(spark, sf_dir).withColumn("qqs", F.col("qqs")).withColumnRenamed("desc", "d"), "trs", "qqs")


@query(
    "pretty_desc_whole",
    f"""{_L}, a AS (SELECT *, substr(trs, 1, length(trs) - 2) AS tr, {_NUM} FROM l),
b AS (SELECT *, (lag(tr) OVER (ORDER BY pos) IS DISTINCT FROM tr)::INTEGER AS new FROM a),
c AS (SELECT *, sum(new) OVER (ORDER BY pos)::BIGINT AS run FROM b)
SELECT run, CASE WHEN any_value(tn) IS NULL THEN 'T---X-R---X' ELSE 'T' || any_value(tn) || upper(any_value(ns)) || '-R' || any_value(rn) || upper(any_value(ew)) END AS heading,
  string_agg('Sec ' || right(trs, 2) || ': ' || desc, chr(10) ORDER BY pos) AS body FROM c GROUP BY run""",
)
def pretty_desc_whole(spark, sf_dir):
    return tail.pretty_desc(_list(spark, sf_dir))


@query("quick_desc_lots_aliquots", f"{_L} SELECT pos, trs || ': ' || CASE desc WHEN 'N/2' THEN 'N2' WHEN 'S/2' THEN 'S2' ELSE 'L1' END AS quick_desc FROM l")
def quick_desc_lots_aliquots(spark, sf_dir):
    return tail.quick_desc_lots_aliquots(_list(spark, sf_dir)).select("pos", "quick_desc")


def _csv_folder(spark, sf_dir, pattern) -> str:
    """Texts by key, as CSV files with the key in front."""
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    texts(spark, sf_dir, pattern).select("k", "text").write.csv(path, header=True)
    return path


@query(
    "csv_parse_rows",
    f"{_D} SELECT CASE WHEN i = 0 THEN k::VARCHAR END AS k, i AS orig_index, {_TRS} || {_SEC.format('s + i')} AS trs, CASE i WHEN 0 THEN '' ELSE 'NE' END AS qqs FROM d, (SELECT unnest(range(2))::INTEGER AS i)",
)
def csv_parse_rows(spark, sf_dir):
    path = _csv_folder(spark, sf_dir, "T{t}N-R{r}W Sec {s}: Lot 1, Sec {s+1}: NE")
    return csvfiles.parse_csv_rows(spark, path, 2, ["trs", "qqs"], "clean_qq,qq_depth.1", header_row=1).select("k", "orig_index", "trs", "qqs")


@query("writer_uid", f"{_L} SELECT lpad((desc_no + 5)::VARCHAR, 7, '0') AS number, count(*) AS n FROM l WHERE pos % 2 = 0 GROUP BY 1 UNION ALL SELECT lpad(((SELECT max(desc_no) FROM l WHERE pos % 2 = 0) + 6)::VARCHAR, 7, '0'), count(*) FROM l WHERE trs LIKE 'XXX%' AND pos < 1000")
def writer_uid(spark, sf_dir):
    """Two tables written one after the other; the identifiers of the second go on where those of the first end."""
    path, d = f"{shared_dir(spark)}/tracts-{uuid.uuid4().hex}", _list(spark, sf_dir)
    with csvfiles.TractWriter(spark, path, ["trs"], uid=5) as w:
        w.write(d.where("pos % 2 = 0"), by="desc_no", order="pos")
        top = w.uid
        w.write(tail.filter_errors(d.where("pos < 1000"))[0], order="pos")
    assert w.uid == top + 1
    back = spark.read.csv(path, header=True, schema="uid string, trs string")
    return back.groupBy(F.lpad(F.substring_index("uid", ".", 1), 7, "0").alias("number")).agg(F.count("*").alias("n"))
