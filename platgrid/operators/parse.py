"""Descriptions to tract rows, and tract rows to lots and quarter-quarters. No shuffle in either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.trs import fields_of
from ..plans.options import Options


#: Rows that a task is given to parse; at 0.5 milliseconds a text it runs for less than a minute.
ROWS_A_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """df in even partitions: ROWS_A_TASK rows each, or as many partitions as the session has cores if that is more.

    To parse texts costs far more than to move them, and the partitions of a file say nothing of its rows. df is counted first; of a Parquet file that reads the footers alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS_A_TASK)))


def tracts(descriptions: DataFrame, options: Options | None = None, text_col: str = "text", config_col: str | None = None, orig_desc: bool = False, outer: bool = False) -> DataFrame:
    """A row for each tract of each description, in order of orig_index; other columns of the description stay, as does a column source.

    Descriptions without a text give no tract; with outer they give one row without orig_index. With parse_qq, the columns of tract_parts are added, with orig_desc the description's text."""
    options = options or Options.default()
    keep = [c for c in descriptions.columns if c != text_col]
    p = (descriptions if outer else descriptions.where(F.col(text_col).isNotNull())).withColumn("_p", text.parse_description(text_col, options, config_col))
    rows = p.select(*keep, *([F.col(text_col).alias("orig_desc")] if orig_desc else []), "_p", (F.posexplode_outer if outer else F.posexplode)("_p.tracts").alias("orig_index", "_t"))
    fields = fields_of(F.col("_t.twp"), F.col("_t.rge"), F.col("_t.sec"))
    flags = lambda name: F.col(f"_p.{name}_flag_lines.flag")
    out = rows.select(
        *keep,
        *(["orig_desc"] if orig_desc else []),
        "orig_index",
        *[c.alias(n) for n, c in fields.items()],
        F.concat("_t.twp", "_t.rge").alias("twprge"),
        F.col("_t.sec_found").alias("sec_found"),
        F.col("_t.desc").alias("desc"),
        F.col("_p.layout").alias("layout"),
        flags("w").alias("w_flags"),
        flags("e").alias("e_flags"),
        F.col("_p.w_flag_lines").alias("w_flag_lines"),
        F.col("_p.e_flag_lines").alias("e_flag_lines"),
        F.concat(flags("e"), flags("w")).alias("flags"),
        F.concat("_p.e_flag_lines", "_p.w_flag_lines").alias("flag_lines"),
        (F.size("_p.e_flag_lines") > 0).alias("desc_is_flawed"),
    )
    return tract_parts(out, options, "desc", config_col) if options.parse_qq else out


def tract_parts(rows: DataFrame, options: Options | None = None, desc_col: str = "desc", config_col: str | None = None) -> DataFrame:
    """rows with pp_desc, lots, qqs, lots_qqs, aliquots_whole, lot_acres; warnings are put behind w_flags, if there."""
    options = options or Options.default()
    p = rows.withColumn("_q", text.parse_tract(desc_col, options, config_col))
    new = {
        "pp_desc": F.col("_q.pp_desc"),
        "lots": F.col("_q.lots"),
        "qqs": F.col("_q.qqs"),
        "lots_qqs": F.concat("_q.lots", "_q.qqs"),
        "aliquots_whole": F.col("_q.aliquots_whole"),
        "lot_acres": F.col("_q.lot_acres"),
    }
    flags = F.transform("_q.w_flag_lines", lambda x: x["flag"])
    new["w_flags"] = F.concat("w_flags", flags) if "w_flags" in rows.columns else flags
    if "flags" in rows.columns:  # errors stand first, so warnings of the tract come last
        new["flags"] = F.concat("flags", flags)
        new["flag_lines"] = F.concat("flag_lines", "_q.w_flag_lines")
    new["w_flag_lines"] = F.concat("w_flag_lines", "_q.w_flag_lines") if "w_flag_lines" in rows.columns else F.col("_q.w_flag_lines")
    return p.withColumns(new).drop("_q")


def with_aliquots(rows: DataFrame, assume_standard: bool = False) -> DataFrame:
    """rows of tract_parts with sorted_lots, aliquots and lots_aliquots; apart, as they cost most."""
    out = rows.withColumn("sorted_lots", text.sorted_lots("lots")).withColumn("aliquots", text.simplify_aliquots("qqs", assume_standard))
    return out.withColumn("lots_aliquots", F.concat("sorted_lots", "aliquots"))


def register(spark: SparkSession, options: Options | None = None) -> None:
    """Makes the SQL table functions plss_tracts(text, config) and tract_parts(text, config).

    They are queries over the Arrow functions, which stay under the names plss_description and plss_tract, so that a lateral join with them works on whole batches. OUTER keeps Spark from inferring a filter that would parse every text once more."""
    options = options or Options.default()
    spark.udf.register("plss_description", text.description_udf(options, lateral=True))
    spark.udf.register("plss_tract", text.tract_udf(options, lateral=True))
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION plss_tracts(description STRING, config STRING)
        RETURNS TABLE (orig_index INT, twprge STRING, sec STRING, desc STRING, layout STRING)
        RETURN SELECT i, t.twp || t.rge, t.sec, t.desc, p.layout FROM (SELECT plss_description(description, config) AS p) LATERAL VIEW OUTER posexplode(p.tracts) x AS i, t WHERE i IS NOT NULL"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION tract_parts(description STRING, config STRING)
        RETURNS TABLE (lots ARRAY<STRING>, qqs ARRAY<STRING>, lot_acres MAP<STRING, STRING>)
        RETURN SELECT p.lots, p.qqs, p.lot_acres FROM (SELECT plss_tract(description, config) AS p)"""
    )
