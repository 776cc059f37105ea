"""The relational tail on tract rows. Order is data: `pos` is the place of a row in its list."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import simplify_aliquots, sorted_lots
from ..functions.trs import is_error, is_undef, pretty_twprge, trs_fields
from ..plans.storage import cut

POS = "pos"


def attribute(df: DataFrame, name: str) -> Column:
    """The column of that name, or the text '<name>: n/a' where there is none."""
    return F.col(name) if name in df.columns else F.lit(f"{name}: n/a")


def project(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[attribute(df, n).alias(n) for n in names])


# Filters: each gives (selected, remaining).


def filter_rows(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the condition holds, and those where it doesn't or is null."""
    sure = F.coalesce(condition.cast("boolean"), F.lit(False))
    return df.where(sure), df.where(~sure)


def filter_errors(df: DataFrame, twp: bool = True, rge: bool = True, sec: bool = True, undef: bool = False) -> tuple[DataFrame, DataFrame]:
    bad = is_error("trs", twp, rge, sec)
    return filter_rows(df, bad | is_undef("trs", twp, rge, sec) if undef else bad)


def filter_duplicates(df: DataFrame, method: str = "default", pos: str = POS) -> tuple[DataFrame, DataFrame]:
    """Second and later rows of equal key, and the rest; the first in order of pos stays.

    trs; desc (and the trimmed pp_desc); lots_qqs (and the set of lots_qqs, where parsed); instance (by the column uid, or where there is none
    rows that are equal in all columns but pos). default is instance for tracts, and trs for a list of TRS strings, which are equal by value."""
    if method == "default":
        method = "instance" if "desc" in df.columns else "trs"
    keys = {
        "trs": lambda: ["trs"],
        "desc": lambda: ["trs", F.trim(F.coalesce("pp_desc", F.lit(""))) if "pp_desc" in df.columns else F.trim("desc")],
        "lots_qqs": lambda: ["trs", F.array_join(F.array_sort(F.array_distinct("lots_qqs")), ",")],
        "instance": lambda: ["uid"] if "uid" in df.columns else [F.to_json(F.struct(*[c for c in df.columns if c != pos]))],
    }
    if method not in keys:
        raise ValueError(f"no such method: {method!r}")
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys[method]()).orderBy(pos)))
    later = (F.col("_n") > 1) & F.col("lots_qqs").isNotNull() if method == "lots_qqs" else F.col("_n") > 1
    return ranked.where(later).drop("_n"), ranked.where(~later).drop("_n")


# Order.

_KEY = re.compile(r"^(i|t|r|s)(?:\.(num|ns|sn|ew|we))?(?:\.(rev|reverse))?(.*)$")


def sort_keys(key: str = "i,s,r,t", reverse: bool = False, pos: str = POS) -> list[tuple[Column, bool]]:
    """(column, whether it descends) of one orderBy that equals stable sorts by each key in turn; the last key leads.

    Erroneous and undefined numbers come last, in a reversed key first. reverse turns the whole order round."""
    f = trs_fields("trs")  # not looked at for places alone
    out: list[tuple[Column, bool]] = []
    for item in (x.strip().lower() for x in key.split(",")):
        m = _KEY.match(item)
        if not m or m[2] in ("ns", "sn") and m[1] != "t" or m[2] in ("ew", "we") and m[1] != "r" or m[2] and m[1] == "i" and m[2] != "num":
            raise ValueError(f"no such sort key: {item!r}")
        if m[4]:
            warnings.warn(f"ignored in sort key: {m[4]!r}", stacklevel=2)
        if m[1] == "i":
            c = F.col(pos)
        else:
            name = {"t": "twp", "r": "rge", "s": "sec"}[m[1]]
            c = f[f"{name}_num"]
            if m[2] in ("ns", "sn"):
                c = F.when((f["twp_ns"] == "n") == (m[2] == "ns"), -c).otherwise(c)
            elif m[2] in ("ew", "we"):
                c = F.when((f["rge_ew"] == "w") == (m[2] == "we"), -c).otherwise(c)
        out.insert(0, (c, bool(m[3]) != reverse))
    return [*out, (F.col(pos), reverse)]


def _projected(df: DataFrame, keys: list[tuple[Column, bool]]) -> tuple[DataFrame, list[Column], list[str]]:
    """df with the keys as columns, what to order by, and the names of those columns: a sort works out its expressions anew for every comparison."""
    names = [f"_key{k}" for k in range(len(keys))]
    return df.withColumns({n: c for n, (c, _) in zip(names, keys)}), [F.col(n).desc_nulls_first() if back else F.col(n).asc_nulls_last() for n, (_, back) in zip(names, keys)], names


def custom_sort(df: DataFrame, key: str | Column | list = "i,s,r,t", reverse: bool = False, pos: str = POS) -> DataFrame:
    keys = key if isinstance(key, list) else [key]
    flat = [k for item in reversed(keys) for k in (sort_keys(item, reverse, pos)[:-1] if isinstance(item, str) else [(item, reverse)])]
    keyed, by, names = _projected(df, [*flat, (F.col(pos), reverse)])
    return keyed.orderBy(*by).drop(*names)


def with_rank(df: DataFrame, key: str = "i,s,r,t", reverse: bool = False, pos: str = POS, by: list[str] | None = None) -> DataFrame:
    """df with `rank`, the place of each row in the sorted list; by: of each list of equal values.

    Without `by` the whole table is one list: it is sorted by ranges, and each range learns how many rows stand before it,
    so no task holds more than its range."""
    df, columns, names = _projected(df, sort_keys(key, reverse, pos))
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*columns)).cast("bigint")).drop(*names)
    # an id has the number of the range above bit 33, and counts from 0 inside it; it must not be worked out twice
    placed = cut(df.orderBy(*columns).drop(*names).withColumn("_id", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_id", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    # a row for each range of the sort is what is broadcast
    out = placed.withColumn("_range", F.shiftright("_id", 33)).join(F.broadcast(before), "_range")
    return out.withColumn("rank", (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("_id", "_range", "_before")


def first_rows(df: DataFrame, n: int, pos: str = POS) -> DataFrame:
    return df.orderBy(pos).limit(n)


def slice_rows(df: DataFrame, start: int, stop: int, pos: str = POS) -> DataFrame:
    return df.where((F.col(pos) >= start) & (F.col(pos) < stop))


# Groups.


def _ordered(df: DataFrame, pos: str) -> Column:
    rest = [c for c in df.columns if c != pos]
    return F.sort_array(F.collect_list(F.struct(pos, *rest))).alias("rows")


def group_by(df: DataFrame, *attributes: str, into: DataFrame | None = None, pos: str = POS, sort_key: str | None = None, sort_reverse: bool = False) -> DataFrame:
    """(attributes, rows, first_pos): rows of equal attributes in order; groups are in order of first_pos.

    into: rows that come before. sort_key: the order of the rows in each group, as in custom_sort."""
    if into is not None:
        df = concat(into, df, pos=pos)
    df = df.withColumns({a: attribute(df, a) for a in attributes if a not in df.columns})
    if sort_key is None:
        return df.groupBy(*attributes).agg(_ordered(df, pos), F.min(pos).alias("first_pos"))
    names = [pos, *[c for c in df.columns if c != pos]]
    ranked = with_rank(df, sort_key, sort_reverse, pos, list(attributes))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.struct(*names).alias("r")))), lambda x: x["r"])
    return ranked.groupBy(*attributes).agg(rows.alias("rows"), F.min(pos).alias("first_pos"))


def group_by_nested(df: DataFrame, *attributes: str, into: DataFrame | None = None, pos: str = POS, sort_key: str | None = None, sort_reverse: bool = False) -> DataFrame:
    """(first attribute, groups, first_pos): groups is a map from the second attribute to maps from the third, and so on to the ordered rows; keys are in order of first_pos."""
    one, value = group_by(df, *attributes, into=into, pos=pos, sort_key=sort_key, sort_reverse=sort_reverse), "rows"
    for k in range(len(attributes) - 1, 0, -1):
        entries = F.sort_array(F.collect_list(F.struct("first_pos", F.struct(F.col(attributes[k]).alias("key"), F.col(value).alias("value")).alias("e"))), True)
        if value != "rows":  # maps have no order, but no two entries share their first_pos
            entries = F.array_sort(F.collect_list(F.struct("first_pos", F.struct(F.col(attributes[k]).alias("key"), F.col(value).alias("value")).alias("e"))), lambda a, b: F.when(a["first_pos"] < b["first_pos"], -1).when(a["first_pos"] > b["first_pos"], 1).otherwise(0))
        one = one.groupBy(*attributes[:k]).agg(F.map_from_entries(F.transform(entries, lambda x: x["e"])).alias("groups"), F.min("first_pos").alias("first_pos"))
        value = "groups"
    return one


def unpack_group(grouped: DataFrame) -> DataFrame:
    """The rows of group_by, or of group_by_nested of any depth, again."""
    value = "groups" if "groups" in grouped.columns else "rows"
    out = grouped.select(F.col(value).alias("_v"))
    while isinstance(out.schema["_v"].dataType, T.MapType):
        out = out.select(F.explode(F.map_values("_v")).alias("_v"))
    return out.select(F.explode("_v").alias("_v")).select("_v.*")


def sort_nested(grouped: DataFrame, *attributes: str, key: str, reverse: bool = False, pos: str = POS) -> DataFrame:
    """group_by_nested's result by these attributes, with the rows of every innermost group sorted."""
    return group_by_nested(unpack_group(grouped), *attributes, pos=pos, sort_key=key, sort_reverse=reverse)


def sort_grouped(grouped: DataFrame, key: str, reverse: bool = False, pos: str = POS) -> DataFrame:
    """group_by's result with the rows of each group sorted; one shuffle by group."""
    names = [c for c in grouped.columns if c not in ("rows", "first_pos")]
    flat = grouped.select(*[F.col(c).alias(f"_g_{c}") for c in names], "first_pos", F.explode("rows").alias("r"))
    ranked = with_rank(flat.select("*", "r.*"), key, reverse, pos, [f"_g_{c}" for c in names])
    out = ranked.groupBy(*[f"_g_{c}" for c in names]).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "r"))), lambda x: x["r"]).alias("rows"), F.min("first_pos").alias("first_pos"))
    return out.toDF(*names, "rows", "first_pos")


def consolidate(df: DataFrame, delim: str = "; ", pos: str = POS) -> DataFrame:
    """A row for each trs: distinct descs joined, distinct lots and qqs, all in order; pos is that of the first row."""
    g = df.groupBy("trs").agg(F.sort_array(F.collect_list(F.struct(pos, "desc", "lots", "qqs"))).alias("r"))
    distinct = lambda name: F.array_distinct(F.flatten(F.transform("r", lambda x: x[name])))
    return g.select(
        "trs",
        F.array_join(F.array_distinct(F.transform("r", lambda x: x["desc"])), delim).alias("desc"),
        distinct("lots").alias("lots"),
        distinct("qqs").alias("qqs"),
        F.element_at("r", 1)[pos].alias(pos),
    )


def simplified_desc(df: DataFrame, standard: DataFrame | bool = False, delim: str = ", ", pos: str = POS) -> DataFrame:
    """consolidate, with desc made of the sorted lots and the largest aliquots; standard: all, none, or those whose trs it has."""
    c = consolidate(df, pos=pos)
    if isinstance(standard, DataFrame):
        c = c.join(standard.select("trs").distinct().withColumn("_std", F.lit(True)), "trs", "left").withColumn("_std", F.coalesce("_std", F.lit(False)))
    else:
        c = c.withColumn("_std", F.lit(standard))
    c = c.withColumn("aliquots", simplify_aliquots("qqs", F.col("_std"))).drop("_std")
    return c.withColumn("desc", F.array_join(F.concat(sorted_lots("lots"), "aliquots"), delim))


# Lists.


def concat(*dfs: DataFrame, pos: str = POS) -> DataFrame:
    """One list after the other, duplicates kept; pos counts on. Each list but the last is read once more for its greatest pos."""
    out, base = [], 0
    for k, df in enumerate(dfs):
        out.append(df.withColumn(pos, F.col(pos) + base))
        if k + 1 < len(dfs):
            top = df.agg(F.max(pos)).first()[0]
            base += 0 if top is None else top + 1
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def repeat(df: DataFrame, times: int, size: int, pos: str = POS) -> DataFrame:
    """The list, times over; size is its length."""
    copies = F.sequence(F.lit(0), F.lit(times - 1)) if times > 0 else F.array().cast("array<int>")
    return df.withColumn("_k", F.explode(copies)).withColumn(pos, F.col(pos) + F.col("_k") * size).drop("_k")


def contains(df: DataFrame, wanted: DataFrame, match_all: bool = False) -> bool:
    """Whether any (or every) trs of wanted is in df."""
    if match_all:
        return wanted.join(df, "trs", "left_anti").isEmpty()
    return not wanted.join(df, "trs", "left_semi").isEmpty()


def same_list(a: DataFrame, b: DataFrame, pos: str = POS) -> bool:
    """Whether both have the same trs in the same order."""
    b = b.select(pos, F.col("trs").alias("_b"))
    return a.select(pos, F.col("trs").alias("_a")).join(b, pos, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).isEmpty()


def insert(df: DataFrame, other: DataFrame, at: int, size: int, pos: str = POS) -> DataFrame:
    """df with the rows of other, size of them, before place at."""
    moved = df.withColumn(pos, F.when(F.col(pos) >= at, F.col(pos) + size).otherwise(F.col(pos)))
    return moved.unionByName(other.withColumn(pos, F.col(pos) + at), allowMissingColumns=True)


def remove(df: DataFrame, at: int, pos: str = POS) -> tuple[DataFrame, DataFrame]:
    """(the row at that place, the rest, which closes up)."""
    rest = df.where(F.col(pos) != at).withColumn(pos, F.when(F.col(pos) > at, F.col(pos) - 1).otherwise(F.col(pos)))
    return df.where(F.col(pos) == at), rest


def reverse_rows(df: DataFrame, size: int, pos: str = POS) -> DataFrame:
    """The list of that size from its end to its beginning."""
    return df.withColumn(pos, size - 1 - F.col(pos))


def iter_rows(df: DataFrame, *names: str, pos: str = POS):
    """Dicts of the attributes of each row, in order, a range at a time."""
    for r in df.orderBy(pos).select(*[attribute(df, n).alias(n) for n in names]).toLocalIterator():
        yield r.asDict()


def to_json_rows(df: DataFrame, *names: str) -> DataFrame:
    """`json` of the attributes of each row, instead of its columns."""
    return df.select(F.to_json(F.struct(*[attribute(df, n).alias(n) for n in names])).alias("json"))


def list_trs(df: DataFrame, remove_duplicates: bool = False, pos: str = POS) -> DataFrame:
    """(trs, pos); without duplicates in order of the first."""
    return df.groupBy("trs").agg(F.min(pos).alias(pos)) if remove_duplicates else df.select("trs", pos)


# Reports.


def quick_desc(df: DataFrame, delim: str = ": ", max_len: int | None = None) -> DataFrame:
    c = F.concat_ws(delim, "trs", "desc")
    if max_len is not None:
        c = F.when(F.length(c) > max_len, F.concat(F.left(c, F.lit(max(0, max_len - 3))), F.lit("..."))).otherwise(c)
    return df.withColumn("quick_desc", c)


def lots_aliquots_desc(df: DataFrame, standard: DataFrame | bool = False, delim: str = ", ") -> DataFrame:
    """df with desc made of the sorted lots and the largest aliquots of each row; standard: all, none, or those whose trs it has."""
    if isinstance(standard, DataFrame):
        df = df.join(standard.select("trs").distinct().withColumn("_std", F.lit(True)), "trs", "left").withColumn("_std", F.coalesce("_std", F.lit(False)))
    else:
        df = df.withColumn("_std", F.lit(standard))
    return df.withColumn("desc", F.array_join(F.concat(sorted_lots("lots"), simplify_aliquots("qqs", F.col("_std"))), delim)).drop("_std")


def quick_desc_lots_aliquots(df: DataFrame, delim: str = ": ", max_len: int | None = None, standard: DataFrame | bool = False) -> DataFrame:
    return quick_desc(lots_aliquots_desc(df, standard), delim, max_len)


def pretty_desc_lots_aliquots(df: DataFrame, word_sec: str = "Sec ", by: str | None = None, standard: DataFrame | bool = False, pos: str = POS) -> DataFrame:
    return pretty_desc(lots_aliquots_desc(df, standard), word_sec, by, pos)


#: Neighbouring rows of the whole list that one task counts.
_STRETCH = 1 << 16


def _runs(d: DataFrame, pos: str) -> DataFrame:
    """d with `run`, the number of the row's run of neighbouring rows of equal _tr in the whole list; no task holds more than a stretch of it."""
    d = cut(with_rank(d, "i", pos=pos))
    before = d.select((F.col("rank") + 1).alias("rank"), F.col("_tr").alias("_last"), F.lit(True).alias("_some"))
    d = d.join(before, "rank", "left").withColumn("_new", F.when(F.col("_some") & F.col("_last").eqNullSafe(F.col("_tr")), 0).otherwise(1)).drop("_last", "_some")
    d = d.withColumn("_s", F.expr(f"rank div {_STRETCH}"))
    sums = d.groupBy("_s").agg(F.sum("_new").alias("_n"))
    sums = sums.withColumn("_upto", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum("_new").over(Window.partitionBy("_s").orderBy("rank"))
    return d.withColumn("_in", inside).join(sums, "_s").withColumn("run", F.col("_upto") + F.col("_in")).drop("_s", "_in", "_upto", "_new", "rank")


def pretty_desc(df: DataFrame, word_sec: str = "Sec ", by: str | None = None, pos: str = POS, justify_linebreaks: str | None = None) -> DataFrame:
    """A row for each run of neighbouring rows of equal Twp/Rge: (run, heading, body).

    by: the column of the list that a row belongs to; every list is one window. justify_linebreaks: what stands in front of later lines of a
    description; without it they are aligned with the first one."""
    jump = "\n" + (" " * (len(word_sec) + 4) if justify_linebreaks is None else justify_linebreaks)
    keys = [by] if by else []
    f = trs_fields("trs")
    d = df.withColumn("_tr", F.concat(f["twp"], f["rge"])).withColumn("_line", F.concat(F.lit(word_sec), f["sec"], F.lit(": "), F.replace("desc", F.lit("\n"), F.lit(jump))))
    if by:
        w = Window.partitionBy(by).orderBy(pos)
        d = d.withColumn("_new", (~F.lag("_tr").over(w).eqNullSafe(F.col("_tr"))).cast("int")).withColumn("run", F.sum("_new").over(w))
    else:
        d = _runs(d.select(pos, "trs", "_tr", "_line"), pos)
    g = d.groupBy(*keys, "run").agg(F.first(pretty_twprge("trs"), ignorenulls=True).alias("heading"), F.sort_array(F.collect_list(F.struct(pos, "_line"))).alias("r"))
    return g.select(*keys, F.col("run").cast("bigint").alias("run"), "heading", F.array_join(F.transform("r", lambda x: x["_line"]), "\n").alias("body"))


def tracts_to_str(df: DataFrame, *names: str, by: str | None = None, pos: str = POS) -> DataFrame:
    """(by, pos, report): 'Tract i / n' and a line '<attribute> : <value>' for each attribute, names padded to the longest, later lines of a value under its first.

    by: the column of the list that a row belongs to; without it the table is one list. Reports in order of pos, with empty lines between, are the whole text."""
    wide = max(map(len, names)) + 1

    def cell(n: str) -> Column:
        c = attribute(df, n)
        if n in df.columns and isinstance(df.schema[n].dataType, T.ArrayType):
            c = F.array_join(F.flatten(c) if isinstance(df.schema[n].dataType.elementType, T.ArrayType) else c, ", ")
        return F.concat(F.lit(f"{n:<{wide}}: "), F.replace(F.coalesce(c.cast("string"), F.lit("None")), F.lit("\n"), F.lit("\n" + " " * (wide + 2))))

    d = df.select(*([by] if by else []), pos, F.concat_ws("\n", *[cell(n) for n in names]).alias("_cells"))
    if by:
        d = d.withColumns({"rank": F.row_number().over(Window.partitionBy(by).orderBy(pos)), "_n": F.count("*").over(Window.partitionBy(by))})
    else:
        d = with_rank(d, "i", pos=pos)
        d = d.crossJoin(F.broadcast(d.agg(F.count("*").alias("_n"))))  # one row
    head = F.concat(F.lit("Tract "), F.col("rank").cast("string"), F.lit(" / "), F.col("_n").cast("string"))
    return d.select(*([by] if by else []), pos, F.concat_ws("\n", head, "_cells").alias("report"))


def report(df: DataFrame, *names: str, by: str | None = None, pos: str = POS) -> DataFrame:
    """Text report: a line '<attribute> : <value>' for each attribute of each row, names padded to the longest."""
    wide = max(map(len, names))
    cells = [F.concat(F.lit(f"{n:<{wide}} : "), F.coalesce(attribute(df, n).cast("string"), F.lit(""))) for n in names]
    return df.select(*([by] if by else []), pos, F.concat_ws("\n", *cells).alias("report"))
