"""CSV in, CSV out."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.parse import tract_parts, tracts
from ..operators.tail import attribute
from ..plans.options import LAYOUTS, Options

HEADERS = {
    "trs": "Twp/Rge/Sec", "twp": "Township", "twp_num": "Township Number", "twp_ns": "Township N/S", "rge": "Range", "rge_num": "Range Number",
    "rge_ew": "Range E/W", "twprge": "Twp/Rge", "sec": "Section", "sec_num": "Section Number", "desc": "Description", "pp_desc": "Preprocessed Description",
    "lots": "Lots", "qqs": "QQs", "lots_qqs": "Lots and QQs", "lot_acres": "Lot Acreages", "aliquots": "Aliquots", "aliquots_whole": "Whole Aliquots",
    "lots_aliquots": "Lots and Aliquots", "source": "Source", "orig_desc": "Original Description", "orig_index": "Original Index", "w_flags": "Warning Flags",
    "e_flags": "Error Flags", "flags": "Flags", "desc_is_flawed": "Flawed", "parse_complete": "Parse Complete", "twp_undef": "Township Undefined", "rge_undef": "Range Undefined", "sec_undef": "Section Undefined",
}


def num_to_alpha(n: Column) -> Column:
    """1 to A, 26 to Z, 27 to AA."""
    letter = lambda c: F.char(c + 64)
    return F.when(n <= 26, letter(n)).otherwise(F.concat(letter(((n - 1) / 26).cast("int")), letter((n - 1) % 26 + 1)))


def alpha_to_num(s: Column) -> Column:
    """A to 1, ZZ to 702; longer ones are null."""
    at = lambda k: F.ascii(F.substring(F.upper(s), k, 1)) - 64
    return F.when(F.length(s) == 1, at(1)).when(F.length(s) == 2, at(1) * 26 + at(2))


def gen_uid(number: Column, sub: Column, total: Column, just: int = 4) -> Column:
    """0001.a-d: the first of four tracts of the first description."""
    return F.concat(F.lpad(number.cast("string"), F.greatest(F.lit(just), F.length(number.cast("string"))), "0"), F.lit("."), F.lower(num_to_alpha(sub)), F.lit("-"), F.lower(num_to_alpha(total)))


def stringify(df: DataFrame, name: str) -> Column:
    """The text of a cell: maps as k:v,k:v; arrays joined, also nested ones and arrays of structs."""
    if name not in df.columns:
        return attribute(df, name)
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.MapType):
        return F.array_join(F.transform(F.map_entries(c), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), ",")
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.ArrayType):
            return F.array_join(F.transform(F.flatten(c), lambda x: x.cast("string")), ", ")
        if isinstance(kind.elementType, T.StructType):
            return F.array_join(F.transform(c, lambda x: F.concat_ws(", ", *[x[f.name].cast("string") for f in kind.elementType.fields])), ", ")
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    return c.cast("string")


def headers(names: list[str], nice: bool | dict | list = False) -> list[str]:
    """Headers of columns: their names, nice names, those of a dict, or a list as it stands (names where it is shorter)."""
    if isinstance(nice, dict):
        return [nice.get(n, n) for n in names]
    if isinstance(nice, list):
        return [*nice[: len(names)], *names[len(nice) :]]
    return [HEADERS.get(n, n) if nice else n for n in names]


def csv_rows(df: DataFrame, names: list[str], nice: bool | dict | list = False, plus: dict[str, Column] | None = None, uid: tuple[str, str] | None = None) -> DataFrame:
    """df as text cells. uid: (number of the description, place in it); then the first column is UID."""
    cells = {n: stringify(df, n) for n in names} | {n: c.cast("string") for n, c in (plus or {}).items()}
    heads = [*headers(names, nice), *(plus or {})]
    if uid is None:
        return df.select(*cells.values()).toDF(*heads)
    w = Window.partitionBy(uid[0])
    d = df.withColumn("_sub", F.row_number().over(w.orderBy(uid[1]))).withColumn("_total", F.count("*").over(w))
    return d.select(gen_uid(F.col(uid[0]), F.col("_sub"), F.col("_total")), *cells.values()).toDF("UID", *heads)


def write_csv(df: DataFrame, path: str, names: list[str], mode: str = "w", **how) -> int:
    """Writes csv_rows to a folder, in as many files as there are partitions, each with a header, and gives their number; mode a adds to what is there."""
    seen = Observation()
    csv_rows(df, names, **how).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if mode == "a" else "overwrite").csv(path, header=True)
    return seen.get["n"]


class TractWriter:
    """Adds tables of tracts to a folder of CSV files; unique identifiers go on from one table to the next.

    header: each (every file begins with the headers, as Spark reads them), once (in a file of their own, first by name) or none."""

    def __init__(self, spark: SparkSession, path: str, names: list[str], mode: str = "w", nice: bool | dict | list = False, plus: list[str] = (), uid: int | None = None, header: str = "each"):
        if header not in ("each", "once", "none"):
            raise ValueError(f"no such way with headers: {header!r}")
        self.spark, self.path, self.names, self.mode, self.nice, self.plus, self.uid, self.header = spark, path, names, mode, nice, list(plus), uid, header
        self.is_open = False
        self.open()
        if header == "once" and mode == "w":
            self.write_headers()

    def open(self) -> None:
        self.is_open = True

    def close(self) -> None:
        self.is_open = False

    def __enter__(self) -> TractWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def headers(self) -> list[str]:
        return [*(["UID"] if self.uid is not None else []), *headers(self.names, self.nice), *self.plus]

    def write_headers(self) -> None:
        """The headers as a file of one line."""
        self._check()
        line = self.spark.createDataFrame([self.headers()], ", ".join(f"_{k} string" for k in range(len(self.headers()))))
        line.coalesce(1).write.mode("append" if self.mode == "a" else "overwrite").csv(self.path)
        self.mode = "a"
        fs = self.spark._jvm.org.apache.hadoop.fs
        folder = fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in system.listStatus(folder):
            if f.getPath().getName().startswith("part-") and f.getLen() > 0:
                system.rename(f.getPath(), fs.Path(folder, "0-headers.csv"))

    def _check(self) -> None:
        if not self.is_open:
            raise RuntimeError("the writer is closed; call open() first")

    def write(self, df: DataFrame | None, plus: list | None = None, by: str | None = None, order: str = "orig_index") -> int:
        """Writes the rows of df and gives their number; None writes nothing, but takes a number all the same.

        by: a column that numbers the descriptions of df from 0, each of which gets a number of its own; without it the table counts as one. plus: the same further cells for every row."""
        self._check()
        if df is None:
            self.uid = None if self.uid is None else self.uid + 1
            return 0
        seen, number = Observation(), F.col(by) if by else F.lit(0)
        cells = {n: F.lit(v) for n, v in zip(self.plus, plus or [None] * len(self.plus))}
        if self.uid is not None:
            df = df.withColumn("_number", (number + self.uid).cast("bigint"))
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.max(number).alias("last"))
        rows = csv_rows(df, self.names, self.nice, cells, ("_number", order) if self.uid is not None else None)
        rows.write.mode("append" if self.mode == "a" else "overwrite").csv(self.path, header=self.header == "each")
        self.mode = "a"
        if self.uid is not None:
            self.uid += (seen.get["last"] or 0) + 1
        return seen.get["n"]


def _number(batches):
    """Batches with the row's number in its file; a task reads its files one after the other and whole."""
    file, n = None, 0
    for batch in batches:
        runs = pc.run_end_encode(batch.column("file"))
        numbers, at = [], 0
        for f, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            file, n = f, n if f == file else 0
            numbers += range(n + 1, n + 1 + end - at)
            n, at = n + end - at, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, "row"])


#: Bytes of CSV that a task is given to parse; some 100,000 short descriptions.
BYTES_A_TASK = 8 << 20


def _head(raw: DataFrame, row: int):
    """That row of the first of the files by name, from this file alone; None if it has not so many."""
    path = raw.sparkSession._jvm.org.apache.hadoop.fs.Path
    uri = raw.sparkSession._jvm.java.net.URI
    first = min((path(uri(f)).toString() for f in raw.inputFiles()), default=None)
    if first is None or row < 1:
        return None
    got = raw.where(F.col("_metadata.file_path") == first).limit(row).collect()
    return got[-1] if len(got) == row else None


def parse_csv_rows(
    spark: SparkSession,
    path: str,
    desc_col: int | str,
    attributes: list[str] = ("trs", "desc"),
    config: Options | str | None = None,
    first_row: int = 1,
    last_row: int | None = None,
    header_row: int | None = None,
    config_col: int | str | None = None,
    layout_col: int | str | None = None,
    unpack: bool = True,
    copy_data: bool = False,
    tract_level: bool = False,
    include_uid: bool = False,
    include_unparsed: bool = True,
) -> DataFrame:
    """A CSV file's rows with the attributes of each tract behind them, a row for each tract, as text.

    Rows and columns count from 1; columns may also be named, if there is a header_row, which is no row of the result. Rows outside first_row ..
    last_row, and those without a description, stay as they are (include_unparsed). The file's own cells stand in the first row of a description alone,
    or in each (copy_data). With unpack lists are joined, without it they are written as JSON. Columns row and orig_index give the order; file the file.
    A file is read and its rows are numbered by one task, as quoted cells may hold line feeds; parsed they are by as many as its bytes ask for."""
    if isinstance(desc_col, int) and desc_col < 1:
        raise ValueError(f"columns count from 1: {desc_col}")
    raw = spark.read.csv(path, multiLine=True, escape='"')
    cells, size = raw.columns, int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    raw = raw.select(*cells, F.col("_metadata.file_path").alias("file"))
    rows = raw.mapInArrow(_number, T.StructType([*raw.schema, T.StructField("row", T.IntegerType())]))
    names = list(cells)
    if header_row is not None:
        head = _head(raw, header_row) or rows.where(F.col("row") == header_row).orderBy("file").first()
        names = [(head[c] if head and head[c] else c) for c in cells]
        names = [n if names.index(n) == k else f"{n}_{k + 1}" for k, n in enumerate(names)]
        rows = rows.where(F.col("row") != header_row)
        first_row = max(first_row, header_row + 1) if first_row <= header_row else first_row

    def column(c: int | str) -> Column:
        return F.col(cells[c - 1] if isinstance(c, int) else cells[names.index(c)])

    base = Options.parse(config) if config is None or isinstance(config, str) else config
    own = F.lit(None).cast("string") if config_col is None else column(config_col)
    if layout_col is not None:
        own = F.concat_ws(",", own, F.when(F.trim(column(layout_col)).isin(*LAYOUTS), F.concat(F.lit("layout."), F.trim(column(layout_col)))))
    inside = (F.col("row") >= first_row) & (F.lit(True) if last_row is None else F.col("row") <= last_row)
    inside = F.coalesce(inside & (F.trim(column(desc_col)) != ""), F.lit(False))
    # a file's rows are read and numbered by one task, but not parsed
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-size // BYTES_A_TASK)), "file", "row")
    # rows that are not parsed go along without a text, so that the files are read once
    todo = (rows if include_unparsed else rows.where(inside)).select(F.struct("*").alias("_cells"), F.when(inside, column(desc_col)).alias("_text"), F.when(inside, own).alias("_config"), inside.alias("_in"))
    if tract_level:
        done = tract_parts(todo.withColumn("orig_index", F.when(F.col("_in"), 0)).withColumn("desc", F.col("_text")), base, "desc", "_config")
    else:
        done = tracts(todo, base, "_text", "_config", outer=include_unparsed)
        if not base.parse_qq and any(a in ("lots", "qqs", "lots_qqs", "lot_acres", "pp_desc", "aliquots_whole") for a in attributes):
            done = tract_parts(done, base, "desc", "_config")
    cell = lambda n: stringify(done, n) if unpack or n not in done.columns or not isinstance(done.schema[n].dataType, (T.ArrayType, T.MapType)) else F.to_json(n)
    kept = [(F.col(f"_cells.`{c}`") if copy_data else F.when((F.col("orig_index") == 0) | ~F.col("_in"), F.col(f"_cells.`{c}`"))).alias(c) for c in cells]
    if include_uid:
        w = Window.partitionBy("_cells.file", "_cells.row")
        done = done.withColumns({"_total": F.count("*").over(w), "_sub": F.row_number().over(w.orderBy("orig_index"))})
        number = rows.where(inside).select("file", "row").withColumn("_no", F.row_number().over(Window.partitionBy("file").orderBy("row")))
        done = done.join(number, (F.col("_cells.file") == number["file"]) & (F.col("_cells.row") == number["row"]), "left").drop("file", "row")
        done = done.withColumn("UID", gen_uid(F.col("_no"), F.col("_sub"), F.col("_total")))
    uid = ["UID"] if include_uid else []
    out = done.select(F.col("_cells.file").alias("file"), F.col("_cells.row").alias("row"), "orig_index", *kept, *[F.when(F.col("_in"), cell(a)).alias(f"_a{k}") for k, a in enumerate(attributes)], *uid)
    return out.toDF("file", "row", "orig_index", *names, *attributes, *uid)


def parse_csv(spark: SparkSession, path: str, desc_col: str, options: Options = Options(), config_col: str | None = None, tract_level: bool = False, trs_col: str = "trs", **read) -> DataFrame:
    """Tracts of a CSV file's descriptions, with the other columns carried along; tract_level: a row is one tract already."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', **read)
    return tract_parts(raw, options, desc_col, config_col) if tract_level else tracts(raw, options, desc_col, config_col)


def parse_file_names(spark: SparkSession, path: str, suffix: str = r"\s+report\s+(\d{1,2}-\d{1,2}-\d{4})\.\w+$", options: Options = Options()) -> DataFrame:
    """Tracts of descriptions in the names of files; only the names are read. The first group of suffix is report_date."""
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    rows = files.withColumn("_n", name).select(F.col("path").alias("source"), F.regexp_extract("_n", suffix, 1).alias("report_date"), F.regexp_replace("_n", suffix, "").alias("text"))
    return tracts(rows, options)
