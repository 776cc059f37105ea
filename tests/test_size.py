"""What must not grow with the input: the rows of a task, the work for equal texts, the memory of a worker."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platgrid import catalog
from platgrid.functions import aliquots, grammar
from platgrid.functions import text as tx
from platgrid.operators import parse
from platgrid.plans import Options
from platgrid.sources import csvfiles

SF = "/root/testdata/sf0.001"


def test_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(parse, "ROWS_A_TASK", 1000)
    # all rows are in one of many partitions, as in a file of one row group
    df = spark.range(0, 20000, 1, 16).where("id < 1250").unionByName(spark.range(1250, 20000, 1, 1))
    got = parse.spread(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(got) == 20 and max(r["count"] for r in got) <= 1100 and sum(r["count"] for r in got) == 20000
    assert parse.spread(spark.range(10)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_equal_texts_are_parsed_once(spark, monkeypatch):
    calls, f = [], grammar.parse_description
    monkeypatch.setattr(grammar, "parse_description", lambda t, o: calls.append(t) or f(t, o))
    tx.known.cache_clear()
    run = tx.description_udf(Options(), lateral=True).func
    text, none = ["T1N-R2W Sec 3: NE/4", None, "T1N-R2W, Sec 4: SW/4, Sec 5 - 6: S/2"], pa.nulls(3, pa.string())
    a, b = run(pa.array(text), none), run(pa.array(text[::-1]), none)
    assert a.to_pylist() == b.to_pylist()[::-1] and a[1].as_py() is None and len(a[2].as_py()["tracts"]) == 3
    assert sorted(calls) == sorted(x for x in text if x)  # in the second batch, and in a task after it, none
    c = run(pa.array(text), pa.array([None, "s,e", "layout.copy_all"]))
    assert len(c[2].as_py()["tracts"]) == 1 and c[1].as_py() is None and c[0] == a[0] and len(calls) == 3


def test_what_is_known_is_bounded(monkeypatch):
    monkeypatch.setattr(tx, "KEPT", 10000)
    known = tx.Known(pa.list_(pa.string()))
    for k in range(200):
        keys = [f"{k + i} " * 10 for i in range(5)] * 2
        got = known.of(keys, lambda new: pa.array([[x, x] for x in new], pa.list_(pa.string())))
        assert got.to_pylist() == [[x, x] for x in keys]
        assert known.size + known.results.nbytes <= 10000 and len(known.at) == len(known.results)


def test_equal_subtractions_are_made_once(spark, monkeypatch):
    calls, f = [], aliquots.subtract
    monkeypatch.setattr(aliquots, "subtract", lambda a, b: calls.append((a, b)) or f(a, b))
    tx.known.cache_clear()
    run, kind = tx.subtract_udf().func, pa.list_(pa.string())
    # slices, so that offsets do not begin at 0
    a = pa.array([["x"], ["NE", "NW"], None, ["ALL"], ["NE", "NW"], []], kind)[1:]
    b = pa.array([["x"], ["NE"], ["NE"], ["N2"], ["NE"], None], kind)[1:]
    want = [["NW"], [], ["S2"], ["NW"], []]
    assert run(a, b).to_pylist() == want and run(a, b).to_pylist() == want and len(calls) == 4


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ")


def test_csv_is_read_once_and_parsed_by_many(spark, tmp_path, monkeypatch):
    texts = [f'{k},"T{k % 9 + 1}N-R2W\nSec {k % 36 + 1}: NE/4"' if k % 3 else f"{k}," for k in range(1, 25001)]
    (tmp_path / "long.csv").write_text("\n".join(["no,text", *texts]))
    (tmp_path / "short.csv").write_text("no,text\n1,T1N-R2W Sec 3: SW/4\n")
    monkeypatch.setattr(csvfiles, "BYTES_A_TASK", 20000)
    df = csvfiles.parse_csv_rows(spark, str(tmp_path), 2, ["trs"], header_row=1)
    assert scans(df) == 1 and df.columns == ["file", "row", "orig_index", "no", "text", "trs"]
    got = df.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got if "long" in r.file}) > 20
    # more rows than a batch holds, and a file behind another one
    assert sorted((r.row, r.no, r.trs) for r in got if "long" in r.file) == [(k + 1, str(k), f"{k % 9 + 1}n2w{k % 36 + 1:02d}" if k % 3 else None) for k in range(1, 25001)]
    assert [(r.row, r.orig_index, r.no, r.trs) for r in got if "short" in r.file] == [(2, 0, "1", "1n2w03")]


def test_rows_are_numbered_by_file():
    files = [["a", "a"], ["a", "b"], [], ["b", "c", "d"], ["d"]]
    batches = (pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["file"]) for x in files)
    assert [b.column("row").to_pylist() for b in csvfiles._number(batches)] == [[1, 2], [3, 1], [], [2, 1, 1], [2]]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["error_desc_rate", "flags_by_kind", "plss_preprocess", "plss_layout"])
def test_several_patterns_take_one_pass(spark, name):
    assert scans(catalog.QUERIES[name](spark, SF)) == 1
