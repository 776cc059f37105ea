"""Column functions, operators on tract rows, sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from platgrid.functions import text as tx
from platgrid.functions import trs as tr
from platgrid.operators import parse, tail
from platgrid.plans import Options
from platgrid.sources import csvfiles


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f("x").alias("y")).orderBy("i").collect()]


def test_trs(spark):
    got = column(spark, ["8n9w1", "154N97W01", None, "", "asdf", "154n97w", "154n97w145", "1154n97w14", "___z___z14", "XXXzXXXz14"], tr.trs_struct)
    assert [g.trs for g in got] == ["8n9wXX", "154n97w01", "___z___z__", "___z___z__", "XXXzXXXzXX", "154n97wXX", "154n97wXX", "154n97w14", "___z___z14", "XXXzXXXzXX"]
    assert (got[1].twp_num, got[1].twp_ns, got[1].rge_num, got[1].rge_ew, got[1].sec_num) == (154, "n", 97, "w", 1)
    assert got[2].twp_undef and got[2].twp_num is None and not got[4].twp_undef and got[4].twp_ns is None
    assert column(spark, ["154n97w01", None, "x"], tr.is_error) == [False, False, True]
    assert column(spark, ["154n97w01", None, "x"], lambda c: tr.is_undef(c, sec=False)) == [False, True, False]
    assert column(spark, ["154n97w01", "1s2e03", None], tr.pretty_twprge) == ["T154N-R97W", "T1S-R2E", "T---X-R---X"]
    assert column(spark, ["154n97w"], tr.short_to_natural) == ["T154N-R97W"] and column(spark, ["T154N-R97W"], tr.natural_to_short) == ["154n97w"]


def test_construct_trs(spark):
    rows = [("154n", "97w", "1"), ("154", "97", "01"), ("7S", "8E", "36"), (None, "97w", "1"), ("bad", "97w", None), ("1S4n", "9Ow", "l"), ("154n", "97w", "abc")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, r string, s string")
    got = [r.x for r in df.select("i", tr.construct_trs("t", "r", "s").alias("x")).orderBy("i").collect()]
    assert got == ["154n97w01", "154n97w01", "7s8e36", "___z97w01", "XXXz97w__", "XXXzXXXzXX", "154n97wXX"]
    assert df.where("i = 5").select(tr.construct_trs("t", "r", "s", ocr_scrub=True)).first()[0] == "154n90w01"


DESC = "T7N-R9W Sec 1: Lots 1 - 3, S/2NE/4, Sec 13 - 15: S/2N/2"


def test_tracts(spark):
    df = spark.createDataFrame([(1, DESC, None), (2, None, None), (3, "T7N-R9W Sec 1: N2", "clean_qq,qq_depth.1")], "id int, text string, config string")
    rows = parse.tracts(df, Options(parse_qq=True), config_col="config").orderBy("id", "orig_index").collect()
    assert [(r.id, r.trs, r.lots, r.qqs) for r in rows] == [
        (1, "7n9w01", ["L1", "L2", "L3"], ["SENE", "SWNE"]),
        *[(1, f"7n9w{s}", [], ["SENE", "SWNE", "SENW", "SWNW"]) for s in (13, 14, 15)],
        (3, "7n9w01", [], ["NE", "NW"]),
    ]
    assert rows[0].w_flags == ["multisec_found<13,14,15>"] and not rows[0].desc_is_flawed
    a = parse.with_aliquots(parse.tract_parts(df.select("id", F.lit("Lot 2, Lots 10, 1, E/2, W/2").alias("desc"))), True).first()
    assert a.sorted_lots == ["L1", "L2", "L10"] and a.aliquots == ["ALL"] and a.lots_aliquots == ["L1", "L2", "L10", "ALL"]
    assert df.select(tx.lot_numbers(F.array(F.lit("N2 of L4"), F.lit("L12")))).first()[0] == [4, 12]


def test_sql_table_functions(spark):
    parse.register(spark)
    got = spark.sql(f"SELECT * FROM plss_tracts('{DESC}', NULL)").collect()
    assert [(r.twprge, r.sec) for r in got] == [("7n9w", s) for s in ("01", "13", "14", "15")]
    assert spark.sql("SELECT * FROM tract_parts('Lot 1(2.5), NE', 'clean_qq,qq_depth.1')").first() == (["L1"], ["NE"], {"L1": "2.5"})


def rows(spark, *trs):
    return spark.createDataFrame([(i, t, f"d{i % 2}", [f"L{i % 2}"], ["NENE"]) for i, t in enumerate(trs)], "pos int, trs string, desc string, lots array<string>, qqs array<string>")


def order(df):
    return [r.pos for r in df.collect()]


def test_sort(spark):
    df = rows(spark, "2n1w03", "1s9e01", "asdf", "1n9w02", "", "2n1w03")
    assert order(tail.custom_sort(df)) == [1, 3, 0, 5, 2, 4]  # township, then range, then section
    assert order(tail.custom_sort(df, "t.num.rev"))[:2] == [2, 4]
    assert order(tail.custom_sort(df, "t.ns"))[:4] == [0, 5, 3, 1] and order(tail.custom_sort(df, "r.we"))[:4] == [3, 0, 5, 1]
    assert order(tail.custom_sort(df, "s", True)) == order(tail.custom_sort(df, "s"))[::-1]
    assert order(tail.custom_sort(df, [F.col("desc"), "s"])) == order(tail.custom_sort(tail.with_rank(df, "s"), [F.col("desc"), "s"]))
    for bad in ("x", "s.ns", "t.ew", "r.sn"):
        with pytest.raises(ValueError):
            tail.sort_keys(bad)
    with pytest.warns(UserWarning):
        tail.sort_keys("t.num junk")


def test_filters_and_groups(spark):
    df = rows(spark, "1n1w01", "bad", "1n1w01", "", "1n1w02").withColumn("lots_qqs", F.concat("lots", "qqs"))
    bad, rest = tail.filter_errors(df)
    assert order(bad) == [1] and sorted(order(rest)) == [0, 2, 3, 4] and sorted(order(tail.filter_errors(df, undef=True)[0])) == [1, 3]
    assert order(tail.filter_duplicates(df, "trs")[0]) == [2] == order(tail.filter_duplicates(df, "lots_qqs")[0]) == order(tail.filter_duplicates(df, "desc")[0])
    with pytest.raises(ValueError):
        tail.filter_duplicates(df, "colour")
    g = {r.desc: [x.pos for x in r.rows] for r in tail.group_by(df, "desc").collect()}
    assert g == {"d0": [0, 2, 4], "d1": [1, 3]}
    n = {r.desc: {k: len(v) for k, v in r.groups.items()} for r in tail.group_by_nested(df, "desc", "trs").collect()}
    assert n == {"d0": {"1n1w01": 2, "1n1w02": 1}, "d1": {"bad": 1, "": 1}}
    assert sorted(order(tail.unpack_group(tail.group_by(df, "desc")))) == [0, 1, 2, 3, 4]
    c = {r.trs: (r.desc, r.lots, r.qqs, r.pos) for r in tail.consolidate(df).collect()}
    assert c["1n1w01"] == ("d0", ["L0"], ["NENE"], 0) and len(c) == 4
    into = tail.group_by(df.where("pos = 4"), "desc", into=df.where("pos < 2"))
    assert {r.desc: len(r.rows) for r in into.collect()} == {"d0": 2, "d1": 1}


def test_lists(spark):
    a, b = rows(spark, "1n1w01", "1n1w02"), rows(spark, "1n1w02", "3n3w03")
    both = tail.concat(a, b)
    assert order(both.orderBy("pos")) == [0, 1, 2, 3] and tail.same_list(both, tail.concat(a, b)) and not tail.same_list(a, b)
    assert tail.contains(a, b) and not tail.contains(a, b, True) and tail.contains(both, b, True)
    assert [r.trs for r in tail.list_trs(both, True).orderBy("pos").collect()] == ["1n1w01", "1n1w02", "3n3w03"]
    assert sorted(order(tail.repeat(a, 2, 2))) == [0, 1, 2, 3] and order(tail.slice_rows(both, 1, 3)) == [1, 2] and tail.repeat(a, 0, 2).count() == 0
    assert tail.project(a, "trs", "owner").first() == ("1n1w01", "owner: n/a")
    assert [r.trs for r in tail.insert(a, b, 1, 2).orderBy("pos").collect()] == ["1n1w01", "1n1w02", "3n3w03", "1n1w02"]
    gone, rest = tail.remove(both, 1)
    assert gone.first().trs == "1n1w02" and order(rest.orderBy("pos")) == [0, 1, 2]
    assert [r["trs"] for r in tail.iter_rows(tail.reverse_rows(both, 4), "trs")] == ["3n3w03", "1n1w02", "1n1w02", "1n1w01"]
    assert tail.to_json_rows(a, "trs", "lots").first().json == '{"trs":"1n1w01","lots":["L0"]}'
    p = tail.pretty_desc(both).orderBy("run").collect()
    assert [(r.heading, r.body) for r in p] == [("T1N-R1W", "Sec 01: d0\nSec 02: d1\nSec 02: d0"), ("T3N-R3W", "Sec 03: d1")]
    assert tail.report(a, "trs", "desc").first().report == "trs  : 1n1w01\ndesc : d0"
    assert tail.quick_desc(a, max_len=8).first().quick_desc == "1n1w0..."


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text('owner,land,config\n"Smith","T7N-R9W Sec 1: Lots 1 - 2, NE",clean_qq\n"Jones","T7N-R9W Sec 2: ALL, Sec 3: N/2",\n')
    got = csvfiles.parse_csv(spark, str(tmp_path / "in.csv"), "land", Options(parse_qq=True), "config").withColumn("n", F.when(F.col("owner") == "Smith", 1).otherwise(2))
    csvfiles.write_csv(got.coalesce(1), str(tmp_path / "out"), ["trs", "lots", "lot_acres", "owner", "w_flag_lines"], nice=True, uid=("n", "orig_index"), plus={"note": F.lit("x")})
    back = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("UID").collect()
    assert back[0].asDict() == {"UID": "0001.a-a", "Twp/Rge/Sec": "7n9w01", "Lots": "L1, L2", "Lot Acreages": None, "owner": "Smith", "w_flag_lines": None, "note": "x"}
    assert [r.UID for r in back] == ["0001.a-a", "0002.a-b", "0002.b-b"]
    assert csvfiles.write_csv(got, str(tmp_path / "out"), ["trs"], mode="a") == 3
    assert csvfiles.headers(["trs", "zz"], {"trs": "A"}) == ["A", "zz"] and csvfiles.headers(["trs", "zz"], ["A"]) == ["A", "zz"]
    assert column(spark, [1, 26, 27, 702], lambda c: csvfiles.num_to_alpha(F.col(c)), "int") == ["A", "Z", "AA", "ZZ"]
    assert column(spark, ["A", "Z", "AA", "ZZ", "AAA"], lambda c: csvfiles.alpha_to_num(F.col(c))) == [1, 26, 27, 702, None]


def test_file_names(spark, tmp_path):
    (tmp_path / "T7N-R9W Sec 1 - 2 report 3-14-2020.docx").write_text("x")
    got = csvfiles.parse_file_names(spark, str(tmp_path)).collect()
    assert [(r.trs, r.report_date) for r in got] == [("7n9w01", "3-14-2020"), ("7n9w02", "3-14-2020")]


def test_stream(spark, tmp_path):
    from platgrid.streaming import append_csv, stream_tracts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"{DESC}\nT1S-R2E Sec 4: N/2\n")
    s = stream_tracts(spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "text"))
    append_csv(s, str(tmp_path / "out"), str(tmp_path / "ck"), ["trs", "desc"]).awaitTermination()
    assert sorted(r.trs for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()) == ["1s2e04", "7n9w01", "7n9w13", "7n9w14", "7n9w15"]


def test_queries_plan_without_needless_shuffles(spark):
    df = spark.createDataFrame([(1, DESC)], "id int, text string")
    plan = parse.tracts(df, Options(parse_qq=True))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_every_text_is_parsed_once(spark):
    df = spark.createDataFrame([(1, DESC)], "id int, text string")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(parse.tracts(df)).count("ArrowEvalPython") == 1
    whole = parse.tracts(df, Options(parse_qq=True))
    assert plan(whole.where("size(qqs) > 0 and trs is not null")).count("ArrowEvalPython") == 2
    parse.register(spark)
    df.createOrReplaceTempView("one_text")
    assert plan(spark.sql("SELECT id, x.* FROM one_text, LATERAL plss_tracts(text, CAST(NULL AS STRING)) x WHERE x.sec > '01'")).count("ArrowEvalPython") == 1


def test_sections_above_99_are_errors(spark):
    df = spark.createDataFrame([("T7N-R9W Sec 145: NE/4, Sec 4: ALL",)], "text string")
    got = parse.tracts(df, orig_desc=True).orderBy("orig_index").collect()
    assert [(r.trs, r.sec_found, r.sec_num) for r in got] == [("7n9wXX", "145", None), ("7n9w04", "04", 4)]
    assert got[0].e_flags == ["sec_error<7n9w145>"] and got[0].desc_is_flawed and got[1].orig_desc.startswith("T7N")


def test_sort_keys_are_worked_out_once(spark):
    import re

    df = rows(spark, "2n1w03", "1s9e01")
    for d in (tail.custom_sort(df, "s.rev,r.ew,t.ns"), tail.with_rank(df, "s.rev,t.ns", by=["desc"])):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert not any("regexp" in line for line in plan.split("\n") if re.match(r"\W*Sort ", line))


def test_nested_groups_and_sorted_groups(spark):
    df = rows(spark, "1n1w03", "1n1w02", "2n1w01", "1n1w01", "2n1w05").withColumn("owner", F.when(F.col("pos") < 3, "a").otherwise("b"))
    g = {r.owner: r.groups for r in tail.group_by_nested(df, "owner", "desc", "trs").collect()}
    assert {k: {d: {t: [x.pos for x in v] for t, v in m.items()} for d, m in x.items()} for k, x in g.items()} == {
        "a": {"d0": {"1n1w03": [0], "2n1w01": [2]}, "d1": {"1n1w02": [1]}},
        "b": {"d1": {"1n1w01": [3]}, "d0": {"2n1w05": [4]}},
    }
    nested = tail.group_by_nested(df.where("pos > 1"), "owner", "desc", into=df.where("pos < 2"))
    assert sorted(order(tail.unpack_group(nested))) == [0, 1, 4, 5, 6] and sorted(order(tail.unpack_group(tail.group_by_nested(df, "owner", "desc", "trs")))) == [0, 1, 2, 3, 4]
    s = {r.owner: [x.pos for x in r.rows] for r in tail.group_by(df, "owner", sort_key="s.rev").collect()}
    assert s == {"a": [0, 1, 2], "b": [4, 3]}
    n = {r.owner: {k: [x.pos for x in v] for k, v in r.groups.items()} for r in tail.sort_nested(tail.group_by_nested(df, "owner", "desc"), "owner", "desc", key="s").collect()}
    assert n == {"a": {"d0": [2, 0], "d1": [1]}, "b": {"d1": [3], "d0": [4]}}


def test_text_reports(spark):
    df = rows(spark, "1n1w03", "1n1w02", "2n1w01").withColumn("desc", F.concat("desc", F.lit("\nmore")))
    got = [r.report for r in tail.tracts_to_str(df, "trs", "lots", "desc", "owner").orderBy("pos").collect()]
    assert got[0] == "Tract 1 / 3\ntrs   : 1n1w03\nlots  : L0\ndesc  : d0\n        more\nowner : owner: n/a" and got[2].startswith("Tract 3 / 3\n")
    by = tail.tracts_to_str(df.withColumn("g", F.col("pos") > 0), "trs", by="g").orderBy("pos").collect()
    assert [r.report.split("\n")[0] for r in by] == ["Tract 1 / 1", "Tract 1 / 2", "Tract 2 / 2"]
    assert [r.body for r in tail.pretty_desc(df).orderBy("run").collect()] == ["Sec 03: d0\n        more\nSec 02: d1\n        more", "Sec 01: d0\n        more"]
    assert tail.pretty_desc(df, justify_linebreaks="\t").orderBy("run").first().body == "Sec 03: d0\n\tmore\nSec 02: d1\n\tmore"
    quarters = df.withColumn("qqs", F.array(*[F.lit(q) for q in ("NENE", "NWNE", "SENE", "SWNE")]))
    assert [r.quick_desc for r in tail.quick_desc_lots_aliquots(quarters).orderBy("pos").collect()] == ["1n1w03: L0, NE", "1n1w02: L1, NE", "2n1w01: L0, NE"]
    whole = quarters.withColumn("qqs", F.array(*[F.lit(q) for q in ("NE", "NW", "SE", "SW")]))
    assert [r.body for r in tail.pretty_desc_lots_aliquots(whole, standard=df.where("pos = 2")).orderBy("run").collect()][1] == "Sec 01: L0, ALL"


def test_runs_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(tail, "_STRETCH", 4)
    df = spark.range(40).select(F.col("id").alias("pos"), F.concat((F.expr("id div 3") % 5 + 1).cast("string"), F.lit("n1w01")).alias("trs"), F.lit("d").alias("desc"))
    got = tail.pretty_desc(df.repartition(3)).orderBy("run").collect()
    assert [(r.run, r.body.count("Sec")) for r in got] == [(k + 1, 3 if k < 13 else 1) for k in range(14)]


def test_instances_are_the_default_of_tract_lists(spark):
    df = rows(spark, "1n1w01", "1n1w01", "1n1w01")
    assert order(tail.filter_duplicates(df)[0]) == [2]  # the second differs in desc and lots
    assert sorted(order(tail.filter_duplicates(df.select("pos", "trs"))[0])) == [1, 2]


def test_default_options(spark):
    df = spark.createDataFrame([("T7, R9 Sec 1: NE/4",)], "text string")
    try:
        Options.set_default(Options(default_ns="s", default_ew="e"))
        assert parse.tracts(df).first().trs == "7s9e01" and Options.parse("n").default_ew == "e"
    finally:
        Options.set_default()
    assert parse.tracts(df).first().trs == "7n9w01"


def test_csv_rows_of_a_table(spark, tmp_path):
    (tmp_path / "in.csv").write_text('made by hand,,,\nowner,land,config,layout\n"Smith","T7N-R9W Sec 1: Lots 1 - 2,\nNE, Sec 2: ALL",clean_qq,\n"Jones","",,\n"Doe","N/2 of Sec 3, T7N-R9W",,desc_STR\n"Roe","T1N-R1W Sec 9: ALL",,junk\n')
    how = dict(attributes=["trs", "lots", "qqs"], header_row=2, config_col="config", layout_col=4, include_uid=True)
    got = [r for r in csvfiles.parse_csv_rows(spark, str(tmp_path / "in.csv"), "land", last_row=5, **how).orderBy("row", "orig_index").collect()]
    assert [(r.row, r.owner, r.trs, r.lots, r.UID) for r in got] == [
        (1, "made by hand", None, None, None),
        (3, "Smith", "7n9w01", "L1, L2", "0001.a-b"),
        (3, None, "7n9w02", "", "0001.b-b"),
        (4, "Jones", None, None, None),
        (5, "Doe", "7n9w03", "", "0002.a-a"),
        (6, "Roe", None, None, None),
    ]
    got = csvfiles.parse_csv_rows(spark, str(tmp_path / "in.csv"), 2, ["trs", "lots"], "clean_qq", first_row=3, copy_data=True, include_unparsed=False, unpack=False).orderBy("row", "orig_index").collect()
    assert [(r._c0, r.trs, r.lots) for r in got] == [("Smith", "7n9w01", '["L1","L2"]'), ("Smith", "7n9w02", "[]"), ("Doe", "7n9w03", "[]"), ("Roe", "1n1w09", "[]")]
    lots = csvfiles.parse_csv_rows(spark, str(tmp_path / "in.csv"), 2, ["lots"], first_row=3, last_row=3, tract_level=True, include_unparsed=False).collect()
    assert [(r.row, r.lots) for r in lots] == [(3, "L1, L2")]
    with pytest.raises(ValueError):
        csvfiles.parse_csv_rows(spark, str(tmp_path / "in.csv"), 0)


def test_tract_writer(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, DESC), (2, 1, "T1N-R1W Sec 4: ALL")], "id int, n int, text string")
    got = parse.tracts(df)
    with csvfiles.TractWriter(spark, str(tmp_path / "a"), ["trs"], nice=True, plus=["note"], uid=7) as w:
        assert w.is_open and w.write(got, ["x"], by="n") == 5 and w.uid == 9
        assert w.write(None) == 0 and w.uid == 10
        assert w.write(got.where("n = 1"), ["y"]) == 1
    assert not w.is_open
    with pytest.raises(RuntimeError):
        w.write(got)
    w.open()
    assert w.write(got.where("n = 1")) == 1
    back = [tuple(r) for r in spark.read.csv(str(tmp_path / "a"), header=True).orderBy("UID").collect()]
    assert back == [(f"0007.{c}-d", t, "x") for c, t in zip("abcd", ("7n9w01", "7n9w13", "7n9w14", "7n9w15"))] + [("0008.a-a", "1n1w04", "x"), ("0010.a-a", "1n1w04", "y"), ("0011.a-a", "1n1w04", None)]
    w = csvfiles.TractWriter(spark, str(tmp_path / "b"), ["trs", "desc"], header="once")
    w.write(got.coalesce(1))
    files = sorted(p.name for p in (tmp_path / "b").glob("*.csv"))
    assert files[0] == "0-headers.csv" and "".join((tmp_path / "b" / f).read_text() for f in files).splitlines()[:2] == ["trs,desc", '7n9w01,"Lots 1 - 3, S/2NE/4"']
