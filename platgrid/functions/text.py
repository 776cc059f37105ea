"""The grammar as Arrow functions on columns: whole batches cross to Python, one call for each distinct text.

Spark copies a deterministic function into every filter that it pushes below a projection and so would call it twice; those that cost most are
declared nondeterministic, but for lateral joins, which ask for deterministic ones."""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.options import Options
from . import aliquots, grammar

_LINE = "array<struct<flag:string,context:string>>"
DESCRIPTION = f"struct<text:string,layout:string,tracts:array<struct<twp:string,rge:string,sec:string,sec_found:string,desc:string>>,w_flag_lines:{_LINE},e_flag_lines:{_LINE}>"
PARTS = f"struct<pp_desc:string,lots:array<string>,qqs:array<string>,aliquots_whole:array<string>,lot_acres:map<string,string>,w_flag_lines:{_LINE}>"
_A_LINE = pa.list_(pa.struct([("flag", pa.string()), ("context", pa.string())]))
_A_DESCRIPTION = pa.struct([("text", pa.string()), ("layout", pa.string()), ("tracts", pa.list_(pa.struct([(n, pa.string()) for n in ("twp", "rge", "sec", "sec_found", "desc")]))), ("w_flag_lines", _A_LINE), ("e_flag_lines", _A_LINE)])
_A_PARTS = pa.struct([("pp_desc", pa.string()), ("lots", pa.list_(pa.string())), ("qqs", pa.list_(pa.string())), ("aliquots_whole", pa.list_(pa.string())), ("lot_acres", pa.map_(pa.string(), pa.string())), ("w_flag_lines", _A_LINE)])


#: Bytes of texts and results that a Python worker keeps for each function and its options.
KEPT = 64 << 20


class Known:
    """Results of a function of keys as one Arrow array: equal keys are worked out once, also over the batches and tasks of a worker.

    No more than about KEPT bytes stay behind a batch; beyond that all are dropped and the next batch begins anew."""

    def __init__(self, kind: pa.DataType):
        self.kind = kind
        self.drop()

    def drop(self) -> None:
        self.at: dict = {}
        self.results, self.size = pa.array([], self.kind), 0

    def of(self, keys: list, work) -> pa.Array:
        """The results of keys, in their order; work gives the Arrow array of a list of keys."""
        new = [k for k in dict.fromkeys(keys) if k not in self.at]
        if new:
            self.at.update(zip(new, range(len(self.results), len(self.results) + len(new))))
            self.results = pa.concat_arrays([self.results, work(new)])
            self.size += sum(200 + _length(k) for k in new)
        out = self.results.take(pa.array(map(self.at.__getitem__, keys), pa.int64()))
        if self.size + self.results.nbytes > KEPT:
            self.drop()
        return out


def _length(key) -> int:
    return len(key) if isinstance(key, str) else sum(map(_length, key)) if isinstance(key, tuple) else 0


@lru_cache(8)
def known(name: str, options: tuple) -> Known:
    """What this process knows of a function; found again by its name, as functions are pickled anew for each task."""
    return Known(_KINDS[name])


def _keys(text: pa.Array, config: pa.Array) -> list:
    """A text by itself, or with options of its own in a pair."""
    texts = text.to_pylist()
    return texts if config.null_count == len(config) else [t if c is None else (t, c) for t, c in zip(texts, config.to_pylist())]


def _rows(keys: list, options: Options):
    own: dict = {}
    for k in keys:
        t, c = k if isinstance(k, tuple) else (k, None)
        if c is not None and c not in own:
            own[c] = Options.parse(c, options)
        yield t, options if c is None else own[c]


def _list(rows: list, values) -> pa.Array:
    """A list array of rows; values gives the Arrow array of all their elements."""
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), values([x for row in rows for x in row]))


def _struct(names: tuple | list, rows: list) -> pa.Array:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], list(names))


def _strings(rows: list) -> pa.Array:
    return _list(rows, lambda xs: pa.array(xs, pa.string()))


def _lines(rows: list) -> pa.Array:
    return _list(rows, lambda xs: _struct(("flag", "context"), xs))


_NOTHING = {"text": None, "layout": None, "tracts": [], "w": [], "e": []}


def _descriptions(keys: list, options: Options) -> pa.Array:
    got = [_NOTHING if t is None else grammar.parse_description(t, o) for t, o in _rows(keys, options)]
    places = [[(*grammar.parts(a, s), s, d) for a, s, d in p["tracts"]] for p in got]
    columns = [
        pa.array([p["text"] for p in got], pa.string()),
        pa.array([p["layout"] for p in got], pa.string()),
        _list(places, lambda xs: _struct(("twp", "rge", "sec", "sec_found", "desc"), xs)),
        _lines([p["w"] for p in got]),
        _lines([p["e"] for p in got]),
    ]
    return pa.StructArray.from_arrays(columns, fields=list(_A_DESCRIPTION), mask=pa.array([p is _NOTHING for p in got], pa.bool_()))


def _parts(keys: list, options: Options) -> pa.Array:
    got = [grammar.parse_tract(t or "", o.clean_qq, o.suppress_lot_divs, *o.depths(), o.break_halves) for t, o in _rows(keys, options)]
    acres = pa.array([list(p["acres"].items()) for p in got], pa.map_(pa.string(), pa.string()))
    columns = [pa.array([p["pp"] for p in got], pa.string()), *(_strings([p[n] for p in got]) for n in ("lots", "qqs", "whole")), acres, _lines([p["w"] for p in got])]
    return pa.StructArray.from_arrays(columns, fields=list(_A_PARTS))


_KINDS = {"description": _A_DESCRIPTION, "tract": _A_PARTS, "preprocess": pa.string(), "layout": pa.string(), "scrub": pa.string()}
_KINDS |= {name: pa.list_(pa.string()) for name in ("twprge", "sec", "simplify", "subtract")}


def description_udf(options: Options, lateral: bool = False):
    """The function of (text, config) behind parse_description."""

    def run(text: pa.Array, config: pa.Array) -> pa.Array:
        return known("description", (options,)).of(_keys(text, config), lambda new: _descriptions(new, options))

    f = F.arrow_udf(run, DESCRIPTION)
    return f if lateral else f.asNondeterministic()


def parse_description(text: Column | str, options: Options = Options(), config: Column | str | None = None) -> Column:
    """DESCRIPTION of each text; null stays null. config holds options for single rows, over the given ones."""
    return description_udf(options)(text, F.lit(None).cast("string") if config is None else config)


def tract_udf(options: Options, lateral: bool = False):
    """The function of (text, config) behind parse_tract."""

    def run(text: pa.Array, config: pa.Array) -> pa.Array:
        return known("tract", (options,)).of(_keys(text, config), lambda new: _parts(new, options))

    f = F.arrow_udf(run, PARTS)
    return f if lateral else f.asNondeterministic()


def parse_tract(text: Column | str, options: Options = Options(), config: Column | str | None = None) -> Column:
    """PARTS (lots, quarter-quarters, acreages) of each tract's text; null counts as empty."""
    return tract_udf(options)(text, F.lit(None).cast("string") if config is None else config)


def _text_udf(name: str, f, kind: str, *options):
    """f on each text; options are all that its results depend on beside the text."""

    def run(text: pa.Array) -> pa.Array:
        return known(name, options).of(text.to_pylist(), lambda new: pa.array([None if t is None else f(t) for t in new], _KINDS[name]))

    return F.arrow_udf(run, kind)


def preprocess(text: Column | str, options: Options = Options()) -> Column:
    return _text_udf("preprocess", lambda t: grammar.preprocess(t, options)[0], "string", options)(text)


def deduce_layout(text: Column | str, options: Options = Options()) -> Column:
    return _text_udf("layout", lambda t: grammar.deduce_layout(grammar.preprocess(t, options)[0]), "string", options)(text)


def find_twprge(text: Column | str, options: Options = Options(), pre: bool = False) -> Column:
    return _text_udf("twprge", lambda t: grammar.find_twprge(t, options, pre), "array<string>", options, pre)(text)


def find_sec(text: Column | str) -> Column:
    return _text_udf("sec", grammar.find_sec, "array<string>")(text)


def scrub_aliquots(text: Column | str, clean_qq: bool = False) -> Column:
    return _text_udf("scrub", lambda t: grammar.scrub(t, clean_qq), "string", clean_qq)(text)


def _tuples(lists: pa.Array) -> list[tuple]:
    """Lists of strings as tuples, null as the empty one; each string of the batch becomes Python's once."""
    coded = lists.values.dictionary_encode()
    names = [*coded.dictionary.to_pylist(), None]
    flat = [names[i] for i in coded.indices.fill_null(len(names) - 1).to_numpy().tolist()]
    at = lists.offsets.to_numpy().tolist()
    out = [tuple(flat[a:b]) for a, b in zip(at, at[1:])]
    return out if not lists.null_count else [x if there else () for x, there in zip(out, lists.is_valid().to_pylist())]


def simplify_aliquots(qqs: Column | str, assume_standard: Column | bool = False) -> Column:
    """The fewest and largest aliquots of the same land; equal arrays are simplified once."""

    def run(qqs: pa.Array, standard: pa.Array) -> pa.Array:
        keys = list(zip(_tuples(qqs), standard.to_pylist()))
        return known("simplify", ()).of(keys, lambda new: _strings([aliquots.simplify(sorted(set(q)), bool(s)) for q, s in new]))

    return F.arrow_udf(run, "array<string>")(qqs, F.lit(assume_standard) if isinstance(assume_standard, bool) else assume_standard)


def subtract_udf():
    """The function of (qqs, gone) behind subtract_aliquots."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return known("subtract", ()).of(list(zip(_tuples(a), _tuples(b))), lambda new: _strings([aliquots.subtract(x, y) for x, y in new]))

    return F.arrow_udf(run, "array<string>")


def subtract_aliquots(qqs: Column | str, gone: Column | str) -> Column:
    """The land of qqs without that of gone; equal pairs are worked out once."""
    return subtract_udf()(qqs, gone)


def lot_numbers(lots: Column | str) -> Column:
    return F.transform(lots, lambda x: F.element_at(F.split(x, "L"), -1).cast("int"))


def sorted_lots(lots: Column | str) -> Column:
    """Lots by number; equal numbers keep their order."""
    keyed = F.transform(lots, lambda x, i: F.struct(F.element_at(F.split(x, "L"), -1).cast("int").alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])
