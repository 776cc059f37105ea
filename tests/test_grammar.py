"""Texts to Twp/Rges, sections, layouts, lots and aliquots."""

import pytest

from platgrid.functions import aliquots, grammar
from platgrid.plans import ConfigError, DefaultEWError, DefaultNSError, Options

O = Options()
CANON = "T12N-R34W Sec 5: NE/4"


@pytest.mark.parametrize("text", ["Township 12 North, Range 34 West Sec 5: NE/4", "T12N-R34W Sec 5: NE/4", "12N-34W Sec 5: NE/4", "T12-R34 Sec 5: NE/4", "12N-R34 Sec 5: NE/4", "T12N-R34W, 6th P.M., Sec 5: NE/4", "Twp. 012 N., Rge. 034 W.; Sec 5: NE/4", "T 12 N, R 34 W of the 6th Principal Meridian, Sec 5: NE/4"])
def test_spellings(text):
    assert grammar.preprocess(text, O)[0] == CANON


def test_fixed_and_defaults():
    assert grammar.preprocess("T12-R34 Sec 5: NE/4", O)[1] == ("T12N-R34W",)
    assert grammar.preprocess(CANON, O)[1] == ()
    o = Options(default_ns="s", default_ew="e")
    assert grammar.find_twprge("T12-R34, T13N R35", o, True) == ["T12S-R34E", "T13N-R35E"]
    assert grammar.find_twprge("Township 12 North, Range 34 West; T 13 S, R 2 E") == ["T12N-R34W", "T13S-R2E"]
    assert grammar.find_twprge("Lot 2, N2 W2") == []


def test_ocr():
    assert grammar.preprocess("Township lS4 North, Range 9O West Sec 5: NE/4", Options(ocr_scrub=True))[0] == "T154N-R90W Sec 5: NE/4"


LAND = [("8n9w", "01", "SW/4"), ("7n9w", "20", "W/2"), *[("7n9w", str(s), "S/2") for s in (24, 25, 26, 27)], ("7n9w", "28", "N/2")]
LAYOUTS = {
    "TRS_desc": "T8N-R9W Sec 1: SW/4, T7N-R9W Sec 20: W/2, Sec 24 - 27: S/2, Sec 28: N/2",
    "S_desc_TR": "Sec 1: SW/4 of T8N-R9W, Sec 20: W/2, Sec 24 - 27: S/2, Sec 28: N/2 of T7N-R9W",
    "desc_STR": "SW/4 of Sec 1, T8N-R9W, W/2 of Sec 20, S/2 of Sec 24 - 27: N/2 of Sec 28, T7N-R9W",
    "TR_desc_S": "T8N-R9W SW/4 of Sec 1, T7N-R9W W/2 of Sec 20, S/2 of Sec 24 - 27, N/2 of Sec 28",
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("o", [O, Options(segment=True)])
def test_four_layouts_one_land(layout, o):
    p = grammar.parse_description(LAYOUTS[layout], o)
    assert p["tracts"] == LAND and p["e"] == [] and p["layout"] == layout
    given = grammar.parse_description(LAYOUTS[layout], Options(layout=layout))
    assert given["tracts"] == LAND


def test_array_fold_equals_window_rule():
    """The Twp/Rge of a block is the last before or the first after it, by layout."""
    for layout, text in LAYOUTS.items():
        marks = sorted([(m.start(), "t", grammar.short(m[0])) for m in grammar.CANON.finditer(text)] + [(m.start(), "s", grammar.sections_of(m)[0]) for m in grammar.SECTION.finditer(text)])
        want = []
        for k, (_, kind, value) in enumerate(marks):
            if kind == "s":
                side = marks[:k][::-1] if layout in ("TRS_desc", "TR_desc_S") else marks[k:]
                want += [(next(v for _, q, v in side if q == "t"), s) for s in value]
        assert [t[:2] for t in grammar.parse_description(text, O)["tracts"]] == want


def test_flaws_and_flags():
    flags = lambda text, o=O: [f for f, _ in grammar.parse_description(text, o)["e"] + grammar.parse_description(text, o)["w"]]
    assert flags("Sec 2: W/2, T7N-R9W Sec 4: NE/4, Sec 5: S/2")
    assert flags("T7N-R9W Sec 4: NE/4, Sec 5: W/2") == []
    assert flags("T7N-R9W Sec 9 - 7: NE/4") == ["multisec_found<09,08,07>", "nonsequential_sections"]
    assert flags("T7N-R9W, 5th PM, Sec 4: NE/4", Options(no_pm=True)) == ["unused_desc< NE/4>"]
    assert "less_except" in flags("T7N-R9W Sec 4: NE/4, less and except the road")
    assert {"well", "depth"} <= set(flags("T7N-R9W Sec 4: wellbore of the well from surface down"))
    assert "twprge_error" in flags("Sec 4: NE/4 of Sec 5", Options(layout="TRS_desc"))
    assert grammar.parse_description("nothing here", O)["tracts"] == [("XXXzXXXz", "XX", "nothing here")]


def test_colon_modes():
    text = "T7N-R9W Sec 4: NE/4, and Sec 5 road"
    assert len(grammar.parse_description(text, O)["tracts"]) == 2
    assert len(grammar.parse_description(text, Options(sec_colon_required=True))["tracts"]) == 1
    assert len(grammar.parse_description(text, Options(sec_colon_cautious=True))["tracts"]) == 1
    p = grammar.parse_description("T7N-R9W Sec 4 NE/4", Options(sec_colon_cautious=True))
    assert p["tracts"] == [("7n9w", "04", "NE/4")] and p["w"][0][0] == "pulled_sec_without_colon<04>"


@pytest.mark.parametrize("text", ["T7N-R9W: That part of the NE/4 of Sec 3 - 5 lying within RoW", "That part of the NE/4 of Sec 3 - 5, T7N-R9W lying within RoW", "That part of the NE/4 of Sec 3 - 5 lying within RoW, T7N-R9W"])
def test_sec_within(text):
    p = grammar.parse_description(text, Options(sec_within=True))
    assert p["tracts"] == [("7n9w", s, "That part of the NE/4 lying within RoW") for s in ("03", "04", "05")]
    assert "sec_within<7n9w04>" in [f for f, _ in p["w"]]


def test_sections():
    assert grammar.find_sec("Sections 1, 3 - 5 and § 9; Sec. 12") == ["01", "03", "04", "05", "09", "12"]
    assert grammar.unpack("9 - 6") == ([9, 8, 7, 6], True) and grammar.unpack("3 thru 3") == ([3], True)


def test_many_twprges_stay_linear():
    import time

    text = ", ".join(f"T{k}N-R9W, 5th P.M., Sec {k % 36 + 1}: NE/4" for k in range(1, 150))
    began = time.time()
    assert len(grammar.parse_description(text, O)["tracts"]) == 149 and time.time() - began < 5


def tract(text, clean=False, off=False, least=2, most=None, halves=False):
    return grammar.parse_tract(text, clean, off, least, most, halves)


def test_lots():
    p = tract("Lots 2 - 4, S/2N/2, Lot 9(38.5), SE/4SE/4")
    assert (p["lots"], p["acres"], p["qqs"]) == (["L2", "L3", "L4", "L9"], {"L9": "38.5"}, ["SENE", "SWNE", "SENW", "SWNW", "SESE"])
    assert tract("N/2 of Lot 1, Lot 3, E/2SW/4 of Lot 7")["lots"] == ["N2 of L1", "L3", "E2SW of L7"]
    assert tract("N/2 of Lot 1, Lot 3, E/2SW/4 of Lot 7", off=True)["lots"] == ["L1", "L3", "L7"]
    assert tract("Lot 5, N/2 of Lots 1 - 3")["lots"] == ["L5", "N2 of L1", "N2 of L2", "N2 of L3"]
    assert [f for f, _ in tract("Lots 1 - 2, Lot 1, NE/4NE/4, NE/4NE/4")["w"]] == ["dup_lot<L1>", "dup_qq<NENE>"]
    assert [f for f, _ in tract("Lot 1(2.5), NE/4, Lot 1(3)")["w"]][0] == "dup_lot_acreage<L1(2.5)>"


@pytest.mark.parametrize("text, want", [("Lot 1 of SE/4 of the NW/4", ["L1", "SENW"]), ("NENE", ["NENE"]), ("S2NE", ["SENE", "SWNE"]), ("S2NENW, Lot 7", ["L7", "S2NENW"]), ("N2 of NE of NW, NW", ["N2NENW", "NENW", "NWNW", "SENW", "SWNW"]), ("S½N½ SW", ["S2NESW", "S2NWSW"])])
def test_clean_qq(text, want):
    p = tract(text, True)
    assert p["lots"] + p["qqs"] == want


def test_scrub():
    for x in ("NE/4", "NE4", "NE /4", "NE / 4", "Northeast Quarter", "N.E. One Quarter", "NE 1/4", "ne¼"):
        assert grammar.scrub(x) == "NE¼"
    for x in ("N/2", "N2", "N /2", "N / 2", "North Half", "N. 1/2", "N½"):
        assert grammar.scrub(x) == "N½"
    for x in ("No. 2", "N 2°", "N2a", "N/ 2", "NE/ 4", "One Hundred Feet", "NENE"):
        assert grammar.scrub(x) == x
    assert grammar.scrub("N½ of the NE¼ of SW¼") == "N½NE¼SW¼" and grammar.scrub("S2NENW") == "S½NE¼NW¼"


def test_all_only_at_the_end():
    assert len(tract("ALL")["qqs"]) == 16 and len(tract("Lot 1, ALL")["qqs"]) == 16 and tract("ALL, Lot 1")["qqs"] == [] and tract("All of the bank")["qqs"] == []


def test_depths():
    assert list(aliquots.expand("N½", 1)) == ["NE", "NW"]
    assert len(aliquots.expand("N½", 3)) == 32 and len(aliquots.expand("ALL", 5)) == 1024
    deep = "S½N½NW¼SW¼"
    assert [list(aliquots.expand(deep, 2, m)) for m in (2, 3, 4)] == [["NWSW"], ["N2NWSW"], ["S2N2NWSW"]]
    assert list(aliquots.expand(deep, 1, 1)) == ["SW"] and list(aliquots.expand(deep, 3, 3)) == ["NENWSW", "NWNWSW"]
    assert list(aliquots.expand("N½NW¼SW¼")) == ["N2NWSW"] and list(aliquots.expand("N½NW¼SW¼", 2, None, True)) == ["NENWSW", "NWNWSW"]
    assert aliquots.standardise(["W", "SE"]) == ["SW", "E"] and aliquots.standardise(["N", "E"]) == ["NE"] and aliquots.standardise(["E", "W"]) == ["E", "W"]
    assert list(aliquots.expand("SE¼W½")) == list(aliquots.expand("E½SW¼")) and list(aliquots.expand("W½N½")) == list(aliquots.expand("NW¼"))


def test_simplify():
    s = lambda *xs, **k: aliquots.simplify([q for x in xs for q in aliquots.expand(x)], **k)
    assert s("S2SW", "NENE", "NWNE", "NESW", "NWSW", "N2SENE", "SWSENE", "SESENE", "SWNW", "SESWNE") == ["N2NE", "SENE", "SESWNE", "SWNW", "SW"]
    assert s("E2", "W2") == ["N2", "S2"] and s("E2", "W2", assume_standard=True) == ["ALL"] and s() == []
    assert s("NENE", "SENE", "NWNW") == ["E2NE", "NWNW"] and aliquots.subtract(["ALL"], ["N2"]) == ["S2"]


def test_simplify_keeps_the_land():
    import random

    rng = random.Random(1)
    every = aliquots.expand("ALL", 3)
    for _ in range(150):
        land = set(rng.sample(every, rng.randrange(0, 64)))
        got = aliquots.simplify(sorted(land))
        back = [q for a in got for q in aliquots.expand(a, 3)]
        assert sorted(back) == sorted(land)


def test_options():
    o = Options.parse("s, e; clean_qq, qq_depth.3, segment=False, TRS_desc")
    assert (o.default_ns, o.default_ew, o.clean_qq, o.qq_depth, o.segment, o.layout) == ("s", "e", True, 3, False, "TRS_desc")
    assert Options.parse(o.to_text()) == o and Options.from_dict(o.to_dict()) == o and o.child(qq_depth=None).depths() == (2, None)
    for bad, error in (("colour", ValueError), ("qq_depth.x", ValueError)):
        with pytest.raises(error):
            Options.parse(bad)
    with pytest.raises(ConfigError):
        Options.parse(3)
    with pytest.raises(ConfigError):
        Options(qq_depth_min="2")
    with pytest.raises(DefaultNSError):
        Options(default_ns="x")
    with pytest.raises(DefaultEWError):
        Options(default_ew="x")


@pytest.mark.parametrize("text", ["t12nr34w", "T-12-N-R-34-W", "Twp. 12 N., Rge. 34 W.", "12-N-R-34", "12 N., Rge. 34", "T-12-R-34", "T-12-34-W", "Township 12, 34 West", "T-12-N-R-34-W-6-PM", "12N-34W-6 P.M.", "T12N-R34W, Sixth Principal Meridian", "Township 12 North, Range 34 West ---- ,", "t12nr34w  :, ", "T-12-N-R-34-W  -", "Twnshp 12 N, Rng 34 W"])
def test_more_spellings(text):
    assert grammar.preprocess(text, O)[0].strip() == "T12N-R34W"


@pytest.mark.parametrize("text", ["TISlN-RIL0W", "Township ISl North, Range IL0 West", "T0wnship ISl North, Range IL0 West", "T0wn5h1p ISl North, Range IL0 West", "Twp. ISl N., Rge. IL0 W.", "T-ISl-N-R-IL0-W"])
def test_more_ocr(text):
    assert grammar.preprocess(text, Options(ocr_scrub=True))[0] == "T151N-R110W"


def test_range_two_needs_its_word():
    assert grammar.find_twprge("3N-2W") == [] and grammar.find_twprge("3N-R2W") == ["T3N-R2W"] == grammar.find_twprge("T3N, Range 2 West")


@pytest.mark.parametrize("text, want", [("Seciton 4", "4"), ("Sect. 4", "4"), ("§4", "4"), ("Sec: 4", "4"), ("Secs 4 and", "4"), ("Sections: 4,", "4"), ("Seciton 4 through 6", "4 5 6"), ("Sections 4 and 6 to 8", "4 6 7 8"), ("Sec. 4, 5, and 7 - 8", "4 5 7 8"), ("Sect. 4 and Section 6 to 7", "4 6 7"), ("§4-§6", "4 5 6"), ("Sec. 4, 5 - 6, and 9", "4 5 6 9"), ("§4 & §9", "4 9")])
def test_more_sections(text, want):
    assert [str(int(s)) for s in grammar.find_sec(text)] == want.split()


@pytest.mark.parametrize("text, want", [("N½ NE", "N½NE¼"), ("N½ of the NE", "N½NE¼"), ("S½N½ of NE", "S½N½NE¼"), ("N½ Northeast", "N½NE¼"), ("N½ of the Southwest of the Northeast", "N½SW¼NE¼"), ("N½ Nebraska", "N½ Nebraska")])
def test_half_and_bare_quarters(text, want):
    assert grammar.scrub(text) == want


@pytest.mark.parametrize("text, lots", [("L. 1", "L1"), ("Lot 1 - Lot 3", "L1 L2 L3"), ("Lots 1, 2 and 4", "L1 L2 L4"), ("Lot 1 [2.5], Lot 2(3.25)", "L1 L2"), ("L1, L2", "L1 L2"), ("Lots 1 thru 3, and 7", "L1 L2 L3 L7"), ("Pilot 3", "")])
def test_more_lots(text, lots):
    assert tract(text)["lots"] == lots.split()
