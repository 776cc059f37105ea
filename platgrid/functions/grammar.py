"""The grammar of land descriptions: text to Twp/Rges, sections, lots and aliquots. Plain Python on one text."""

from __future__ import annotations

import re

from ..plans.options import ERROR_RGE, ERROR_SEC, ERROR_TWP, Options
from .aliquots import expand

I = re.IGNORECASE
_GAP = r"[\s.,\-–—]*"
_WIDE = r"[\s.,;|_~\-–—]*"
_ONE = r"[\s.,;|_~\-–—]+"
_T = r"t(?:o?w?n?s?n?h?s?h?i?i?p?|wps?|wn|ps?)?s?(?![a-z])\.?"
_R = r"r(?:anges?|ngs?|ges?|gs?)?(?![a-z])\.?"
_NS = r"(?P<ns>n(?:orth|o)?|s(?:outh|o)?)(?=[\W\d_]|r)\.?"
_EW = r"(?P<ew>e(?:ast)?|w(?:est)?)(?![a-z])\.?"
_NO_EW = r"(?![\s.,\-–—]*(?:e(?:ast)?|w(?:est)?)(?![a-z]))"
_AT = r"(?<![a-z0-9])"
_N = r"\d{1,3}(?!\d)"
#: Without the word for range, a lone "2" is the 2 of a half.
_RANGE = rf"(?:{_R}{_GAP}(?P<r1>{_N})|(?!2(?!\d))(?P<r2>{_N}))"
EXACT = re.compile(rf"{_AT}(?:{_T}{_GAP})?(?P<t>{_N}){_GAP}{_NS}{_WIDE}{_RANGE}{_GAP}{_EW}", I)
_NEITHER = re.compile(rf"{_AT}{_T}{_GAP}(?P<t>{_N}){_ONE}{_R}{_GAP}(?P<r1>{_N}){_NO_EW}", I)
_NO_NS = re.compile(rf"{_AT}{_T}{_GAP}(?P<t>{_N}){_ONE}(?:{_R}{_GAP}(?P<r1>{_N})|(?P<r2>{_N})){_GAP}{_EW}", I)
_NO_EW_RE = re.compile(rf"{_AT}(?:{_T}{_GAP})?(?P<t>{_N}){_GAP}{_NS}{_WIDE}{_R}{_GAP}(?P<r1>{_N}){_NO_EW}", I)
_D = r"[0-9SOILl\]|]{1,3}"
_OCR = re.compile(rf"(?<![A-Za-z0-9])(?:(?i:t(?:[0o]wn[s5]h[i1l]ps?|wps?|wn|ps?)?\.?){_GAP})(?P<t>{_D}){_GAP}(?i:{_NS}){_WIDE}(?i:{_R.replace('(?![a-z])', '')}){_GAP}(?P<r1>{_D}){_GAP}(?i:{_EW})")
CANON = re.compile(r"T(\d{1,3})([NS])-R(\d{1,3})([EW])(?![A-Za-z0-9])")
_PM = re.compile(r"(?P<tr>T\d{1,3}[NS]-R\d{1,3}[EW])\s*[^\n]{0,25}?(?:of\s+the\s+)?[^\n]{0,25}?(?:\bp\.?\s?m\b\.?|princip[ale]{1,3}\s+merid[ia]{1,2}[an]{1,2}\b)", I)
_PUNCT = re.compile(r"(T\d{1,3}[NS]-R\d{1,3}[EW])(?:[\s,;:.]|(?<=\s)[\-–—]+(?=[\s,;:.]|$))+")
_SEC_WORD = r"(?:se(?:c(?:t(?:i?oi?ns?|ins?|on|io)?|ito?i?o?ns?|ions?)?|tions?)s?\.?|§+)"
_JOIN = r"(?:\s*(?:[/.,;:\-–—&]|(?:through|thru|to|and)(?![a-z])|th(?![a-z]))\s*)+"
SECTION = re.compile(rf"{_SEC_WORD}[\s:.\-–—]*(?P<first>{_N})(?P<more>(?:{_JOIN}(?:{_SEC_WORD}[\s:.\-–—]*)?{_N}(?![/½¼\d]))*)(?P<colon>\s*:)?", I)
_SEC_ONLY = re.compile(_SEC_WORD + r"[\s:.\-–—]*\d", I)
_NUMBER = re.compile(rf"(?P<thru>[\-–—]|(?:through|thru|to|th)(?![a-z]))|(?P<n>\d{{1,3}})", I)
_GUARD = re.compile(r"(?:of|said|in|within)\s*$", I)
_CONNECT = re.compile(r"^[\s,]*(?:(?:(?:that\s+)?l(?:ying|ies)\s+|all\s+)?(?:with)?in|(?:all\s+)?of)?[\s,]*$", I)
_TIDY_TAIL = re.compile(r"\s+(?:the|all in|all of|all|of|in|and)$", I)
_TIDY_ENDS = frozenset("eElLfFnNdD")
_CONTEXT = [
    ("well", re.compile(r"\bwell(?:s|bores?)?\b", I), 5, 25),
    ("depth", re.compile(r"\b(?:depths?|surf(?:ace)?|down|form(?:ations?)?|top|base)\b", I), 10, 20),
    ("including", re.compile(r"\bincl(?:\.|ud(?:es?|ing))?", I), 0, 40),
    ("less_except", re.compile(r"\b(?:less(?:\s+and\s+except)?|except\w*|limit\w*)\b", I), 0, 40),
    ("insofar", re.compile(r"\bin\s?so\s?far\b", I), 0, 40),
]
#: What a text must hold for a pattern of _CONTEXT to match.
_CONTEXT_WORDS = {"well": ("well",), "depth": ("depth", "surf", "down", "form", "top", "base"), "including": ("incl",), "less_except": ("less", "except", "limit"), "insofar": ("far",)}


_DIGITS = str.maketrans("SsOIlL", "550111")


def twprge_of(m: re.Match, o: Options) -> str:
    """Natural form such as T154N-R97W of a match."""
    g = m.groupdict()
    t, r = g["t"], g.get("r1") or g.get("r2")
    if not (t.isdecimal() and r.isdecimal()):
        t, r = t.translate(_DIGITS), r.translate(_DIGITS)
    t, r = t.lstrip("0") or "0", r.lstrip("0") or "0"
    return f"T{t}{(g.get('ns') or o.default_ns)[0].upper()}-R{r}{(g.get('ew') or o.default_ew)[0].upper()}"


def short(natural: str) -> str:
    """T154N-R97W to 154n97w."""
    return natural.replace("T", "").replace("-R", "").lower()


_PARTS = re.compile(r"(\d{1,3}[ns])(\d{1,3}[ew])$")


def parts(twprge: str, sec: str) -> tuple[str, str, str]:
    """Township, range and section of a tract; beside an erroneous Twp/Rge, and above 99, the section is erroneous."""
    m = _PARTS.match(twprge)
    return (m[1], m[2], sec if len(sec) == 2 else ERROR_SEC) if m else (ERROR_TWP, ERROR_RGE, ERROR_SEC)


def natural(short_form: str) -> str:
    """154n97w to T154N-R97W."""
    return re.sub(r"^(\d+)([ns])(\d+)([ew])$", lambda m: f"T{m[1]}{m[2].upper()}-R{m[3]}{m[4].upper()}", short_form)


_BLANKS = re.compile(r"[ \t]{2,}|\t")
_EMPTY_LINES = re.compile(r"\n{3,}")


def reduce_whitespace(text: str) -> str:
    text = _BLANKS.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " "))
    text = _EMPTY_LINES.sub("\n\n", text)
    return text[1:] if text[:1] in (" ", "\n") else text


def preprocess(text: str, o: Options) -> tuple[str, tuple[str, ...]]:
    """The text with every Twp/Rge in natural form, and those that had to be completed."""
    exact = [(m[0], twprge_of(m, o)) for m in EXACT.finditer(text)]
    before = [x for _, x in exact]
    for pattern in (_OCR, EXACT, _NEITHER, _NO_NS, _NO_EW_RE) if o.ocr_scrub else (EXACT, _NEITHER, _NO_NS, _NO_EW_RE):
        done: dict[str, str] = {}
        for found, x in exact if pattern is EXACT and not o.ocr_scrub else [(m[0], twprge_of(m, o)) for m in pattern.finditer(text)]:
            done.setdefault(found, x)
        # every occurrence of what was matched is replaced, the longest first
        for found in sorted(done, key=len, reverse=True):
            if found != done[found]:
                text = text.replace(found, done[found] + " ")
    if not o.no_pm and ("m" in text or "M" in text):
        text = _PM.sub(lambda m: m[0] if CANON.search(m[0], len(m["tr"])) else m["tr"] + " ", text)
    text = _PUNCT.sub(r"\1 ", text)
    fixed = [m[0] for m in CANON.finditer(text)]
    for x in before:
        if x in fixed:
            fixed.remove(x)
    return reduce_whitespace(text).rstrip(" \t"), tuple(fixed)


def find_twprge(text: str, o: Options = Options(), pre: bool = False) -> list[str]:
    """All Twp/Rges of a text in natural form."""
    if pre or o.ocr_scrub:
        return [m[0] for m in CANON.finditer(preprocess(text, o)[0])]
    return [twprge_of(m, o) for m in EXACT.finditer(text)]


def unpack(text: str) -> tuple[list[int], bool]:
    """Numbers of a list such as '1, 3 - 5', ranges written out; whether a range runs backwards or on the spot."""
    out: list[int] = []
    thru = odd = False
    for m in _NUMBER.finditer(text):
        if m["thru"]:
            thru = bool(out)
            continue
        n = int(m[0])
        if thru:
            a = out[-1]
            odd |= n <= a
            out += range(a + 1, n + 1) if n > a else range(a - 1, n - 1, -1)
        else:
            out.append(n)
        thru = False
    return out, odd


_SEC_AGAIN = re.compile(_SEC_WORD + r"[\s:.\-–—]*", I)


def sections_of(m: re.Match) -> tuple[list[str], bool]:
    more = m["more"]
    numbers, odd = unpack(m["first"] + _SEC_AGAIN.sub(" ", more)) if more else ([int(m["first"])], False)
    return [f"{n:02d}" for n in numbers], odd


def find_sec(text: str) -> list[str]:
    """All section numbers of a text, with two digits at least, ranges written out."""
    return [s for m in SECTION.finditer(text) for s in sections_of(m)[0]]


def deduce_layout(text: str) -> str:
    """The layout of a preprocessed text, from where its first section and first Twp/Rge stand."""
    sec, tr = _SEC_ONLY.search(text), CANON.search(text)
    if not sec or not tr:
        return "copy_all"
    if sec.start() < tr.start():
        return "S_desc_TR" if sec.start() <= 1 else "desc_STR"
    return "TR_desc_S" if len(text[tr.end() : sec.start()].strip()) >= 4 else "TRS_desc"


def cleanup(text: str) -> str:
    """A block of description without the punctuation and the connecting words at its ends."""
    while True:
        text = text.strip(" \t\r\n,;:-–—")
        m = _TIDY_TAIL.search(text) if text[-1:] in _TIDY_ENDS else None
        if not m:
            return text
        text = _TIDY_TAIL.sub("", text)


def context_flags(text: str) -> list[tuple[str, str]]:
    """(flag, text around it) of words that limit a description; hits that follow each other closely count once."""
    out = []
    lower = text.lower() if text.isascii() else None
    for name, pattern, left, right in _CONTEXT:
        # most texts hold none of the words; other alphabets have letters that count as s or k
        if lower is not None and not any(x in lower for x in _CONTEXT_WORDS[name]):
            continue
        span = None
        for m in pattern.finditer(text):
            if span and m.start() <= span[1]:
                span[1] = m.end() + right
                continue
            if span:
                out.append((name, span))
            span = [max(0, m.start() - left), m.end() + right]
        if span:
            out.append((name, span))
    return [(name, f"<{re.sub(r'\s+', ' ', text[a:b])}>") for name, (a, b) in out]


def _segments(text: str, o: Options) -> tuple[list[str], list[str]]:
    """Chunks with a Twp/Rge each, and what stands before the first or after the last."""
    marks = list(CANON.finditer(text))
    layout = o.layout or deduce_layout(text)
    if len(marks) < 2 or layout == "copy_all":
        return [text], []
    if layout in ("TRS_desc", "TR_desc_S"):
        cuts = [m.start() for m in marks] + [len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])], [text[: cuts[0]]]
    cuts = [0] + [m.end() for m in marks]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])], [text[cuts[-1] :]]


def parse_description(text: str, o: Options) -> dict:
    """{'text', 'layout', 'tracts': [(trs parts, sections, desc)], 'w': [(flag, line)], 'e': [(flag, line)]} of a description."""
    text, fixed = preprocess(text, o)
    w: list[tuple[str, str]] = []
    e: list[tuple[str, str]] = []
    if fixed:
        flag = f"fixed_twprge<{','.join(short(x) for x in fixed)}>"
        w.append((flag, ",".join(fixed)))
    layout = o.layout or deduce_layout(text)
    chunks, unused = _segments(text, o) if o.segment else ([text], [])
    parts, loose = [], [(u, 0) for u in unused if u.strip()]
    for chunk in chunks:
        own = o.layout or (deduce_layout(chunk) if o.segment else layout)
        got, free = _chunk(chunk, own, o, w, e)
        loose += [(u, k + len(parts)) for u, k in free]
        parts += got
    if o.sec_within and len(parts) == 1:
        tr, secs, desc = parts[0]
        for u, k in loose:
            u = cleanup(u)
            if u:
                desc = f"{u} {desc}".strip() if k == 0 else f"{desc} {u}".strip()
        parts, loose = [(tr, secs, desc)], []
        w += [(f"sec_within<{tr}{s}>", desc) for s in secs]
    e += [(f"unused_desc<{u}>", u) for u, _ in loose if len(u.strip()) >= 4]
    w += [(name, line) for name, line in context_flags(text)]
    tracts = [(tr, s, desc) for tr, secs, desc in parts for s in secs]
    if any("X" in tr for tr, _, _ in tracts):
        e.append(("twprge_error", ",".join(tr + s for tr, s, _ in tracts if "X" in tr)))
    e += [(f"sec_error<{tr}{s}>", desc) for tr, s, desc in tracts if len(s) > 2]
    return {"text": text, "layout": layout, "tracts": tracts, "w": w, "e": e}


def _chunk(text: str, layout: str, o: Options, w: list, e: list) -> tuple[list, list]:
    """Components (Twp/Rge, sections, block) of a chunk, and unused blocks with the number of components before them."""
    trs = [(m.start(), m.end(), short(m[0])) for m in CANON.finditer(text)]
    secs = [m for m in SECTION.finditer(text) if not any(a <= m.start() < b for a, b, _ in trs)]
    numbered = {m: sections_of(m) for m in secs}
    first = layout in ("TRS_desc", "S_desc_TR")  # the section stands before its description
    if layout != "copy_all":
        good = []
        if first:
            after = [m for m in secs if not _GUARD.search(text, 0, m.start())]
            for m in secs:
                if m not in after:
                    n, _ = numbered[m]
                    w.append((f"{'multisec' if len(n) > 1 else 'sec'}_ignored<{','.join(n)}>", m[0]))
            with_colon = [m for m in after if m["colon"]]
            if o.sec_colon_required or o.sec_colon_cautious and with_colon:
                after = with_colon
            elif o.sec_colon_cautious and after:
                w += [(f"pulled_sec_without_colon<{','.join(numbered[m][0])}>", m[0]) for m in after]
            good = after
            kept = []
            for a, b, tr in trs:
                last = max((m for m in secs if m.end() <= a), key=lambda m: m.end(), default=None)
                if last is not None and layout == "TRS_desc" and trs[0][0] != a and last.end() < a and _CONNECT.match(text[last.end() : a]) and text[last.end() : a].strip(" ,"):
                    w.append((f"twprge_ignored<{tr}>", tr))
                else:
                    kept.append((a, b, tr))
            trs = kept
        secs = good if first else secs
        for m in secs:
            numbers, odd = numbered[m]
            if len(numbers) > 1:
                w.append((f"multisec_found<{','.join(numbers)}>", m[0]))
            if odd:
                w.append(("nonsequential_sections", m[0]))
        marks = sorted([(m.start(), m.end(), "s", numbered[m][0]) for m in secs] + [(a, b, "t", tr) for a, b, tr in trs])
        ends = [(0, 0, "", None), *marks, (len(text), len(text), "", None)]
        got, free, used = [], [], set()
        for k in range(len(ends) - 1):
            block = text[ends[k][1] : ends[k + 1][0]]
            sec = k if first else k + 1
            if ends[sec][2] != "s":
                if cleanup(block):
                    free.append((block, len(got)))
                continue
            order = range(sec - 1, 0, -1) if layout in ("TRS_desc", "TR_desc_S") else range(sec + 1, len(ends) - 1)
            at = next((j for j in order if ends[j][2] == "t"), None)
            used.add(at)
            got.append(("XXXzXXXz" if at is None else ends[at][3], ends[sec][3], cleanup(block)))
        if got:
            for k, m in enumerate(marks, 1):
                if m[2] == "t" and k not in used:
                    e.append((f"unused_twprge<{m[3]}>", m[3]))
            for tr, s, _ in got:
                if "X" in tr:
                    e.append((f"twprge_error<{','.join(s)}>", ",".join(s)))
            return got, free
    numbers = numbered[secs[0]][0][:1] if secs else [ERROR_SEC]
    tr = trs[0][2] if trs else "XXXzXXXz"
    if not secs:
        e.append((f"sec_error<{tr}>", text))
    return [(tr, numbers, text)], []


# Lots and aliquots

_QUARTER = r"(?P<{0}>n(?:orth)?\.?\s?e(?:ast)?|n(?:orth)?\.?\s?w(?:est)?|s(?:outh)?\.?\s?e(?:ast)?|s(?:outh)?\.?\s?w(?:est)?)\.?"
_END = r"(?=[\s,.;½¼)]|[NSEW]|$)"
_Q_FULL = re.compile(r"(?<![A-Za-z])" + _QUARTER.format("q") + rf"(?:\s*(?:(?:one\s+)?quarter(?![a-z])|1\s?/\s?4{_END}|¼)|(?:4|\s?/4|\s/\s4){_END})", I)
_H_FULL = re.compile(rf"(?<![A-Za-z])(?P<h>north|south|east|west|no(?=\.?\s*(?:half|1/2|½))|[nsew])\.?(?:\s*(?:(?:one\s+)?half(?![a-z])|1\s?/\s?2{_END}|½)|(?:2|\s?/2|\s/\s2)(?!\s?°){_END})", I)
_BARE_Q = r"(?:NE|NW|SE|SW|north\s?east|north\s?west|south\s?east|south\s?west)"
_BARE_AFTER_HALF = re.compile(rf"(?<=½)(?P<chain>(?:\s*(?:of\s+(?:the\s+)?)?{_BARE_Q})+)(?=[\s.,;]|$|[NSEW]{{1,2}}[½¼])", I)
_BARE = re.compile(r"(?<![A-Za-z])(?P<chain>(?:NE|NW|SE|SW)+)(?![A-Za-z¼½])(?:\s?/\s?4|4)?", I)
_GLUE = re.compile(r"(?<=[½¼])\s*(?:of|if)?\s*(?:the|teh|th)?\s*(?=(?:NE|NW|SE|SW)¼|[NSEW]½)", I)
_ALIQUOT = r"(?:(?:NE|NW|SE|SW)¼|[NSEW]½)+"
_ACRES = r"(?:\s*[(\[]\s*\d{1,3}(?:\.\d{0,6})?\s*[)\]])?"
_LOT_WORD = r"L(?:ot|t)?s?\.?\s*"
_LOT_LIST = rf"(?P<lots>{_LOT_WORD}{_N}{_ACRES}(?:{_JOIN}(?:{_LOT_WORD})?{_N}(?![/½¼\d]){_ACRES})*)"
_LOTS = re.compile(rf"(?:(?P<aliquot>{_ALIQUOT})\s*(?:of\s+(?:the\s+)?)?)?(?<![A-Za-z0-9]){_LOT_LIST}", I)
_LOTS_HERE = re.compile(rf"(?P<aliquot>(?!)x)?{_LOT_LIST}", I)
_LOT_TOKEN = re.compile(rf"(?P<thru>[\-–—]|(?:through|thru|to|th)(?![a-z]))|(?P<word>L(?:ot|t)?s?\.?(?=\s*\d))|(?P<n>\d{{1,3}})(?:\s*[(\[]\s*(?P<ac>\d{{1,3}}(?:\.\d{{0,6}})?)\s*[)\]])?", I)
_BLOCK = re.compile(_ALIQUOT)
_ALL = re.compile(r"(?<![A-Za-z0-9])ALL(?P<context>.{1,6})?", I)


def scrub(text: str, clean_qq: bool = False) -> str:
    """The text with its aliquots as in 'N½NE¼'."""
    letters = lambda x: "".join(c for c in re.sub(r"north|south|east|west", lambda m: m[0][0], x, flags=I).upper() if c in "NSEW")
    text = _Q_FULL.sub(lambda m: letters(m["q"]) + "¼", text)
    before = None
    while text != before:
        before = text
        text = _H_FULL.sub(lambda m: m["h"][0].upper() + "½", text)
    if clean_qq:
        text = re.sub(r"(?<=½)(?:NE|NW|SE|SW)+(?![A-Za-z¼½])", lambda m: re.sub("..", lambda q: q[0].upper() + "¼", m[0]), text, flags=I)
        text = _BARE.sub(lambda m: re.sub("..", lambda q: q[0].upper() + "¼", m["chain"]), text)
    text = _BARE_AFTER_HALF.sub(lambda m: re.sub(rf"\s*(?:of\s+(?:the\s+)?)?({_BARE_Q})", lambda q: letters(q[1]) + "¼", m["chain"], flags=I), text)
    return _GLUE.sub("", text)


def _plain(aliquot: str) -> str:
    return aliquot.replace("½", "2").replace("¼", "")


def parse_tract(text: str, clean_qq: bool, suppress_lot_divs: bool, least: int, most: int | None, break_halves: bool) -> dict:
    """Lots, aliquots, quarter-quarters, acreages and flags of one tract's text."""
    pp = scrub(text, clean_qq)
    lots, acres, w, left, at = [], {}, [], [], 0
    # a lot may stand right behind the one before it, where the pattern looks for no letter or digit in front
    while m := _LOTS_HERE.match(pp, at) or _LOTS.search(pp, at):
        left.append(pp[at : m.start()])
        at = m.end()
        own, thru, words, through, odd = [], False, 0, None, False
        for t in _LOT_TOKEN.finditer(m["lots"]):
            if t["thru"]:
                thru = True
            elif t["word"]:
                words += 1
                if words == 2:
                    through = len(own)
            else:
                n = int(t["n"])
                if thru and own:
                    a = own[-1]
                    odd |= n <= a
                    own += range(a + 1, n + 1) if n > a else range(a - 1, n - 1, -1)
                else:
                    own.append(n)
                thru = False
                if t["ac"]:
                    lot = f"L{n}"
                    if lot in acres:
                        w.append((f"dup_lot_acreage<{lot}({acres[lot]})>",) * 2)
                    acres[lot] = t["ac"]
        if odd:
            w.append(("nonsequential_lots", m["lots"]))
        through = len(own) if through is None else through
        lead = _plain(m["aliquot"]) if m["aliquot"] and not suppress_lot_divs else None
        lots += [f"{lead} of L{n}" if lead and k < through else f"L{n}" for k, n in enumerate(own)]
    rest = ";;".join([*left, pp[at:]])
    blocks = _BLOCK.findall(rest)
    rest = _BLOCK.sub(";;", rest)
    whole = [_plain(b) for b in blocks]
    m = _ALL.search(re.sub(r"\s+", " ", rest).strip())
    if m and m["context"] is None:
        blocks.append("ALL")
    qqs = [q for b in blocks for q in expand(b, least, most, break_halves)]
    for name, xs in (("dup_lot", lots), ("dup_qq", qqs)):
        again, last = [], {x: k for k, x in enumerate(xs)}
        again = [x for k, x in enumerate(xs) if last[x] > k]
        if again:
            w.append((f"{name}<{','.join(again)}>", ",".join(again)))
    return {"pp": pp, "lots": lots, "qqs": qqs, "whole": whole, "acres": acres, "w": w}
