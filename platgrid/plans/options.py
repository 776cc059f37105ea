"""Parse options: immutable, built on the driver and captured into the plan."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields, replace

LAYOUTS = ("TRS_desc", "desc_STR", "S_desc_TR", "TR_desc_S", "copy_all")
ERROR_TWP = ERROR_RGE = "XXXz"
ERROR_SEC = "XX"
UNDEF_TWP = UNDEF_RGE = "___z"
UNDEF_SEC = "__"


class ConfigError(TypeError):
    """An option of the wrong type."""


class DefaultNSError(ValueError):
    """A default that is neither n nor s."""


class DefaultEWError(ValueError):
    """A default that is neither e nor w."""


@dataclass(frozen=True)
class Options:
    default_ns: str = "n"
    default_ew: str = "w"
    layout: str | None = None
    wait_to_parse: bool = False
    parse_qq: bool = False
    clean_qq: bool = False
    sec_colon_required: bool = False
    sec_colon_cautious: bool = False
    suppress_lot_divs: bool = False
    ocr_scrub: bool = False
    segment: bool = False
    qq_depth: int | None = None
    qq_depth_min: int = 2
    qq_depth_max: int | None = None
    break_halves: bool = False
    sec_within: bool = False
    no_pm: bool = False

    def __post_init__(self):
        if self.default_ns not in ("n", "s"):
            raise DefaultNSError(f"default_ns must be n or s: {self.default_ns!r}")
        if self.default_ew not in ("e", "w"):
            raise DefaultEWError(f"default_ew must be e or w: {self.default_ew!r}")
        if self.layout is not None and self.layout not in LAYOUTS:
            raise ValueError(f"no such layout: {self.layout!r}")
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name.startswith("qq_depth") and v is not None and (isinstance(v, bool) or not isinstance(v, int)):
                raise ConfigError(f"{f.name} must be a whole number: {v!r}")
            if isinstance(f.default, bool) and not isinstance(v, bool):
                raise ConfigError(f"{f.name} must be true or false: {v!r}")

    @classmethod
    def default(cls) -> Options:
        """What holds where no options are given."""
        return _default[0]

    @classmethod
    def set_default(cls, options: Options | None = None) -> None:
        """Makes options hold for all plans built from now on in this process where none are given; None: the original ones."""
        _default[0] = options or cls()

    @classmethod
    def parse(cls, text: str | None, base: Options | None = None) -> Options:
        """Options of a text such as 'n, w; clean_qq, qq_depth.3, segment=False'."""
        if text is None:
            return base or cls.default()
        if not isinstance(text, str):
            raise ConfigError(f"options must be text: {text!r}")
        found: dict = {}
        known = {f.name: f for f in fields(cls)}
        for item in filter(None, (x.strip() for x in re.split("[,;]", text))):
            name, _, value = (x.strip() for x in re.sub(r"\s*[.=]\s*", "\0", item, count=1).partition("\0"))
            if not value and name.lower() in "ns" and len(name) == 1:
                found["default_ns"] = name.lower()
            elif not value and name.lower() in "ew" and len(name) == 1:
                found["default_ew"] = name.lower()
            elif not value and name in LAYOUTS:
                found["layout"] = name
            elif name.startswith("qq_depth") and name in known and value.isdigit():
                found[name] = int(value)
            elif name in ("default_ns", "default_ew", "layout") and value:
                found[name] = value if name == "layout" else value.lower()
            elif name in known and isinstance(known[name].default, bool) and value in ("", "True", "False"):
                found[name] = value != "False"
            else:
                raise ValueError(f"no such option: {item!r}")
        return replace(base or cls.default(), **found)

    @classmethod
    def from_dict(cls, values: dict) -> Options:
        """Options of a dict; names that are no option are an error."""
        return cls(**values)

    from_kwargs = classmethod(lambda cls, **values: cls(**values))

    def child(self, **changed) -> Options:
        """A full copy, with changes."""
        return replace(self, **changed)

    def to_text(self) -> str:
        """A text that parse() turns into equal options."""
        out = []
        for f in fields(self):
            v = getattr(self, f.name)
            if v != f.default:
                out.append(f.name if v is True else f"{f.name}.{v}")
        return ",".join(out)

    def to_dict(self) -> dict:
        return asdict(self)

    def depths(self) -> tuple[int, int | None]:
        """(least, greatest) depth to which aliquots are divided; an exact depth is both."""
        return (self.qq_depth, self.qq_depth) if self.qq_depth is not None else (self.qq_depth_min, self.qq_depth_max)


_default = [Options()]
