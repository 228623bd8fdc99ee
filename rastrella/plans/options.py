"""Options of a run, as keyword arguments or as the flags of a command line."""

from __future__ import annotations

import getopt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from rastrella.functions import requests

# The flags, those with a colon take a value; the formats that small and capital letters stand for.
FLAGS = "D:F:I:JM:NPQRVWdhjlno:pq:rs:vwz:"
FORMATS = {"j": "JPEG", "p": "PNG", "r": "RAW", "w": "WEBP"}
MOST_WHOLE = 4


@dataclass(frozen=True)
class Options:
    """``whole`` and ``tile`` formats, zooms, and how images are made; ``inputs`` are requests, or ``-`` for a feed."""

    inputs: tuple[str, ...] = ()
    fill: int = 0
    interpolation: str = "linear"
    memory_limit: float | None = None
    quality: int | None = None
    scale: int = 1
    warp: bool = True
    folder: str = ""
    whole: tuple[str, ...] = ()
    tile: str | None = None
    whole_default: bool = True
    zooms: tuple[int, ...] = ()
    level: int = 0
    show: str | None = None

    def whole_formats(self) -> tuple[str, ...]:
        """Formats of the whole image: those asked for, else that of the tiles unless this is switched off."""
        return self.whole or ((self.tile or "JPEG",) if self.whole_default else ())

    def alpha_wanted(self, feature: str = "") -> bool:
        """Whether an alpha channel is made: for a feature, or if a format can hold one."""
        return feature != "" or any(f in ("PNG", "WEBP") for f in (*self.whole_formats(), self.tile))


def parse(args: Sequence[str]) -> Options:
    """Options of a command line. Flags of devices (D, d, l) are accepted and have no effect here.

    Raises ``ValueError`` for what cannot be: a fill colour beyond 8 bits, too many formats or zooms, no input.
    """
    try:
        found, inputs = getopt.getopt(list(args), FLAGS)
    except getopt.GetoptError as e:
        raise ValueError(str(e)) from None
    out, whole = Options(tuple(inputs)), []
    for flag, value in found:
        name = flag[1]
        if name.lower() in FORMATS:
            if name.islower():
                out = replace(out, tile=FORMATS[name])
            else:
                whole.append(FORMATS[name.lower()])
        elif name == "F":
            out = replace(out, fill=int(value, 0))
        elif name == "I":
            out = replace(out, interpolation="nearest" if value in ("1", "nearest") else "linear")
        elif name == "M":
            out = replace(out, memory_limit=float(value) * 1e9)
        elif name == "N":
            out = replace(out, whole_default=False)
        elif name in "Qv":
            out = replace(out, level=out.level + (1 if name == "v" else -1))
        elif name in "Vh":
            out = replace(out, show={"V": "version", "h": "help"}[name])
        elif name == "n":
            out = replace(out, warp=False)
        elif name == "o":
            out = replace(out, folder=value.rstrip("/") + "/")
        elif name == "q":
            out = replace(out, quality=int(value))
        elif name == "s":
            out = replace(out, scale=int(value))
        elif name == "z":
            out = replace(out, zooms=tuple(int(z, 0) for z in value.split(",") if z))
    out = replace(out, whole=tuple(whole))
    if not 0 <= out.fill <= 255:
        raise ValueError("the fill colour has 8 bits")
    if len(out.whole) > MOST_WHOLE or len(out.zooms) > requests.MOST_ZOOMS or any(z > requests.MOST_ZOOMS for z in out.zooms):
        raise ValueError("too many formats or zooms")
    if not out.inputs and not out.show:
        raise ValueError("no input")
    return out
