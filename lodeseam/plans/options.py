"""What a scan is told: options, their defaults, and the command line's words for them."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from lodeseam.functions.detect import switched
from lodeseam.functions.registry import FORMATS


@dataclass(frozen=True)
class ScanOptions:
    verify: bool = True
    block_bytes: int = 100 << 20
    intense: bool = False
    intense_limit: int = 9
    brute: bool = False
    brute_limit: int = 12
    mjpeg: bool = True
    brunsli: bool = True
    packjpg_fallback: bool = True
    min_identical: int = 4
    formats: tuple[str, ...] = tuple(n for _, n, *_ in FORMATS[1:])
    meta_block: int = 65536
    verify_parameters: bool = True
    max_depth: int | None = None
    ignored: tuple[int, ...] = ()
    max_output: int = 1 << 28
    inside: bool = True

    def with_(self, **changes) -> ScanOptions:
        return dataclasses.replace(self, **changes)


DEFAULTS = ScanOptions()


@dataclass(frozen=True)
class Command:
    """A parsed command line: what to do with which file, and how."""

    operation: str
    source: str | None
    target: str | None
    options: ScanOptions
    verbose: bool = False
    keep_extension: bool = False


class UsageError(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


#: Depth that the command line sets where none is given; the library has none.
COMMAND_DEPTH = 10


def parse(arguments: list[str]) -> Command:
    """-r rebuilds, -comfort decides by the file, -oFILE, -e, -v, -verify, -dN, -intense[N], -brute[N], -t+LETTERS, -t-LETTERS, -sN."""
    operation, source, target, verbose, keep = "precompress", None, None, False, False
    options = ScanOptions(max_depth=COMMAND_DEPTH)
    depth_set = size_set = False
    for word in arguments:
        name = word[1:].lower()
        if not word.startswith("-") or word == "-":
            if source is not None:
                raise UsageError(12, "More than one input file given")
            source = word
        elif name == "r":
            operation = "recompress"
        elif name == "comfort":
            operation = "comfort"
        elif name == "longhelp":
            operation = "help"
        elif name == "verify":
            options = options.with_(verify=True)
        elif name in ("v", "vstderr"):
            verbose = True
        elif name == "e":
            keep = True
        elif name.startswith(("intense", "brute")):
            kind = "intense" if name.startswith("intense") else "brute"
            number = name.removeprefix(kind)
            if number and not number.isdigit():
                raise UsageError(1, f"unknown switch {word}")
            limit = int(number) if number else getattr(options, f"{kind}_limit")
            options = options.with_(**{kind: True, f"{kind}_limit": limit})
        elif name.startswith("o"):
            if target is not None:
                raise UsageError(11, "More than one output file given")
            if not (target := word[2:]):
                raise UsageError(10, "Please don't use a space between the -o switch and the output filename")
        elif name.startswith("d") and name[1:].isdigit():
            if depth_set:
                raise UsageError(8, "Recursion depth can only be set once")
            depth_set = True
            options = options.with_(max_depth=int(name[1:]) or COMMAND_DEPTH)
        elif name.startswith("s") and name[1:].isdigit():
            if size_set:
                raise UsageError(9, "Minimal identical size can only be set once")
            size_set = True
            options = options.with_(min_identical=int(name[1:]))
        elif name[:2] in ("t+", "t-"):
            options = options.with_(formats=tuple(switched(name)))
        else:
            raise UsageError(1, f"unknown switch {word}")
    return Command(operation, source, target, options, verbose, keep)
