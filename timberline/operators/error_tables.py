"""Error codes by domain: the dimension that lookups use, and how numbers are tried in it.

The codes are fixed values: domains, numbers and symbols have to be these for lookups to give the
expected matches. They are plain rows of ``error_codes.csv`` beside this file, one a code, in the order
of domains; descriptions are for the most part the customary wording of these systems, not our own.
"""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

CODES_FILE = Path(__file__).with_name("error_codes.csv")

# Domains in the order numbers are tried.
DOMAINS = [
    "errno",
    "OSStatus",
    "IOReturn",
    "Mach",
    "CFNetwork",
    "Cocoa",
    "Security",
    "POSIX Signal",
    "SQLite",
    "gRPC",
    "Bonjour",
    "Exit Code",
    "HTTP",
]

# Numbers a domain is tried for; the others take any 32-bit number.
NUMBER_RANGE = {"gRPC": (0, 16), "Exit Code": (0, 255), "HTTP": (1, 599)}


class Code(NamedTuple):
    domain: str
    code: int
    symbol: str
    description: str


def load_codes(path: str | Path) -> list[Code]:
    """Codes from a CSV file of the driver with the header ``domain,code,symbol,description``."""
    with open(path, newline="", encoding="utf-8") as f:
        return [Code(r["domain"], int(r["code"]), r["symbol"], r["description"]) for r in csv.DictReader(f)]


@lru_cache(maxsize=1)
def built_in_codes() -> tuple[Code, ...]:
    """All codes, domain by domain, with 32-bit numbers."""
    return tuple(load_codes(CODES_FILE))
