"""Checks of numbers and addresses: one implementation for the scanner, sessions and columns."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WS


def luhn(value: str) -> bool:
    """13 to 19 digits, not all alike, with a valid check digit."""
    digits = [int(c) for c in value if "0" <= c <= "9"]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    doubled = [divmod(2 * d, 10) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(a + b for a, b in doubled)) % 10 == 0


_BLANKS = re.compile(f"[{re.escape(PY_WS)}-]")
_ACCOUNT = re.compile("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def iban(value: str) -> bool:
    """Country, check digits and account, whose mod-97 remainder is one; blanks and hyphens don't count."""
    compact = _BLANKS.sub("", value).upper()
    return bool(_ACCOUNT.fullmatch(compact)) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def ipv6(value: str) -> bool:
    """Eight groups of one to four hex digits, or fewer around one "::"; no zone and no dotted end."""
    if not re.fullmatch("[0-9A-Fa-f:]*", value):
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def _column(check: Callable[[str], bool]) -> Callable[[Column], Column]:
    def of(value: Column) -> Column:
        @F.udf("boolean", useArrow=True)
        def run(v):
            return None if v is None else check(v)

        return run(value)

    return of


luhn_valid, iban_valid, ipv6_valid = _column(luhn), _column(iban), _column(ipv6)
