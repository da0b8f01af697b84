"""Keyed pseudonyms that keep the format of a value.

A value is permuted within the set of values of its own format by a Feistel
network. Every letter, digit and vowel sign is a place with an alphabet: the
characters of its own script and kind (capital, small, without case, digit), so
Cyrillic stays Cyrillic and no such character stays in clear. Marks, blanks and
punctuation stay. The places of a value are one number of mixed radix, in
blocks of sixteen places whose tweak holds the blocks before.

Identity numbers with check digits (``SCHEMES``) stay valid: the payload is
permuted and its check made anew. Those without a valid check stay without.
Dates of birth stay dates: their day is permuted within ``DAYS``. Each of these three is a
permutation of its own set, reached by walking on until the set is met again,
so ``decrypt`` turns all of them back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

_ROUNDS = 10
_BLOCK = 16
#: A block of 128 with fewer letters of a kind is no alphabet of its own.
FEW = 8
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049


# ---- alphabets ------------------------------------------------------------


def _class_of(c: str) -> tuple | None:
    """What a character is exchanged within: its script, kind and, for scripts with case, block of 128; null for those that stay."""
    kind = unicodedata.category(c)
    if kind[0] not in "LN" and kind != "Mc":
        return None
    name = unicodedata.name(c, "")
    if not name:
        return (kind, ord(c) >> 7)
    script = re.split(r"[ -]", name)[0]
    return (script, kind, ord(c) >> 7) if kind in ("Lu", "Ll", "Nd") else (script, kind)


def _place(c: str) -> tuple[str, int, str] | None:
    """(alphabet, index, sign of the class) of a character."""
    for first, radix in (("0", 10), ("A", 26), ("a", 26)):
        if first <= c < chr(ord(first) + radix):
            return _ascii(first, radix), ord(c) - ord(first), first
    own = _class_of(c)
    if own is None:
        return None
    a = _alphabet(own, ord(c) > 0xFFFF)
    return (a, a.index(c), a[0]) if len(a) > 1 else None


class _Places(dict):
    """The place of each character, worked out once."""

    def __missing__(self, c: str) -> tuple[str, int, str] | None:
        got = self[c] = _place(c)
        return got


_PLACES = _Places()


@lru_cache(maxsize=8)
def _ascii(first: str, radix: int) -> str:
    return "".join(chr(ord(first) + i) for i in range(radix))


@lru_cache(maxsize=64)
def _alphabet(own: tuple, wide: bool) -> str:
    """All characters of a class; blocks of few such characters are one class together."""
    whole = range(0x10000, 0x110000) if wide else range(0x80, 0x10000)
    if not isinstance(own[-1], int):
        return "".join(chr(x) for x in whole if not 0xD800 <= x < 0xE000 and _class_of(chr(x)) == own)
    a = _in_block(own)
    if len(a) >= FEW:
        return a
    blocks = sorted({k for x in whole if not 0xD800 <= x < 0xE000 and (k := _class_of(chr(x))) and k[:-1] == own[:-1]})
    return "".join(b for k in blocks if len(b := _in_block(k)) < FEW)


def _in_block(own: tuple) -> str:
    return "".join(chr(x) for x in range(own[-1] << 7, (own[-1] + 1) << 7) if x > 0x7F and _class_of(chr(x)) == own)


# ---- check digits ---------------------------------------------------------

_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _dni(p: str) -> str:
    return _DNI[int({"X": "0", "Y": "1", "Z": "2"}.get(p[0], p[0]) + p[1:]) % 23]


def _cpf(p: str) -> str:
    for n in (10, 11):
        p += str(sum(int(d) * (n - i) for i, d in enumerate(p)) * 10 % 11 % 10)
    return p[-2:]


def _nir(p: str) -> str:
    return f"{97 - int(p) % 97:02}"


_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def _fiscale(p: str) -> str:
    at = [int(c) if c.isdigit() else ord(c) - 65 for c in p]
    return chr(65 + sum(_ODD[n] if i % 2 == 0 else n for i, n in enumerate(at)) % 26)


def _bsn(p: str) -> str | None:
    r = sum(int(d) * (9 - i) for i, d in enumerate(p)) % 11
    return str(r) if r < 10 else None


def _pt_nif(p: str) -> str:
    r = 11 - sum(int(d) * (9 - i) for i, d in enumerate(p)) % 11
    return str(r if r < 10 else 0)


def _steuer_id(p: str) -> str:
    r = 10
    for d in p:
        s = (int(d) + r) % 10 or 10
        r = 2 * s % 11
    return str((11 - r) % 10)


def _pesel(p: str) -> str:
    return str(-sum(int(d) * (1, 3, 7, 9)[i % 4] for i, d in enumerate(p)) % 10)


#: Name, payload and check of numbers of persons, and the check that belongs to a payload. The first scheme that holds is that of the number.
SCHEMES: tuple[tuple[str, re.Pattern, Callable[[str], str | None]], ...] = tuple(
    (name, re.compile(p), check)
    for name, p, check in (
        ("dni", r"(\d{8}|[XYZ]\d{7})([A-Z])", _dni),
        ("codice fiscale", r"([A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3})([A-Z])", _fiscale),
        ("nir", r"([12]\d{12})(\d{2})", _nir),
        ("cpf", r"(\d{9})(\d{2})", _cpf),
        ("steuer-id", r"([1-9]\d{9})(\d)", _steuer_id),
        ("pesel", r"(\d{10})(\d)", _pesel),
        ("bsn", r"(\d{8})(\d)", _bsn),
        ("pt nif", r"([1-35689]\d{7})(\d)", _pt_nif),
    )
)


def scheme_of(value: str) -> int | None:
    """The place in SCHEMES of the first scheme whose check a number without separators keeps."""
    if not value.isascii() or not value[-9:-1].isalnum() or not 9 <= len(value) <= 16:
        return None
    for i, (_, pattern, check) in enumerate(SCHEMES):
        m = pattern.fullmatch(value)
        if m and check(m[1]) == m[2]:
            return i
    return None


# ---- the cipher -----------------------------------------------------------

_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})", re.A)


def _day_of(value: str) -> int | None:
    m = _DATE.fullmatch(value)
    if not m:
        return None
    try:
        n = (datetime.date(*map(int, m.groups())) - FIRST_DAY).days
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


class Feistel:
    """The permutation of a key. The key has no default: who knows it can turn pseudonyms back."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def permute(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of 0..size-1: a network over the next a*a >= size, walked until it is back in range."""
        if size < 2:
            return value
        a = _root(size)
        # A round's function: 48 bytes of keyed hash, far longer than the halves of a block, modulo their size.
        base = hashlib.blake2b(tweak, key=self.key, digest_size=48)
        while True:
            left, right = divmod(value, a)
            for i in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
                h = base.copy()
                h.update(b"%d|%d" % (i, left if i & 1 else right))
                f = int.from_bytes(h.digest(), "big")
                if back:
                    f = -f
                if i & 1:
                    right = (right + f) % a
                else:
                    left = (left + f) % a
            value = left * a + right
            if value < size:
                return value

    def _text(self, value: str, kind: str, back: bool) -> str:
        places = list(map(_PLACES.__getitem__, value))
        at = [(i, p) for i, p in enumerate(places) if p]
        out = list(value)
        base = f"{kind}|{''.join([p[2] if p else c for p, c in zip(places, value)])}|"
        for b in range(0, len(at), _BLOCK):
            block = at[b : b + _BLOCK]
            size, n = 1, 0
            for _, (alphabet, index, _) in block:
                radix = len(alphabet)
                n = n * radix + index
                size *= radix
            # The tweak holds the pseudonym so far, which both directions know.
            before = value if back else out
            n = self.permute(n, size, (base + "".join(before[: block[0][0]])).encode("utf-8", "replace"), back)
            for i, (alphabet, _, _) in reversed(block):
                n, r = divmod(n, len(alphabet))
                out[i] = alphabet[r]
        return "".join(out)

    def _step(self, value: str, kind: str, scheme: int | None, back: bool) -> str:
        if scheme is None:
            return self._text(value, kind, back)
        name, pattern, check = SCHEMES[scheme]
        payload, old = pattern.fullmatch(value).groups()
        while True:
            payload = self._text(payload, f"{kind}|{name}", back)
            # First letters or digits that the format doesn't have, and payloads without a check, are walked past.
            new = check(payload) if pattern.fullmatch(payload + old) else None
            if new is not None:
                return payload + new

    def _run(self, value: str, kind: str, back: bool) -> str:
        if kind == "BIRTH_DATE":
            day = _day_of(value)
            if day is not None:
                return str(FIRST_DAY + datetime.timedelta(self.permute(day, DAYS, b"date", back)))
            out = self._text(value, kind, back)
            while _day_of(out) is not None:
                out = self._text(out, kind, back)
            return out
        if kind != "IDENTITY_DATA":
            return self._text(value, kind, back)
        scheme = scheme_of(value)
        out = value
        while True:
            out = self._step(out, kind, scheme, back)
            if scheme_of(out) == scheme:
                return out

    def encrypt(self, value: str, kind: str) -> str:
        return self._run(value, kind, False)

    def decrypt(self, value: str, kind: str) -> str:
        return self._run(value, kind, True)


@lru_cache(maxsize=4096)
def _root(size: int) -> int:
    """The least a with a * a >= size."""
    import math

    a = math.isqrt(size)
    return a if a * a >= size else a + 1
