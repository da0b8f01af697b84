"""Problem 1: texts over a token budget cut into pieces at natural boundaries.

Tokens are counted by rule: a run of letters and digits of length n counts
ceil(n / 8), every other character one, blanks none. Sliding blocks of BLOCK
words to both sides of each gap between words are compared; their similarity
has valleys where the topic changes. Boundaries are natural (ends of
paragraphs, sentences, lines), else ends of clauses, else blanks. Within the
window in which a piece may end, the boundary with the deepest valley is taken;
the kind of boundary and then the later place only break ties. Weaker
boundaries count only where a window has no stronger one. Without any boundary
the cut is at a token.

A piece after the first begins so far before the cut that it repeats
``overlap_tokens`` tokens. A piece never exceeds the budget, the overlap
included; each adds at least one token. Pieces cover the text.

Defined cases: a null text gives one piece with a null text and no tokens; an
empty text one empty piece; a null budget leaves the text whole, a budget below
one counts as one; a null or negative overlap is none, one not below the budget
is the budget less one; a null offset counts as 0. Each row is replaced by its
own pieces, so rows delivered twice give their pieces twice, and rows with one
id and different texts keep both; ``once`` drops whole duplicates before.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

RUN = 8
#: Words on each side of a gap that are compared.
BLOCK = 40
#: A piece ends in the last part of what the budget allows, if that part has a boundary.
LEAST_FILL = 0.5

_TOKEN = re.compile(r"[^\W_]{1,%d}|[^\w \t\r\n ]|_" % RUN)
_WORD = re.compile(r"[^\W\d_]{3,}")
#: Kinds of boundaries; the cut is after the match.
_BOUNDARY = re.compile(
    r"(?P<para>\r?\n[ \t]*(?:\r?\n[ \t]*)+)|(?P<sent>(?<![.!?…])[.!?…]++[\"'»”’)\]*_]*+(?:[ \t\xa0]*\r?\n|[ \t\xa0]+))|(?P<line>\r?\n)|(?P<clause>[,;:|)\t–—]+[ \t\xa0]*)|(?P<word>[ \t\xa0]+)"
)
#: The tier of a kind and its rank among equals.
_TIER = {"para": (0, 2), "sent": (0, 1), "line": (0, 0), "clause": (1, 0), "word": (2, 0)}


def token_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a text."""
    return [m.span() for m in _TOKEN.finditer(text)]


def _similarities(words: list[str]) -> np.ndarray:
    """The cosine of the counts of the BLOCK words before and after each gap; gap i is before word i.

    Dot product and norms are kept up as the blocks move by one word, so the work is linear.
    """
    n = len(words)
    ids = {}
    w = [ids.setdefault(x, len(ids)) for x in words]
    left, right = [0] * len(ids), [0] * len(ids)
    dot = nl = nr = 0
    for x in w[:BLOCK]:
        nr += 2 * right[x] + 1
        right[x] += 1
    out = np.zeros(n + 1)
    for i in range(1, n):
        x = w[i - 1]
        # Word i - 1 goes from the right block to the left one.
        nr += 1 - 2 * right[x]
        dot -= left[x]
        right[x] -= 1
        nl += 2 * left[x] + 1
        dot += right[x]
        left[x] += 1
        if i + BLOCK - 1 < n:
            x = w[i + BLOCK - 1]
            nr += 2 * right[x] + 1
            dot += left[x]
            right[x] += 1
        if i > BLOCK:
            x = w[i - 1 - BLOCK]
            nl += 1 - 2 * left[x]
            dot -= right[x]
            left[x] -= 1
        out[i] = dot / (nl * nr) ** 0.5
    return out


def _valleys(text: str, cuts: list[int]) -> np.ndarray:
    """For each cut, how much less alike its two sides are than at the nearest peaks on both sides; 0 to 1."""
    found = list(_WORD.finditer(text))
    starts = [m.start() for m in found]
    similar = _similarities([m[0].lower() for m in found])
    sim = similar[[bisect.bisect_left(starts, c) for c in cuts]] if cuts else np.zeros(0)
    rise_l, rise_r = sim.copy(), sim.copy()
    for i in range(1, len(sim)):
        if rise_l[i - 1] > sim[i]:
            rise_l[i] = rise_l[i - 1]
    for i in range(len(sim) - 2, -1, -1):
        if rise_r[i + 1] > sim[i]:
            rise_r[i] = rise_r[i + 1]
    return np.round((rise_l - sim + rise_r - sim) / 2, 9)


def split_text(text: str, budget: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text."""
    budget = max(1, budget)
    overlap = min(max(0, overlap), budget - 1)
    tokens = token_spans(text)
    if len(tokens) <= budget:
        return [(0, len(text), len(tokens))]
    starts = [t[0] for t in tokens]
    cuts: list[list[int]] = [[], [], []]
    ranks: list[list[int]] = [[], [], []]
    for m in _BOUNDARY.finditer(text):
        if m.end() not in (0, len(text)):
            tier, rank = _TIER[m.lastgroup]
            cuts[tier].append(m.end())
            ranks[tier].append(rank)
    depth: list[np.ndarray | None] = [None, None, None]

    def deepest(floor: int, limit: int) -> int:
        """The boundary after floor, up to limit, of the strongest tier there, with the deepest valley; 0 without any."""
        for tier in range(3):
            a, b = bisect.bisect_right(cuts[tier], floor), bisect.bisect_right(cuts[tier], limit)
            if a < b:
                if depth[tier] is None:
                    depth[tier] = _valleys(text, cuts[tier])
                return cuts[tier][max(range(a, b), key=lambda i: (depth[tier][i], ranks[tier][i], i))]
        return 0

    out: list[tuple[int, int, int]] = []
    first, begin, covered = 0, 0, 0
    while True:
        last = first + budget
        if last >= len(tokens):
            out.append((begin, len(text), len(tokens) - first))
            return out
        # The cut may be anywhere up to the start of the token that no longer fits, and after what is covered.
        limit = starts[last]
        cut = deepest(starts[max(covered, first + int(budget * LEAST_FILL))], limit) or deepest(starts[covered] if covered > first else starts[first], limit)
        after = bisect.bisect_left(starts, cut) if cut else 0
        if after <= covered or after <= first:
            cut, after = limit, last
        out.append((begin, cut, after - first))
        covered = after
        first = max(first + 1, after - overlap)
        begin = starts[first] if overlap and first < after else cut


PIECE_DDL = "piece_no int, n_pieces int, text string, piece_offset int, token_count int, oversized boolean"


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", offset_col: str = "text_offset", budget_col: str = "token_budget", overlap_col: str = "overlap_tokens", once: bool = False) -> DataFrame:
    """(id_col, PIECE_DDL): the pieces of each row; a row within its budget is its only piece. A map without a shuffle, but for ``once``."""
    src = df.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).cast("string").alias("body"), *[F.col(c).cast("int").alias(n) for c, n in ((offset_col, "at"), (budget_col, "budget"), (overlap_col, "over"))])
    if once:
        src = src.distinct()
    names = [x.split()[0] for x in PIECE_DDL.split(", ")]

    def make():
        def fn(cols):
            out: dict[str, list] = {n: [] for n in ("key", *names)}
            for key, body, at, budget, over in zip(*(cols[c] for c in ("key", "body", "at", "budget", "over"))):
                if body is None:
                    rows = [(0, 1, None, at or 0, 0, False)]
                else:
                    n = budget if budget is not None else max(1, len(body))
                    pieces = split_text(body, n, over or 0)
                    rows = [(i, len(pieces), body[a:b], (at or 0) + a, t, len(pieces) > 1) for i, (a, b, t) in enumerate(pieces)]
                for r in rows:
                    for name, v in zip(out, (key, *r)):
                        out[name].append(v)
            return out

        return fn

    return map_rows(src, make, f"key bigint, {PIECE_DDL}", batch_rows=500).withColumnRenamed("key", id_col)
