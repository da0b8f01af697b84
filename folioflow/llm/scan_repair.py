"""Problem 4: repair of text from scanned pages.

The words of all pages are shuffled once, by page. One pass over the pages
(``layout``) does what looks at single words and lines and writes a table of
small facts: edge lines, ends of lines, cut lines, counts of word forms, odd
words, and the words of each page as one row. All else is joins and counts of
such facts; only the fixes and the paragraphs read the pages again.

* Edge lines: the first and the last line of a page are running lines if they
  stand apart, are page numbers, break off although the next word had room, or
  end like the edge lines of other documents and unlike body lines.
* Hyphens: a word cut at a line end is joined with the first word of the next
  body line, on the next page if need be. How often the word is printed whole,
  with and without its hyphen, tells a cut word from a compound.
* Misread words: each word form has an anagram hash, the sum of the hashes of
  its characters, so a confusion such as "rn" for "m" changes it by a fixed
  difference. Doubtful forms (low mean confidence, or far rarer) and trusted
  forms meet in an equi-join on the hash after up to two differences; edit
  distance and counts verify and rank what meets. Words whose form has a fix are
  found through a bitmap of the fixed forms and an equi-join on the form, so
  frequent words are never shuffled.

Forms are counted over all words; running lines and the halves of cut words,
which are few, are then taken off.

Defined cases: blank words and rows without document, page or line are left
out; rows delivered twice count once; a null confidence says nothing; pages
without words give nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Filter, arrow_schema, bitmap, map_rows, written

#: What was printed and what is read for it.
CONFUSIONS = (
    "e>c a>o n>ri o>0 t>f i>! s>5 i>l d>cl l>1 u>ii g>q h>b m>rn b>6 w>vv i>1 l>i c>e o>a f>t q>g b>h l>! l>| i>| "
    "z>2 g>9 b>8 t>7 ü>u ö>o ä>a é>e è>e ê>e ç>c ñ>n ã>a õ>o á>a à>a í>i ó>o ú>u é>6 in>m n>u u>n m>nn rn>m cl>d ri>n"
)
#: Mean confidence below which a form is doubtful, and from which it is trusted.
DOUBTFUL, TRUSTED = 84.0, 85.0
#: A trusted form must be so many times as frequent, after one and after two differences.
LEAD_ONE, LEAD_TWO = 2, 5
#: A form that is not doubtful by its confidence must be so many times rarer.
LEAD_SURE = 50
#: The same for forms of two or three letters.
LEAD_SHORT = 300
#: So many different edge lines with the same end make it that of a running title; copies of a page don't.
EDGE_TEXTS = 3

_HYPHEN = "[-\u2010\u2011\u00ad\u00ac\u2013~]"
_PAGE_NUMBER = (
    r"(?i)^\W*(?:p(?:age|ág|\.)?\.?|seite|s\.|pagina|página|blz\.?)?\W*(?:[0-9lOIo]{1,4}|[ivxl!1]{1,6})(?:\s*(?:/|of|von|de|di|van|sur)\s*[0-9lOI]{1,4})?\W*$"
)
_NUMBERED = r"^[0-9lO]{1,3}\.\s"
_END = r"[.!?;:,…][\"'»”’)\]]*$"



#: Rows that no single delivery of a page has.
HOT_ROWS = 100_000
#: Fixes that are broadcast; more are met in a shuffle.
BROADCAST_ROWS = 200_000
#: Word forms a task of the layout counts before it writes them.
KEPT_FORMS = 200_000
#: Small facts in one row.
PACK = 5_000
#: Confidences are summed as whole millionths, so that sums can be taken off again.
MILLION = 1_000_000


# ---- words ----------------------------------------------------------------

_AROUND = re.compile(r"^[(\[\"“„«¿¡*'‘]+|[.,;:!?)\]\"”»…*'’]+$")
#: Digits or marks among letters, letters among digits; codes such as "AB-123" are neither.
_ODD = regex.compile(
    r"(?!\p{L}{1,4}-?[0-9]+$|[0-9]+(?:st|nd|rd|th|er|re|e|ème|te[nr]?|de)$)(?:.*\p{Ll}[0-9!|]\p{Ll}.*|[0-9!|]\p{Ll}{2,}.*|.*\p{Ll}{2,}[0-9|].*|(?=.*[0-9])[0-9.,:/]*[lOI][0-9lOI.,:/]*)"
)
_ODD_MARKS = re.compile(r"[0-9!|lOI]")
_ODD_AROUND = re.compile(r"^\W+|[.,;:?)\]\"”»!]+$")
_TAIL_MARKS = re.compile(r"[.,;:?)\]\"”»!]+$")
_CUT = regex.compile(rf"\p{{L}}[\p{{L}}0-9!|]*{_HYPHEN}$")
_GOES_ON = regex.compile(r"^\W*[\p{L}0-9!|]")
_OWN = regex.compile(r"^\W*[\p{Lu}0-9]")


def core(text: str) -> str:
    """A printed word without the marks around it, in small letters; marks inside stay."""
    return _AROUND.sub("", text).lower()


def is_odd(text: str) -> bool:
    """Whether digits or marks stand among a word's letters, or letters among its digits."""
    return bool(_ODD_MARKS.search(text)) and bool(_ODD.fullmatch(_ODD_AROUND.sub("", text)))


class _Words(dict):
    """(form, whether it is odd) of each printed word."""

    def __missing__(self, text: str) -> tuple[str, bool]:
        if len(self) > 500_000:
            self.clear()
        got = self[text] = (core(text), is_odd(text))
        return got


def anagram_hash(word: str) -> int:
    """The sum of the hashes of a word's characters."""
    return sum(map(_CHAR_HASHES.__getitem__, word))


class _CharHashes(dict):
    def __missing__(self, c: str) -> int:
        h = self[c] = xxhash.xxh3_64_intdigest(c) % (1 << 44)
        return h


_CHAR_HASHES = _CharHashes()


# ---- layout ---------------------------------------------------------------

#: The facts of pages; ``kind`` says which columns a row has. Lists are those of a line's or a page's words, or, for titles, widths and forms, of many facts in one row.
FACT_DDL = (
    "kind string, doc_id bigint, page int, line int, pos int, text string, conf double, n bigint, "
    "top boolean, bottom boolean, next_line int, next_pos int, next_text string, next_conf double, next_bottom boolean, flag boolean, lines array<int>, poss array<int>, texts array<string>, confs array<double>, ns array<bigint>, ms array<bigint>, ks array<bigint>"
)
_NAMES = [x.split()[0] for x in FACT_DDL.split(", ")]

_NUMBER_RE, _NUMBERED_RE, _END_RE, _HYPHEN_RE = re.compile(_PAGE_NUMBER), re.compile(_NUMBERED), re.compile(_END), re.compile(f"{_HYPHEN}$")
_SHORT_NUMBERS = regex.compile(r"(?<![\p{L}0-9])[0-9lOI]{1,4}(?![\p{L}0-9])")
_NO_LETTERS = regex.compile(r"[^\p{L}]+")


#: What a line without a next line says of it.
_NOTHING = dict.fromkeys(("next_line", "next_pos", "next_text", "next_conf", "next_bottom"))


def _list(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count or pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int], list, list[str], list]]:
    """(document, page, and the lines, positions, texts and confidences of its words, in order and each place once) of rows sorted by the hash of their page."""
    last, rows = None, [[] for _ in range(6)]
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = batch.column(0).to_numpy(zero_copy_only=False)
        cols = [_list(batch.column(i)) for i in range(1, 7)]
        edges = [0, *(np.flatnonzero(hashes[1:] != hashes[:-1]) + 1).tolist(), len(hashes)]
        for a, b in zip(edges, edges[1:]):
            if last is not None and hashes[a] != last:
                yield from _ordered(rows)
                rows = [[] for _ in range(6)]
            last = hashes[a]
            for x, y in zip(rows, cols):
                x += y[a:b]
    if last is not None:
        yield from _ordered(rows)


def _ordered(rows: list[list]) -> Iterator[tuple]:
    docs, pages, lines, poss, texts, confs = rows
    keys = list(zip(docs, pages, lines, [-1 if p is None else p for p in poss]))
    order = sorted(range(len(keys)), key=keys.__getitem__)
    at: list[int] = []
    for i in order:
        if at and keys[at[-1]] == keys[i]:
            # Of rows with one place the greatest text counts, then the greatest confidence.
            j = at[-1]
            if (texts[i], -1.0 if confs[i] is None else confs[i]) > (texts[j], -1.0 if confs[j] is None else confs[j]):
                at[-1] = i
        else:
            at.append(i)
    # Nearly always one page; two whose hashes are the same come apart here.
    cuts = [0, *(k for k in range(1, len(at)) if keys[at[k]][:2] != keys[at[k - 1]][:2]), len(at)] if keys[at[0]][:2] != keys[at[-1]][:2] else [0, len(at)]
    for a, b in zip(cuts, cuts[1:]):
        part = at[a:b]
        yield docs[part[0]], pages[part[0]], *([c[i] for i in part] for c in (lines, poss, texts, confs))


def _parts_of(facts: list) -> Iterator[list]:
    return (facts[at : at + PACK] for at in range(0, len(facts), PACK))


def _layout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(FACT_DDL)
    memo = _Words()
    forms: dict[str, list[int]] = {}
    rows: list[dict] = []

    def ready() -> Iterator[pa.RecordBatch]:
        """The rows so far, a batch for each kind: columns that a kind hasn't are nulls without being looked at."""
        by_kind: dict[str, list[dict]] = {}
        for r in rows:
            by_kind.setdefault(r["kind"], []).append(r)
        rows.clear()
        for part in by_kind.values():
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], f.type) if any(n in r for r in (part[0], part[-1])) else pa.nulls(len(part), f.type) for n, f in zip(_NAMES, schema)], schema=schema)

    titles: dict[bool, list[tuple[str, int]]] = {True: [], False: []}
    all_widths: dict[tuple[int, int], int] = {}

    def packed() -> None:
        """Small facts go into rows of many."""
        for flag, found in titles.items():
            for part in _parts_of(found):
                rows.append({"kind": "title", "flag": flag, "texts": [k for k, _ in part], "ns": [n for _, n in part]})
            found.clear()
        for part in _parts_of(list(all_widths.items())):
            rows.append({"kind": "width", "ns": [k[0] for k, _ in part], "poss": [k[1] for k, _ in part], "ms": [n for _, n in part]})
        all_widths.clear()

    def count() -> None:
        for part in _parts_of([(w, f) for w, f in forms.items() if w]):
            rows.append({"kind": "form", "texts": [w for w, _ in part], "ns": [f[0] for _, f in part], "ms": [f[1] for _, f in part], "ks": [f[2] for _, f in part]})
        forms.clear()

    for doc, page, lines, poss, texts, confs in _pages(batches):
        base = {"doc_id": doc, "page": page}
        for line, pos, text, conf in zip(lines, poss, texts, confs):
            w, odd = memo[text]
            f = forms.get(w)
            if f is None:
                f = forms[w] = [0, 0, 0]
            f[0] += 1
            if conf is not None:
                f[1] += round(conf * MILLION)
                f[2] += 1
            if odd:
                rows.append({"kind": "odd", **base, "line": line, "pos": pos})
        starts = [i for i in range(len(lines)) if not i or lines[i] != lines[i - 1]] + [len(lines)]
        spans = list(zip(starts, starts[1:]))
        for no, (a, b) in enumerate(spans):
            top, bottom = no == 0, no == len(spans) - 1
            text = " ".join(texts[a:b])
            c, d = spans[no + 1] if not bottom else (None, None)
            after = _NOTHING if bottom else {"next_line": lines[c], "next_pos": poss[c], "next_text": texts[c], "next_conf": confs[c], "next_bottom": no == len(spans) - 2}
            own = {**base, "line": lines[a], "top": top, "bottom": bottom}
            cut = _HYPHEN_RE.search(text)
            if cut and _CUT.search(texts[b - 1]):
                rows.append({"kind": "cut", **own, **after, "pos": poss[b - 1], "text": texts[b - 1], "conf": confs[b - 1]})
            if no < 2:
                rows.append({"kind": "start", **own, "pos": poss[a], "text": texts[a], "conf": confs[a]})
            apart = not top and lines[a] - lines[spans[no - 1][0]] >= 3
            opens = not (cut or _END_RE.search(text) or _NUMBERED_RE.search(text))
            if top or bottom:
                keys: list[str] = []
            else:
                all_widths[doc, len(text)] = all_widths.get((doc, len(text)), 0) + 1
            if opens:
                # The last word and the last two without numbers: what a running title ends in, whatever firm or page it has.
                parts = _NO_LETTERS.sub(" ", _SHORT_NUMBERS.sub(" ", text).lower()).split()
                mine = [k for k in (" ".join(parts[-1:]), " ".join(parts[-2:]) if len(parts) > 1 else "") if len(k) > 3]
                if top or bottom:
                    keys = mine
                if mine and (top or not bottom or apart):
                    # Texts are only told apart, which their hashes do.
                    bare = xxhash.xxh3_64_intdigest(" ".join(parts)) - (1 << 63)
                    titles[top or bottom].extend((k, bare) for k in mine)
            if top or bottom:
                number = bool(_NUMBER_RE.search(text))
                sure = (bottom and not top and (apart or number)) or (top and not bottom and opens and (number or bool(re.search(r"\s[|—]\s", text))))
                maybe = top and not bottom and opens
                rows.append({"kind": "edge", **own, **after, "flag": sure, "n": len(text) + 3 + len(after["next_text"] or "") if maybe else None, "texts": keys if maybe else []})
                rows.append({"kind": "edge words", **own, "texts": [memo[t][0] for t in texts[a:b]], "confs": confs[a:b]})
        rows.append({"kind": "page", **base, "lines": lines, "poss": poss, "texts": texts})
        if len(forms) > KEPT_FORMS:
            count()
        if len(rows) > 10_000:
            packed()
            yield from ready()
    count()
    packed()
    yield from ready()


def layout(words: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The facts of all pages (FACT_DDL), from words with doc_id, page, line, pos, text and confidence."""
    src = words.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in ("page", "line", "pos")],
        F.trim(F.col("text").cast("string")).alias("text"), F.col("confidence").cast("double").alias("confidence"),
    )
    src = src.filter("text <> '' AND doc_id IS NOT NULL AND page IS NOT NULL AND line IS NOT NULL")
    src = src.select(F.xxhash64("doc_id", "page").alias("at"), "doc_id", "page", "line", "pos", "text", "confidence")
    # A page of so many rows was delivered again and again: copies are dropped where they lie before all its rows meet in one task.
    if not src.groupBy("at").count().filter(F.col("count") > hot_rows).isEmpty():
        src = src.distinct()
    # The one shuffle of all words; one number to sort by needs no comparisons.
    return src.repartition("at").sortWithinPartitions("at").mapInArrow(_layout, FACT_DDL)


PAGE, LINE, PLACE = ["doc_id", "page"], ["doc_id", "page", "line"], ["doc_id", "page", "line", "pos"]


def _each(facts: DataFrame, kind: str, *keep: str, **lists: str) -> DataFrame:
    """The facts of a kind that lie in rows of many, with the names of their parts."""
    each = F.explode(F.arrays_zip(*lists.values())).alias("x")
    return facts.filter(F.col("kind") == kind).select(*keep, each).select(*keep, *[F.col(f"x.{c}").alias(n) for n, c in lists.items()])


def running_lines(facts: DataFrame) -> DataFrame:
    """(doc_id, page, line): the running lines."""
    edge = facts.filter("kind = 'edge'").select(*LINE, "flag", "n", F.col("texts").alias("keys"))
    # Different texts of edge lines against different texts of body lines with the same end.
    titles = _each(facts, "title", "flag", key="texts", n="ns").distinct().groupBy("key").agg(F.count_if("flag").alias("edges"), F.count_if(~F.col("flag")).alias("bodies"))
    titles = titles.filter(f"edges >= {EDGE_TEXTS} AND edges > 3 * bodies").select("key")
    titled = edge.select(*LINE, F.explode("keys").alias("key")).join(titles, "key").select(*LINE)
    # The width of a document: nine in ten of its lines within a page are no longer.
    widths = _each(facts, "width", doc_id="ns", len="poss", n="ms").groupBy("doc_id", "len").agg(F.sum("n").alias("n"))
    by_doc = Window.partitionBy("doc_id")
    widths = widths.withColumns({"so_far": F.sum("n").over(by_doc.orderBy("len")), "all": F.sum("n").over(by_doc)}).filter("so_far >= 0.9 * all").groupBy("doc_id").agg(F.min("len").alias("width"))
    had_room = edge.filter("n IS NOT NULL").join(widths, "doc_id").filter("n <= width").select(*LINE)
    return edge.filter("flag").select(*LINE).unionByName(titled).unionByName(had_room).distinct()


def cut_pairs(facts: DataFrame, running: DataFrame) -> DataFrame:
    """Lines whose last word is cut, with the first word of the body line that follows: on the page, else the first on the next page."""
    body = facts.filter("kind IN ('cut', 'start')").join(running, LINE, "left_anti")
    bottoms = running.withColumnRenamed("line", "next_line").withColumn("next_runs", F.lit(True))
    cut = body.filter("kind = 'cut'").join(bottoms, [*PAGE, "next_line"], "left")
    stays = F.col("next_line").isNotNull() & F.col("next_runs").isNull()
    here = F.struct("page", F.col("next_line").alias("line"), F.col("next_pos").alias("pos"), F.col("next_text").alias("text"), F.col("next_conf").alias("conf"))
    cut = cut.select(*PLACE, "text", "conf", F.when(stays, here).alias("next"))
    first = body.filter("kind = 'start'").groupBy(*PAGE).agg(F.min_by(F.struct("page", "line", "pos", "text", "conf"), "line").alias("over")).select("doc_id", (F.col("page") - 1).alias("page"), "over")
    pairs = cut.join(first, PAGE, "left").withColumn("next", F.coalesce("next", "over")).filter("next IS NOT NULL")
    pairs = pairs.select(
        *PLACE, F.col("text").alias("last"), "conf", F.col("next.page").alias("n_page"), F.col("next.line").alias("n_line"), F.col("next.pos").alias("n_pos"), F.col("next.text").alias("rest"), F.col("next.conf").alias("n_conf")
    )
    return _with_words(pairs)


PAIR_DDL = "doc_id bigint, page int, line int, pos int, n_page int, n_line int, n_pos int, stem string, rest string, conf double, n_conf double, joined string, compound string, stem_form string, rest_form string, cut_at int, own boolean, odd_stem boolean, odd_rest boolean, odd_joined boolean, odd_compound boolean, mark_stem boolean, mark_rest boolean, last_form string"


def _with_words(pairs: DataFrame) -> DataFrame:
    """PAIR_DDL: what the two halves give, joined and as a compound."""

    def make():
        def fn(cols):
            out: dict[str, list] = {x.split()[0]: [] for x in PAIR_DDL.split(", ")}
            for i, (last, rest) in enumerate(zip(cols["last"], cols["rest"])):
                if not _GOES_ON.search(rest):
                    continue
                stem = _HYPHEN_RE.sub("", last)
                row = {n: cols[n][i] for n in (*PLACE, "n_page", "n_line", "n_pos", "conf", "n_conf")}
                row |= {"stem": stem, "rest": rest, "joined": core(stem + rest), "compound": core(f"{stem}-{rest}"), "stem_form": core(stem), "rest_form": core(rest), "cut_at": len(core(stem)), "own": bool(_OWN.search(rest)), "last_form": core(last)}
                row |= {"odd_stem": is_odd(stem), "odd_rest": is_odd(rest), "odd_joined": is_odd(stem + rest), "odd_compound": is_odd(f"{stem}-{rest}")}
                row |= {f"mark_{k}": bool(re.search("[0-9!|]", _TAIL_MARKS.sub("", v))) for k, v in (("stem", stem), ("rest", rest))}
                for n, v in row.items():
                    out[n].append(v)
            return out

        return fn

    return map_rows(pairs, make, PAIR_DDL)


def word_forms(facts: DataFrame, running: DataFrame, pairs: DataFrame) -> DataFrame:
    """(w, n, conf): how often each form stands in body lines as a whole word, and its mean confidence."""
    counts = _each(facts, "form", w="texts", n="ns", conf_sum="ms", conf_n="ks")
    off = facts.filter("kind = 'edge words'").join(running, LINE).select(F.explode(F.arrays_zip("texts", "confs")).alias("x")).select(F.col("x.texts").alias("w"), F.col("x.confs").alias("conf"))
    ends = pairs.select(*PLACE, F.col("last_form").alias("w"), "conf")
    starts = pairs.select("doc_id", F.col("n_page").alias("page"), F.col("n_line").alias("line"), F.col("n_pos").alias("pos"), F.col("rest_form").alias("w"), F.col("n_conf").alias("conf"))
    halves = ends.unionByName(starts).dropDuplicates(PLACE).select("w", "conf")
    off = off.unionByName(halves).select("w", F.lit(-1).cast("bigint").alias("n"), (-F.coalesce(F.round(F.col("conf") * MILLION), F.lit(0))).cast("bigint").alias("conf_sum"), (-F.col("conf").isNotNull().cast("bigint")).alias("conf_n"))
    both = counts.unionByName(off).filter("w <> ''").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "conf_sum", "conf_n")])
    return both.filter("n > 0").select("w", "n", F.when(F.col("conf_n") > 0, F.col("conf_sum") / F.col("conf_n") / MILLION).otherwise(DOUBTFUL - 1).alias("conf"))


def _differences(df: DataFrame, reverse: bool) -> DataFrame:
    """(w, n, conf, key, cost): each form under its anagram hash and under those that one confusion of it leads to."""
    ddl = "w string, n bigint, conf double, key bigint, cost int"

    def make():
        moves = []
        for printed, read in (x.split(">") for x in CONFUSIONS.split()):
            d = anagram_hash(printed) - anagram_hash(read)
            moves.append((printed if reverse else read, -d if reverse else d, max(len(printed), len(read))))

        def fn(cols):
            out: dict[str, list] = {x.split()[0]: [] for x in ddl.split(", ")}
            w_out, key_out, cost_out = out["w"], out["key"], out["cost"]
            for w, n, conf in zip(cols["w"], cols["n"], cols["conf"]):
                h = anagram_hash(w)
                own = {(h, 0): None, **{(h + d, cost): None for has, d, cost in moves if has in w}}
                for key, cost in own:
                    w_out.append(w)
                    key_out.append(key)
                    cost_out.append(cost)
                out["n"] += [n] * len(own)
                out["conf"] += [conf] * len(own)
            return out

        return fn

    return map_rows(df.select("w", "n", "conf"), make, ddl)


def corrections(doubtful: DataFrame, trusted: DataFrame) -> DataFrame:
    """(w, c): the best trusted form for each doubtful form, by the differences of their anagram hashes."""
    a = _differences(doubtful.filter("length(w) >= 2"), False).withColumnRenamed("cost", "cost_a")
    b = _differences(trusted, True).select(F.col("w").alias("c"), F.col("n").alias("c_n"), "key", F.col("cost").alias("cost_b"))
    sure = F.col("conf") >= DOUBTFUL
    two = (F.col("cost_a") > 0) & (F.col("cost_b") > 0)
    lead = F.when(sure, LEAD_SURE).when(two, LEAD_TWO).otherwise(LEAD_ONE)
    # The cheap tests are part of the join; the edit distance is worked out for what is left.
    met = a.join(b, (a["key"] == b["key"]) & (F.col("w") != F.col("c")) & (F.col("c_n") >= F.col("n") * lead) & (~sure | (F.length("w") >= 4) | (F.col("c_n") >= LEAD_SHORT * F.col("n"))) & ~(two & (F.length("w") < 5)))
    met = met.filter(F.levenshtein("w", "c", 4) <= F.col("cost_a") + F.col("cost_b")).filter(F.levenshtein("w", "c", 4) >= 0)
    return met.groupBy("w").agg(F.max_by("c", F.struct(-two.cast("int"), F.col("c_n"), F.col("c"))).alias("c"))


def _same(side: Callable[[str, Column], Column]) -> Column:
    """How many characters w and c share from one end."""
    both = F.sequence(F.lit(1), F.greatest(F.length("w"), F.length("c")))
    return F.size(F.filter(both, lambda i: side("w", i) == side("c", i)))


def _left(c: str, i: Column) -> Column:
    return F.left(F.col(c), i)


def _right(c: str, i: Column) -> Column:
    return F.right(F.col(c), i)


class Repair:
    """The stages of a repair; each is a DataFrame that later ones use."""

    def __init__(self, words: DataFrame, cut=lambda df: df, broadcast_rows: int = BROADCAST_ROWS):
        self.facts = written(layout(words), "kind")
        self.running = cut(running_lines(self.facts))
        pairs = cut(cut_pairs(self.facts, self.running))
        forms = cut(word_forms(self.facts, self.running, pairs))
        known = forms.select("w", "n")
        pairs = (
            pairs.join(known.select(F.col("w").alias("joined"), F.col("n").alias("n_joined")), "joined", "left")
            .join(known.select(F.col("w").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
            .na.fill(0, ["n_joined", "n_compound"])
            .withColumn("broken", F.expr("n_joined > n_compound OR (n_joined = 0 AND n_compound = 0 AND NOT own)"))
        )
        self.pairs = cut(pairs)
        self.broken, self.compounds = self.pairs.filter("broken"), self.pairs.filter("NOT broken")
        # Forms of cut words that stand nowhere whole count as doubtful forms too, with the lower confidence of their halves.
        cut_only = self.broken.filter("n_joined = 0 AND joined <> ''").groupBy(F.col("joined").alias("w")).agg(F.count("*").alias("n"), F.coalesce(F.avg(F.least("conf", "n_conf")), F.lit(DOUBTFUL - 1)).alias("conf"))
        doubtful = forms.unionByName(cut_only.select("w", "n", "conf")).filter(F.col("w").rlike(r"\p{L}|[!|]"))
        trusted = forms.filter((F.col("conf") >= TRUSTED) & F.col("w").rlike(r"\p{L}") & (F.col("n") >= 2) & ~F.col("w").rlike(r"[0-9!|]"))
        fixes = cut(corrections(doubtful, trusted))
        self.n_fixes = fixes.count()
        self.fixes = fixes
        self._met = F.broadcast(fixes) if self.n_fixes <= broadcast_rows else fixes

    def halves(self) -> DataFrame:
        """The places of the halves of cut words and compounds: no words of their own."""
        starts = self.pairs.select("doc_id", F.col("n_page").alias("page"), F.col("n_line").alias("line"), F.col("n_pos").alias("pos"))
        return self.pairs.select(*PLACE).unionByName(starts).distinct()

    def _of_body(self, places: DataFrame) -> DataFrame:
        """Places that are neither in running lines nor halves of cut words."""
        halves = self.halves().withColumn("p", F.coalesce("pos", F.lit(-1))).drop("pos")
        return places.join(self.running, LINE, "left_anti").withColumn("p", F.coalesce("pos", F.lit(-1))).join(halves, [*LINE, "p"], "left_anti").drop("p")

    def fixed_words(self) -> DataFrame:
        """(doc_id, page, line, pos, w, c): the whole words of body lines whose form has a fix."""
        only = bitmap(self.fixes.select(F.xxhash64("w").alias("hash")), self.n_fixes)
        ddl = "doc_id bigint, page int, line int, pos int, w string"
        schema = arrow_schema(ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep = Filter(only[0], only[1].value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                doc, page, lines, poss, texts = batch.columns
                # Each different word of a batch is looked at once; its places are told by number.
                coded = texts.flatten().dictionary_encode()
                forms = [core(t) for t in coded.dictionary.to_pylist()]
                passes = np.zeros(len(forms), bool)
                passes[keep.passing(np.array([xxhash.xxh64_intdigest(w, 42) for w in forms], np.uint64))] = True
                number = coded.indices.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(passes[number])
                if len(at):
                    ends = texts.offsets.to_numpy()
                    row = pa.array(np.searchsorted(ends - ends[0], at, side="right") - 1)
                    there = pa.array(at)
                    columns = [doc.take(row), page.take(row), lines.flatten().take(there), poss.flatten().take(there), pa.array([forms[i] for i in number[at].tolist()])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        words = self.facts.filter("kind = 'page'").select(*PAGE, "lines", "poss", "texts").mapInArrow(run, ddl)
        return self._of_body(words.join(self._met, "w"))

    def defects(self) -> DataFrame:
        """(doc_id, page, line, defect): 'running', 'broken' and 'misread' lines."""
        next_line = ["doc_id", F.col("n_page").alias("page"), F.col("n_line").alias("line")]
        running = self.running.select(*LINE, F.lit("running").alias("defect"))
        broken = self.broken.select(*LINE, F.lit("broken").alias("defect"))
        odd = self._of_body(self.facts.filter("kind = 'odd'").select(*PLACE)).select(*LINE)
        # Cut words are looked up as a whole, compounds by their parts too; the difference tells in which half the fault is.
        whole = F.when(F.col("broken"), F.col("joined")).otherwise(F.col("compound"))
        form = lambda w, side: F.struct(w.alias("w"), F.lit(side).alias("side"))
        looked_up = F.when(F.col("broken"), F.array(form(whole, "whole"))).otherwise(F.array(form(F.col("stem_form"), "stem"), form(F.col("rest_form"), "rest"), form(whole, "whole")))
        met = self.pairs.select(*LINE, "n_page", "n_line", "cut_at", "broken", F.explode(looked_up).alias("f")).select("*", "f.w", "f.side").join(self._met, "w").withColumns({"a": _same(_left), "z": _same(_right)})
        hyphen = F.when(F.col("broken"), 0).otherwise(1)
        in_stem = met.filter("side = 'stem' OR (side = 'whole' AND a < cut_at)").select(*LINE)
        in_rest = met.filter((F.col("side") == "rest") | ((F.col("side") == "whole") & (F.col("z") < F.length("w") - F.col("cut_at") - hyphen))).select(*next_line)
        # A half is odd by itself, or has the digit or mark that makes the whole odd.
        by_whole = F.when(F.col("broken"), F.col("odd_joined")).otherwise(F.col("odd_compound")) & ~F.col("odd_stem") & ~F.col("odd_rest")
        odd_stem = self.pairs.filter(F.col("odd_stem") | (by_whole & F.col("mark_stem"))).select(*LINE)
        odd_rest = self.pairs.filter(F.col("odd_rest") | (by_whole & F.col("mark_rest"))).select(*next_line)
        misread = self.fixed_words().select(*LINE)
        for more in (odd, in_stem, in_rest, odd_stem, odd_rest):
            misread = misread.unionByName(more)
        return running.unionByName(broken).unionByName(misread.withColumn("defect", F.lit("misread"))).distinct()

    def paragraphs(self) -> DataFrame:
        """(doc_id, page, paragraph, text): paragraphs by the page they begin on, with repairs made.

        A paragraph ends before a gap between lines and before a numbered
        heading; across pages it goes on if its last line has no end mark.
        """
        edit = lambda kind, text: F.struct(F.lit(kind).alias("kind"), "line", "pos", text.alias("w"), F.col("c") if kind == "fix" else F.lit(None).cast("string").alias("c")).alias("e")
        runs = self.running.withColumn("pos", F.lit(None).cast("int")).select(*PAGE, edit("run", F.lit("")))
        fixed = self.fixed_words().select(*PAGE, edit("fix", F.col("w")))
        # A cut word is repaired as a whole and cut again, so that each line keeps its part; its halves are no words to be repaired.
        cut = self.broken.withColumnRenamed("joined", "w").join(self._met, "w", "left")
        cut = map_rows(cut.select(*PLACE, "n_page", "n_line", "n_pos", "stem", "rest", "w", "c", "cut_at"), _cut_again, "doc_id bigint, page int, line int, pos int, n_page int, n_line int, n_pos int, first string, second string")
        firsts = cut.select(*PAGE, "line", "pos", "first").select(*PAGE, edit("half", F.col("first")))
        seconds = cut.select("doc_id", F.col("n_page").alias("page"), F.col("n_line").alias("line"), F.col("n_pos").alias("pos"), "second").select(*PAGE, edit("half", F.col("second")))
        ends = cut.select(*PAGE, "line", "pos").select(*PAGE, edit("cut", F.lit("")))
        edits = runs.unionByName(fixed).unionByName(firsts).unionByName(seconds).unionByName(ends).groupBy(*PAGE).agg(F.collect_list("e").alias("e"))
        pages = self.facts.filter("kind = 'page'").select(*PAGE, "lines", "poss", "texts").join(edits, PAGE, "left")
        of = lambda name: F.coalesce(F.col(f"e.{name}"), F.array()).alias(f"e_{name}")
        parts = map_rows(pages.select(*PAGE, "lines", "poss", "texts", *[of(n) for n in ("kind", "line", "pos", "w", "c")]), _parts, "doc_id bigint, page int, part int, text string, end boolean, heading boolean", batch_rows=500)
        # A page whose last part is open is continued by the first part of the next; chains are followed over small rows.
        pages = parts.groupBy("doc_id", "page").agg(F.max("part").alias("last"), F.max_by("end", "part").alias("end"), F.max_by("heading", "part").alias("heading"))
        before = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.col("last").alias("p_last"), (~F.col("end") & ~F.col("heading")).alias("open"))
        pages = pages.join(before, ["doc_id", "page"], "left").na.fill(False, ["open"])
        in_doc = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        # Where a paragraph that reaches the end of the page before began.
        pages = pages.withColumn("own", F.when(~F.col("open") | (F.col("last") > 1), F.struct("page", "last")))
        pages = pages.withColumn("from", F.when(F.col("open"), F.last("own", True).over(in_doc)))
        starts = parts.join(pages.select("doc_id", "page", "from"), ["doc_id", "page"])
        carried = (F.col("part") == 1) & F.col("from").isNotNull()
        starts = starts.select("doc_id", F.when(carried, F.col("from.page")).otherwise(F.col("page")).alias("at"), F.when(carried, F.col("from.last")).otherwise(F.col("part")).alias("paragraph"), "page", "text")
        return starts.groupBy("doc_id", "at", "paragraph").agg(F.rtrim(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text"))).getField("text"), "")).alias("text")).withColumnRenamed("at", "page")


# ---- repairs --------------------------------------------------------------


def repaired(text: str, w: str, c: str | None) -> str:
    """A printed word of form ``w`` with ``c`` in its place, in the case of the print; the word itself where there is no ``c``."""
    at = text.lower().find(w)
    if c is None or at < 0:
        return text
    inner = text[at : at + len(w)]
    if inner == inner.upper():
        c = c.upper()
    elif inner[:1].isupper():
        c = c[:1].upper() + c[1:]
    return text[:at] + c + text[at + len(w) :]


def _cut_again() -> Callable:
    def fn(cols):
        names = [*PLACE, "n_page", "n_line", "n_pos"]
        out: dict[str, list] = {n: [] for n in (*names, "first", "second")}
        for i, (stem, rest, w, c, cut_at) in enumerate(zip(*(cols[n] for n in ("stem", "rest", "w", "c", "cut_at")))):
            whole, at = repaired(stem + rest, w, c), len(stem)
            if c is not None:
                start = next((k for k, (a, b) in enumerate(zip(w, c)) if a != b), min(len(w), len(c)))
                at = max(1, min(at + (len(c) - len(w) if start < cut_at else 0), len(whole) - 1))
            for n in names:
                out[n].append(cols[n][i])
            out["first"].append(whole[:at] + "-")
            out["second"].append(whole[at:])
        return out

    return fn


def _parts() -> Callable:
    """The paragraphs of a page, from its words and its edits."""

    def fn(cols):
        out: dict[str, list] = {n: [] for n in ("doc_id", "page", "part", "text", "end", "heading")}
        for doc, page, lines, poss, texts, kinds, e_lines, e_poss, ws, cs in zip(*(cols[c] for c in (*PAGE, "lines", "poss", "texts", "e_kind", "e_line", "e_pos", "e_w", "e_c"))):
            runs, cuts, fixes, halves = set(), set(), {}, {}
            for kind, line, pos, w, c in zip(kinds, e_lines, e_poss, ws, cs):
                if kind == "run":
                    runs.add(line)
                elif kind == "cut":
                    cuts.add(line)
                elif kind == "fix":
                    fixes[line, pos] = (w, c)
                else:
                    halves.setdefault((line, pos), []).append(w)
            printed: dict[int, list[str]] = {}
            for line, pos, text in zip(lines, poss, texts):
                if line in runs:
                    continue
                mine = halves.get((line, pos))
                if mine:
                    # A word that is all of its line can end one cut word and begin another; it stays as it is.
                    text = mine[0] if len(mine) == 1 else text
                elif (line, pos) in fixes:
                    text = repaired(text, *fixes[line, pos])
                printed.setdefault(line, []).append(text)
            before, after_heading, part, joined = None, False, 0, []
            for line, ws_ in printed.items():
                text = " ".join(ws_)
                heading = bool(_NUMBERED_RE.search(text))
                if before is None or line - before > 1 or heading or after_heading:
                    part += 1
                    joined.append([part, "", False, False])
                if line in cuts:
                    add = _HYPHEN_RE.sub("", text)
                elif _ENDS_IN_HYPHEN.search(text):
                    add = text
                else:
                    add = text + " "
                own = joined[-1]
                own[1] += add
                own[2], own[3] = bool(_END_RE.search(text)), heading
                before, after_heading = line, heading
            for row in joined:
                for n, v in zip(out, (doc, page, *row)):
                    out[n].append(v)
        return out

    return fn


_ENDS_IN_HYPHEN = regex.compile(r"[\p{L}0-9]-$")
