"""Problem 3: the language of each document and of each of its segments.

A bidirectional gated recurrent network reads the bytes of a sentence one by
one, forwards and backwards, and labels each byte with a distribution over the
languages. The log-probabilities of a sentence's bytes are pooled to the
sentence, those of neighbouring sentences of one language to a segment, and
those of all sentences to the document.

The network is trained in numpy by backpropagation through time
(``train_network``) on a bounded sample of labelled sentences; its weights are
in ``models/language_gru.npz``. Inference is numpy over many sentences at once;
sentences that occur more than once in a task are read once, and what sentences
have in common at their beginnings or ends is read once in each direction.

Defined cases: a null or blank text gives one row with a null code, confidence
0 and detected false; so does a text without a sentence. Whole duplicates of a
row give equal rows.
"""

from __future__ import annotations

import io
import re
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .text_quality import clean_newlines, text_kind

#: The languages, the two-letter forms, and the class of text in none of them.
LANGUAGES = ("eng", "fra", "deu", "spa", "ita", "nld", "por")
ISO2 = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "nl": "nld", "pt": "por"}
NONE = "und"
CLASSES = (*LANGUAGES, NONE)

HIDDEN = 24
#: A sentence is read in pieces of at most so many bytes; all pieces are pooled.
PIECE_BYTES = 1024
#: Pieces that are read in step, and bytes whose scores are kept at once.
BLOCK_ROWS = 4096
GROUP_BYTES = 1 << 22
#: A language counts from so many full sentences on.
MIN_SENTENCES = 2
MIN_WORDS = 4
DETECTED_FROM = 0.6
SURE = 0.9

_MARKUP = re.compile(r"^[ \t]*(?:>[ \t]?)+|[*_`\u00ad\u200b-\u200d\u2060\ufeff]{1,3}|\[[ xX]\] |(?<=\])\([^)\s]*\)", re.M)
#: Without one of these a text has no markup.
_MARKS = re.compile("[>*_`\\[\\]\u00ad\u200b-\u200d\u2060\ufeff]")
_HEADING = re.compile(r"[ \t]*#{1,6} ")
_ITEM = re.compile(r"[ \t]*(?:[-*+•] |\d{1,4}[.)] )")
_STOP = re.compile(r"(?<=[^\s.!?…;])[.!?…;]++[\"'»”’)\]]*+(?=\s|$)")
_WORDS = re.compile(r"[^\W\d_]+")
_ENOUGH = re.compile(r"(?:[\W\d_]*+[^\W\d_]++){%d}" % MIN_WORDS)


def language_code(label: str | None) -> str | None:
    """The three-letter code that a label names: two letters, region and case don't matter."""
    if not label:
        return None
    head = re.split(r"[-_ ]", label.strip().lower())[0]
    code = ISO2.get(head, head)
    return code if code in LANGUAGES else None


def sentences(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, sentence, whether it is a full sentence) of a text's paragraphs; wrapped lines are joined.

    Headings and list items without an end mark are left out: they are no sentences.
    """
    out = []
    at = 0
    block: list[str] = []
    begin = 0

    def flush():
        nonlocal block
        if not block:
            return
        para = "\n".join(block)
        pos = 0
        for m in _STOP.finditer(para):
            piece = para[pos : m.end()]
            out.append((begin + pos, begin + m.end(), piece, True))
            pos = m.end()
        if para[pos:].strip():
            out.append((begin + pos, begin + len(para), para[pos:], False))
        block = []

    for line in text.split("\n"):
        begins = line.lstrip()[:1]
        if not begins or begins == "#" and _HEADING.match(line):
            flush()
        elif (begins in "-*+•" or begins.isdigit()) and _ITEM.match(line):
            flush()
            begin, block = at, [line]
        else:
            if not block:
                begin = at
            block.append(line)
        at += len(line) + 1
    flush()
    # Most have enough words, which their beginning shows.
    return [(s, e, t, full and n >= MIN_WORDS) for s, e, t, full in out if (n := MIN_WORDS if _ENOUGH.match(t) else len(_WORDS.findall(t))) >= 2]


def plain(sentence: str, marked: bool = True) -> str:
    """A sentence as the network reads it: without markup, if its text may have any, and with single blanks."""
    return " ".join((_MARKUP.sub("", sentence) if marked else sentence).split())


# ---- the network ----------------------------------------------------------
#
# Sequences are read step by step in arrays of (steps, rows), the longest row
# first, so that the rows with a byte at a step are the first live[step] ones.


def init_network(seed: int = 7, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net: dict[str, np.ndarray] = {}
    for d in "fb":
        net[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        net[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        net[f"B{d}"] = np.zeros(3 * hidden)
    net["W"] = rng.normal(0, 0.2, (2 * hidden, len(CLASSES)))
    net["b"] = np.zeros(len(CLASSES))
    return {k: v.astype(np.float32) for k, v in net.items()}


def steps_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as (steps, rows), the rows with a byte at each step, and which text each row is; longest first."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    x = np.zeros((len(texts), int(n[0])), np.uint8)
    x[np.arange(x.shape[1]) < n[:, None]] = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    live = np.searchsorted(-n, -np.arange(x.shape[1]), side="left")
    return np.ascontiguousarray(x.T), live, order


def _scan(net: dict, d: str, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (steps, rows, hidden); with keep, also what backpropagation needs."""
    e, u = net[f"E{d}"] + net[f"B{d}"], net[f"U{d}"]
    h = u.shape[0]
    state = np.zeros((x.shape[1], h), u.dtype)
    out = np.zeros((*x.shape, h), u.dtype)
    saved = []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        k = live[t]
        s = state[:k]
        g = e[x[t, :k]]
        a = s @ u
        zr = 0.5 * np.tanh(0.5 * (g[:, : 2 * h] + a[:, : 2 * h])) + 0.5
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(g[:, 2 * h :] + r * a[:, 2 * h :])
        if keep:
            saved.append((t, s.copy(), z, r, c, a[:, 2 * h :]))
        s += z * (c - s)
        out[t, :k] = s
    return out, saved


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s -= s.max(-1, keepdims=True)
    return s - np.log(np.exp(s).sum(-1, keepdims=True))


def log_probabilities(net: dict, text: bytes) -> np.ndarray:
    """Log-probabilities of the classes at each byte of one text."""
    x, live, _ = steps_of([text])
    h = np.concatenate([_scan(net, d, x, live, False)[0] for d in "fb"], 2)
    return _log_softmax(h[:, 0] @ net["W"] + net["b"])


def _gradients(net: dict, texts: list[bytes], y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the bytes, and its gradients by backpropagation through time."""
    x, live, order = steps_of(texts)
    y = y[order]
    states = {d: _scan(net, d, x, live, True) for d in "fb"}
    hs = net["Uf"].shape[0]
    on = np.arange(x.shape[1]) < live[:, None]
    h = np.concatenate([states[d][0] for d in "fb"], 2)[on]
    labels = np.broadcast_to(y, x.shape)[on]
    ds = _log_softmax(h @ net["W"] + net["b"])
    loss = float(-ds[np.arange(len(ds)), labels].mean())
    np.exp(ds, out=ds)
    ds[np.arange(len(ds)), labels] -= 1
    ds /= len(ds)
    grad = {"W": h.T @ ds, "b": ds.sum(0)}
    dh_all = np.zeros((*x.shape, 2 * hs), h.dtype)
    dh_all[on] = ds @ net["W"].T
    by = np.argsort(x[on], kind="stable")
    seen, first = np.unique(x[on][by], return_index=True)
    for i, d in enumerate("fb"):
        u = net[f"U{d}"]
        dg_all = np.zeros((*x.shape, 3 * hs), h.dtype)
        du = np.zeros_like(u)
        carry = np.zeros((x.shape[1], hs), h.dtype)
        for t, h0, z, r, c, ac in reversed(states[d][1]):
            k = len(h0)
            dh = carry[:k] + dh_all[t, :k, i * hs : (i + 1) * hs]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h0) * z * (1 - z)
            dr = dc * ac * r * (1 - r)
            dg_all[t, :k] = np.concatenate([dz, dr, dc], 1)
            da = np.concatenate([dz, dr, dc * r], 1)
            du += h0.T @ da
            carry[:k] = dh * (1 - z) + da @ u.T
        dg = dg_all[on]
        de = np.zeros_like(net[f"E{d}"])
        de[seen] = np.add.reduceat(dg[by], first, axis=0)
        grad |= {f"E{d}": de, f"U{d}": du, f"B{d}": dg.sum(0)}
    return loss, grad


def train_network(
    texts: list[str], codes: list[str], epochs: int = 4, batch: int = 256, rate: float = 0.03, seed: int = 7, hidden: int = HIDDEN
) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of sentences of like length; a sentence's label is the label of each of its bytes."""
    net = init_network(seed, hidden)
    data = [(t.encode()[:PIECE_BYTES], CLASSES.index(c)) for t, c in zip(texts, codes) if t]
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.items()}
    step, steps = 0, epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        groups = [sorted(order[at : at + 16 * batch].tolist(), key=lambda i: len(data[i][0])) for at in range(0, len(order), 16 * batch)]
        batches = [g[at : at + batch] for g in groups for at in range(0, len(g), batch)]
        for b in rng.permutation(len(batches)):
            rows = [data[i] for i in batches[b]]
            _, grad = _gradients(net, [r[0] for r in rows], np.array([r[1] for r in rows]))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            lr = rate * (1 - step / (steps + 1)) * min(1, 1 / (norm + 1e-9))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                net[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def load_network() -> dict[str, np.ndarray]:
    """The weights that come with the package, which may be an archive."""
    data = resources.files(__package__).joinpath("models/language_gru.npz").read_bytes()
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _lengths(texts: list[bytes]) -> np.ndarray:
    """Classes of texts of like length."""
    return np.array([max(7, (len(t) - 1).bit_length()) for t in texts], np.int64)


def _alike(texts: list[bytes]) -> np.ndarray:
    """An order of texts: those of like length together, and of these what begins alike."""
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__))
    return order[np.argsort(_lengths(texts)[order], kind="stable")]


class Reader:
    """Pools the network's positions over whole texts; texts are read in pieces, all of them.

    What the network has read of a beginning doesn't depend on what follows, so
    pieces that begin alike are read together up to where they part, and
    backwards so are those that end alike.
    """

    def __init__(self, net: dict[str, np.ndarray]):
        # Each gate has tables of its own, so that all arrays of a step are contiguous. They hold what exp is taken of in sigmoid, 1 / (1 + exp(-v)), and tanh, 2 / (1 + exp(-2 v)) - 1.
        h = net["Uf"].shape[0]
        cut = [slice(0, h), slice(h, 2 * h), slice(2 * h, 3 * h)]
        self.e = [[np.ascontiguousarray(((net[f"E{d}"] + net[f"B{d}"])[:, c]) * f) for c, f in zip(cut, (-1, -1, -2))] for d in "fb"]
        self.u = [[np.ascontiguousarray(net[f"U{d}"][:, c] * f) for c, f in zip(cut, (-1, -1, -2))] for d in "fb"]
        self.w, self.b, self.h = [np.ascontiguousarray(net["W"][i * h : (i + 1) * h]) for i in (0, 1)], net["b"], h
        # States are between -1 and 1, which bounds the scores: where their exponentials don't fit into four bytes they take eight.
        self.scores = [np.empty((0, len(CLASSES)), np.float32)] * 2
        self.kind = np.float32 if max(np.abs(net["W"]).sum(0) + np.abs(self.b)) < 80 else np.float64

    def _direction(self, pieces: list[bytes], d: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One direction over pieces: the state's number at each of their bytes in order, the classes' scores by that number, and their sum for each piece."""
        (ez, er, ec), (uz, ur, uc), w = self.e[d], self.u[d], self.w[d]
        read = [p[::-1] for p in pieces] if d else pieces
        order = _alike(read)
        size = np.array([len(p) for p in read])
        begin = np.cumsum(size) - size
        number = np.empty(size.sum(), np.int32)
        if self.scores[d].shape[0] < len(number):
            self.scores[d] = np.empty((len(number), len(CLASSES)), np.float32)
        scores = self.scores[d]
        sums = np.empty((len(read), len(CLASSES)), np.float32)
        used = 0
        for at in range(0, len(order), block):
            part = order[at : at + block]
            n = size[part]
            steps = np.arange(n.max(), dtype=np.int32)
            on = steps < n[:, None]
            x = np.zeros(on.shape, np.uint8)
            x[on] = np.frombuffer(b"".join([read[i] for i in part.tolist()]), np.uint8)
            # Bytes that each row has in common with the one before it; at these it has that one's states.
            same = np.zeros(len(part), np.int64)
            differs = x[1:] != x[:-1]
            same[1:] = np.minimum(np.where(differs.any(1), differs.argmax(1), len(steps)), np.minimum(n[1:], n[:-1]))
            own = np.ascontiguousarray(((steps >= same[:, None]) & on).T)
            x = np.ascontiguousarray(x.T)
            place = np.cumsum(own, 1, dtype=np.int32)
            place -= 1
            count = place[:, -1] + 1
            first = used + np.cumsum(count) - count
            ends = np.argsort(n, kind="stable")
            ended = np.searchsorted(n[ends], steps + 1, side="right").tolist()
            done = np.empty((len(part), len(CLASSES)), np.float32)
            gone = 0
            most = int(count.max())
            state, total = np.zeros((1, self.h), np.float32), np.zeros((1, len(CLASSES)), np.float32)
            spare = [(np.empty((most, self.h), np.float32), np.empty((most, len(CLASSES)), np.float32)) for _ in range(2)]
            gates = np.empty((4, most, self.h), np.float32)
            for t, k in enumerate(count.tolist()):
                rows = np.flatnonzero(own[t])
                before = place[t - 1].take(rows) if t else np.zeros(k, np.int32)
                xt = x[t].take(rows).astype(np.intp)
                z, r, c, a = gates[:, :k]
                s, now = spare[t % 2][0][:k], spare[t % 2][1][:k]
                np.take(state, before, 0, out=s, mode="clip")
                # c = tanh(ec + r * (s uc)), s += z * (c - s)
                np.take(er, xt, 0, out=r, mode="clip")
                r += np.matmul(s, ur, out=a)
                np.exp(r, out=r)
                r += 1
                np.take(ec, xt, 0, out=c, mode="clip")
                np.matmul(s, uc, out=a)
                a /= r
                c += a
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                np.take(ez, xt, 0, out=z, mode="clip")
                z += np.matmul(s, uz, out=a)
                np.exp(z, out=z)
                z += 1
                c -= s
                c /= z
                s += c
                got = np.matmul(s, w, out=scores[used : used + k])
                np.take(total, before, 0, out=now, mode="clip")
                now += got
                state, total = s, now
                used += k
                if ended[t] > gone:
                    done[gone : ended[t]] = total.take(place[t].take(ends[gone : ended[t]]), 0)
                    gone = ended[t]
            sums[part[ends]] = done
            place += first.astype(np.int32)[:, None]
            flat = np.ascontiguousarray(place.T)[on]
            n_before = np.cumsum(n) - n
            if d:
                number[np.repeat(begin[part] + n - 1 + n_before, n) - np.arange(len(flat))] = flat
            else:
                number[np.repeat(begin[part] - n_before, n) + np.arange(len(flat))] = flat
        return number, scores[:used], sums

    def _read(self, pieces: list[bytes], block: int) -> np.ndarray:
        """Sum over a piece's bytes of the classes' log-probabilities, for each piece."""
        with np.errstate(over="ignore"):  # a gate that is shut
            (at_f, scores_f, sums), (at_b, scores_b, sums_b) = (self._direction(pieces, d, block) for d in (0, 1))
        size = np.array([len(p) for p in pieces])
        sums = sums.astype(np.float64) + sums_b + size[:, None] * self.b
        scores_b += self.b
        # The sum of the exponentials of a byte's scores is a product of those of both directions.
        exp_f, exp_b = (np.exp(x, out=x if self.kind == np.float32 else None, dtype=self.kind) for x in (scores_f, scores_b))
        norm = np.empty(len(at_f), self.kind)
        some = 1 << 13
        f, b = np.empty((2, some, len(CLASSES)), self.kind)
        one = np.ones(len(CLASSES), self.kind)
        for at in range(0, len(norm), some):
            k = min(some, len(norm) - at)
            np.take(exp_f, at_f[at : at + k], 0, out=f[:k], mode="clip")
            np.take(exp_b, at_b[at : at + k], 0, out=b[:k], mode="clip")
            f[:k] *= b[:k]
            np.matmul(f[:k], one, out=norm[at : at + k])
        np.log(norm, out=norm)
        return sums - np.add.reduceat(norm, np.cumsum(size) - size, dtype=np.float64)[:, None]

    def pooled(self, texts: list[bytes], block: int = BLOCK_ROWS) -> np.ndarray:
        """Sum over a text's bytes of the classes' log-probabilities, and the bytes, for each text."""
        owner, pieces = [], []
        for i, t in enumerate(texts):
            for at in range(0, len(t), PIECE_BYTES):
                owner.append(i)
                pieces.append(t[at : at + PIECE_BYTES])
        sums = np.zeros((len(texts), len(CLASSES)), np.float64)
        count = np.array([len(t) for t in texts], np.float64)
        order = np.argsort(_lengths(pieces), kind="stable")
        group = np.cumsum(np.array([len(p) for p in pieces], np.int64)[order]) // GROUP_BYTES
        for part in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            if len(part):
                np.add.at(sums, np.array(owner)[part], self._read([pieces[i] for i in part.tolist()], block))
        return np.concatenate([sums, count[:, None]], 1)


def _best(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each pooled row (sums, bytes) and its confidence: pooled as a mean with a little weight for length."""
    n = np.maximum(logs[:, -1:], 1)
    mean = logs[:, :-1] / n * np.minimum(4.0, 1 + n / 80)
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    k = p.argmax(1)
    return k, p[np.arange(len(k)), k]


SEGMENT_DDL = "seg_no int, start_pos int, end_pos int, code string, confidence double, detected boolean, n_sentences int, doc_code string, doc_confidence double, doc_detected boolean"


def read_documents(spans: list[list], rows: np.ndarray) -> list[list[tuple]]:
    """The segments of documents from their sentences; ``rows`` has the pooled rows of all sentences in order."""
    if not len(rows):
        return [[(0, 0, 0, None, 0.0, False, 0, None, 0.0, False)] for _ in spans]
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, 0)])
    code, sure = (x.tolist() for x in _best(rows))
    marks: list[tuple[int, int, int, int, int]] = []  # first and last sentence, start, end, full sentences
    ends, at = [], 0
    for doc in spans:
        begin = len(marks)
        for i, (start, end, _, full) in enumerate(doc, at):
            # A sentence that isn't full, or doubtful, goes with the one before it.
            if len(marks) > begin and (code[i] == of or not full or sure[i] < SURE):
                m = marks[-1]
                marks[-1] = (m[0], i, m[2], end, m[4] + full)
            else:
                of = code[i]
                marks.append((i, i, start, end, int(full)))
        at += len(doc)
        ends.append((begin, len(marks), at - len(doc), at))
    first, last = np.array([m[0] for m in marks]), np.array([m[1] for m in marks])
    seg_code, seg_conf = (x.tolist() for x in _best(total[last + 1] - total[first]))
    lo, hi = np.array([e[2] for e in ends]), np.array([e[3] for e in ends])
    doc_code, doc_conf = (x.tolist() for x in _best(total[hi] - total[lo]))
    out = []
    for d, (a, b, _, _) in enumerate(ends):
        if a == b:
            out.append([(0, 0, 0, None, 0.0, False, 0, None, 0.0, False)])
            continue
        known = CLASSES[doc_code[d]] != NONE and doc_conf[d] >= DETECTED_FROM
        whole = CLASSES[doc_code[d]] if known else NONE
        out.append(
            [
                (i - a, marks[i][2], marks[i][3], CLASSES[seg_code[i]], seg_conf[i], CLASSES[seg_code[i]] != NONE and seg_conf[i] >= DETECTED_FROM, marks[i][4], whole, doc_conf[d], known)
                for i in range(a, b)
            ]
        )
    return out


#: Sentences whose rows a task keeps; beyond that it begins anew.
CACHE = 150_000
#: Documents are read in parts of about so many characters, within batches of so many rows: the more at once, the more sentences begin or end alike.
PART_CHARS = 1 << 23
BATCH_ROWS = 10_000


def parts_of(texts: list[str | None], chars: int = PART_CHARS) -> list[tuple[int, int]]:
    """Rows from and to of parts that have, besides their first text, less than so many characters."""
    part = np.cumsum([len(t or "") for t in texts]) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return list(zip(cuts, cuts[1:]))


def detect_languages(df: DataFrame, id_col: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """Rows of SEGMENT_DDL for each document, with ``text_kind`` and whether its label ``is_case``.

    With ``lang_col``, ``is_case`` tells that the label names no language of the
    text or that the text has several, and that the text is prose; without it,
    that the text has several. Offsets count characters after line ends are made
    "\\n"; a language counts from MIN_SENTENCES full sentences on, and
    ``counts`` tells whether that of the segment does.
    """
    src = df.select(
        F.col(id_col).cast("bigint").alias("key"),
        F.col(text_col).cast("string").alias("body"),
        (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("label"),
    )
    names = [x.split()[0] for x in SEGMENT_DDL.split(", ")]

    def make():
        reader = Reader(load_network())
        keys: dict[str, int] = {}
        pooled = np.zeros((0, len(CLASSES) + 1))

        def fn(cols):
            out: dict[str, list] = {n: [] for n in ("key", *names, "counts", "is_case")}
            for begin, end in parts_of(cols["body"]):
                read({n: v[begin:end] for n, v in cols.items()}, out)
            return out

        def read(cols, out):
            nonlocal pooled
            spans = [sentences(clean_newlines(t)) if t else [] for t in cols["body"]]
            if len(keys) > CACHE:
                keys.clear()
                pooled = pooled[:0]
            at = [keys.setdefault(plain(s[2], marked), len(keys)) for doc, t in zip(spans, cols["body"]) for marked in [bool(t and _MARKS.search(t))] for s in doc]
            if len(keys) > len(pooled):
                new = list(keys)[len(pooled) :]
                pooled = np.concatenate([pooled, reader.pooled([k.encode("utf-8", "replace") for k in new])])
            for key, body, label, segs in zip(cols["key"], cols["body"], cols["label"], read_documents(spans, pooled[at])):
                per: dict[str, int] = {}
                for s in segs:
                    if s[3] and s[3] != NONE:
                        per[s[3]] = per.get(s[3], 0) + s[6]
                counted = {c for c, n in per.items() if n >= MIN_SENTENCES}
                case = bool(counted) and (len(counted) > 1 or language_code(label) not in counted)
                if case:
                    case = text_kind(clean_newlines(body)) == "prose"
                for s in segs:
                    out["key"].append(key)
                    for n, v in zip(names, s):
                        out[n].append(v)
                    out["counts"].append(s[3] in counted)
                    out["is_case"].append(case)

        return fn

    return map_rows(src, make, f"key bigint, {SEGMENT_DDL}, counts boolean, is_case boolean", BATCH_ROWS).withColumnRenamed("key", id_col)
