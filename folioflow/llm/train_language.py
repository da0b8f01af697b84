"""Fits the network of ``language`` and writes its weights: python -m folioflow.llm.train_language DOCUMENTS OUT.

The sample is bounded: at most SAMPLE labelled sentences, taken in equal shares
from the languages. Labels are those of the documents (some are wrong); after a
first fit, sentences that the network reads as another language with high
confidence are left out and the network is fitted again.
"""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow.parquet as pq

from .language import CLASSES, LANGUAGES, NONE, Reader, language_code, plain, sentences, train_network
from .text_quality import clean_newlines, text_kind

SAMPLE = 64_000


def sample(path: str, limit: int = SAMPLE, seed: int = 11) -> tuple[list[str], list[str]]:
    t = pq.read_table(path, columns=["text", "lang"]).to_pydict()
    by: dict[str, list[str]] = {c: [] for c in CLASSES}
    for text, lang in zip(t["text"], t["lang"]):
        if not text:
            continue
        text = clean_newlines(text)
        kind = text_kind(text)
        if kind == "junk":
            by[NONE] += [text[i : i + 120] for i in range(0, min(len(text), 360), 120)]
        elif kind == "prose" and (code := language_code(lang)):
            by[code] += [plain(s[2]) for s in sentences(text) if s[3]]
    rng = random.Random(seed)
    rows = []
    for code, texts in by.items():
        texts = sorted(set(texts))
        rng.shuffle(texts)
        rows += [(x, code) for x in texts[: limit // len(CLASSES)]]
    rng.shuffle(rows)
    return [r[0] for r in rows], [r[1] for r in rows]


def fit(texts: list[str], codes: list[str], epochs: int = 6) -> dict[str, np.ndarray]:
    """Fits, leaves out what looks mislabelled, and fits again. Half of the copies are clipped or stripped of accents."""
    net = train_network(texts, codes, epochs=2)
    got = Reader(net).pooled([t.encode() for t in texts])[:, :-1].argmax(1)
    kept = [(t, c) for t, c, g in zip(texts, codes, got) if CLASSES[g] == c or c == NONE]
    rng = random.Random(3)
    more = []
    for t, c in kept:
        if c in LANGUAGES:
            i = rng.randrange(max(1, len(t) // 2))
            t = t[i : i + rng.randrange(25, 120)]
            more.append((t.upper() if rng.random() < 0.3 else t, c))
    rows = kept + more
    rng.shuffle(rows)
    return train_network([r[0] for r in rows], [r[1] for r in rows], epochs=epochs)


if __name__ == "__main__":
    texts, codes = sample(sys.argv[1])
    held = len(texts) // 10
    net = fit(texts[held:], codes[held:])
    got = Reader(net).pooled([t.encode() for t in texts[:held]])[:, :-1].argmax(1)
    print("agreement with the labels of held-out sentences:", np.mean([CLASSES[g] == c for g, c in zip(got, codes)]))
    np.savez_compressed(sys.argv[2], **{k: v.astype(np.float16) for k, v in net.items()})
