"""Training of the boilerplate field on labelled pages: python -m harrow.llm.train_boilerplate DATA_DIR [PAGES].

Lines are labelled by the written-out knowledge of page furniture in ``page_words`` and by
markup; at most PAGES pages (default 9000, a bounded sample) and as many excerpts are used.
A tenth of them is held out and its accuracy printed. Weights are fitted by stochastic
gradient ascent on the conditional log-likelihood (forward-backward), with AdaGrad steps
and L2 decay, and averaged over the second half of the training; a page is shown without its words three times in ten, and only a part of it as often.
Features seen in fewer than twelve pages are left out.
"""

from __future__ import annotations

import json
import sys
from collections import Counter

import numpy as np
import pandas as pd

from .boilerplate import MODEL_FILE, ChainField, features
from .page_words import FURNITURE, is_menu
from .pages import Block, blocks_of, plain_blocks


def label(block: Block, raw: str) -> int:
    """1 for a main line, 0 for furniture."""
    if block.tag in ("noscript", "in-noscript") or FURNITURE.match(block.text):
        return 0
    if block.linked and (block.tag in ("li", "bare", "in-li") or is_menu(block.text)):
        return 0
    if block.tag in ("h1", "h2", "h3"):
        return 1
    if block.tag in ("li", "tr") and not block.linked:
        return 1
    return 0 if is_menu(block.text, raw) or path_like(block.text) else 1


def path_like(text: str) -> bool:
    """A path through the site: short steps between separators, the first ones menu entries."""
    for sign in (" / ", " > ", " » ", " › "):
        steps = text.split(sign)
        if len(steps) >= 2 and is_menu(sign.join(steps[:-1])):
            return True
    return False


def examples(folder: str, pages: int) -> list[tuple[list[Block], list[int]]]:
    bodies = pd.read_parquet(f"{folder}/fetch_results.parquet", columns=["body"]).body.dropna().drop_duplicates()
    evidence = pd.read_parquet(f"{folder}/site_signals.parquet", columns=["evidence"]).evidence.dropna().drop_duplicates()
    out = []
    for kind, texts in (("body", bodies), ("evidence", evidence)):
        for text in texts.sample(min(pages, len(texts)), random_state=7):
            blocks = blocks_of(text) if kind == "body" else plain_blocks(text)
            lines = text.split("\n")
            labels = [label(b, lines[b.line - 1] if b.tag == "text" else "") for b in blocks]
            if blocks and kind == "body" and "</html>" not in text[-40:] and len(blocks) > 1:
                blocks, labels = blocks[:-1], labels[:-1]  # a cut-off last line has no certain label
            if blocks:
                out.append((blocks, labels))
    return out


def train(data: list[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.3, decay: float = 2e-6, seed: int = 11) -> ChainField:
    rows = [[features(b, i, len(bs)) for i, b in enumerate(bs)] for bs, _ in data]
    seen = Counter(f for page in rows for f in {f for block in page for f in block})
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 12))}
    coded = [[np.array([index[f] for f in block if f in index], dtype=np.int64) for block in page] for page in rows]
    lexical = np.array([f.startswith(("w=", "f=", "z=")) for f in sorted(index, key=index.get)])
    w = np.zeros(len(index))
    g2 = np.full(len(index), 1e-6)
    trans = np.zeros((2, 2, 2))  # fresh container or not, from, to
    t2 = np.full((2, 2, 2), 1e-6)
    start, s2 = np.zeros(2), np.full(2, 1e-6)
    order = np.random.default_rng(seed)
    kept_w, kept_t, kept_s, kept_n = np.zeros(len(index)), np.zeros((2, 2, 2)), np.zeros(2), 0
    for epoch in range(epochs):
        for k in order.permutation(len(data)):
            blocks, y = data[k]
            codes = coded[k]
            if order.random() < 0.3:  # without its words, so that the form of a block tells something of its own
                codes = [c[~lexical[c]] for c in codes]
            fresh = [int(b.fresh) for b in blocks]
            if order.random() < 0.3:  # a part of the page, so that pages may begin and end anywhere
                lo = int(order.integers(0, len(codes)))
                hi = int(order.integers(lo + 1, len(codes) + 1))
                codes, y, fresh = codes[lo:hi], y[lo:hi], fresh[lo:hi]
            n = len(codes)
            e = np.array([w[c].sum() for c in codes])
            emit = np.stack([np.zeros(n), e], 1)
            alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
            alpha[0] = start + emit[0]
            for i in range(1, n):
                alpha[i] = np.logaddexp(alpha[i - 1][0] + trans[fresh[i], 0], alpha[i - 1][1] + trans[fresh[i], 1]) + emit[i]
            for i in range(n - 2, -1, -1):
                nxt = emit[i + 1] + beta[i + 1]
                beta[i] = [np.logaddexp(trans[fresh[i + 1], a, 0] + nxt[0], trans[fresh[i + 1], a, 1] + nxt[1]) for a in (0, 1)]
            z = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
            p1 = np.exp(alpha[:, 1] + beta[:, 1] - z)
            miss = np.array(y) - p1
            flat = np.concatenate(codes)
            grad = np.bincount(flat, weights=np.repeat(miss, [len(c) for c in codes]), minlength=len(w))
            hit = np.unique(flat)
            g2[hit] += grad[hit] ** 2
            w[hit] += rate * grad[hit] / np.sqrt(g2[hit]) - decay * len(data) * w[hit] / np.sqrt(g2[hit] + 1)
            tg = np.zeros((2, 2, 2))
            for i in range(1, n):
                pair = np.exp(alpha[i - 1][:, None] + trans[fresh[i]] + emit[i][None, :] + beta[i][None, :] - z)
                tg[fresh[i]] -= pair
                tg[fresh[i], y[i - 1], y[i]] += 1
            t2 += tg**2
            trans += rate * tg / np.sqrt(t2)
            sg = -np.array([1 - p1[0], p1[0]])
            sg[y[0]] += 1
            s2 += sg**2
            start += rate * sg / np.sqrt(s2)
            if 2 * epoch >= epochs and k % 50 == 0:  # averaged over the second half of the training
                kept_w, kept_t, kept_s, kept_n = kept_w + w, kept_t + trans, kept_s + start, kept_n + 1
    if kept_n:
        w, trans, start = kept_w / kept_n, kept_t / kept_n, kept_s / kept_n
    kept = {f: round(float(w[i]), 3) for f, i in index.items() if abs(w[i]) >= 0.02}
    return ChainField(kept, trans[0].round(3).tolist(), trans[1].round(3).tolist(), start.round(3).tolist())


def main(folder: str, pages: int = 9000) -> None:
    data = examples(folder, pages)
    held = data[::10]
    model = train([d for i, d in enumerate(data) if i % 10])
    right = total = 0
    wrong: Counter = Counter()
    for blocks, y in held:
        for b, got, want in zip(blocks, model.decode(blocks), y, strict=True):
            right += got == bool(want)
            total += 1
            if got != bool(want):
                wrong[(b.text[:100], want)] += 1
    print(f"held-out accuracy {right / total:.5f} of {total} lines; {len(model.weights)} weights")
    for (text, want), n in wrong.most_common(25):
        print(n, want, text)
    MODEL_FILE.write_text(json.dumps({"weights": model.weights, "transitions": model.transitions, "fresh": model.fresh, "start": model.start}, ensure_ascii=False, indent=0, sort_keys=True))


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 9000)
