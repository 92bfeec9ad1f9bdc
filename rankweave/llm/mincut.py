"""Minimum-cut labelling of the lines of pages: body or furniture (see ``body``)."""

from __future__ import annotations

import numpy as np

from rankweave.llm.lines import MARKED, RELATED, furniture_score, title_like

NEAR, NEXT = 1.1, 0.35  # capacity between neighbours, and between lines two apart in a block
HEADING = -2.0  # of a menu label that stands alone in the middle of a page
EDGE_LABEL = 0.8  # a bare menu label at the top or the bottom of a page


def line_costs(lines: list[str]) -> list[float]:
    """Log-odds of furniture for the non-blank lines of one page, with what precedes them in view."""
    score = [furniture_score(x) for x in lines]
    n, related = len(lines), False
    for i, x in enumerate(lines):
        if RELATED.match(x):
            related = True
        elif related:
            if title_like(x) and score[i] < 1 and not MARKED.match(x):
                score[i] = 2.2
            elif score[i] < 1:
                related = False
    menu = [0.5 < s < 1.5 and len(x) < 40 for s, x in zip(score, lines)]
    i = 0
    while i < n:  # runs of bare labels
        j = i
        while j < n and (menu[j] or score[j] >= 3):
            j += 1
        labels = sum(menu[i:j])
        if labels == 1 and i > 0 and j < n:  # a bare label in the middle of a page is a heading
            for k in range(i, j):
                if menu[k]:
                    score[k] = HEADING
        elif labels:
            lift = (1.2 if labels >= 3 else 0.4 if labels == 2 else 0.0) + (EDGE_LABEL if i == 0 or j == n else 0.0)
            for k in range(i, j):
                if menu[k]:
                    score[k] += lift
        i = max(j, i + 1)
    return score


def min_cut(score: np.ndarray, near: np.ndarray, far: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Labels (1: furniture) of the minimum cut of each row's band graph.

    ``score[r, i]`` > 0 is the capacity lost by calling line i of row r body, < 0 by calling it
    furniture; ``near[r, i]`` and ``far[r, i]`` join line i to i-1 and i-2. Ties go to body.
    """
    rows, width = score.shape
    cost = np.zeros((rows, 4))  # state 2a+b: label a of line i-1, b of line i
    back = np.zeros((width, rows, 4), dtype=np.int8)
    lab = np.array([0, 1])
    for i in range(width):
        live = (i < length)[:, None]
        unary = np.where(lab == 1, np.maximum(-score[:, i], 0)[:, None], np.maximum(score[:, i], 0)[:, None] + 0.0)
        new = np.full((rows, 4), np.inf)
        for b in (0, 1):
            for c in (0, 1):  # line i-1 is b, line i is c
                best = np.full(rows, np.inf)
                frm = np.zeros(rows, dtype=np.int8)
                for a in (0, 1) if i > 1 else (0,):
                    base = cost[:, 2 * a + b] if i > 0 else (np.zeros(rows) if b == 0 else np.full(rows, np.inf))
                    v = base + (near[:, i] * (b != c) if i > 0 else 0) + (far[:, i] * (a != c) if i > 1 else 0)
                    better = v < best - 1e-12
                    best = np.where(better, v, best)
                    frm = np.where(better, np.int8(a), frm)
                new[:, 2 * b + c] = best + unary[:, c]
                back[i, :, 2 * b + c] = frm
        cost = np.where(live, new, cost)
    labels = np.zeros((rows, width), dtype=np.int8)
    state = cost.argmin(axis=1)
    at = np.arange(rows)
    for i in range(width - 1, -1, -1):
        live = i < length
        labels[live, i] = state[live] & 1
        prev = back[i, at, state].astype(np.int64) * 2 + (state >> 1)
        state = np.where(live, prev, state)
    return labels


GROUP = 512  # pages cut at once, of like length


def furniture_lines(texts: list[str | None]) -> list[list[int]]:
    """Line numbers (from 1, blank lines counted) of the furniture of each text."""
    pages, out = [], [[] for _ in texts]
    for t_no, text in enumerate(texts):
        if not text or text.isspace():
            continue
        numbered = [(i, s) for i, x in enumerate(text.split("\n"), 1) if (s := x.strip())]
        if numbered:
            pages.append((len(numbered), t_no, numbered))
    pages.sort(key=lambda p: p[0])
    for g in range(0, len(pages), GROUP):
        part = pages[g : g + GROUP]
        width = part[-1][0]
        step = max(1, min(len(part), 4_000_000 // max(1, width * 8)))
        for h in range(0, len(part), step):
            some = part[h : h + step]
            w = some[-1][0]
            score, near, far = np.zeros((len(some), w)), np.zeros((len(some), w)), np.zeros((len(some), w))
            for r, (n, _, numbered) in enumerate(some):
                score[r, :n] = line_costs([x for _, x in numbered])
                no = np.array([i for i, _ in numbered])
                near[r, 1:n] = NEAR
                far[r, 2:n] = np.where(no[2:] - no[:-2] == 2, NEXT, 0.0)
            labels = min_cut(score, near, far, np.array([p[0] for p in some]))
            for r, (n, t_no, numbered) in enumerate(some):
                if labels[r, :n].any():
                    out[t_no] = [i for (i, _), l in zip(numbered, labels[r]) if l]
    return out
