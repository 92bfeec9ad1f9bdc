"""Problem 10: texts over a token limit are cut into pieces at natural boundaries, with overlap.

Method: lexical cohesion. A text is seen as units (sentences, lines); at each gap between units the
similarity of the blocks of words before and after it is measured; topic changes are valleys of
that curve. Each piece ends at the deepest valley within its size window (between half the limit
and the limit), ties going to the stronger boundary (paragraph, line, sentence) and then the later
one. Where a window has no gap, the cut falls between pre-tokens, or inside one that is longer than
the window, at a character boundary. The next piece starts ``overlap`` tokens before the cut; an
overlap of half the limit or more narrows the window to what keeps it.

A piece is a range of the text's token ids: pieces cover the text, no piece exceeds the limit, and
neighbours share exactly ``overlap`` tokens, up to three more where the range would start within a
character. Only where one character has more tokens than the window holds does a piece start or end
within it (its text shows U+FFFD there).

Defined results: NULL, empty and blank texts and texts within the limit give no piece; repeated
rows each give their pieces; a NULL limit splits nothing; a limit under one, and an overlap that is
negative or not below the limit, are errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.tokens import Encoder, encoder

BLOCK = 6  # units on each side of a gap that are compared
_UNIT = regex.compile(r"[^\n.!?。！？…]*(?:\n+|[.!?…]+[\"'”’)\]]*(?:[^\S\n]+|(?=\n)|$)|[。！？]+[”’」』）]*|$|.)")
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}]+")


def _ends(text: str) -> list[tuple[int, int]]:
    """(end, strength) of each unit: 3 a paragraph, 2 a line, 1 a sentence."""
    out, at = [], 0
    for m in _UNIT.finditer(text):
        if m.end() == at:
            continue
        u, at = m.group(), m.end()
        if not u.strip() and out:
            out[-1] = (at, max(out[-1][1], 3 if u.count("\n") > 1 else 2 if "\n" in u else 1))
        elif u[-1:].isspace() or u[-1:] in ".!?…。！？”’」』）\"')]":
            out.append((at, 3 if u.endswith("\n\n") else 2 if u.endswith("\n") else 1))
    return out


def _depths(text: str, gaps: list[tuple[int, int]]) -> list[float]:
    """Depth of the similarity valley at each gap: how far the curve rises on both sides of it."""
    units, at = [], 0
    for e, _ in gaps:
        bag: dict[str, int] = {}
        for w in _WORD.findall(text, at, e):
            w = w.lower()
            bag[w] = bag.get(w, 0) + 1
        units.append(bag)
        at = e
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = ll = rr = 0

    def change(side: dict, other: dict, bag: dict, sign: int) -> tuple[int, int]:
        d = s = 0
        for w, n in bag.items():
            old = side.get(w, 0)
            new = old + sign * n
            d += (new - old) * other.get(w, 0)
            s += new * new - old * old
            if new:
                side[w] = new
            else:
                side.pop(w, None)
        return d, s

    n, sims = len(units), []
    for i in range(min(BLOCK, n)):
        d, s = change(right, left, units[i], 1)
        dot, rr = dot + d, rr + s
    for i in range(n):  # the gap after unit i: it moves from right to left
        d, s = change(right, left, units[i], -1)
        dot, rr = dot + d, rr + s
        d, s = change(left, right, units[i], 1)
        dot, ll = dot + d, ll + s
        if i >= BLOCK:
            d, s = change(left, right, units[i - BLOCK], -1)
            dot, ll = dot + d, ll + s
        if i + BLOCK < n:
            d, s = change(right, left, units[i + BLOCK], 1)
            dot, rr = dot + d, rr + s
        sims.append(dot / math.sqrt(ll * rr) if ll > 0 and rr > 0 else 0.0)
    up_left, up_right = sims[:], sims[:]  # highest point reached by climbing without a fall
    for i in range(1, n):
        if up_left[i - 1] >= sims[i] and sims[i - 1] >= sims[i]:
            up_left[i] = up_left[i - 1]
    for i in range(n - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            up_right[i] = up_right[i + 1]
    return [round(a + b - 2 * s, 9) for a, b, s in zip(up_left, up_right, sims)]


def check_limits(limit: int, overlap: int) -> None:
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"a limit of {limit} tokens cannot have an overlap of {overlap}")


def split_text(text: str, enc: Encoder, limit: int, overlap: int) -> list[tuple[int, int, str, int]]:
    """(first token, end token, text, strength of the cut) of the pieces; none if the text is within the limit."""
    check_limits(limit, overlap)
    parts, ids = enc.pieces(text)
    total = sum(map(len, ids))
    if total <= limit:
        return []
    flat = [t for x in ids for t in x]
    # starts[t]: whether token t starts a character; tokens and characters meet there
    chars = text.encode("utf-8", "replace")
    byte_at = [0]
    for t in flat:
        byte_at.append(byte_at[-1] + len(enc.bytes_of[t]))
    whole = [b == len(chars) or (chars[b] & 0xC0) != 0x80 for b in byte_at]
    # token count at the ends of pre-tokens, by character
    end_tok, c, k = {}, 0, 0
    for p, x in zip(parts, ids):
        c, k = c + len(p), k + len(x)
        end_tok[c] = k
    gaps = _ends(text)
    depth = _depths(text, gaps)
    cuts = []
    for (e, strength), d in zip(gaps, depth):
        tok = end_tok.get(e)
        if tok is None and e and text[e - 1].isspace():  # the last blank belongs to the next pre-token
            tok = end_tok.get(len(text[:e].rstrip(" ")))
        if tok is not None and tok < total:
            cuts.append((tok, strength, d))
    ends = sorted(end_tok.values())
    out, start, i, j = [], 0, 0, 0
    while total - start > limit:
        low, high = start + max(limit // 2, overlap + 1), start + limit
        while i < len(cuts) and cuts[i][0] < low:
            i += 1
        window, m = [], i
        while m < len(cuts) and cuts[m][0] <= high:
            window.append(cuts[m])
            m += 1
        if window:
            end, strength, _ = max(window, key=lambda x: (x[2], x[1], x[0]))
        else:
            strength = 0
            while j + 1 < len(ends) and ends[j + 1] <= high:
                j += 1
            end = ends[j] if low <= ends[j] <= high else next((e for e in range(high, max(low, high - 4) - 1, -1) if whole[e]), high)
        out.append((start, end, strength))
        last, start = start, end - overlap
        start = next((s for s in range(start, max(last, start - 4), -1) if whole[s]), start)
    out.append((start, total, 4))
    return [(a, b, chars[byte_at[a] : byte_at[b]].decode("utf-8", "replace"), s) for a, b, s in out]


PIECES = "piece_no int, first_token int, end_token int, n_tokens int, cut int, piece string"


def split_documents(docs: DataFrame, key: str, text: str, path: str, limit: int | None, overlap: int | None, pattern: str | None = None) -> DataFrame:
    """The pieces of each text over ``limit`` tokens; no shuffle."""
    chosen = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    key_type = chosen.schema["_key"].dataType.simpleString()
    most, share = 1 << 62 if limit is None else limit, overlap or 0
    check_limits(most, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, schema = encoder(path, pattern), None
        for b in batches:
            schema = schema or pa.schema([("_key", b.schema.field(0).type), ("piece_no", pa.int32()), ("first_token", pa.int32()), ("end_token", pa.int32()), ("n_tokens", pa.int32()), ("cut", pa.int32()), ("piece", pa.string())])
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # a token is at least one byte, so a text of no more bytes than the limit is within it
                if t and len(t) * 4 > most and len(t.encode("utf-8", "replace")) > most and (got := split_text(t, enc, most, share)):
                    rows = [(k, n + 1, a, e, e - a, s, p) for n, (a, e, p, s) in enumerate(got)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return chosen.mapInArrow(run, f"_key {key_type}, {PIECES}").withColumnRenamed("_key", key)
