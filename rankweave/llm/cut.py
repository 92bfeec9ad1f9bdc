"""Problem 6: texts cut at a field limit or in mid-transfer, and how often each source cuts.

Method: intact values are cut artificially to make positives; a logistic regression over hashed
features (closing characters, punctuation, length to a limit, the stated length) is trained on them
and scores every record. Two features are gathered from the whole corpus before: whether the last
line occurs as a complete line elsewhere, and whether any other capture of the same page goes on
where this one stops (marks and closing blanks aside).

The classifier is fitted on at most ``TRAIN_ROWS`` records taken as intact: the stated length is the
length, and no sibling goes on. They are chosen by hash, so the choice is stable, and have at most
``TRAIN_CHARS`` characters each; nothing else is bounded. A few of them are cut all the same, which
the regression bears. As more records are cut in training than in the corpus, the log-odds are shifted
to the share of cut records that all scores together show.

Defined results: NULL and blank texts are no case; a differing stated length alone is none; rows
without url have no siblings; repeated rows are each scored; rows with
a NULL key are left out; with no intact record to learn from,
nothing is found.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.lines import ITEM, RELATED, STOP, WORD, furniture_score, is_prose, title_like
from rankweave.session import written

TRAIN_ROWS, TRAIN_CHARS = 6000, 20_000
PAGE_PARTS = 16  # the captures of one page are spread over as many parts, by the hash of the text
CUT_SHARE = 0.4  # of the intact records are cut once
BUCKETS = 2048
LEAST_SHARE = 0.005  # of cut records that is assumed
MARK = r"\s*(?:…|\.\.\.|\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|(?:…|\.\.\.)?\s*\[\+\d+ (?:chars?|characters|bytes)\])\s*$"
_MARK = re.compile(MARK)
MARKS = ("…", "...", " [...]", "… [+{n} chars]")
LIMITS = (250, 256, 300, 400, 500, 512, 600, 700, 750, 800, 900, 1000, 1024, 1200, 1500, 1600, 1800, 2000, 2048)
_TERMINAL = re.compile(r"[.!?。！？][\"”’»)\]]*$")
_STOPS = (". ", ".\n", "? ", "! ", "?\n", "!\n", "。", "！", "？")
_CODE = re.compile(r"(?<!\w)(?=[0-9a-f]*\d)(?=\d*[a-f])[0-9a-f]{6,}$|(?<!\w)\d{5,}$")  # a reference or incident number
_CLAUSE = re.compile(r"[.!?。！？][\"”’»)\]]*\s+")


def under_related(lines: list[str]) -> bool:
    """Whether the last line is one of the titles below a heading of related pages."""
    for x in reversed(lines):
        if RELATED.match(x.strip()):
            return x is not lines[-1]
        if not title_like(x.strip()):
            return False
    return False


def closing(text: str, stated: int | None) -> tuple:
    """What the end of a text looks like, before anything is known of other texts."""
    size, size_b = len(text), len(text.encode("utf-8", "replace"))
    mark = bool(_MARK.search(text[-40:]))
    bare = _MARK.sub("", text) if mark else text
    tail = bare[-1:] or " "
    stripped = bare.rstrip()
    last = stripped.rsplit("\n", 1)[-1].strip()
    lines = [x for x in stripped.split("\n") if x and not x.isspace()]
    furniture = bool(last) and (furniture_score(last) >= 1.5 or under_related(lines))
    stops = sum(map(stripped[:-1].count, _STOPS))  # does this text end sentences at all?
    style = "none" if not stops else "few" if 150 * stops < size else "most"
    tiny = min(size // 60, 3)
    terminal = bool(_TERMINAL.search(last[-4:]))
    clause = _CLAUSE.split(last[-400:])[-1]
    words = WORD.findall(clause)
    final = stripped[-1:] or " "
    kind = (
        "broken" if "�" in bare[-4:] else "terminal" if terminal else "comma" if final in ",;:–-" else "code" if _CODE.search(last[-24:]) else "digit" if final.isdigit() else "open" if final in "([{<\"“„«¿¡/" else "letter" if final.isalpha() else "other"
    )
    prose = sum(w.lower() in STOP for w in words) >= 2 and len(words) >= 4 or is_prose(last)
    state = "furniture" if furniture else "title" if not prose and title_like(last) else "prose" if prose else "row" if len(lines) > 2 and ITEM.match(last) and ITEM.match(lines[-2].strip()) else "short" if len(words) <= 4 else "run"
    round_ = "limit" if size % 100 == 0 or size_b % 100 == 0 or size in LIMITS or size_b in LIMITS else "none"
    if stated is None or stated <= 0:
        rel = "none"
    elif stated in (size, size_b, len(text.strip())):
        rel = "equal"
    elif stated > max(size, size_b):
        rel = "more" if stated > 1.08 * size_b + 20 else "bit"
    else:
        rel = "less"
    word = words[-1].lower() if words else ""
    alone = [
        f"kind={kind}", f"round={round_}", f"stated={rel}", f"mark={mark}", f"space={tail.isspace()}", f"tail={tail if not tail.isalnum() else 'w'}", f"kr={kind},{round_}", f"kt={kind},{rel}",
        f"stop={word in STOP and not terminal}", f"style={style}", f"yk={style},{kind},{rel}", f"ys={style},{state},{rel}", f"tiny={tiny},{kind},{state}", f"fr={furniture},{kind},{rel}", f"yr={style},{round_},{kind}", f"wl={min(len(word), 8)},{kind}" if prose else "wl=-", f"cl={min(len(words), 12)},{kind}",
    ]
    return hashed(alone), kind, state, round_, rel, furniture


@lru_cache(1 << 14)
def _context(kind: str, state: str, round_: str, rel: str, longer: bool) -> list[int]:
    return hashed([f"state={state}", f"longer={longer}", f"ks={kind},{state}", f"sr={state},{round_}", f"st={state},{rel}", f"kl={kind},{longer}", f"sl={state},{longer}"])


def features(text: str, stated: int | None, known: bool, longer: bool) -> list[int]:
    """Hashed features of one record: of its end, and crossed with what other texts tell."""
    alone, kind, state, round_, rel, _ = closing(text, stated)
    return alone + _context(kind, "known" if known else state, round_, rel, longer)


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


def artificial(intact: list[tuple[str, int | None, bool]], seed: int = 7) -> list[tuple[list[int], int]]:
    """Training rows: each intact record as it is, and once cut."""
    rnd, out = random.Random(seed), []
    for text, _, known in intact:
        r = rnd.random()  # stated lengths of intact records: right, missing, or counted before clean-up
        said = len(text) if r < 0.8 else None if r < 0.9 else len(text) + rnd.randint(1, 3 + len(text) // 30)
        out.append((features(text, said, known, False), 0))
        if len(text) < 80 or rnd.random() > CUT_SHARE:
            continue
        if rnd.random() < 0.45 and (fit := [x for x in LIMITS if 0.1 * len(text) < x < 0.97 * len(text)]):
            at = rnd.choice(fit)
        else:
            at = rnd.randint(max(20, len(text) // 10), int(0.97 * len(text)))
        piece = text[:at]
        if rnd.random() < 0.06:
            piece = piece.rstrip() + "�" * rnd.randint(1, 2)
        elif rnd.random() < 0.12:
            piece = piece.rstrip() + rnd.choice(MARKS).format(n=len(text) - at)
        whole = text[at : at + 1] == "\n" and not piece.endswith("\n")  # the cut fell between lines
        r = rnd.random()
        said = len(text) if r < 0.4 else len(piece) if r < 0.85 else None
        out.append((features(piece, said, whole, rnd.random() < 0.35), 1))
    return out


def fit(rows: list[tuple[list[int], int]], rounds: int = 900, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic regression; batch gradient with AdaGrad."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        w[-1] = -10.0
        return w
    width = max(len(f) for f, _ in rows)
    x = np.full((len(rows), width), BUCKETS + 1)
    for i, (f, _) in enumerate(rows):
        x[i, : len(f)] = f
    y = np.array([t for _, t in rows], dtype=float)
    seen = np.full(BUCKETS + 2, 1e-8)
    v = np.zeros(BUCKETS + 2)
    b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(v[x].sum(axis=1) + b)))
        e = (p - y) / len(y)
        g = np.bincount(x.ravel(), weights=np.repeat(e, width), minlength=BUCKETS + 2) + l2 * v
        seen += g * g
        v -= rate * g / np.sqrt(seen)
        v[BUCKETS + 1] = 0.0
        b -= rate * e.sum()
    w[:BUCKETS], w[-1] = v[:BUCKETS], b
    return w


_BLANK = " \t\r\n\u00a0\u3000�"


def _bare(text: Column) -> Column:
    """A text without the mark of a cut and closing blanks; the mark is looked for in the last characters only."""
    marked = F.substring(text, -40, 40).rlike(MARK)
    return F.rtrim(F.when(marked, F.concat(F.substring(text, F.lit(1), F.length(text) - 40), F.regexp_replace(F.substring(text, -40, 40), MARK, ""))).otherwise(text), F.lit(_BLANK))


def _line_hash(line: Column) -> Column:
    """Hash of a line without regard to case, digits and blanks."""
    return F.xxhash64(F.translate(F.lower(line), "0123456789 \t\r", ""))


def facts_of(rows: DataFrame, key: str, text: str, page: Column, stated: str) -> DataFrame:
    """Of each non-blank row: ``inner`` and ``pages`` (its last line is complete elsewhere, or ends several pages), ``longer`` (a sibling goes on), ``right`` (the stated length is right)."""
    named = rows.select(F.col(key).alias("_key"), F.col(stated).cast("bigint").alias("_stated"), F.col(text).alias("_text"), page.alias("_name")).filter(F.col("_text").rlike(r"\S"))
    base = named.select("_key", "_stated", "_text", F.xxhash64("_name").alias("_page"), F.col("_name").isNotNull().alias("_has_page"))  # the name is made once a row
    split = F.split(F.rtrim(F.col("_text"), F.lit(_BLANK)), "\n")
    n = F.size(split)
    lines = base.select("_page", F.explode(F.array_distinct(F.transform(split, lambda x, i: F.struct(_line_hash(x).alias("line"), (i < n - 1).alias("inner"))))).alias("_l"))
    seen = lines.groupBy("_l.line").agg(F.max(F.col("_l.inner")).alias("inner"), (F.min("_page") != F.max("_page")).alias("pages"))
    seen = seen.filter(F.col("inner") | F.col("pages"))
    right = (F.col("_stated") == F.length("_text")) | (F.col("_stated") == F.octet_length("_text"))
    slim = base.withColumn("_bare", _bare(F.col("_text"))).select(
        "_key", "_page", "_has_page", _line_hash(F.element_at(split, -1)).alias("_line"), F.length("_bare").alias("_len"), F.xxhash64("_bare").alias("_hash"), (F.coalesce(right, F.lit(False)) & (F.length("_text") <= TRAIN_CHARS)).alias("right"), F.xxhash64("_text").alias("_order")
    )
    slim = written(slim, "cut-ends")
    # every distinct capture of a page is hashed at the lengths of the page's other captures
    lengths = slim.filter("_has_page").groupBy("_page").agg(F.collect_set("_len").alias("_lens")).filter(F.size("_lens") > 1)
    lengths = lengths.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PAGE_PARTS - 1))))
    captures = base.filter("_has_page").select("_page", _bare(F.col("_text")).alias("_bare")).withColumn("_hash", F.xxhash64("_bare")).withColumn("_part", F.pmod("_hash", F.lit(PAGE_PARTS)).cast("int"))
    captures = captures.repartition("_page", "_part").groupBy("_page", "_part", "_hash").agg(F.first("_bare").alias("_bare"))
    shorter = F.filter("_lens", lambda n: n + 1 < F.length("_bare"))
    heads = captures.join(lengths, ["_page", "_part"]).select("_page", F.explode(F.transform(shorter, lambda n: F.struct(n.alias("len"), F.xxhash64(F.substring(F.col("_bare"), F.lit(1), n)).alias("hash")))).alias("_h"))
    ends = heads.select("_page", F.col("_h.len").alias("_len"), F.col("_h.hash").alias("_hash")).distinct().withColumn("_longer", F.lit(True))
    facts = slim.join(seen, slim["_line"] == seen["line"], "left").join(ends, ["_page", "_len", "_hash"], "left")
    no = F.lit(False)
    facts = facts.select("_key", F.coalesce("inner", no).alias("inner"), F.coalesce("pages", no).alias("pages"), F.coalesce("_longer", no).alias("longer"), "right", "_order")
    yes = lambda c: F.max(c).alias(c)
    return facts.groupBy("_key", "_order").agg(yes("inner"), yes("pages"), yes("longer"), yes("right"))  # a repeated row has one set of facts


def score_cuts(rows: DataFrame, key: str, text: str, page: Column, stated: str, source: str) -> DataFrame:
    """``key``, ``source`` and ``score`` (probability that the text is cut) of each non-blank record.

    Whole texts are scanned, never shuffled to be scored: a pass over them gives the score for each
    outcome of the two corpus features, and the join with those features takes only numbers.
    """
    facts = written(facts_of(rows, key, text, page, stated), "cut-facts")
    base = rows.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(stated).cast("bigint").alias("_stated"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_order")).filter(F.col("_text").rlike(r"\S"))
    keys = facts.filter("right AND NOT longer").orderBy("_order", "_key").limit(TRAIN_ROWS).select("_key", "inner", "pages", "_order")
    sample = base.select("_key", "_text", "_stated", "_order").join(F.broadcast(keys), ["_key", "_order"]).orderBy("_order", "_key").collect()  # TRAIN_ROWS at most
    intact = [(r["_text"], r["_stated"], r["inner"] or r["pages"] and closing(r["_text"], None)[-1]) for r in sample]
    train = artificial(intact)
    weights = fit(train)
    types = {f.name: f.dataType.simpleString() for f in base.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = weights.tolist(), float(weights[-1])
        for b in batches:
            out, furniture = [[], [], [], []], []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                alone, kind, state, round_, rel, fur = closing(t, s)
                z = b0 + sum(w[i] for i in alone)
                for o, (name, longer) in zip(out, ((state, False), (state, True), ("known", False), ("known", True))):
                    o.append(z + sum(w[i] for i in _context(kind, name, round_, rel, longer)))
                furniture.append(fur)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4), *[pa.array(o, pa.float64()) for o in out], pa.array(furniture, pa.bool_())], names=["_key", "_source", "_order", "z00", "z01", "z10", "z11", "_furniture"])

    z = base.mapInArrow(run, f"_key {types['_key']}, _source {types['_source']}, _order bigint, z00 double, z01 double, z10 double, z11 double, _furniture boolean").join(facts, ["_key", "_order"])
    known = F.col("inner") | (F.col("pages") & F.col("_furniture"))
    one = F.when(known, F.when(F.col("longer"), F.col("z11")).otherwise(F.col("z10"))).otherwise(F.when(F.col("longer"), F.col("z01")).otherwise(F.col("z00")))
    scored = written(z.select("_key", "_source", one.alias("_z")), "cut-scores")
    bins = scored.groupBy(F.round(F.least(F.greatest("_z", F.lit(-40.0)), F.lit(40.0)), 1).alias("z")).count().collect()  # 801 at most
    shift = prior_shift([(r["z"], r["count"]) for r in bins], sum(t for _, t in train) / max(1, len(train)))
    return scored.select(F.col("_key").alias(key), F.col("_source").alias(source), (1 / (1 + F.exp(-(F.col("_z") + F.lit(shift))))).alias("score"))


def prior_shift(bins: list[tuple[float, int]], trained: float, rounds: int = 200) -> float:
    """What to add to log-odds learned where a share ``trained`` is cut, so that they hold for all records.

    The share of cut records is that at which the mean probability equals it (expectation
    maximisation over the log-odds of all records, as a histogram).
    """
    if not bins or not 0 < trained < 1:
        return 0.0
    z, n = np.array([b for b, _ in bins]), np.array([c for _, c in bins], dtype=float)
    odds = math.log(trained / (1 - trained))
    shift = 0.0
    for _ in range(rounds):
        share = float(np.average(1 / (1 + np.exp(-(z + shift))), weights=n))
        share = min(max(share, LEAST_SHARE), trained)
        shift = math.log(share / (1 - share)) - odds
    return shift


def cut_rates(scored: DataFrame, source: str) -> DataFrame:
    """Per source: records, cut records, and their share."""
    n = scored.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") >= 0.5).alias("n_cut"))
    return n.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_rows"), 6))
