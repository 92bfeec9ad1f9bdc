"""Problem 1: pages of keywords, links or product tags instead of sentences.

Method: every page is cut into phrases of five words, the shingles of its words in order, and the
distinct hosts of each phrase are counted over all pages. A phrase stands as it is written. Stuffed
pages also pour the keywords of a page into patterns that all such pages share ("buy X, X price, best
X"), so a phrase of which at least four words are such keywords, links or numbers, a keyword phrase,
is counted in a second form besides: a word that the page repeats stands for its place in the phrase,
a number for a number. A phrase of either form that other hosts have is replicated. A page is flagged
when it is list-dense (most of its text is no sentence), keyword phrases are a fair part of it, and
its list text is stitched from replicated phrases. All must hold: replication decides which
list-dense pages are flagged, and without other hosts none is.

Honest lists, tables and link collections stay: their entries differ, so they have few such phrases.

Defined results: NULL and blank texts are no case; nor are texts whose list text has under five
words, as they have no phrase; rows without host form one host of their own; repeated rows are each
judged, and add no host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.lines import STOP, WORD, is_latin, menu_share
from rankweave.llm.residue import FILLER_MARK, line_marks
from rankweave.session import written

SHINGLE = 5
KEYWORDS = 4  # of the words of a phrase
REPEATED = 2  # uses in a page from which a word is one of its keywords
HOSTS = 2  # from which a phrase is replicated
DENSE = 0.5  # share of list text among list text and prose
STITCHED = 0.3  # share of the phrases of the list text that are replicated; one foreign word spoils five phrases
KEYED = 0.15  # share of the phrases of the whole page that are keyword phrases
VARIED = 0.55  # distinct words by words, up to which a list without sentences repeats itself
SALTS = 16  # parts of a popular phrase
BATCH = 512  # pages whose phrases are made at once
_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
_LINK = re.compile(r"\[[^\]]*\]\([^)\s]*\)|https?://\S+|(?<![\w@])#\w{3,}|(?<![\w@.])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,9}(?:/\S*)?(?![\w.])", re.I)
_STOPPED = re.compile(r"[.!?…](?:\s|$)")
_SKU = re.compile(r"\b[A-Z]{2,}-?\d{3,}\b")
_CJK = re.compile(r"[぀-ヿ一-鿿]")


@lru_cache(1 << 16)
def line_evidence(line: str) -> tuple:
    """(list text, prose characters, link characters, words of the list text, short rows) of a line."""
    prose = linked = 0
    listed: list[str] = []
    seen: list[str] = []
    short: list[tuple[str, tuple[str, ...]]] = []
    for seg in _SENTENCES.split(line) if len(line) > 60 else (line,):
        words = [w.lower() for w in WORD.findall(seg)]
        n = len(words)
        if not n:
            continue
        stops = sum(w in STOP for w in words)
        content = [w for w in words if w not in STOP]
        if n >= 6 and content and (top := max(map(content.count, set(content)))) >= 3 and top >= 0.25 * len(content):
            if is_latin(seg):
                continue  # filler, not keywords
            listed.append(seg)  # a sentence that says one word over and over
            seen += words
            continue
        links = sum(len(m) for m in _LINK.findall(seg)) if any(c in seg for c in "./#") else 0
        if links and links >= 0.5 * len(seg.replace(" ", "")):
            listed.append(seg)
            linked += len(seg)
            seen += words
        elif _SKU.search(seg):
            short.append((seg, tuple(words)))
        elif n >= 12 and not _STOPPED.search(seg) and sum(w.isdigit() for w in words) < 0.2 * n and (
            seg.count("|") + seg.count(";") >= 6 and menu_share(seg) < 0.5 or n >= 20 and len({w for w in words if w in STOP}) <= 3 and len(set(words)) <= 0.7 * n
        ):  # a list without a sentence, whatever little words its items have
            if not is_latin(seg):
                listed.append(seg)
                seen += words
        elif (n >= 4 and stops >= 2 and stops >= 0.12 * n) or (not seg.isascii() and len(_CJK.findall(seg)) > 0.3 * len(seg)):
            prose += len(seg)
        elif n >= 12 and stops < 0.12 * n and sum(w.isdigit() for w in words) < 0.2 * n and (n > 40 or menu_share(seg) < 0.5) and not is_latin(seg):
            listed.append(seg)
            linked += links
            seen += words
        elif not is_latin(seg):
            short.append((seg, tuple(words)))
    return tuple(listed), prose, linked, tuple(seen), tuple(short)


def page_evidence(lines: list[str]) -> dict:
    """List density of a page, its list text, and whether that says the same words over and over or is links."""
    prose = linked = 0
    parts: list[str] = []
    words_seen: list[str] = []
    short: list[tuple[str, tuple[str, ...]]] = []
    for line in lines:
        a, b, c, seen, rows = line_evidence(line)
        if (a or rows) and line_marks(line) & FILLER_MARK:
            continue
        parts += a
        prose, linked = prose + b, linked + c
        words_seen += seen
        short += rows
    listed = sum(map(len, parts))
    if len(short) >= 5 and sum(len(x) for x, _ in short) + listed >= DENSE * prose:  # else they cannot decide
        pairs = Counter(p for _, w in short for p in set(zip(w, w[1:])))
        key, most = pairs.most_common(1)[0] if pairs else (None, 0)
        skus = sum(bool(_SKU.search(s)) for s, _ in short) >= max(4, 0.4 * len(short))
        keyed = most >= max(5, 0.4 * len(short))
        for seg, w in short:
            if (keyed and key in set(zip(w, w[1:]))) or (skus and _SKU.search(seg)):
                parts.append(seg)
                words_seen += w
    elif short and not prose and not listed:  # a lone short list
        words = [w for _, ws in short for w in ws]
        if len(words) >= 8 and len(set(words)) <= VARIED * len(words):
            parts, words_seen = [s for s, _ in short], words
    listed = sum(map(len, parts))
    varied = len(set(words_seen)) / len(words_seen) if words_seen else 1.0
    density = listed / (listed + prose) if listed else 0.0
    dense = len(words_seen) >= SHINGLE and density >= DENSE
    return {"density": density, "text": "\n".join(parts), "dense": dense, "spam": dense and (varied <= VARIED or linked >= 0.5 * listed)}


_LINKED = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|https?://\S+|(?<![\w@.])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,9}(?:/\S*)?(?![\w.])", re.I)
_MAY_LINK = re.compile(r"\.[A-Za-z]")
_TAG = re.compile(r"(?<![\w@])#(\w{3,})")
_PART = re.compile(r"[^\W\d_]?[^\W\d_A-Z]+|[A-Z]+|\d+")
_TOKEN = re.compile(r"[^\W_]+|[\x00\x01]")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_WORD_OF: dict[str, tuple[int, int, int]] = {}  # of the words seen by this worker: hash where numbers are alike, kind, hash as written
_STOPS, _NUMBER, _LINKS, _ARTICLE, _PLAIN = 1, 2, 3, 4, 0


def _told(word: str) -> tuple[int, int, int]:
    if word == "\x01":
        return 1, _LINKS, 1
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) | 8
    if word.isdigit():
        return 2, _NUMBER, h
    if word[-1].isdigit() and word[0].isalpha():
        return 3, _ARTICLE, h
    return h, _STOPS if word in STOP else _PLAIN, h


def _prepared(text: str) -> str:
    """A text in lower case, with a mark for each link and tags taken apart into their words."""
    text = text.replace("\x00", " ").replace("\x01", " ")
    if "://" in text or "](" in text or _MAY_LINK.search(text):
        text = _LINKED.sub(" \x01 ", text)
    if "#" in text:
        text = _TAG.sub(lambda m: " " + " ".join(_PART.findall(m.group(1))) + " ", text)
    return text.lower()


def _hashed(words: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    """One hash of five words each."""
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = (out ^ words(k)) * _ODD[k]
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrases of each text; for each phrase the number of its text, its hash as written, and whether it is a keyword phrase; for each keyword phrase its hash without the keywords)."""
    size = np.zeros(len(texts), dtype=np.int64)
    none = np.empty(0, dtype=np.int64)
    nothing = none, none, none.astype(bool), none
    tokens = _TOKEN.findall("\x00".join(map(_prepared, texts)))
    if len(tokens) < SHINGLE:
        return size, *nothing
    if len(_WORD_OF) > 500_000:
        _WORD_OF.clear()
    distinct = set(tokens)
    for w in distinct - _WORD_OF.keys():
        _WORD_OF[w] = _told(w)
    number = {w: i for i, w in enumerate(distinct)}
    told = [_WORD_OF[w] for w in number]
    word_hash, word_kind, word_raw = np.array([h for h, _, _ in told], dtype=np.uint64), np.array([k for _, k, _ in told], dtype=np.int8), np.array([r for _, _, r in told], dtype=np.uint64)
    ids = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    gap = ids == number.get("\x00", -1)
    page = np.cumsum(gap)
    ids, page = ids[~gap], page[~gap]
    n = len(ids) - SHINGLE + 1
    size = np.maximum(np.bincount(page, minlength=len(texts)) - SHINGLE + 1, 0)
    if n < 1:
        return size, *nothing
    kind, h, raw = word_kind[ids], word_hash[ids], word_raw[ids]
    own = page * len(number) + ids
    back, uses = np.unique(own, return_inverse=True, return_counts=True)[1:]
    key = (kind == _PLAIN) & (uses[back] >= REPEATED)
    # a function word between two keywords is one if the page repeats the three
    mid = np.flatnonzero((kind[1:-1] == _STOPS) & key[:-2] & key[2:] & (page[:-2] == page[2:])) + 1
    if len(mid):
        with np.errstate(over="ignore"):
            three = ((h[mid - 1] * _ODD[0] ^ h[mid]) * _ODD[1] ^ h[mid + 1]) * _ODD[2] ^ page[mid].astype(np.uint64) * _ODD[3]
        back, uses = np.unique(three, return_inverse=True, return_counts=True)[1:]
        key[mid[uses[back] >= REPEATED]] = True
    filled = key | (kind == _LINKS) | (kind == _ARTICLE)
    total = np.concatenate(([0], np.cumsum(filled)))
    every = np.flatnonzero(page[:n] == page[SHINGLE - 1 :])
    keyed = total[every + SHINGLE] - total[every] >= KEYWORDS
    at = every[keyed]

    def left_out(k: int) -> np.ndarray:
        place = np.full(len(at), k, dtype=np.uint64)  # the first place of the same keyword in the phrase
        for j in range(k - 1, -1, -1):
            place = np.where(ids[at + j] == ids[at + k], np.uint64(j), place)
        return np.where(key[at + k], place + np.uint64(100), h[at + k])

    return size, page[every], _hashed(lambda k: raw[every + k], len(every)), keyed, _hashed(left_out, len(at))


def phrases(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrases of each text; for each keyword phrase the number of its text, and its hash without the keywords)."""
    size, page, _, keyed, patterns = shingles(texts)
    return size, page[keyed], patterns


def _ends(page: np.ndarray, n: int) -> list[int]:
    return np.searchsorted(page, np.arange(n + 1)).tolist()


def list_phrases(texts: list[str]) -> dict[str, tuple]:
    """(list density, number of phrases of the list text; of its distinct phrases the hash as written, the hash without keywords where it is a keyword phrase, and the uses) of the list-dense texts that have enough keyword phrases."""
    out: dict[str, tuple] = {}
    for start in range(0, len(texts), BATCH):
        some = texts[start : start + BATCH]
        size, page, _ = phrases(some)
        ends = _ends(page, len(some))
        lists = []
        for t, n, a, b in zip(some, size, ends, ends[1:]):
            if b > a and b - a >= KEYED * n and (e := page_evidence([s for x in t.split("\n") if (s := x.strip())]))["dense"]:
                lists.append((t, e))
        _, page, words, keyed, left_out = shingles([e["text"] for _, e in lists])
        patterns = words.copy()
        patterns[keyed] = left_out
        ends = _ends(page, len(lists))
        for (t, e), a, b in zip(lists, ends, ends[1:]):
            both, uses = np.unique(np.stack((words[a:b], patterns[a:b])), axis=1, return_counts=True)
            out[t] = (e["density"], b - a, both[0], both[1], uses)
    return out


def _texts(rows: DataFrame, key: Column, text: str) -> DataFrame:
    return rows.select(key.alias("_key"), F.col(text).cast("string").alias("_text")).filter(F.col("_text").isNotNull())


def evidence(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Of each list-dense page with enough keyword phrases: ``_key``, list density, ``n_phrases`` of its list text, and its distinct phrases, ``phrases`` as written and ``patterns`` without keywords, with their ``uses``; no shuffle."""
    chosen = _texts(rows, F.col(key), text)
    key_type = chosen.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = list_phrases(list(dict.fromkeys(texts)))  # captures repeat: each text once
            at = [i for i, t in enumerate(texts) if t in found]
            cols = list(zip(*[found[texts[i]] for i in at])) or [()] * 5
            many = pa.list_(pa.int64())
            arrays = [b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.int32(), many, many, many))]]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "density", "n_phrases", "phrases", "patterns", "uses"])

    return chosen.mapInArrow(run, f"_key {key_type}, density double, n_phrases int, phrases array<bigint>, patterns array<bigint>, uses array<bigint>")


def host_phrases(rows: DataFrame, host: str, text: str) -> DataFrame:
    """``_host`` and ``phrase`` of every phrase of every page, in both forms, each once a batch."""
    chosen = _texts(rows, F.coalesce(F.xxhash64(F.col(host)), F.lit(0)), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts_of: dict[str, set[int]] = {}
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hosts_of.setdefault(t, set()).add(h)
            texts = list(hosts_of)
            hosts, found = [], []
            for start in range(0, len(texts), BATCH):
                some = texts[start : start + BATCH]
                _, page, words, keyed, patterns = shingles(some)
                for numbers, forms in ((page, words), (page[keyed], patterns)):
                    ends = _ends(numbers, len(some))
                    for t, x, y in zip(some, ends, ends[1:]):
                        for h in hosts_of[t] if y > x else ():
                            hosts.append(np.full(y - x, h, dtype=np.int64))
                            found.append(forms[x:y])
            if not found:
                continue
            host, phrase = np.concatenate(hosts), np.concatenate(found)
            order = np.lexsort((phrase, host))
            host, phrase = host[order], phrase[order]
            new = np.concatenate(([True], (host[1:] != host[:-1]) | (phrase[1:] != phrase[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(host[new]), pa.array(phrase[new])], names=["_host", "phrase"])

    return chosen.mapInArrow(run, "_host bigint, phrase bigint")


def phrase_hosts(pairs: DataFrame) -> DataFrame:
    """``phrase`` and ``n_hosts`` of the phrases that at least ``HOSTS`` hosts have."""
    return pairs.distinct().groupBy("phrase").agg(F.count("*").alias("n_hosts")).filter(F.col("n_hosts") >= HOSTS)


def replicated_share(dense: DataFrame, counts: DataFrame) -> DataFrame:
    """``_row`` and ``replicated``: share of the phrases of a page's list text that other hosts have too, as written or without keywords.

    A phrase that a third of all pages have is spread over ``SALTS`` parts, with its count beside each; only
    phrases of these pages are.
    """
    wanted = dense.select(F.explode(F.concat("phrases", "patterns")).alias("phrase")).distinct()
    salted = counts.join(wanted, "phrase", "left_semi").select("phrase", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = dense.select("_row", "n_phrases", F.posexplode(F.arrays_zip("phrases", "patterns", "uses")).alias("_at", "_p"))
    forms = own.select("_row", "n_phrases", "_at", F.col("_p.uses").alias("_n"), F.explode(F.array_distinct(F.array("_p.phrases", "_p.patterns"))).alias("phrase")).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    once = forms.join(salted, ["phrase", "_salt"]).groupBy("_row", "n_phrases", "_at").agg(F.first("_n").alias("_n"))
    return once.groupBy("_row", "n_phrases").agg((F.sum("_n") / F.col("n_phrases")).alias("replicated")).drop("n_phrases")


def stuffed_pages(rows: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """Flagged pages: ``key``, ``density`` and ``replicated``."""
    dense = written(evidence(rows, key, text).withColumn("_row", F.monotonically_increasing_id()), "stuffed-lists")
    share = replicated_share(dense, phrase_hosts(host_phrases(rows, host, text))).filter(F.col("replicated") >= STITCHED)
    return dense.select("_row", F.col("_key").alias(key), "density").join(share, "_row").drop("_row")
