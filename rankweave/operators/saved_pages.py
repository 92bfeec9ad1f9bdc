"""Result cards, answer items and source lists of saved pages (HTM14 to HTM16).

What needs a browser is left out: layout checks of adverts, and link groups that open on a click.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rankweave.functions.urls import clean_url, decode_any, domain10
from rankweave.operators.html import VOID
from rankweave.operators.setops import is_ad_click

HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
ADS = re.compile(r'adsMv|b_ads|ad_em|mv-data="Ads', re.I)
AD_CLASSES = frozenset(("adsMvCarousel", "adsMvC", "b_ads1line", "ad_em", "mnau"))
CARDS = "array<struct<title:string,href:string,display:string,snippet:string,page_num:int>>"
ITEMS = "array<struct<item_section_title:string,item_position:int,item_name:string,item_text:string,links:array<string>>>"
SOURCES = "array<struct<section:string,title:string,description:string,href:string>>"


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.classes = set(attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        todo = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def above(self) -> Iterator[Node]:
        n = self
        while n is not None:
            yield n
            n = n.parent

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def text(self, skip: Callable[[Node], bool] = lambda n: False) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n is self or not skip(n):
                todo += reversed(n.kids)
        return " ".join("".join(out).split())

    def markup(self) -> str:
        """The start tags of the element and those below, and its text."""
        tags = " ".join(f"<{n.tag} " + " ".join(f'{k}="{v}"' for k, v in n.attrs.items()) + ">" for n in (self, *self.walk()))
        return tags + self.text()

    def siblings(self, step: int) -> Iterator[Node]:
        own = [k for k in self.parent.kids if isinstance(k, Node)] if self.parent else [self]
        at = next(i for i, n in enumerate(own) if n is self) + step
        while 0 <= at < len(own):
            yield own[at]
            at += step


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "li":  # an open item of the same list ends
            for n in self.at.above():
                if n.tag in ("ul", "ol"):
                    break
                if n.tag == "li":
                    self.at = n.parent
                    break
        elif self.at.tag == "p" and tag in ("p", "div", "ul", "ol", *HEADS):
            self.at = self.at.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        for n in self.at.above():
            if n.tag == tag and n.parent is not None:
                self.at = n.parent
                break

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(html: str | None) -> Node:
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _web(n: Node | None) -> str:
    href = n.attrs.get("href", "").strip() if n else ""
    return href if href.lower().startswith(("http://", "https://")) else ""


def sponsored(card: Node) -> bool:
    """Adverts by label, by classes and by the list item around them."""
    if re.match(r"sponsored\b", card.text(), re.I) or ADS.search(card.markup()) or any(n.classes & AD_CLASSES for n in card.walk()):
        return True
    item = next((n for n in card.above() if n.tag == "li"), None)
    if item is None:
        return False
    if re.search(ADS.pattern + "|sponsored", item.markup(), re.I):
        return True
    before = [s.text() for _, s in zip(range(3), item.siblings(-1))]
    return any("sponsored" in t.lower() and len(t) < 100 for t in before)


def _page(root: Node, test: Callable[[Node], bool]) -> int:
    found = root.first(test)
    m = re.match(r"\d+", found.text()) if found else None
    return int(m[0]) if m else 1


def _in(n: Node, name: str) -> bool:
    return any(name in x.classes for x in n.parent.above())


def cards(html: str | None) -> list[dict]:
    """HTM14: result cards of a saved page in order, adverts and cards without title or link left out; urls as written."""
    root, out = tree(html), []
    page = _page(root, lambda n: "sb_pagS" in n.classes)
    snip = lambda n: _in(n, "b_caption") and (n.tag in ("p", "span", "div") or "b_dList" in n.classes) or bool(n.classes & {"b_paractl", "b_snippet"})
    for c in root.walk():
        if "b_algo" not in c.classes or c.classes & {"b_adTop", "b_adBottom"} or "data-apurl" in c.attrs or sponsored(c):
            continue
        link = c.first(lambda n: n.tag == "a" and any(x.tag == "h2" for x in n.parent.above()))
        title, href = link.text() if link else "", _web(link)
        if title and href:
            cite, s = c.first(lambda n: n.tag == "cite"), c.first(snip)
            snippet = (s.text() if s else "") or next((t for n in c.walk() if n.tag == "p" and 20 < len(t := n.text()) < 500), "")
            out.append({"title": title, "href": href, "display": cite.text() if cite else "", "snippet": snippet, "page_num": page})
    return out


def answer_items(html: str | None) -> list[dict]:
    """HTM15: list items of an answer under their last heading, with the links each item shows (six at most, as in the study)."""
    section, out = "", []
    badge = lambda n: n.tag == "button" or n.attrs.get("role") == "button" or bool(n.classes & {"rounded-full", "badge", "chip"})
    for n in tree(html).walk():
        if n.tag in HEADS:
            section = n.text() or section
        elif n.tag == "li" and (text := n.text(badge)):
            m = re.match(r"\s*([^—\-:]{2,80})\s*[—\-:]\s+", text)
            name = m[1].strip() if m else " ".join(text.split()[:3])
            chips = [x for x in n.walk() if (x.tag in ("a", "button") or x.attrs.get("role") == "button") and 0 < len(t := x.text()) <= 50 and not re.search("copy|share|edit", t, re.I)][:6]
            links = [u for x in chips if x.tag == "a" and (u := _web(x))]
            out.append({"item_section_title": section, "item_position": len(out) + 1, "item_name": name, "item_text": text, "links": links})
    return out


def _entry(link: Node, section: str, fallback: bool) -> dict:
    bold = link.first(lambda n: {"line-clamp-2", "text-sm", "font-semibold"} <= n.classes) or link.first(lambda n: "font-semibold" in n.classes) or link.first(lambda n: n.tag in ("h3", "h4", "h5"))
    desc = link.first(lambda n: {"text-token-text-secondary", "line-clamp-2"} <= n.classes) or link.first(lambda n: {"text-sm", "leading-snug"} <= n.classes) or link.first(lambda n: n.tag == "p")
    return {"section": section, "title": (bold.text() if bold else "") or (link.text() if fallback else ""), "description": desc.text() if desc else "", "href": _web(link)}


def source_lists(html: str | None) -> list[dict]:
    """HTM16: the cited and the further sources of a panel: lists after sticky heads, else after any head of that name, else all links as cited."""
    root, out = tree(html), []
    names = {"citations": "cited", "more": "additional"}

    def take(box: Node | None, section: str) -> None:
        out.extend(_entry(n, section, False) for n in (box.walk() if box else ()) if n.tag == "a" and n.attrs.get("target") == "_blank" and n.attrs.get("rel") == "noopener" and _web(n))

    for n in root.walk():
        sticky = n.tag == "li" and ("sticky" in n.attrs.get("class", "") or _in(n, "sticky"))
        if sticky and (section := names.get(n.text().lower())):
            for s in n.siblings(1):
                if s.tag == "div":
                    break
                if s.tag == "ul":
                    take(s, section)
                    break
    if not out:
        for n in root.walk():
            if (n.tag in ("li", "h1", "h2", "h3", "h4", "h5") or "header" in n.attrs.get("class", "")) and (section := names.get(n.text().lower())):
                box = next(n.siblings(1), None) or next(n.parent.siblings(1), None) or n.parent.first(lambda x: x.tag == "ul")
                take(box if box is None or box.tag == "ul" else box.first(lambda x: x.tag == "ul"), section)
    if not out:
        out = [_entry(n, "cited", True) for n in root.walk() if n.tag == "a" and _web(n) and "chatgpt.com" not in _web(n)]
    return out


def html_cards(html: Column | str) -> Column:
    return pandas_udf(_cards, CARDS)(html)


def html_items(html: Column | str) -> Column:
    return pandas_udf(_answer_items, ITEMS)(html)


def html_sources(html: Column | str) -> Column:
    return pandas_udf(_source_lists, SOURCES)(html)


def _cards(html: pd.Series) -> pd.Series:
    return html.map(cards)


def _answer_items(html: pd.Series) -> pd.Series:
    return html.map(answer_items)


def _source_lists(html: pd.Series) -> pd.Series:
    return html.map(source_lists)


def result_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HTM14 with redirects decoded, ad clicks and undecodable redirects left out, and positions from 1 over what is kept of a page.

    Each step works on the elements of the list: a column of rows would be written out wherever a later rule
    uses it, and rules over rules are then too large for the driver to plan.
    """
    found = F.transform("_cards", lambda c: F.struct(c.alias("c"), F.coalesce(decode_any(c["href"]), clean_url(c["href"])).alias("url")))
    kept = F.filter(found, lambda x: ~is_ad_click(x["url"]) & ~F.contains(x["url"], F.lit("bing.com/ck/")))
    told = F.transform(kept, lambda x: F.struct(x["c"].alias("c"), x["url"].alias("url"), domain10(x["url"]).alias("domain")))
    c = pages.select(key, html_cards(html).alias("_cards")).select(key, F.posexplode(told).alias("_at", "_x")).select(key, (F.col("_at") + 1).alias("position"), "_x.c.*", "_x.url", "_x.domain")
    return c.select(key, "position", "title", "url", "domain", F.when(F.col("display") != "", F.col("display")).otherwise(F.col("domain")).alias("display_url"), "snippet", "page_num")


def source_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """HTM16: each cleaned url once, at its first place, numbered within its section."""
    s = pages.select(key, F.posexplode(html_sources(html)).alias("_at", "_s")).select(key, "_at", "_s.*").withColumn("url", clean_url("href"))
    s = s.withColumn("_n", F.row_number().over(W.partitionBy(key, "url").orderBy("_at"))).filter("_n = 1")
    return s.withColumn("position", F.row_number().over(W.partitionBy(key, "section").orderBy("_at"))).select(key, "section", "position", "title", "description", "url", domain10("url").alias("domain"))
