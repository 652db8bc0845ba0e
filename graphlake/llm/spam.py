"""Pages of keywords, tags, product lines or links rather than sentences.

A page is judged by statistics of its body, that is of what is left without fenced code, lines of code, stack
traces, tables of identifiers and headings: the shares of its commonest word and phrases, of repeated lines, of link
text, the density of separators, and the share of function words, against thresholds of the page's language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlake.sources.tables import one_each, table

# The most frequent function words of each language.
FUNCTION_WORDS = {
    "en": "a about above after all also although an and any are as at be because been before being below beside but by can could did do does each either few first for from given had has have he her his how i if in inside into is it its just may me might more most must my no nor not nothing of on one only onto or other our out over own please same she should so some still such than that the their them then there these they this those through to too under unless until up us very was we were what when where whether which while who why will with within without would yet you your",
    "de": "aber alle als am an auch auf aus bei beim bis bitte da damit dann das dass dem den der des die dies diese dieser dieses doch dort du durch ein eine einem einen einer eines er erneut es etwa für hat hier ich ihr im in ins ist ja jede jeder kann kein keine man mehr mit muss nach nicht noch nur ob oder ohne schon sehr sein seine sich sie sind so solange sonst um und uns vom von vor war warum was wenn wer werden wie wieder wird wir wo zu zum zur zuerst zwei zwischen über",
    "fr": "a afin ai alors après au aucun aussi aux avant avec car ce cela ces cet cette ceux chaque comme dans de depuis des deux donc du elle elles en encore est et eux fait il ils je jusque la le les leur lors lorsque mais mais même moins ne ni nos notre nous on ont ou où par pas peut plus pour pourquoi puis qu quand que qui sa sans se ses si son sont sous sur ta tant tous tout toute très tu un une vers voir vos votre vous y à été être d l c n s",
    "es": "a al algo antes aquí así aun aunque bajo bien cada como con cual cuando de del desde después donde dos el ella ellos en entre era es esa ese eso esta estas este esto están está fue ha hace hacia hasta hay la las le les lo los luego mas me mi mientras muy más ni no nos o otra para pero poco por porque pues puede que quien se sea ser si sin sino sobre solo son su sus sí también tan tiene todo todos tras tu un una unas uno unos y ya él",
}
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_BITS = {w: sum(1 << k for k, known in enumerate(_WORDS.values()) if w in known) for w in frozenset().union(*_WORDS.values())}


@dataclass(frozen=True)
class Limits:
    """Thresholds of one language.  Shares are of the body's words, a page above (function words: below) one is spam."""

    function: float = 0.21
    word: float = 0.20
    pair: float = 0.27
    triple: float = 0.28
    lines: float = 0.50
    links: float = 0.50
    # Separators for each word, counted only where function words are few.
    separators: float = 0.35
    few: float = 0.30


# Calibrated per language on the pages of sf0.1 that consist of sentences: a page half of which is sentences has half of
# the median share of function words (en 0.463, de 0.473, fr 0.457, es 0.473), less a tenth; `few` is two thirds of it.
LIMITS = {
    "en": Limits(function=0.208, few=0.31), "de": Limits(function=0.213, few=0.315), "fr": Limits(function=0.206, few=0.305), "es": Limits(function=0.213, few=0.315)}
# Words of a body from which it can be spam; from which single words and phrases can stuff it, since in short texts
# any word is frequent; and from which a frequent triple is a phrase and not the pattern of a few sentences.
LEAST_WORDS, LEAST_STUFFED, LEAST_PHRASES = 8, 25, 60
# A line or phrase that stands so often on a page is a repetition.
REPEATED = 3

# Identifiers and paths count as one word.
_WORD = re.compile(r"[^\W\d_]\w*(?:[./-]\w+)*")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_TRACE = re.compile(r"^[ \t]*(?:at \S+ \(\S+:\d+\)|File \"[^\"\n]+\", line \d+).*$", re.M)
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t][^\n]{0,60}|=+|-+)[ \t]*$", re.M)
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a>|!?\[([^\]\n]*)\]\([^)\n]*\)|(?:https?://|www\.)\S+", re.I | re.S)
_TAG = re.compile(r"<[^<>\n]{1,300}>")
_HASHTAG = re.compile(r"(?<!\S)#[^\W\d]\w*")
_SIGNS = re.compile(r"^[^\n=(){};]*[=(){};][^\n=(){};]*[=(){};][^\n]*$|^[^\n;]*(?:;[^\n;]*)?[;{}][ \t]*$", re.M)
_CODE = re.compile(r"\w\s*[(=]|[;{}]\s*$")
_ROW = re.compile(r"^[ \t]*\|?[ \t]*`?\w*(?:[_.(\d]|[a-z][A-Z])[\w.()]*`?[ \t]*(?:\|[^|\n]*){2,5}$", re.M)
_SEPARATOR = re.compile(r"[|,;/·•»>~#–—]|\s-\s")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_END = (".", "?", ":", "…")


def language(words: list[str], given: str | None = None) -> str:
    """The language whose function words are most frequent; the given one, or English, if there are none."""
    hits = _hits(words)
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    return best if hits[best] else given if given in hits else "en"


def _hits(words: list[str]) -> dict[str, int]:
    """How many of the words are function words of each language."""
    masks = Counter(map(_BITS.get, words, repeat(0)))
    return {k: sum(n for mask, n in masks.items() if mask >> at & 1) for at, k in enumerate(_WORDS)}


def _count(text: str) -> int:
    return len(_WORD.findall(text))


def body(text: str) -> tuple[str, int, int]:
    """(text without code, traces, tables of identifiers, headings, links, hashtags and markup; words of links and hashtags; words of code)."""
    code: list[int] = []
    linked: list[int] = []

    def drop(m: re.Match) -> str:
        code.append(_count(m.group()))
        return ""

    def link(m: re.Match) -> str:
        named = [g for g in m.groups() if g is not None]
        shown = _TAG.sub(" ", named[0]) if named else m.group()
        linked.append(_count(shown))
        return " \x01 "

    if "```" in text or "~~~" in text:
        text = _FENCE.sub(drop, text)
    if "at " in text or "File " in text:
        text = _TRACE.sub(drop, text)
    text = _HEADING.sub("", text)
    if "://" in text or "](" in text or "<" in text or "www." in text.lower():
        text = _TAG.sub(" ", _LINK.sub(link, text))
    if "#" in text:
        text = _HASHTAG.sub(link, text)
    text = _SIGNS.sub(lambda m: drop(m) if _CODE.search(m.group()) else m.group(), text)
    if text.count("|") >= 6 and len(_ROW.findall(text)) >= REPEATED:
        text = _ROW.sub(drop, text)
    return text, sum(linked), sum(code)


def _phrases(words: list[str]) -> tuple[float, float]:
    """Shares that the commonest pair and triple of words cover, 0 for what does not stand REPEATED times."""
    n = len(words)
    pair = max(Counter(zip(words, words[1:], strict=False)).values(), default=0)
    if pair < REPEATED:
        return 0.0, 0.0
    triple = max(Counter(zip(words, words[1:], words[2:], strict=False)).values(), default=0)
    return min(1.0, 2 * pair / n), min(1.0, 3 * triple / n) if triple >= REPEATED else 0.0


def page_statistics(text: str | None, lang: str | None = None) -> dict:
    """Statistics of a page, `reasons` for which it is spam, and `spam`: whether there are any.

    A null or blank page has no words and is no spam; nor is a page of fewer than LEAST_WORDS words, or one more than
    half of which is code.  Phrases are looked for in different sentences: a whole sentence said again counts once, and
    so does a line that ends as a sentence does.
    """
    out = {"lang": lang if lang in _WORDS else "en", "words": 0, "function_share": 0.0, "top_word_share": 0.0, "top_pair_share": 0.0, "top_triple_share": 0.0, "duplicate_line_share": 0.0, "link_text_ratio": 0.0, "separator_density": 0.0, "reasons": "", "spam": False}
    if not text or text.isspace():
        return out
    plain, linked, code = body(text)
    low = plain.lower()
    words = _WORD.findall(low)
    n = len(words)
    whole = n + linked
    out["words"] = whole
    if whole == 0:
        return out
    out["link_text_ratio"] = linked / whole
    limits = LIMITS[out["lang"]]
    if n:
        out["lang"] = tongue = language(words, lang)
        limits = LIMITS[tongue]
        known = _WORDS[tongue]
        times = Counter(words)
        out["function_share"] = sum(k for w, k in times.items() if w in known) / n
        out["top_word_share"] = max((k for w, k in times.items() if w not in known), default=0) / n
        pair, triple = _phrases(words)
        if n >= LEAST_STUFFED and (pair >= limits.pair or triple >= limits.triple):
            once = [w for s in dict.fromkeys(s.strip() for line in low.splitlines() for s in _SENTENCE.split(line)) for w in _WORD.findall(s)]
            n_once = len(once)
            pair, triple = _phrases(once) if n_once >= LEAST_STUFFED else (0.0, 0.0)
        out["top_pair_share"], out["top_triple_share"] = pair, triple
        out["separator_density"] = len(_SEPARATOR.findall(plain)) / n
        lines = Counter(filter(None, map(str.strip, low.splitlines())))
        if len(lines) < low.count("\n"):
            out["duplicate_line_share"] = sum(_count(line) * k for line, k in lines.items() if k >= REPEATED and not line.endswith(_END)) / n
    reasons = {
        "links": out["link_text_ratio"] >= limits.links, "no function words": n >= LEAST_WORDS and out["function_share"] < limits.function,
        "word": n >= LEAST_STUFFED and out["top_word_share"] >= limits.word, "pair": n >= LEAST_STUFFED and out["top_pair_share"] >= limits.pair,
        "phrase": n >= LEAST_PHRASES and out["top_triple_share"] >= limits.triple, "lines": out["duplicate_line_share"] >= limits.lines,
        "separators": out["separator_density"] >= limits.separators and n >= LEAST_WORDS and out["function_share"] < limits.few}
    if whole >= LEAST_WORDS and whole >= code:
        out["reasons"] = ",".join(k for k, v in reasons.items() if v)
    return out | {"spam": out["reasons"] != ""}


_SCHEMA = "doc_id long, lang string, words long, function_share double, top_word_share double, top_pair_share double, top_triple_share double, duplicate_line_share double, link_text_ratio double, separator_density double, reasons string, spam boolean"


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [page_statistics(t, k) for t, k in zip(batch["text"], batch["lang"], strict=True)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")][1:])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def spam_statistics(documents: DataFrame) -> DataFrame:
    """Page statistics of each document (doc_id, text, and lang if there is one): one row per non-null doc_id; see page_statistics."""
    lang = F.lower("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang"))
    return one_each(named, "doc_id").mapInPandas(_pages, _SCHEMA)


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that are more than half keywords, tags, product lines or links."""
    return spam_statistics(table(spark, directory, "documents")).where("spam").select("doc_id")


QUERIES = {"p8_found": p8_found}
ORACLES: dict[str, str] = {}
