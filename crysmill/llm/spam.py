"""Pages of stuffed keywords, lists of links or menus, and product tags or offers.

The corpus says which words are plain: by language, words of many texts whose repeats lie no closer together than chance
lets them (``plain_words``); names, goods and search terms come in bursts instead. A text is then cut into spans (lines,
and sentences in them). Spans ruled by numbers, code or log patterns are data and never spam. All others are judged by
how their terms come back: the gaps between repeats and their evenness, the autocorrelation of the sequence over lags,
and how many distinct nouns stand in a row without any plain word. Measured are the shapes of the spans (a list of links
or of tags is one shape that comes back at once, all the time), the terms of lists and tags, of these with phrases
(without an end mark) and sentences poor in plain words, and of all sentences. A text is spam when flagged spans hold
the greater part of it; without recurrence or a run of nouns nothing is flagged.

Spans in a language that the corpus does not know, with mostly words it has not seen often, have no plain words: what ends
like a sentence, has short words among its words and does not repeat itself counts as a sentence there, and only its
recurrence can flag it.
Scripts without blanks count by character.

Edge cases: null, empty and blank texts are not flagged; texts of any length are read whole, in linear time; a text
without any letter is data; repeated texts share one verdict; without ``words`` ``judge`` takes every language for unknown.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

URL = re.compile(r"(?:https?://|www\.)\S+|\b[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,8}\.(?:example|test|com|org|net|io|de|fr|es|eu)(?:/[^\s\"'<>)\]|]*)?", re.IGNORECASE)
MARKDOWN = re.compile(r"\[[^\[\]\n]*\]\(\s*[^()\s]*\s*\)")
TAG = re.compile(r"(?:^|\s|,)(?:#|tag:)[^\s,]+", re.IGNORECASE)
CRUMB = re.compile(r"\s[>»›/→]\s")
FIELD = re.compile(r"^[^:]{1,60}:\s*[-+~]?\d")
REFERENCE = re.compile(r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)]|[-*•]\s*\d+|[-*•]?\s*\[\d+\])\s")
# a number and a point are an ordinal, not an end
SENTENCE = re.compile(r"(?<=[.!?])(?<!\d\.)\s+|(?<=[。！？])")
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿"
WORD = re.compile(rf"[{_UNSPACED}]|(?<!\w)[^\W\d_{_UNSPACED}]+(?:['’-][^\W\d_]+){{0,8}}(?!\w)")
TERM = re.compile(r"[^\W_]+")
# Marks of an offer in a shop.
OFFER = re.compile(r"\b(?:sku|add to (?:cart|basket)|ships (?:today|free)|buy now|in den warenkorb|ajouter au panier|añadir al carrito)\b", re.IGNORECASE)
# So large a share of plain words makes a span prose, so large a one rich prose.
PLAIN_SHARE, RICH_SHARE = 0.25, 0.45
# So many distinct nouns in a row are a list; a repeat within so many terms is near.
NOUN_RUN, WINDOW, NEAR = 12, 24, 8
# A plain word is in so large a share of its language's texts, in so many at least, and its near repeats
# are at most so many times those that chance gives.
TEXT_SHARE, LEAST_TEXTS, BURST = 0.01, 5, 2.0
# between the items of a list in one line
ITEMS = re.compile(r"\s*[;|·•,]\s*|\s[-–/]\s")
END = re.compile(r"[.!?:…。！？][\"'»”)\]]*\s*$")
NUMBER = re.compile(r"(?<![\w.])[-+]?\d[\d.,]{0,40}(?:[eE][-+]?\d+)?(?![\w])")


class Words:
    """Frequent words of a corpus, and the plain ones among them."""

    def __init__(self, words: dict[str, bool]):
        self.frequent = frozenset(words)
        self.plain = frozenset(w for w, even in words.items() if even)


class Page(NamedTuple):
    spam: bool
    kind: str
    share: float
    recurrence: float
    regularity: float
    distinct: float


def _language(c):
    """Label of two letters, or empty: at most 677 kinds."""
    two = F.lower(F.substring(F.trim(c), 1, 2))
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise("")


def word_gaps(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(terms, texts that hold each, occurrences, near repeats, all occurrences) of a batch of texts."""
    number: dict[str, int] = {}
    codes, sizes = [], []
    for t in texts:
        w = WORD.findall(t.lower()) if isinstance(t, str) else []
        codes += [number.setdefault(x, len(number)) for x in w]
        sizes.append(len(w))
    if not codes:
        return np.zeros(0, object), *[np.zeros(0, np.int64)] * 3, 0
    terms, codes = np.array(list(number), dtype=object), np.asarray(codes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(codes, kind="stable")
    c, o = codes[order], owner[order]
    again = (c[1:] == c[:-1]) & (o[1:] == o[:-1])
    near = again & (order[1:] - order[:-1] <= NEAR)
    n = len(terms)
    held = np.bincount(c, minlength=n) - np.bincount(c[1:][again], minlength=n)
    return terms, held, np.bincount(c, minlength=n), np.bincount(c[1:][near], minlength=n), len(codes)


def plain_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bool]:
    """Frequent words of the corpus, and whether they are even, in the language that uses them most; counted over all texts.

    A word is in at least TEXT_SHARE of its language's texts, so there are at most 100 times as many words as a text has
    different ones, whatever the input's size.
    """

    def run(batches):
        for pdf in batches:
            for lang, g in pdf.groupby("lang", sort=False):
                terms, held, times, near, _ = word_gaps(g["text"])
                yield pd.DataFrame({"lang": lang, "term": terms, "held": held, "times": times, "near": near})
                yield pd.DataFrame({"lang": [lang], "term": [None], "held": [len(g)], "times": [int(times.sum())], "near": [0]})

    lang = _language(F.col(lang_col)) if lang_col in docs.columns else F.lit("")
    slim = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).where(F.length(F.trim("text")) > 0)
    counts = slim.mapInPandas(run, "lang STRING, term STRING, held BIGINT, times BIGINT, near BIGINT").groupBy("lang", "term").agg(*[F.sum(c).alias(c) for c in ("held", "times", "near")])
    # written, as words and languages are both read from it and the corpus is to be counted once
    counts = Scratch(docs.sparkSession, "words").put(counts)
    home = counts.groupBy("term").agg(F.max_by(F.struct("lang", "held", "times", "near"), F.struct("times", "lang")).alias("w"))
    whole = counts.where("term IS NULL").select("lang", F.col("held").alias("texts"), F.col("times").alias("all_times"))
    words = home.where("term IS NOT NULL").select("term", "w.*").where(F.col("held") >= LEAST_TEXTS).join(F.broadcast(whole), "lang")
    chance = 1 - F.pow(1 - F.col("times") / F.col("all_times"), F.lit(NEAR))
    often = words.where(F.col("held") >= TEXT_SHARE * F.col("texts"))
    return {r["term"]: r["even"] for r in often.select("term", (F.col("near") <= BURST * chance * F.col("times")).alias("even")).collect()}


def recurrence(terms: list[str], window: int = WINDOW) -> tuple[float, float, float]:
    """(share of terms that come back within ``window``, evenness of their gaps, highest autocorrelation over lags)."""
    n = len(terms)
    if n < 2:
        return 0.0, 0.0, 0.0
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(t, len(number)) for t in terms), np.int64, n)
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    gaps = (order[1:] - order[:-1])[same]
    back = np.count_nonzero(gaps <= window) / n
    even = 1.0 / (1.0 + float(np.std(gaps) / np.mean(gaps))) if len(gaps) else 0.0
    p = np.bincount(codes) / n
    chance = float((p * p).sum())
    lags = [np.count_nonzero(codes[k:] == codes[:-k]) / (n - k) for k in range(1, min(window, n - 1) + 1)]
    peak = max(lags)
    return back, even, max(0.0, (peak - chance) / (1 - chance)) if chance < 1 else 1.0


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _without_anchors(span: str) -> tuple[str, int]:
    """(span without its anchors, how many there were); anchors of any length, in linear time."""
    bare, links = MARKDOWN.subn(" ", span)
    low, parts, at = bare.lower(), [], 0
    while True:
        start = low.find("<a ", at)
        end = low.find("</a>", start) if start >= 0 else -1
        if end < 0:
            parts.append(bare[at:])
            return " ".join(parts), links
        parts.append(bare[at:start])
        at = end + 4
        links += 1


def spans(text: str, corpus: Words):
    """(kind, span, its words, how many of them are plain, things in it) for each line or sentence: prose, foreign, data, link, tag, list or other."""
    code = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            code = not code
            yield "data", line, [], 0, 1
            continue
        if not line.strip():
            continue
        if code:
            yield "data", line, [], 0, 1
            continue
        cited = REFERENCE.match(line) is not None
        for piece in SENTENCE.split(line):
            if piece.strip():
                yield _kind(piece, corpus, cited)


def _kind(span: str, corpus: Words, cited: bool) -> tuple[str, str, list[str], int, int]:
    # every pattern is bounded in length, so a span takes linear time; cheap tests spare most spans the costly ones
    bare, links = span, 0
    if "](" in span or "<a" in span or "<A" in span:
        bare, links = _without_anchors(span)
    if "." in bare[:-1] or "http" in bare.lower():
        bare, urls = URL.subn(" ", bare)
        links += urls
    words = _words(bare)
    known = sum(map(corpus.plain.__contains__, words))
    share = known / max(1, len(words))
    tags = len(TAG.findall(span)) if "#" in span or ":" in span else 0
    if tags and tags * 2 >= len(span.split()) - 1:
        return "tag", span, words, known, tags
    if OFFER.search(span) and (span.count(";") >= 2 or span.count("|") >= 2 or re.search(r"\bsku\b", span, re.IGNORECASE)):
        return "tag", span, words, known, 1
    ended = END.search(span) is not None
    if links > 1 and len(words) <= 4 * links:
        return "link", span, words, known, links
    if not links and FIELD.match(span):
        return "data", span, words, known, 1
    items = 0 if ended or links else len(ITEMS.findall(bare)) + 1
    if items < 5 or len(words) > 3 * items:
        items = 0
    if not items and len(words) >= (4 if ended else 5) and known >= 2 and share >= PLAIN_SHARE:
        return "prose", span, words, known, 1
    if links:
        cited = cited or len(words) >= 4 and (ended or known and links == 1)
        return ("other", span, words, known, 1) if cited else ("link", span, words, known, links)
    if any(c in span for c in ">»›/→") and len(CRUMB.findall(span)) >= 2 and not NUMBER.search(span.split("Page")[0]):
        return "link", span, words, known, len(CRUMB.findall(span))
    numbers = len(NUMBER.findall(re.sub(r"\d[\d.]*\s*%", " ", bare)))
    if numbers and numbers >= 0.2 * (numbers + len(words)):
        return "data", span, words, known, 1
    if not words:
        return ("data" if numbers else "other"), span, words, known, 1
    if not items and known and share >= PLAIN_SHARE and (ended or len(words) >= 5):
        return "prose", span, words, known, 1
    if ended and len(words) >= 5 and 2 * sum(map(corpus.frequent.__contains__, words)) < len(words) <= 10 * sum(len(w) <= 3 for w in words):
        return "foreign" if 4 * len(set(words)) > 3 * len(words) else "list", span, words, known, 1
    return "list", span, words, known, 1


def _regular(back: float, even: float, peak: float) -> bool:
    """Terms come back soon and again and again, or less often but at fixed lags or in even gaps."""
    return back >= 0.35 or back >= 0.2 and (peak >= 0.3 or even >= 0.7)


def _repeated(terms: list[str], most: float, few: int, window: int) -> bool:
    """Terms with plain words among them: ``few`` distinct ones or a share of ``most``, nearly all back within ``window``."""
    n = len(terms)
    if n < 12 or len(set(terms)) > max(few, most * n):
        return False
    back, even, peak = recurrence(terms, window)
    return back >= 0.6 or back >= 0.5 and (peak >= 0.3 or even >= 0.7)


def judge(text: str | None, words: dict[str, bool] | Words | None = None) -> Page:
    """The verdict on one text, given the frequent words of its corpus and which of them are plain."""
    corpus = words if isinstance(words, Words) else Words(words or {})
    if not isinstance(text, str) or not text.strip():
        return Page(False, "none", 0.0, 0.0, 0.0, 0.0)
    size: Counter = Counter()
    listed, suspect, content, shapes = [], [], [], []
    run: set[str] = set()
    longest = 0
    for kind, span, words, known, things in spans(text, corpus):
        shapes += [kind] * min(things, len(span)) if kind in ("link", "tag") else [f"{kind}{len(shapes)}"]
        if kind in ("list", "tag"):
            terms = TERM.findall(span.lower())
            listed += terms
            suspect += terms
            for w in terms:
                if w in corpus.plain:
                    run = set()
                else:
                    run.add(w)
                    longest = max(longest, len(run))
        elif kind in ("prose", "foreign"):
            run = set()
            content += words
            if kind == "foreign":
                kind = "prose"
            elif known < RICH_SHARE * len(words) or not END.search(span):
                kind = "poor"
                suspect += words
        size[kind] += len(span)
    whole = sum(size.values())
    # links and tags are lists only where one follows the other
    rows = bool(size["link"] or size["tag"]) and (recurrence(shapes)[0] > 0 or len(shapes) == 1 and recurrence(listed)[0] > 0)
    back, even, peak = recurrence(listed)
    stuffed = len(listed) > 1 and _regular(back, even, peak)
    tags = size["tag"] if rows or stuffed or longest >= NOUN_RUN else 0
    links = size["link"] if rows else 0
    lists = tags + (size["list"] if stuffed or longest >= NOUN_RUN or tags > size["list"] else 0)
    # sentences may share terms, so they must come back more often in them than in lists
    if _repeated(content, 1 / 8, 0, NEAR):
        said = size["prose"] + size["poor"]
    else:
        said = size["poor"] if _repeated(suspect, 1 / 2, 20, WINDOW) else 0
    if said:
        lists = tags + size["list"]
    if said > lists:
        listed = content
        back, even, peak = recurrence(listed)
    distinct = len(set(listed)) / len(listed) if listed else 0.0
    bad = links + lists + said
    share = bad / whole
    kinds = {"links": links, "tags": tags, "keywords": (lists - tags if stuffed else 0) + said, "offers": 0 if stuffed else lists - tags}
    return Page(share > 0.5, max(kinds, key=kinds.get) if bad else "none", share, back, peak, distinct)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, is_spam, kind, spam_share, recurrence, regularity, distinct_share) of every document, in Arrow batches."""
    corpus = Words(plain_words(docs, text_col, lang_col))

    def run(batches):
        for pdf in batches:
            pages = [judge(t, corpus) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "is_spam": [p.spam for p in pages], "kind": [p.kind for p in pages], "spam_share": [p.share for p in pages], "recurrence": [p.recurrence for p in pages], "regularity": [p.regularity for p in pages], "distinct_share": [p.distinct for p in pages]})

    slim = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    return slim.mapInPandas(run, "id BIGINT, is_spam BOOLEAN, kind STRING, spam_share DOUBLE, recurrence DOUBLE, regularity DOUBLE, distinct_share DOUBLE").withColumnRenamed("id", id_col)
