"""Passages of evaluation texts in training texts (problem 8)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociform.plans.tables import at_most, materialized, small_side

#: Words of a fingerprinted gram, and of the shortest shared span that is found for sure.
GRAM, SPAN = 12, 30
#: Most rows of a side that is broadcast: fingerprints of the test items, identifiers of the documents hit.
BROADCAST_ROWS = 1_000_000
#: Where the fingerprints join by a shuffle, those of the documents are spread over so many tasks each; items put together in one row for a document.
SPREAD, ITEMS = 8, 64

_UNSEEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb"
_INVISIBLE = re.compile(f"[{_UNSEEN}]+")
_MARKS = re.compile(r"\\+(?:u\{?([0-9a-fA-F]{4,6})\}?|x([0-9a-fA-F]{2})|[abefnrtv0])|&(?:amp;)*(#?[A-Za-z0-9]{1,31};)")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_TOKEN = re.compile(rb"[^ ]+")
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _mark(m: re.Match) -> str:
    """An escape or entity stands for a separator, or for nothing if it spells an invisible character."""
    if m[1] or m[2]:
        code = int(m[1] or m[2], 16)
        char = chr(code) if code < 0x110000 else " "
    else:
        char = html.unescape("&" + m[3]) if m[3] else " "
    return "" if _INVISIBLE.fullmatch(char) else " "


def folded(text: str) -> bytes:
    """The text's words in lower case, all else turned into blanks.

    Words are runs of ASCII letters and digits. Invisible characters vanish, also inside a
    word; string escapes and character entities part words and are none.
    """
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "\\" in text or "&" in text:
        text = _MARKS.sub(_mark, text)
    return text.encode("utf-8", "replace").translate(_FOLD)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each window of ``width`` consecutive values, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x = best(x[:-step], x[step:])
        reach += step
    return x


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of folded bytes."""
    solid = np.concatenate(([False], raw != 32, [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def stretches(flat: bytes, span: int, size: int) -> Iterator[tuple[int, bytes]]:
    """A folded text in stretches of about ``size`` bytes, each with the number of words before it.

    Consecutive stretches share ``span - 1`` words, so every ``span`` words lie in one.
    """
    at = before = 0
    while at < len(flat):
        end = flat.find(b" ", at + size)
        if end < 0:
            yield before, flat[at:]
            return
        start, _ = _words(np.frombuffer(flat, np.uint8, end - at, at))
        if len(start) < 2 * span:
            size *= 2
            continue
        yield before, flat[at:end]
        skip = len(start) - (span - 1)
        before, at = before + skip, at + int(start[skip])


def _winnowed(flat: list[bytes], gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b" ".join(flat) + b" ", np.uint8)
    start, end = _words(raw)
    window = span - gram + 1
    if len(start) < span:
        return none
    sums = _sums(raw * _powers(_BYTE, len(raw)))
    words = _mix((sums[end] - sums[start]) * _powers(pow(_BYTE, -1, 1 << 64), len(raw))[start])
    sums = _sums(words * _powers(_WORD, len(words)))
    grams = _mix((sums[gram:] - sums[:-gram]) * _powers(pow(_WORD, -1, 1 << 64), len(words))[: len(words) - gram + 1])
    offset = np.cumsum([0] + [len(b) + 1 for b in flat])
    owner = np.searchsorted(offset, start, side="right") - 1
    least = _sliding(grams, window, np.minimum)
    inside = owner[: len(least)] == owner[span - 1 :]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    most = _sliding(np.concatenate((pad, least, pad)), window, np.maximum)
    at = np.flatnonzero((most == grams) & (most > 0))
    first = np.searchsorted(owner, np.arange(len(flat)))
    return owner[at], at - first[owner[at]], grams[at].astype(np.int64)


def fingerprints(texts: list[str], gram: int = GRAM, span: int = SPAN, size: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed fingerprints of texts: index of the text, word position, hash.

    Of every ``span - gram + 1`` consecutive grams of a text the one with the least hash is
    kept (all of them on ties), so two texts that share ``span`` consecutive words share a
    fingerprint inside them. Texts of fewer than ``span`` words have none. Texts longer
    than ``size`` bytes are worked through in overlapping stretches, whole all the same.
    """
    return _prints([folded(t) for t in texts], gram, span, size)


def _prints(flat: list[bytes], gram: int, span: int, size: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pieces = [(i, before, piece) for i, t in enumerate(flat) for before, piece in stretches(t, span, size)]
    found, block, held = [], [], 0
    for k, (_, _, piece) in enumerate(pieces):
        block.append(k)
        held += len(piece)
        if held > size or k == len(pieces) - 1:
            owner, place, value = _winnowed([pieces[j][2] for j in block], gram, span)
            which = np.array(block)[owner]
            found.append((np.array([p[0] for p in pieces], np.int64)[which], np.array([p[1] for p in pieces], np.int64)[which] + place, value))
            block, held = [], 0
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    text, place, value = (np.concatenate(x) for x in zip(*found))
    if any(before for _, before, _ in pieces):  # what lies where stretches overlap may have been found twice
        _, once = np.unique(np.stack((text, place)), axis=1, return_index=True)
        text, place, value = text[once], place[once], value[once]
    return text, place, value


def fingerprint_rows(df: DataFrame, ident: str, text: str, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """``ident, print``: the different fingerprints of every text, in one pass without a shuffle.

    A text gives each fingerprint once, so text that repeats itself has few.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, texts = part["ident"], part["words"].tolist()
            size, block = 0, []
            for i, t in enumerate(texts):
                block.append(i)
                size += len(t)
                if size > 1_000_000 or i == len(texts) - 1:
                    owner, _, value = fingerprints([texts[j] for j in block], gram, span)
                    owner, value = np.unique(np.stack((owner, value)), axis=1)
                    yield pd.DataFrame({"ident": ids.iloc[np.array(block)[owner]].to_numpy(), "print": value})
                    size, block = 0, []

    kind = df.select(ident).dtypes[0][1]
    rows = df.select(F.col(ident).alias("ident"), F.col(text).alias("words")).where("ident is not null and length(words) > 0")
    return rows.mapInPandas(run, f"ident {kind}, print long")


def longest_shared(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """The longest run of equal numbers, at least ``least``: its length, first place in doc, first place in item.

    The first hit is followed as far as it goes; if there is a longer one still, lengths are
    halved in between. Runs of one length are compared by their hashes, a hit number by
    number.
    """

    def grams(x: np.ndarray, n: int) -> np.ndarray:
        sums = _sums(_mix(x.astype(np.uint64) + np.uint64(1)) * _powers(_WORD, len(x)))
        return (sums[n:] - sums[:-n]) * _powers(pow(_WORD, -1, 1 << 64), len(x) - n + 1)

    def run(n: int) -> tuple[int, int, int] | None:
        ours, theirs = grams(doc, n), grams(item, n)
        for i in np.flatnonzero(np.isin(ours, theirs)):
            j = int(np.flatnonzero(theirs == ours[i])[0])
            if (doc[i : i + n] == item[j : j + n]).all():
                return n, int(i), j
        return None

    low, high = least, min(len(doc), len(item))
    best = run(low) if low <= high else None
    if best:  # mostly the first run goes on to the longest one
        _, i, j = best
        size = min(len(doc) - i, len(item) - j)
        low = int(np.append(doc[i : i + size] == item[j : j + size], False).argmin())
        longer = run(low + 1) if low < high else None
        if not longer:
            return run(low) if low > least else best
        low, best = low + 1, longer
    while best and low < high:
        n = (low + high + 1) // 2
        if longer := run(n):
            low, best = n, longer
        else:
            high = n - 1
    return best


@lru_cache(maxsize=2000)
def _item_prints(text: bytes, gram: int, span: int) -> np.ndarray:
    return np.unique(_prints([text], gram, span)[2])


def extended(doc: bytes, items: list[bytes], gram: int, span: int) -> list[tuple[int, int, int] | None]:
    """The longest passage of at least ``span`` words that a folded text shares with each item.

    The fingerprints shared are extended both ways over words that the item has, and what
    they reach is compared with it. Time and memory follow the two lengths, however often
    text repeats itself.
    """
    numbers: dict[bytes, int] = {}
    codes = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], np.int64) for t in items]
    own = np.fromiter((numbers.get(m[0], -1) for m in _TOKEN.finditer(doc)), np.int64)
    _, place, value = _prints([doc], gram, span)
    out = []
    for text, words in zip(items, codes):
        hits = place[np.isin(value, _item_prints(text, gram, span))]
        has = np.zeros(len(numbers) + 1, bool)
        has[words] = True
        known = np.concatenate(([False], has[own], [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[::2], edges[1::2]
        runs = np.unique(np.searchsorted(starts, hits, side="right") - 1) if len(starts) else np.empty(0, np.int64)
        pieces = [np.arange(starts[r], ends[r] + 1) for r in runs if r >= 0]
        if not pieces:
            out.append(None)
            continue
        at = np.concatenate(pieces)  # the word behind each run, or the text's end, parts it from the next
        reached = np.where(known[1:][at], own[np.minimum(at, len(own) - 1)], -1)
        found = longest_shared(reached, words, span)
        out.append(found and (found[0], int(at[found[1]]), found[2]))
    return out


def leaked_passages(
    docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, gram: int = GRAM, span: int = SPAN
) -> DataFrame:
    """Documents that hold ``span`` or more consecutive words of an item, in its order.

    Columns: ``doc, item, n_words, doc_place, item_place`` for the longest shared passage
    of each pair (places count words from 0). Fingerprints of documents and items are
    joined, each once per text; the documents hit are read once more, the hits extended
    word by word and compared exactly, so no false hit stays and no passage of ``span``
    words is missed. Items are broadcast only after counting their fingerprints, and so
    are the identifiers of the documents hit; beyond the bound both joins shuffle, the
    documents' side of a frequent fingerprint being spread over several tasks. Null and
    empty texts and those of fewer words hold nothing; repeated documents each count, a
    repeated identifier is one document per text and one row per pair comes out.
    """
    prints = fingerprint_rows(docs, doc, text, gram, span)
    tests = materialized(fingerprint_rows(items, item, item_text, gram, span).select(F.col("ident").alias("item"), "print").distinct())
    if at_most(tests, BROADCAST_ROWS):
        met = prints.join(F.broadcast(tests), "print")
    else:
        salt = F.pmod(F.xxhash64("ident"), F.lit(SPREAD))
        met = prints.withColumn("salt", salt).join(tests.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))), ["print", "salt"])
    hits = materialized(met.select(F.col("ident").alias("doc"), "item").distinct())
    wording = items.select(F.col(item).alias("item"), F.col(item_text).alias("wording")).where("wording is not null")
    part = F.pmod(F.xxhash64("item"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("doc")) / ITEMS))
    found = hits.join(wording, "item").withColumn("part", part).groupBy("doc", "part").agg(F.collect_list(F.struct("item", "wording")).alias("tests"))
    whole = docs.select(F.col(doc).alias("doc"), F.col(text).alias("words")).where("words is not null")
    near = whole.join(small_side(hits.select("doc").distinct(), BROADCAST_ROWS), "doc", "left_semi").join(found, "doc")

    def extend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for who, words, tests in zip(part["doc"], part["words"], part["tests"]):
                spans = extended(folded(words), [folded(t["wording"]) for t in tests], gram, span)
                rows += [(who, t["item"], *s) for t, s in zip(tests, spans) if s]
            yield pd.DataFrame(rows, columns=["doc", "item", "n_words", "doc_place", "item_place"])

    kinds = docs.select(doc).dtypes[0][1], items.select(item).dtypes[0][1]
    spans = near.mapInPandas(extend, f"doc {kinds[0]}, item {kinds[1]}, n_words long, doc_place long, item_place long")
    best = F.max_by(F.struct("n_words", "doc_place", "item_place"), F.struct("n_words", -F.col("doc_place"), -F.col("item_place")))
    return spans.groupBy("doc", "item").agg(best.alias("_b")).select("doc", "item", "_b.*")
