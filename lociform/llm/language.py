"""Languages of documents and of their segments (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociform.plans.tables import small_side

#: Bytes of an n-gram, and the two hash functions' shared multiplier.
GRAM = 5
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Log2 of the slots of the filters; each slot holds one bit per language.
SLOT_BITS = 20
#: Labelled documents per language that the filters are made from, at most.
PER_LANGUAGE = 300
#: An n-gram is a language's own if its share of documents is at least this part of the largest share among the languages.
LEAST_SHARE = 0.1
#: The same for the first filters, which only tell the sampled documents' own lines from those of other languages in them.
FIRST_SHARE = 0.5
#: Parts of a language's labelled documents that are ranked by themselves before the best of each are.
SAMPLE_PARTS = 64
#: A line counts at most so many n-grams against a language, and a change of language costs so many.
LINE_CAP, SWITCH = 12.0, 24.0
#: Lines that a further language needs to be held.
LEAST_LINES = 8
#: Bytes whose n-grams are held at once, so that a very long text needs little more memory than itself.
STEP = 1 << 19
#: Away from the stretches: a line's least lead for a further language, the least share of its n-grams that must be that language's,
#: and the cost of a change where only languages with such lines compete.
CLEAR, COVER, ISLAND = 4.0, 0.4, 2.0

#: What belongs to the language around it: remarks of several lines, those behind code, single-line strings, text in tags.
_INNER = re.compile(
    r"""/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|^[ \t]*[rRuU]?(?P<doc>\"{3}|'{3}).*?(?:(?P=doc)|\Z)|(?<=[ \t;])(?://|\#|--)[ \t][^\n]*"""
    r"""|"(?:[^"\\\n]|\\.)*"|(?<!\w)'(?:[^'\\\n]|\\.)*'(?!\w)|`[^`\n]*`|(?<=>)[^<>\n]*(?=</)|(?<=>)[^<>]*(?=</(?:p|li|td|th|div|span|h\d|a|b|i|em|title)>)""",
    re.S | re.M,
)
_PLAIN = bytes(48 if 48 <= c <= 57 else 32 if c in (9, 11, 12, 13) else c for c in range(256))


def line_bytes(text: str) -> bytes:
    """The text's bytes, each line behind a line feed; digits are all zero, white space is blank."""
    if "\r" in text and "\n" not in text:
        text = text.replace("\r", "\n")
    return b"\n" + text.lstrip("\ufeff").encode("utf-8", "replace").translate(_PLAIN)


@dataclass
class Lines:
    """Lines of some texts: ``of`` gives the text of each, ``line_no`` counts from 1, ``heads`` are their places in ``raw``."""

    raw: np.ndarray
    heads: np.ndarray
    of: np.ndarray
    line_no: np.ndarray
    blank: np.ndarray
    remark: np.ndarray

    def grams(self, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """N-grams that lie in one line, and the line of each, by stretches of ``step`` bytes."""
        for i in range(0, len(self.raw) - GRAM + 1, step):
            part = self.raw[i : i + step + GRAM - 1]
            n = len(part) - GRAM + 1
            gram, inside = part[:n].astype(np.uint64), np.zeros(n, bool)
            for k in range(1, GRAM):
                after = part[k : k + n]
                gram |= after.astype(np.uint64) << np.uint64(8 * k)
                inside |= after == 10
            at = np.flatnonzero(~inside)
            yield gram[at], np.searchsorted(self.heads, at + i, side="right") - 1


def read_lines(texts: list[str]) -> Lines:
    flat = [line_bytes(t) for t in texts]
    raw = np.frombuffer(b"".join(flat), np.uint8)
    before = np.concatenate((np.array([10], np.uint8), raw[:-1]))
    keep = (raw != 32) | ((before != 32) & (before != 10))
    ends = np.cumsum(np.add.reduceat(keep, np.cumsum([0] + [len(b) for b in flat[:-1]]), dtype=np.int64)) if flat else np.zeros(0, np.int64)
    raw = raw[keep]
    heads = np.flatnonzero(raw == 10)
    of = np.searchsorted(ends, heads, side="right").astype(np.int32)
    line_no = np.arange(len(heads)) - np.searchsorted(of, of) + 1
    padded = np.concatenate((raw, np.full(GRAM, 10, np.uint8)))
    a, b, c = padded[heads + 1], padded[heads + 2], padded[heads + 3]
    size = np.diff(np.concatenate((heads, [len(raw)]))) - 1
    blank = (size == 0) | ((size == 1) & (a == 32))
    remark = (
        ((a == 47) & ((b == 47) | (b == 42)))
        | ((a == 42) & ((b == 32) | (b == 47) | (b == 42) | (b == 10)))
        | ((a == 45) & (b == 45) & (c != 45))
        | ((a == 35) & ((b == 32) | (b == 35) | (b == 10)))
        | ((a == 60) & (b == 33) & (c == 45))
        | ((a == 96) & (b == 96))
    ) & ~blank
    return Lines(raw, heads, of, line_no, blank, remark)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: bit l of a slot belongs to the filter of language l."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    @staticmethod
    def slots_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = grams * _HASH
        h ^= h >> np.uint64(32)
        h *= _HASH
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), ((h >> np.uint64(63 - 2 * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, masks: np.ndarray) -> Filters:
        """From n-grams and, for each, the languages that contain it as bits."""
        at = np.concatenate(cls.slots_of(grams.astype(np.uint64)))
        return cls.of_slots(languages, at, np.concatenate((masks, masks)))

    @classmethod
    def of_slots(cls, languages: list[str], at: np.ndarray, masks: np.ndarray) -> Filters:
        slots = np.zeros(1 << SLOT_BITS, np.uint64)
        np.bitwise_or.at(slots, at, masks.astype(np.uint64))
        full = np.array([np.count_nonzero(slots & np.uint64(1 << i)) for i in range(len(languages))]) / len(slots)
        return cls(languages, slots.astype(np.uint32) if len(languages) <= 32 else slots, full**2)

    def counts(self, lines: Lines) -> np.ndarray:
        """Expected true n-grams of each language in each line (lines x languages)."""
        n_lang = len(self.languages)
        out, n = np.zeros((len(lines.of), n_lang), np.float32), np.zeros(len(lines.of), np.float32)
        for grams, line in lines.grams():
            if not len(grams):
                continue
            first, second = self.slots_of(grams)
            masks = self.slots[first] & self.slots[second]
            # sums of up to 255 n-grams fit the byte lanes; longer lines have several chunks
            starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(masks)])))
            parts = -(-sizes // 255)
            chunk = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
            lanes = masks.view(np.uint8).reshape(len(masks), -1)
            chunk_hits = np.empty((len(chunk), 8 * -(-n_lang // 8)), np.uint8)
            for k in range(0, n_lang, 8):
                sums = np.add.reduceat(_SPREAD[lanes[:, k // 8]], chunk)
                chunk_hits[:, k : k + 8] = sums.view(np.uint8).reshape(-1, 8)
            out[line[starts]] += np.add.reduceat(chunk_hits[:, :n_lang], np.cumsum(parts) - parts, axis=0, dtype=np.float32)
            n[line[starts]] += sizes
        return np.maximum(0, (out - n[:, None] * self.false_rate) / (1 - self.false_rate)).astype(np.float32)


_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def smooth(scores: np.ndarray, of: np.ndarray, switch: float) -> np.ndarray:
    """The best language of every line under a cost for each change within a text.

    Viterbi over the lines of all texts at once: step t handles line t of each text.
    ``scores`` are at most 0; lines of a text stand together in ``of``.
    """
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(of)])))
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    labels = np.empty(len(of), np.int64)
    stay = np.empty(scores.shape, bool)
    jump = np.empty(len(of), np.int64)
    best = scores[starts].astype(np.float64)
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    for t in range(1, sizes[0]):
        m = live[t]
        at, old = starts[:m] + t, best[:m]
        top = old.argmax(1)
        base = old[np.arange(m), top][:, None] - switch
        kept = old >= base
        stay[at], jump[at] = kept, top
        best[:m] = np.where(kept, old, base) + scores[at]
    state = best.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        labels[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], jump[at])
    return labels


@dataclass
class Labelled:
    """Lines of some texts that aren't blank: n-grams, those by language, whether a line bears no score, and its smoothed language."""

    of: np.ndarray
    line_no: np.ndarray
    n_grams: np.ndarray
    counts: np.ndarray
    silent: np.ndarray
    lang: np.ndarray


def _counted(texts: list[str], filters: Filters) -> Labelled:
    """Lines without their languages; remarks in a text with other lines bear no score."""
    lines = read_lines(texts)
    use = np.flatnonzero(~lines.blank)
    of, remark = lines.of[use], lines.remark[use]
    only = np.bincount(of, weights=~remark, minlength=len(texts)) == 0
    n_grams = np.diff(np.concatenate((lines.heads, [len(lines.raw)]))) - GRAM + 1
    return Labelled(of, lines.line_no[use], n_grams[use], filters.counts(lines)[use], remark & ~only[of], np.zeros(len(use), np.int64))


def _scores(counts: np.ndarray, silent: np.ndarray) -> np.ndarray:
    scores = np.maximum(counts - counts.max(1, keepdims=True), -LINE_CAP)
    scores[silent] = 0
    return scores


def smoothed(texts: list[str], filters: Filters) -> Labelled:
    """Remarks belong to the language around them: they bear no score unless a text holds nothing else."""
    x = _counted(texts, filters)
    return replace(x, lang=smooth(_scores(x.counts, x.silent), x.of, SWITCH)) if len(x.of) else x


def _runs(x: Labelled) -> pd.DataFrame:
    if not len(x.of):
        return pd.DataFrame({c: [] for c in ("of", "first", "last", "n_lines", "lang", "margin", "best")})
    of, lang = x.of, x.lang
    runs = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (lang[1:] != lang[:-1]))))
    sums = np.add.reduceat(np.where(x.silent[:, None], 0, x.counts), runs, axis=0)
    own = lang[runs]
    best = sums[np.arange(len(runs)), own]
    sums[np.arange(len(runs)), own] = -1
    ends = np.concatenate((runs[1:], [len(of)]))
    return pd.DataFrame({
        "of": of[runs], "first": x.line_no[runs], "last": x.line_no[ends - 1], "n_lines": ends - runs,
        "lang": own, "margin": best - np.maximum(sums.max(1), 0), "best": best,
    })


def label_lines(texts: list[str], filters: Filters) -> pd.DataFrame:
    """A row per run of lines in one language: of, first, last, n_lines, lang, margin, best.

    Blank lines have no language. ``best`` is the sum of the run's n-grams in its
    language, ``margin`` its lead over the next language.
    """
    return _runs(smoothed(texts, filters))


def _clear(x: Labelled, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clear lines and their leads over all languages held, by text and language."""
    top = x.counts.argmax(1)
    most = x.counts[np.arange(len(x.of)), top]
    lead = most - np.where(held[x.of], x.counts, 0).max(1)
    at = np.flatnonzero(~x.silent & (lead >= CLEAR) & (2 * lead >= most) & (most >= COVER * x.n_grams))
    n, total = np.zeros(held.shape), np.zeros(held.shape)
    np.add.at(n, (x.of[at], top[at]), 1)
    np.add.at(total, (x.of[at], top[at]), lead[at])
    return n, total


def held_languages(texts: list[str], filters: Filters, least_lines: int = LEAST_LINES) -> pd.DataFrame:
    """A row per text and language held, the main one first: of, lang, n_lines, margin, best.

    The stretches of the smoothed lines give the main language and those that fill
    ``least_lines`` lines. Further ones are sought line by line, wherever they stand: where
    lines clearly lead for another language, the text is counted again without what
    belongs to the language around it (``_INNER``), and its lines go to the languages
    that still have such leads at a low cost of change.
    """
    found = smoothed(texts, filters)
    per = _runs(found).groupby(["of", "lang"], as_index=False)[["n_lines", "margin", "best"]].sum()
    per = per[per["best"] > 0].sort_values(["of", "n_lines", "best"], ascending=[True, False, False])
    per = per[~per["of"].duplicated() | (per["n_lines"] >= least_lines)]
    if not len(per):
        return per
    held = np.zeros((len(texts), len(filters.languages)), bool)
    held[per["of"].astype(int), per["lang"].astype(int)] = True
    least = least_lines / 2

    def sought(n: np.ndarray, total: np.ndarray) -> np.ndarray:
        return (n >= least) & (total >= SWITCH)

    again = np.flatnonzero(sought(*_clear(found, held)).any(1) & held.any(1))
    if not len(again):
        return per
    x, known = _counted([_INNER.sub(_hidden, texts[i]) for i in again], filters), held[again]
    new = sought(*_clear(x, known))
    scores = np.where((known | new)[x.of], x.counts, -1)
    lang = smooth(np.where(scores < 0, -1e9, _scores(scores, x.silent)), x.of, ISLAND)
    more = _runs(replace(x, lang=lang)).groupby(["of", "lang"], as_index=False)[["n_lines", "margin", "best"]].sum()
    more = more[new[more["of"], more["lang"]] & (more["n_lines"] >= least_lines)].assign(of=lambda x: again[x["of"]])
    return pd.concat([per, more]).sort_values("of", kind="stable", ignore_index=True)


def _hidden(m: re.Match) -> str:
    return "\n" * m[0].count("\n") or " "


def _blocks(part: pd.DataFrame, chars: int = 300_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    texts = part["words"].tolist()
    ends = np.cumsum([len(t) for t in texts])
    which = ends // chars
    for k in np.unique(which):
        at = np.flatnonzero(which == k)
        yield at, [texts[i] for i in at]


def labelled_sample(docs: DataFrame, labels: DataFrame, names: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, lang_code`` of at most ``per_language`` documents of each language.

    Checked labels come first; documents whose own label is a known spelling fill up.
    Within each kind the choice goes by a hash of the identifier. Parts of a language by
    hash are ranked first, so that no task ranks more than ``per_language`` documents of
    each part.
    """
    checked = labels.select("doc_id", "lang_code", F.lit(0).alias("_kind"))
    known = names.select(F.lower(F.trim("spelling")).alias("_s"), "lang_code")
    own = docs.join(known, F.lower(F.trim("lang")) == F.col("_s")).select("doc_id", "lang_code", F.lit(1).alias("_kind"))
    own = own.join(small_side(checked.select("doc_id"), 1_000_000), "doc_id", "left_anti")
    ranked, order = checked.unionByName(own).where("lang_code is not null"), ("_kind", F.xxhash64("doc_id"), "doc_id")
    for part in ((F.col("lang_code"), F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PARTS))), (F.col("lang_code"),)):
        place = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        ranked = ranked.withColumn("_rank", place).where(F.col("_rank") <= per_language)
    return ranked.select("doc_id", "lang_code")


def _fitted(texts: DataFrame, docs_of: DataFrame, languages: list[str], least_share: float, first: Filters | None = None) -> Filters:
    """Filters from ``lang_code, words``; with ``first``, from those lines only that are in the text's language by these."""

    def own(words: str, code: str) -> np.ndarray:
        lines = read_lines([words])
        keep = ~lines.remark
        if first:
            keep[np.flatnonzero(~lines.blank)[smoothed([words], first).lang != first.languages.index(code)]] = False
        parts = [np.unique(g[keep[at]]) for g, at in lines.grams()]
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)

    def grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for code, group in part.groupby("lang_code"):
                found, n = np.unique(np.concatenate([own(words, code) for words in group["words"]]), return_counts=True)
                yield pd.DataFrame({"lang_code": code, "gram": found.astype(np.int64), "n": n})

    def slots(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in Filters.slots_of(part["gram"].to_numpy(np.int64).astype(np.uint64)):
                yield pd.DataFrame({"slot": at, "mask": part["mask"]})

    seen = texts.mapInPandas(grams, "lang_code string, gram long, n long").groupBy("lang_code", "gram").agg(F.sum("n").alias("n"))
    least = F.greatest(F.when(F.col("_docs") >= 4, 2).otherwise(1), F.ceil(F.col("_docs") * 0.01))
    bit = F.create_map(*[x for i, code in enumerate(languages) for x in (F.lit(code), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long"))])
    kept = seen.join(F.broadcast(docs_of), "lang_code").where(F.col("n") >= least)
    each = kept.select("gram", F.try_element_at(bit, F.col("lang_code")).alias("bit"), (F.col("n") / F.col("_docs")).alias("share"))
    per = each.groupBy("gram").agg(F.collect_list(F.struct("bit", "share")).alias("in"), F.max("share").alias("top"))
    held = F.filter("in", lambda x: x["share"] >= F.col("top") * least_share)
    masks = per.select("gram", F.aggregate(held, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["bit"])).alias("mask"))
    made = masks.mapInPandas(slots, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    return Filters.of_slots(languages, made["slot"].to_numpy(np.int64), made["mask"].to_numpy(np.int64))


def fit_filters(docs: DataFrame, labels: DataFrame, names: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from a bounded sample of labelled documents.

    An n-gram is put into a language's filter if at least 1 % of the language's sampled
    documents have it (two at least, where there are four or more), remarks aside; so
    wrong labels leave hardly a trace. It must have ``LEAST_SHARE`` of the share that the
    language with most of it has, too. As documents often hold a second language (code
    in a text, say), first filters under the strict ``FIRST_SHARE`` tell which lines of
    the sampled documents are in the document's own language, and the filters returned
    are made from these alone. The driver gets a row per slot, whatever the sample holds.
    """
    languages = sorted(r[0] for r in names.select("lang_code").distinct().limit(65).collect())
    if len(languages) > 64:
        raise ValueError("at most 64 languages")
    sample = labelled_sample(docs, labels, names, per_language)
    texts = docs.select("doc_id", F.col("text").alias("words")).where("length(words) > 0").join(small_side(sample, per_language * len(languages)), "doc_id")
    docs_of = sample.groupBy("lang_code").agg(F.count(F.lit(1)).alias("_docs"))
    first = _fitted(texts, docs_of, languages, FIRST_SHARE)
    return _fitted(texts, docs_of, languages, LEAST_SHARE, first)


def with_declared(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id, words, declared``: the language code that the document's own label spells, null if none."""
    blanks = F.lit(" \t\r\n")
    known = names.select(F.lower(F.btrim("spelling", blanks)).alias("_s"), F.col("lang_code").alias("declared"))
    rows = docs.select("doc_id", F.col("text").alias("words"), F.lower(F.btrim("lang", blanks)).alias("_s"))
    return rows.where("length(words) > 0").join(small_side(known, 100_000), "_s", "left").select("doc_id", "words", "declared")


def document_languages(docs: DataFrame, names: DataFrame, filters: Filters, least_lines: int = LEAST_LINES) -> DataFrame:
    """The languages each document holds, a row for each.

    Columns: ``doc_id, declared, main_code, n_held, lang_code, n_lines, confidence``.
    Every line gets the languages that contain its n-grams from the filters; counts,
    corrected for false positives, decide line by line, smoothed over the document. The
    main language has the most lines; a further one is held from ``least_lines`` lines
    together, wherever they stand (``held_languages``). ``confidence`` is the share of the language's n-grams by which it leads the
    next language. Null and blank texts give no row; neither do texts without a single
    known n-gram. Whole texts are read in one pass without a shuffle.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at, texts in _blocks(part):
                per = held_languages(texts, filters, least_lines)
                if not len(per):
                    continue
                code = pd.Series(np.array(filters.languages)[per["lang"].astype(int)], index=per.index)
                rows = at[per["of"].astype(int)]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy()[rows], "declared": part["declared"].to_numpy()[rows],
                    "main_code": code.groupby(per["of"]).transform("first"), "n_held": code.groupby(per["of"]).transform("size"),
                    "lang_code": code, "n_lines": per["n_lines"],
                    "confidence": np.clip(per["margin"] / np.maximum(per["best"], 1), 0, 1).astype(float).round(6),
                })

    schema = "doc_id long, declared string, main_code string, n_held int, lang_code string, n_lines long, confidence double"
    return with_declared(docs, names).mapInPandas(run, schema)


def segment_languages(docs: DataFrame, filters: Filters) -> DataFrame:
    """Runs of lines in one language: ``doc_id, segment_no, first_line, last_line, lang_code, confidence``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at, texts in _blocks(part):
                runs = label_lines(texts, filters)
                if len(runs):
                    yield pd.DataFrame({
                        "doc_id": part["doc_id"].to_numpy()[at[runs["of"]]], "segment_no": runs.groupby("of").cumcount() + 1,
                        "first_line": runs["first"], "last_line": runs["last"], "lang_code": np.array(filters.languages)[runs["lang"]],
                        "confidence": np.clip(runs["margin"] / np.maximum(runs["best"], 1), 0, 1).astype(float).round(6),
                    })

    rows = docs.select("doc_id", F.col("text").alias("words")).where("length(words) > 0")
    return rows.mapInPandas(run, "doc_id long, segment_no int, first_line long, last_line long, lang_code string, confidence double")


def relabelled(docs: DataFrame, names: DataFrame, filters: Filters, least_lines: int = LEAST_LINES) -> DataFrame:
    """``doc_id, lang_code`` of documents whose label is missing or wrong or that hold several languages."""
    held = document_languages(docs, names, filters, least_lines)
    return held.where("declared is null or declared <> main_code or n_held > 1").select("doc_id", "lang_code")
