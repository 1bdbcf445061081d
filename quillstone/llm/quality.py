"""Per-document text statistics and text types (prose, list, table, junk) in any language.

Method: thresholds on single statistics are noisy labelling functions. Each vote names the types that the
statistic speaks for; a function abstains between its thresholds and where it does not apply. How often a
function casts which vote for each type is learned by expectation-maximization from the agreement of the
functions alone: types start equally frequent, all functions start equally trusted (a vote is ``DOUBT``
times as likely for a type that it does not name), and pseudo-votes of ``TRUST`` of the documents per
function and type remain of that. The posterior of each type is put out per document.

Common words are learned from the corpus as well: the words (pairs of characters in scripts without
spaces) that at least ``COMMON_IN`` of a language's documents hold. A document is measured against the
share that common words usually have in its language, so no list of words is built in. The language is
what the corpus says of its documents (its first two letters), if it says anything; where it says
nothing, or has fewer than ``LEAST_DOCUMENTS`` of a language, missing common words speak against nothing.

Scale: two narrow passes of numpy over whole texts (``textstats``). The first counts words per language
within each task before the shuffle; what is kept of it are at most ``MOST_COMMON`` words of each of 676
languages. The statistics of the second are kept in the shared checkpoint folder. EM needs only how often
each combination of votes occurs: one partial aggregate, whose result has at most ``prod(votes of a
function)`` rows whatever the corpus (about a thousand in practice), and is fitted on the driver. The
posterior of each combination is joined by broadcast behind a check of its size. No text moves.

Null, empty and blank texts have no type (null) and statistics of zero. Shares of lines are shares of
their visible characters, so a type is that of the larger part of a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm import textstats
from quillstone.session import broadcast_if_small, cut, spread

TYPES = PROSE, LIST, TABLE, JUNK = ("prose", "list", "table", "junk")
#: Share of a language's documents that hold a common word, the most of them, and the documents that a language needs.
COMMON_IN, MOST_COMMON, LEAST_DOCUMENTS = 0.2, 300, 20
#: Likelihood of a vote for a type it does not name against one it names, before anything is learned; its k-th root for a vote that names k.
DOUBT = 0.1
#: Weight of what is believed of a function before learning, as a share of the documents.
TRUST = 0.002


@dataclass(frozen=True)
class Labeller:
    """Votes in order of preference: the first condition that holds gives the vote, a set of types."""

    name: str
    votes: tuple[tuple[Column, tuple[str, ...]], ...]


def labellers(g: Callable[[str], Column]) -> list[Labeller]:
    """The labelling functions on statistics by name. Each looks at one statistic; what stands beside it says where it applies."""
    spaced, many = g("wide_share") < 0.3, g("n_words") >= 8
    ratio, symbols, digits, capitals, vowels = g("common_word_ratio"), g("symbol_ratio"), g("digit_ratio"), g("capital_share"), g("vowel_share")
    short, length, entries = g("short_word_share"), g("mean_word_length"), (PROSE, TABLE, JUNK)
    distinct, enough = g("n_distinct_words"), (g("n_distinct_words") >= 4) & (spaced | (g("n_distinct_words") >= 8))
    words = (PROSE, LIST, TABLE)
    return [
        Labeller("entries", ((g("entry_share") >= 0.5, (LIST,)), (g("entry_share") < 0.5, entries))),
        Labeller("bullets", ((g("bullet_share") >= 0.5, (LIST,)), (g("bullet_share") < 0.5, entries))),
        Labeller("cells", ((g("cell_share") >= 0.5, (TABLE,)), (g("cell_share") < 0.5, (PROSE, LIST, JUNK)))),
        Labeller("line_words", (((g("n_lines") >= 4) & (g("line_words") <= 5.5), (LIST, TABLE)), (g("line_words") >= 9, (PROSE, JUNK)))),
        Labeller("line_ends", ((g("ended_share") >= 0.5, (PROSE,)), ((g("n_lines") >= 3) & (g("ended_share") < 0.3), (LIST, TABLE, JUNK)))),
        Labeller("common_words", ((enough & (ratio >= 0.55), (PROSE,)), (enough & g("language_known") & (ratio < 0.2), (LIST, TABLE, JUNK)))),
        Labeller("symbols", ((symbols >= 0.45, (JUNK,)), (symbols >= 0.085, (LIST, TABLE, JUNK)), (symbols < 0.065, (PROSE, LIST)))),
        Labeller("digits", ((digits >= 0.15, (TABLE, JUNK)), (digits < 0.05, (PROSE, LIST)))),
        Labeller("capitals", ((spaced & (distinct >= 4) & (capitals >= 0.6), (JUNK,)), (spaced & (distinct >= 4) & (capitals < 0.4), words))),
        Labeller("short_words", ((spaced & (distinct >= 8) & (short < 0.08), (TABLE, JUNK)), (spaced & (distinct >= 8) & (short >= 0.2), words))),
        Labeller("vowels", ((vowels < 0.27, (JUNK,)), (vowels >= 0.33, words))),
        Labeller("word_length", ((spaced & ((length >= 14) | ((length > 0) & (length < 2.4))), (JUNK,)), (spaced & (length >= 3) & (length < 9), words))),
        Labeller("repeated_word", ((many & (g("top_word_share") >= 0.5), (JUNK,)), (many & (g("top_word_share") < 0.3), words))),
        Labeller("distinct_words", ((many & (distinct <= 2), (JUNK,)), (many & (distinct >= 6), words))),
        Labeller("repeated_mark", ((g("repeated_share") >= 0.4, (JUNK,)), (g("repeated_share") < 0.4, words))),
        Labeller("unbroken", ((g("unbroken_share") >= 0.5, (JUNK,)), (g("unbroken_share") < 0.5, words))),
        Labeller("letters", ((g("letter_ratio") < 0.4, (TABLE, JUNK)), (g("letter_ratio") >= 0.7, (PROSE, LIST, JUNK)))),
    ]


def vote_codes(g: Callable[[str], Column]) -> list[Column]:
    """Per labelling function 0 for none, or 1 + the index of its vote."""
    out = []
    for lab in labellers(g):
        c = F.lit(0)
        for i, (cond, _) in reversed(list(enumerate(lab.votes))):
            c = F.when(cond, F.lit(i + 1)).otherwise(c)
        out.append(c.alias(lab.name))
    return out


def named_types() -> list[list[tuple[int, ...]]]:
    """Per labelling function the types that each vote names, as indexes."""
    return [[tuple(TYPES.index(t) for t in kinds) for _, kinds in lab.votes] for lab in labellers(F.col)]


def untrained(named: list[list[tuple[int, ...]]]) -> list[np.ndarray]:
    """P(vote | type, a vote is cast) per function before learning, as (types, 1 + votes); an abstention says nothing (1)."""
    out = []
    for votes in named:
        m = np.array([[1.0 if c in v else DOUBT ** (1 / len(v)) for v in votes] for c in range(len(TYPES))])
        out.append(np.hstack([np.ones((len(TYPES), 1)), m / m.sum(axis=1, keepdims=True)]))
    return out


def posterior(patterns: np.ndarray, frequency: np.ndarray, theta: list[np.ndarray]) -> np.ndarray:
    """P(type) of each combination of votes."""
    logp = np.log(frequency)[None, :] + sum(np.log(t[:, patterns[:, j]].T + 1e-12) for j, t in enumerate(theta))
    p = np.exp(logp - logp.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, named: list[list[tuple[int, ...]]], rounds: int = 500) -> tuple[np.ndarray, list[np.ndarray]]:
    """EM on counted combinations of votes → frequency of the types and P(vote | type, a vote is cast) per function.

    The untrained functions remain as pseudo-votes of ``TRUST`` of the documents, one at least, per type.
    """
    k = len(TYPES)
    start = untrained(named)
    theta, frequency = start, np.full(k, 1 / k)
    if not len(patterns):
        return frequency, theta
    trust = max(1.0, TRUST * float(counts.sum()))
    for _ in range(rounds):
        w = posterior(patterns, frequency, theta) * counts[:, None]
        new_frequency = (w.sum(axis=0) + 1) / (w.sum() + k)
        new = []
        for j, t in enumerate(start):
            seen = np.stack([w[patterns[:, j] == v].sum(axis=0) for v in range(1, t.shape[1])], axis=1) + trust * t[:, 1:]
            new.append(np.hstack([t[:, :1], seen / seen.sum(axis=1, keepdims=True)]))
        moved = max(np.abs(a - b).max() for a, b in zip(new, theta))
        theta, frequency = new, new_frequency
        if moved < 1e-6:
            break
    return frequency, theta


def _language(df: DataFrame, lang: str | None) -> Column:
    """The language's first two letters, '' where nothing is said."""
    if lang is None:
        return F.lit("")
    two = F.lower(F.substring(F.trim(F.col(lang).cast("string")), 1, 2))
    return F.when(two.rlike("^[a-z]{2}$"), two).otherwise(F.lit(""))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def common_words(rows: DataFrame, declared: bool) -> tuple[np.ndarray, dict[str, float]]:
    """(sorted words that are common in some language, usual share of common words per language) of rows ``text, lang``.

    ``declared``: the rows say their language; then '' is no language but stands for the mean of all.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = _texts(batch), batch.column("lang").to_pylist()
            names = sorted(set(langs))
            of = {g: i for i, g in enumerate(names)}
            numbers = np.array([of[g] for g in langs], np.int64)
            parts = [textstats.word_counts(texts[a:b], numbers[a:b]) for a, b in textstats.chunks(texts)]
            filled = np.array([bool(t) and not t.isspace() for t in texts], bool)
            g, w, n = (np.concatenate([p[i] for p in parts] + [extra]) for i, extra in enumerate((np.arange(len(names)), np.full(len(names), -1), np.bincount(numbers[filled], minlength=len(names)))))
            pairs, at = np.unique(np.stack([g, w]), axis=1, return_inverse=True) if len(parts) > 1 else (np.stack([g, w]), np.arange(g.size))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in pairs[0]], pa.string()), pa.array(pairs[1], pa.int64()), pa.array(np.bincount(at.ravel(), n, pairs.shape[1]).astype(np.int64))], names=["lang", "word", "n"])

    source = rows.where(F.col("lang") != "") if declared else rows
    counts = cut(source.select("text", "lang").mapInArrow(count, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("word") < 0, F.col("n"))).alias("docs"), F.sum(F.when(F.col("word") >= 0, F.col("n"))).alias("held")).where(F.col("docs") >= LEAST_DOCUMENTS)
    # a language is two letters: at most 676 of them
    frequent = counts.where("word >= 0").join(F.broadcast(totals), "lang").where(F.col("n") >= COMMON_IN * F.col("docs"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    found = frequent.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_COMMON).select("lang", "word", "n", "held").collect()
    if not found:
        return np.zeros(0, np.int64), {}
    held: dict[str, int] = {r["lang"]: r["held"] for r in found}
    hits = {g: sum(r["n"] for r in found if r["lang"] == g) for g in held}
    usual = {g: hits[g] / held[g] for g in held}
    if declared:
        usual[""] = sum(hits.values()) / sum(held.values())
    return np.unique(np.array([r["word"] for r in found], np.int64)), usual


_FIELDS = [*textstats.COUNTS, *textstats.SHARES]


def _voted(df: DataFrame, key: str, text: str, lang: str | None) -> DataFrame:
    """``key``, the statistics and the vote codes ``v``, kept in the shared folder."""
    rows = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), _language(df, lang).alias("lang")))
    common, usual = common_words(rows, lang is not None)
    declared = lang is not None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = _texts(batch), batch.column("lang").to_pylist()
            expect = np.array([usual.get(g, np.nan) for g in langs], float)
            parts = [textstats.statistics(texts[a:b], common, expect[a:b]) for a, b in textstats.chunks(texts)]
            known = pa.array(np.isfinite(expect) & declared, pa.bool_())
            cols = [np.concatenate([p[f] for p in parts]) for f in _FIELDS]
            kinds = [pa.int64() if f in textstats.COUNTS else pa.float64() for f in _FIELDS]
            yield pa.RecordBatch.from_arrays([batch.column("key"), known, *[pa.array(c, k, from_pandas=True) for c, k in zip(cols, kinds)]], names=["key", "language_known", *_FIELDS])

    kind = rows.schema["key"].dataType.simpleString()
    fields = ", ".join(f"{f} {'long' if f in textstats.COUNTS else 'double'}" for f in _FIELDS)
    measured = rows.mapInArrow(measure, f"key {kind}, language_known boolean, {fields}")
    return cut(measured.withColumn("v", F.array(*vote_codes(F.col))))


def _fitted(voted: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The combinations of votes that occur, the frequency of types and what was learned of the functions."""
    counted = voted.where(F.col("n_lines") > 0).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per combination of votes
    counted.sort(key=lambda r: r["v"])
    named = named_types()
    patterns = np.array([r["v"] for r in counted], dtype=int).reshape(-1, len(named))
    return patterns, *fit_accuracies(patterns, np.array([r["n"] for r in counted], dtype=float), named)


def text_types(df: DataFrame, key: str, text: str, lang: str | None = None) -> DataFrame:
    """``<key>``, the statistics, ``p_prose, p_list, p_table, p_junk`` and ``text_type`` of each row.

    ``lang``: column with the language that the corpus gives, in any notation that begins with two
    letters; wrong ones do little harm. Blank texts have null posteriors and type. Equal rows get equal
    results; ties of the posterior go to the earlier type. An empty table gives an empty result. Other
    columns are not read.
    """
    voted = _voted(df, key, text, lang)
    patterns, frequency, theta = _fitted(voted)
    post = posterior(patterns, frequency, theta) if len(patterns) else np.zeros((0, len(TYPES)))
    names = [f"p_{t}" for t in TYPES]
    rows = [(v.tolist(), *map(float, p), TYPES[int(p.argmax())]) for v, p in zip(patterns, post)]
    table = df.sparkSession.createDataFrame(rows, "v array<int>, " + ", ".join(f"{n} double" for n in names) + ", text_type string")
    joined = voted.join(broadcast_if_small(table), "v", "left")
    seen = F.col("n_lines") > 0
    return joined.select(F.col("key").alias(key), *_FIELDS, *[F.when(seen, F.col(n)).alias(n) for n in [*names, "text_type"]])


def accuracies(df: DataFrame, key: str, text: str, lang: str | None = None) -> list[dict]:
    """What was learned of the labelling functions: per function and vote the types named and P(vote | type) (for inspection)."""
    _, _, theta = _fitted(_voted(df, key, text, lang))
    out = []
    for lab, t in zip(labellers(F.col), theta):
        out += [{"function": lab.name, "vote": i, "names": kinds, **{k: float(t[c, 1 + i]) for c, k in enumerate(TYPES)}} for i, (_, kinds) in enumerate(lab.votes)]
    return out
