"""Mapping free-entered values to the closest entry of a reference list.

Method: a prefix-filter set-similarity join. Entries and list items become sets of tokens (character
pairs of the folded text, a repeated pair numbered). Tokens are ordered by global rarity; two sets
of Jaccard similarity t or more share one of their first ``n - ceil(t * n) + 1`` tokens, so only
those prefixes are joined. A length filter and a positional filter (the most tokens that can still
be common from the positions of the shared one) drop candidates, the rest are verified exactly, and
the best item is kept (ties: the smallest item key). The join is made at a high similarity first, where
prefixes are short, and then at lower ones for the entries that found nothing: the best item of an entry
that found one is at that stage, so the result is that of one join at the lowest. An entry without an
item is reported with none.

Other names of an item (codes) count only when they are equal to the entry after folding; a code
one character off is another code.

Scale: the work is done once per distinct entry, so rows are first reduced by a partial distinct;
joins are equi-joins on (field, token) of short prefixes; the answer goes back to the rows by an
equi-join on (field, entry), which AQE broadcasts when the distinct entries prove small and splits
when one entry is hot. Nothing is collected. With a list of many items candidates grow with the lowest
threshold alone, and only for entries that no higher stage settles.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import broadcast_if_small, cut

#: Jaccard similarity of character pairs from which an entry is taken to mean an item.
THRESHOLD = 0.22
#: Similarities at which entries are looked at first: prefixes are short there, and most entries are done.
STAGES = (0.7, 0.45)

# Letters of other scripts that look like Latin ones, and letters that do not decompose.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
        "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ԝ": "w", "х": "x", "ӏ": "l",
        "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
        "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i",
    }
)
_KEPT = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Letters and digits of ``text`` in one width, case and script, without accents."""
    s = unicodedata.normalize("NFKC", text).lower().translate(LOOKALIKES)
    s = "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.combining(ch))
    return unicodedata.normalize("NFC", _KEPT.sub("", s))


def tokens(text: str) -> list[str]:
    """Character pairs of the folded text with its ends marked; a repeated pair gets a number."""
    s = f"^{fold(text)}$"
    seen: dict[str, int] = {}
    out = []
    for i in range(len(s) - 1):
        pair = s[i : i + 2]
        seen[pair] = n = seen.get(pair, 0) + 1
        out.append(pair if n == 1 else f"{pair}{n}")
    return out


def _tokenized(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``key`` (folded text) and ``toks``; runs over Arrow batches."""
    names = [c for c in df.columns if c != text] + [text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fold(t) for t in texts], pa.string()), pa.array([tokens(t) for t in texts], pa.list_(pa.string()))], names=[*names, "key", "toks"])

    return df.select(*names).mapInArrow(run, f"{schema}, key string, toks array<string>")


def _ordered(df: DataFrame, ident: Sequence[str], rarity: DataFrame) -> DataFrame:
    """``ident, toks`` with the tokens of each set from rare to common."""
    each = df.select(*ident, F.explode("toks").alias("tok")).join(rarity, "tok")
    return each.groupBy(*ident).agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "tok"))), lambda x: x["tok"]).alias("toks"))  # a set has as many tokens as its text has characters


def _candidates(entries: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``eid, rid`` that share a token of their prefixes and pass the length and positional filters."""

    def prefixes(df: DataFrame, ident: Sequence[str], side: str) -> DataFrame:
        n = F.size("toks")
        short = F.slice(F.col("toks"), 1, (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
        return df.select(*ident, n.alias(f"n{side}"), F.posexplode(short).alias(f"p{side}", "tok"))

    a, b = prefixes(entries, ["field", "eid"], "a"), prefixes(items, ["field", "rid"], "b")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    near = a.join(broadcast_if_small(b), ["field", "tok"]).where(
        (F.col("nb") >= F.col("na") * threshold - 1e-9) & (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need)
    )
    return near.select("eid", "rid").distinct()


def _similar(entries: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """Rows ``eid, item, similarity`` of all pairs at ``threshold`` or more; both sides with ordered ``toks``."""
    full = _candidates(entries, items, threshold).join(entries.select("eid", F.col("toks").alias("ta")), "eid").join(broadcast_if_small(items.select("rid", "item", F.col("toks").alias("tb"))), "rid")
    common = F.size(F.array_intersect("ta", "tb"))
    return full.withColumn("similarity", common / (F.size("ta") + F.size("tb") - common)).where(F.col("similarity") >= threshold - 1e-9).select("eid", "item", "similarity")


def closest_items(entries: DataFrame, items: DataFrame, other_names: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The closest item of each entry: rows ``field, entry, item, similarity``; without an item none.

    ``entries``: distinct ``field, entry`` (not null); ``items``: ``field, item, name``;
    ``other_names``: ``field, item, name``. Names and entries whose folded text is empty match nothing.
    """
    e = _tokenized(entries.select("field", "entry"), "entry").where("key <> ''")
    e = cut(e.withColumn("eid", F.monotonically_increasing_id()))  # fixed by the checkpoint; keeps long entries out of the joins
    r = cut(_tokenized(items.select("field", "item", "name").where("name is not null"), "name").where("key <> ''").select("field", "item", "toks", "key").dropDuplicates(["field", "item", "key"]))
    r = r.withColumn("rid", F.xxhash64("field", "item", "key"))
    sizes = r.agg(F.min(F.size("toks")).alias("lo"), F.max(F.size("toks")).alias("hi")).first()
    # the length filter against all items at once: other entries cannot reach the threshold
    fits = F.size("toks").between((sizes["lo"] or 0) * threshold - 1e-9, (sizes["hi"] or 0) / threshold + 1e-9)
    near_e = e.where(fits).select("field", "eid", "toks")
    rarity = near_e.select(F.explode("toks").alias("tok")).unionByName(r.select(F.explode("toks").alias("tok"))).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    todo, ro = cut(_ordered(near_e, ["field", "eid"], rarity)), cut(_ordered(r, ["field", "item", "rid"], rarity))
    # an entry's best item is found at the highest stage at which it has any
    found = []
    for at in sorted({t for t in STAGES if t > threshold} | {threshold}, reverse=True):
        best = cut(_similar(todo, ro, at).groupBy("eid").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "item")).alias("b")).select("eid", "b.item", (-F.col("b.s")).alias("similarity")))
        found.append(best)
        todo = todo.join(broadcast_if_small(best.select("eid")), "eid", "left_anti")
    scored = reduce(DataFrame.unionByName, found)
    if other_names is not None:
        o = _tokenized(other_names.select("field", "item", "name").where("name is not null"), "name").where("key <> ''").select("field", "item", "key").distinct()
        same = e.select("field", "key", "eid").join(broadcast_if_small(cut(o)), ["field", "key"]).select("eid", "item", F.lit(1.0).alias("similarity"))
        scored = scored.unionByName(same)
    best = scored.groupBy("eid").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "item")).alias("b"))
    return best.join(e.select("eid", "field", "entry"), "eid").select("field", "entry", F.col("b.item").alias("item"), (-F.col("b.s")).alias("similarity"))


def map_to_list(cells: DataFrame, items: DataFrame, other_names: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``cells`` (with ``field`` and ``entry``) with ``item`` and ``similarity``, null when unmatched.

    Columns of these names in ``cells`` are replaced; others are carried along. Null entries stay unmatched. Repeated cells stay repeated. An empty list leaves all unmatched.
    """
    entries = cells.where("field is not null and entry is not null").select("field", "entry").distinct()
    cells = cells.drop("item", "similarity")
    return cells.join(closest_items(entries, items, other_names, threshold), ["field", "entry"], "left")
