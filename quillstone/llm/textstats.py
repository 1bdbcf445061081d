"""Statistics of whole texts, computed for many texts at once by numpy on their code points.

The texts of a batch are laid end to end as UTF-32. A table gives the class of each code point (it is
filled for the code points that occur), so letters, digits, marks and word borders of all texts come
from array operations, and sums per line and per text from ``reduceat``: no pattern is matched, and the
time per character does not depend on the text. Words are known by a 64-bit hash of their lower case;
in scripts without spaces between words (Chinese, Japanese) every pair of neighbouring characters is one.

Lines end at any line end and at the closing tags of HTML rows and items. Blank lines do not count. A
word is a run of letters and marks, with single apostrophes inside.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

LETTER, MARK, DIGIT, SPACE, UPPER, LATIN, VOWEL, WIDE, END, CLOSER, BREAK, OTHER, BAR, COMMA, FREE, FULL = (1 << i for i in range(16))
#: Characters of texts that are worked on at once; a longer text is worked on alone.
CHUNK = 200_000
#: Characters that are counted in 16 bits.
SPAN = 60_000
#: Words are told apart by so many bits of their hash; texts of a chunk by the rest.
WORD_BITS = 44

_TAGS = re.compile(r"(?i)</(?:tr|li|p|div|h\d)>|<br\s*/?>")
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
_ENDS = ".!?。！？…‽؟।"
_CLOSERS = "\"'»”’)]）」』】"
_BULLETS = np.array([ord(c) for c in "-–—*•·▪●◦✓✔☑✗+>"], np.uint32)


def _class(ch: str) -> int:
    cat = unicodedata.category(ch)
    out = 0
    if cat[0] == "L":
        out |= LETTER
        if cat in ("Lu", "Lt"):
            out |= UPPER
        name = unicodedata.name(ch, "")
        if name.startswith("LATIN"):
            out |= LATIN
            if unicodedata.normalize("NFD", ch.lower())[0] in "aeiouyıæøœ":
                out |= VOWEL
        if name.startswith(("CJK", "HIRAGANA", "KATAKANA", "IDEOGRAPHIC")):
            out |= WIDE
    elif cat[0] == "M" and not 0xFE00 <= ord(ch) <= 0xFE0F:
        out |= MARK
    elif cat[0] == "N":
        out |= DIGIT
    elif cat[0] in "ZC" or ch.isspace():
        out |= SPACE
    else:
        out |= OTHER
    if ch == "ー":
        out |= WIDE | LETTER
    if ch in _ENDS:
        out |= END
    if ch in _CLOSERS or cat == "So":
        out |= CLOSER
    if ch in _BREAKS:
        out |= BREAK
    for bit, marks in ((BAR, "|\t"), (COMMA, ",;"), (FREE, "/|·>•~–—-"), (FULL, "、・")):
        if ch in marks:
            out |= bit
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all of them."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tables:
    """Class and hash of the lower case by code point, filled as code points occur (no class is 0)."""

    def __init__(self) -> None:
        self.cls = np.zeros(0x110000, np.uint16)
        self.mixed = np.zeros(0x110000, np.uint64)

    def classes(self, codes: np.ndarray) -> np.ndarray:
        out = self.cls[codes]
        if not out.all():
            new = np.unique(codes[out == 0])
            for c in new.tolist():
                self.cls[c] = _class(chr(c))
            self.mixed[new] = _mix(np.array([ord(chr(c).lower()[0]) for c in new.tolist()], np.uint64))
            out = self.cls[codes]
        return out


@lru_cache(maxsize=1)
def _tables() -> _Tables:
    return _Tables()


@lru_cache(maxsize=1)
def _packed() -> tuple[np.ndarray, np.ndarray]:
    """By class two numbers with four 16-bit counters: letters, digits, others, visible; wide, Latin, vowels."""
    c = np.arange(1 << 16)
    one = lambda bit: ((c & bit) != 0).astype(np.uint64)
    visible = 1 - one(SPACE)
    pack = lambda *fs: sum(f << np.uint64(16 * i) for i, f in enumerate(fs))
    return pack(one(LETTER), one(DIGIT), one(OTHER), visible), pack(one(WIDE), one(LATIN), one(VOWEL))


class Texts:
    """Code points, lines and words of several texts."""

    def __init__(self, texts: Sequence[str]) -> None:
        # every text ends with a line end of its own
        self.n_chars = np.array([len(t) for t in texts], np.int64)
        texts = [_TAGS.sub("\n", t) if "<" in t else t for t in texts]
        joined = "\n".join(texts) + "\n"
        self.codes = codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        tables = _tables()
        self.cls = cls = tables.classes(codes)
        sizes = np.array([len(t) for t in texts], np.int64) + 1
        self.doc_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        breaks = np.flatnonzero(cls & BREAK)
        # the last character of a text is a line end, so lines begin after line ends only
        self.line_start = np.concatenate([[0], breaks[:-1] + 1])
        self.line_end = breaks
        self.line_doc = np.searchsorted(self.doc_start, self.line_start, "right") - 1
        # words: runs of letters and marks, apostrophes between letters, wide scripts apart
        wide = (cls & WIDE) != 0
        alpha = ((cls & (LETTER | MARK)) != 0) & ~wide
        apos = np.flatnonzero((codes == 0x27) | (codes == 0x2019))
        apos = apos[(apos > 0) & (apos < len(codes) - 1)]
        inner = apos[alpha[apos - 1] & alpha[apos + 1]] if apos.size else apos
        in_word = alpha.copy()
        in_word[inner] = True
        at = np.flatnonzero(in_word)
        first = np.ones(at.size, bool)
        first[1:] = np.diff(at) > 1
        self.word_start = at[first]
        lens = np.diff(np.append(np.flatnonzero(first), at.size))
        if at.size:
            place = np.arange(at.size) - np.repeat(np.flatnonzero(first), lens)
            powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
            self.word_hash = np.add.reduceat(tables.mixed[codes[at]] * powers[place], np.flatnonzero(first))
        else:
            self.word_hash = np.zeros(0, np.uint64)
        self.word_len = lens
        pair = np.flatnonzero(wide[:-1] & wide[1:])
        self.pair_start = pair
        self.pair_hash = _mix(_mix(codes[pair]) * np.uint64(3) + codes[pair + 1])
        self.word_line = np.searchsorted(self.line_start, self.word_start, "right") - 1
        self.word_doc = self.line_doc[self.word_line]
        self.pair_doc = np.searchsorted(self.doc_start, pair, "right") - 1

    def counted_words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, how often) of every distinct word of a text, pairs of wide characters among them."""
        docs, hashes = np.concatenate([self.word_doc, self.pair_doc]), np.concatenate([self.word_hash, self.pair_hash])
        keys = np.sort((docs.astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes >> np.uint64(64 - WORD_BITS)))
        new = np.ones(keys.size, bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        keys = keys[at].astype(np.int64)
        return keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1), np.diff(np.append(at, new.size))


def _after(positions: np.ndarray, at: np.ndarray, none: int) -> np.ndarray:
    """The first of the sorted positions at or after each of ``at``."""
    return np.append(positions, none)[np.searchsorted(positions, at, "left")]


def _before(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last of the sorted positions before each of ``at``, -1 without one."""
    i = np.searchsorted(positions, at, "left") - 1
    return np.where(i >= 0, positions[np.maximum(i, 0)] if positions.size else -1, -1)


#: Statistics in order; all are doubles but the counts.
COUNTS = ("n_chars", "n_lines", "n_words", "n_distinct_words")
SHARES = (
    "mean_word_length", "letter_ratio", "symbol_ratio", "digit_ratio", "ended_line_share", "ended_share", "common_word_share", "common_word_ratio", "wide_share", "bullet_share", "cell_share",
    "pair_share", "strung_share", "brief_share", "entry_share", "line_words", "short_word_share", "capital_share", "vowel_share", "top_word_share", "repeated_share", "unbroken_share",
)


def word_counts(texts: Sequence[str], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, word, texts with it) of texts with the numbers of their groups."""
    doc, word, _ = Texts(texts).counted_words()
    keys, n = np.unique((groups[doc].astype(np.int64) << WORD_BITS) | word, return_counts=True)
    return keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1), n


def statistics(texts: Sequence[str], common: np.ndarray, usual: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text. ``common``: sorted hashes of common words; ``usual``: share of common words that is usual in the text's language (NaN if unknown)."""
    x = Texts(texts)
    n, codes, cls = len(texts), x.codes, x.cls
    add_lines = lambda v: np.bincount(x.line_doc, v, n)
    has = lambda bit: (cls & bit) != 0
    padded = np.concatenate([codes, np.full(8, 10, np.uint32)])
    pcls = np.concatenate([cls, np.full(8, _tables().cls[10] | SPACE | BREAK, np.uint16)])
    visible = ~has(SPACE)
    div = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)

    # characters per line, counted in spans that 16 bits can hold
    spans = np.unique(np.concatenate([x.line_start, np.arange(0, len(codes), SPAN)]))
    of_line = np.searchsorted(spans, x.line_start)
    fields = []
    for table in _packed():
        got = np.add.reduceat(table[cls], spans)
        fields += [np.add.reduceat((got >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF, of_line) for i in range(4)]
    letters, digits, others, size, wide, latin, vowels, _ = fields
    # lines: those with a visible character
    real = size > 0
    shown = np.flatnonzero(visible)
    head = np.minimum(_after(shown, x.line_start, len(codes) - 1), x.line_end)
    last = _before(np.flatnonzero(visible & ~has(CLOSER)), x.line_end)
    ended = real & (last >= x.line_start) & ((cls[np.maximum(last, 0)] & END) != 0)
    line_words = np.bincount(x.word_line, minlength=len(size)) + wide / 3
    # markers at the head of a line
    c = [padded[head + i] for i in range(6)]
    gap = [(pcls[head + i] & SPACE) != 0 for i in range(8)]
    num = [(pcls[head + i] & DIGIT) != 0 for i in range(8)]
    bullet = (np.isin(c[0], _BULLETS)) & gap[1]
    bullet |= (c[0] == ord("[")) & (((c[1] == ord("]")) & gap[2]) | ((c[2] == ord("]")) & gap[3]))
    for off in (0, 1):
        opened = np.ones(len(size), bool) if off == 0 else (c[0] == ord("("))
        stop = lambda i: (padded[head + i] == ord(".")) | (padded[head + i] == ord(")"))
        for k in (1, 2, 3):
            bullet |= opened & np.logical_and.reduce([num[off + j] for j in range(k)]) & stop(off + k) & gap[off + k + 1]
        bullet |= opened & ((pcls[head + off] & LATIN) != 0) & stop(off + 1) & gap[off + 2]
    for k in (1, 2, 3):
        bullet |= (c[0] == ord("#")) & np.logical_and.reduce([num[1 + j] for j in range(k)]) & gap[1 + k]
    bullet &= real
    # cells: delimiters without a space behind, bars, tabs, wide blanks
    nxt = np.concatenate([cls[1:], [SPACE]])
    bare = has(COMMA) & ((nxt & SPACE) == 0)
    blank = codes == 32
    three = blank.copy()
    three[2:] &= blank[1:-1] & blank[:-2]
    three[:2] = False
    three &= (nxt & SPACE) == 0
    lt = np.zeros(len(codes), bool)
    lt[:-2] = (codes[:-2] == ord("<")) & ((codes[1:-1] | 32) == ord("t")) & (((codes[2:] | 32) == ord("d")) | ((codes[2:] | 32) == ord("h")))
    cells = np.bincount(np.searchsorted(x.line_start, np.flatnonzero(has(BAR) | bare | three | lt), "right") - 1, minlength=len(size))
    celled = real & (cells >= 2) & (line_words <= 4 * (cells + 1))
    # a name, a mark and a value on a short line
    mark = _after(np.flatnonzero(~(has(LETTER | MARK) | blank)), head, len(codes) - 1)
    sign = padded[mark]
    dots = (sign == ord(".")) & (padded[mark + 1] == ord(".")) & (padded[mark + 2] == ord("."))
    paired = real & (mark > head) & (mark - head <= 22) & (mark < x.line_end) & ((sign == ord(":")) | (sign == ord("=")) | dots) & (x.line_end - x.line_start < 60) & ~ended

    # several short entries on a line, with marks between them
    prev = np.concatenate([[SPACE], cls[:-1]])
    free = has(FREE) & ((prev & SPACE) != 0) & ((nxt & SPACE) != 0)
    free[head] = False
    tailed = has(COMMA) & ((nxt & SPACE) != 0)
    hashed = (codes == ord("#")) & ((prev & SPACE) != 0)
    between = np.bincount(np.searchsorted(x.line_start, np.flatnonzero(free | tailed | hashed | has(FULL)), "right") - 1, minlength=len(size))
    strung = real & (between >= 4) & (line_words <= 3.6 * (between + 1)) & ~ended
    # short lines without an end, where a text has several
    brief = real & ~ended & (line_words <= 5) & (size <= 45)
    brief &= (np.bincount(x.line_doc, brief, n) >= 4)[x.line_doc]
    entry = bullet | paired | strung | brief

    chars = add_lines(size * real)
    out: dict[str, np.ndarray] = {"n_chars": x.n_chars, "n_lines": add_lines(real).astype(np.int64)}
    words = np.bincount(x.word_doc, minlength=n)
    wides, letters = add_lines(wide), add_lines(letters)
    doc, word, times = x.counted_words()
    total = np.bincount(doc, times, n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, times)
    out["n_words"] = total.astype(np.int64)
    out["n_distinct_words"] = np.bincount(doc, minlength=n).astype(np.int64)
    if common.size:
        i = np.minimum(np.searchsorted(common, word), common.size - 1)
        hits = np.bincount(doc, common[i] == word, n)
    else:
        hits = np.zeros(n)
    share = div(hits, out["n_distinct_words"])
    out["mean_word_length"] = div(np.bincount(x.word_doc, x.word_len, n), words)
    out["letter_ratio"], out["symbol_ratio"], out["digit_ratio"] = div(letters, chars), div(add_lines(others), chars), div(add_lines(digits), chars)
    out["ended_line_share"] = div(add_lines(ended), out["n_lines"])
    out["ended_share"] = div(add_lines(ended * size), chars)
    out["common_word_share"] = share
    out["common_word_ratio"] = np.where(np.isfinite(usual) & (usual > 0), share / np.where(usual > 0, usual, 1), np.nan)
    out["wide_share"] = div(wides, letters)
    for name, mask in (("bullet_share", bullet), ("cell_share", celled), ("pair_share", paired), ("strung_share", strung), ("brief_share", brief), ("entry_share", entry)):
        out[name] = div(add_lines(mask * size), chars)
    out["line_words"] = div(add_lines(line_words * size * real), chars)
    out["capital_share"] = div(np.bincount(x.word_doc, (cls[x.word_start] & UPPER) != 0, n), words)
    latin = add_lines(latin)
    out["vowel_share"] = np.where((latin >= 24) & (latin > 0.5 * letters), div(add_lines(vowels), latin), np.nan)
    out["short_word_share"] = div(np.bincount(x.word_doc, x.word_len <= 3, n), words)
    out["top_word_share"] = div(top, total)
    # runs of one visible character: stretches of characters equal to the one before
    same = np.flatnonzero((codes[1:] == codes[:-1]) & visible[1:])
    border = np.flatnonzero(np.diff(same, prepend=-2) > 1)
    length = np.diff(np.append(border, same.size)) + 1
    begin = same[border]
    # runs of visible characters that are not wide: between any others; a text's last character is one
    other_at = np.flatnonzero(~visible | has(WIDE))
    gaps = np.diff(other_at, prepend=-1) - 1
    for name, at, size_of, least in (("repeated_share", begin, length, 10), ("unbroken_share", other_at - gaps, gaps, 30)):
        keep = size_of >= least
        out[name] = div(np.bincount(np.searchsorted(x.doc_start, at[keep], "right") - 1, size_of[keep], n), chars)
    return out


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > start and (held + size > CHUNK or i - start >= 100_000):
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)
