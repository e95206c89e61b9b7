"""Post-edit metrics of a selected text against the final one.

TER follows Snover et al. (2006) on lower-case words between white space: while a shift of a block lowers the edit
distance, the best one is taken and costs 1. A block of at most BLOCK words moves at most FAR places, holds a word that
is not matched where it stands, and goes next to the words it matches, which are not all matched yet. After CANDIDATES
trials no further shift is looked for. Character and word metrics keep case and use the composed Unicode form."""
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, FAR, CANDIDATES = 10, 50, 1000


#: ASCII characters that are punctuation or symbols.
_MARKS = str.maketrans({c: " " for c in map(chr, range(128)) if unicodedata.category(c)[0] in "PS"})


def plain(text):
    """Compatibility form without case, accents, punctuation, symbols and repeated white space."""
    if text.isascii():
        return " ".join(text.lower().translate(_MARKS).split())
    t = unicodedata.normalize("NFKD", text).casefold()
    kinds = ((c, unicodedata.category(c)) for c in t)
    return " ".join("".join(" " if k[0] in "PS" else c for c, k in kinds if not unicodedata.combining(c)).split())


def composed(text, case_sensitive=True):
    t = unicodedata.normalize("NFC", text)
    return t if case_sensitive else t.casefold()


def grid(a, b):
    """Edit distances of all prefixes of two arrays of word numbers: what Bits holds as bits, in plain form."""
    d = np.empty((len(a) + 1, len(b) + 1), np.int32)
    far = np.arange(len(b) + 1, dtype=np.int32)
    d[0] = far
    for i, x in enumerate(a, 1):
        best = np.concatenate([[i], np.minimum(d[i - 1, 1:] + 1, d[i - 1, :-1] + (b != x))])
        d[i] = np.minimum.accumulate(best - far) + far
    return d


def aligned(states, a, b):
    """(unmatched words of a, unmatched words of b, place in a next to each word of b) of a best alignment.

    states: the columns of the distance matrix that Bits(b) gives for a."""
    i, j = len(a), len(b)
    wrong_a, wrong_b, at = [True] * i, [True] * j, [0] * j
    here = states[i][2]
    while i or j:
        if i:
            # distance of the first i - 1 words of a and the first j of b
            up, down, _ = states[i - 1]
            first = (1 << j) - 1
            above = i - 1 + (up & first).bit_count() - (down & first).bit_count()
        if i and j:
            corner = above - ((up >> j - 1) & 1) + ((down >> j - 1) & 1)
            if here == corner + (a[i - 1] != b[j - 1]):
                i, j, here = i - 1, j - 1, corner
                at[j] = i
                wrong_a[i] = wrong_b[j] = a[i] != b[j]
                continue
        if i and here == above + 1:
            i, here = i - 1, above
        else:
            j, here = j - 1, here - 1
            at[j] = i - 1
    return wrong_a, wrong_b, at


def shifted(a, b, states):
    """Every a with one block moved, with the block's length and place."""
    wrong_a, wrong_b, at = aligned(states, a, b)
    where = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            if abs(i - j) > FAR:
                continue
            for n in range(1, min(BLOCK, len(a) - i, len(b) - j) + 1):
                if a[i + n - 1] != b[j + n - 1]:
                    break
                if i <= at[j] < i + n or True not in wrong_a[i:i + n] or True not in wrong_b[j:j + n]:
                    continue
                last = None
                for k in range(-1, n):
                    to = 0 if j + k < 0 else at[j + k] + 1
                    if to != last and not i <= to <= i + n:
                        rest, block = a[:i] + a[i + n:], a[i:i + n]
                        cut = to - n if to > i else to
                        yield rest[:cut] + block + rest[cut:], n, i, to
                    last = to


class Bits:
    """Edit distances to one sequence b, a word of the other at a time: columns of the distance matrix as bits of differences (Myers 1999, Hyyro 2003)."""

    def __init__(self, b):
        self.size, self.at = len(b), {}
        for j, x in enumerate(b):
            self.at[x] = self.at.get(x, 0) | 1 << j
        self.all, self.last = (1 << self.size) - 1, 1 << max(0, self.size - 1)

    def states(self, a):
        """The column before each word of a, and after the last one: (rises, falls, distance)."""
        s = (self.all, 0, self.size)
        out = [s]
        for x in a:
            s = self.step(s, x)
            out.append(s)
        return out

    def step(self, state, x):
        up, down, far = state
        if not self.size:
            return up, down, far + 1
        hit = self.at.get(x, 0)
        diagonal = ((((hit & up) + up) ^ up) | hit | down) & self.all
        rise, fall = down | (self.all & ~(diagonal | up)), up & diagonal
        far += (rise & self.last > 0) - (fall & self.last > 0)
        rise, fall = (rise << 1 | 1) & self.all, fall << 1 & self.all
        return fall | (self.all & ~(diagonal | rise)), rise & diagonal, far

    def distance(self, states, keep, rest):
        """The distance of a sequence whose first `keep` words are those of `states`."""
        s = states[keep]
        for x in rest:
            s = self.step(s, x)
        return s[2]


def ter_edits(suggested, final):
    """Shifts and word edits from suggested to final."""
    numbers = {}
    a, b = ([numbers.setdefault(w, len(numbers)) for w in t.lower().split()] for t in (suggested, final))
    if a == b:
        return 0
    bits, shifts, tried = Bits(b), 0, 0
    states = bits.states(a)
    while states[-1][2] > 0 and tried < CANDIDATES:
        best, now = None, states[-1][2]
        for x, n, i, to in shifted(a, b, states):
            tried += 1
            # a shift of n words takes back 2n edits at most
            if best is None or 2 * n >= best[0][0]:
                keep = min(i, to)
                rank = (now - bits.distance(states, keep, x[keep:]), n, -i, -to)
                if best is None or rank > best[0]:
                    best = rank, x
            if tried >= CANDIDATES:
                break
        if best is None or best[0][0] <= 0:
            break
        a = best[1]
        states = bits.states(a)
        shifts += 1
    return shifts + states[-1][2]


def characters(a, b):
    """Code points inserted, deleted or replaced."""
    return Bits(b).states(a)[-1][2]


def soft_distance(a, b, insertion=1.0, deletion=1.0, case_sensitive=True):
    """Word edit distance where a replacement costs the words' character distance over the longer one's length."""
    a, b = (composed(t, case_sensitive).split() for t in (a, b))
    if a == b:
        return 0.0
    cost = {x: [word_cost(x, y) if len(x) + len(y) < 200 else word_cost.__wrapped__(x, y) for y in b] for x in set(a)}
    steps = [insertion * j for j in range(len(b) + 1)]
    row = steps
    for i, x in enumerate(a, 1):
        # the least so far, less the insertions up to there
        least = deletion * i
        new = [least]
        for before, above, c, step in zip(row, row[1:], cost[x], steps[1:]):
            before += c
            above += deletion
            here = (before if before < above else above) - step
            if here < least:
                least = here
            new.append(least + step)
        row = new
    return float(row[-1])


@lru_cache(100_000)
def word_cost(x, y):
    """Character distance of two words over the longer one's length; a task's words come back, so the last ones are kept."""
    return 0.0 if x == y else characters(x, y) / max(len(x), len(y))


def _each(kind, work):
    """A UDF of two texts, null where either is or the second has no words."""
    @F.pandas_udf(kind)
    def run(selected: pd.Series, final: pd.Series) -> pd.Series:
        return pd.Series([work(composed(s), composed(f)) if isinstance(s, str) and isinstance(f, str) and f.split() else None for s, f in zip(selected, final)], dtype=object)
    return run


_ter, _soft, _same = _each(T.LongType(), ter_edits), _each(T.DoubleType(), soft_distance), _each(T.BooleanType(), lambda s, f: plain(s) == plain(f))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(composed, na_action="ignore")


def words(x):
    """Words between white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def ascii_(x):
    """Whether a text is plain ASCII: as many bytes as characters."""
    return F.octet_length(x) == F.char_length(x)


def same_plain(x, y):
    """Whether ASCII texts are equal in `plain` form; null where the second has no words."""
    form = lambda t: F.trim(F.regexp_replace(F.lower(t), r"[\p{Punct}\t-\r\x1c-\x20]+", " "))
    return F.when(y.rlike(r"[^\t-\r\x1c-\x20]"), (x == y) | (form(x) == form(y)))


def distance(a, b):
    """Code points inserted, deleted or replaced: those that one text has more where it contains the other, which needs no look at each pair of them."""
    n, m = F.char_length(a), F.char_length(b)
    return F.when(F.contains(b, a), m - n).when(F.contains(a, b), n - m).otherwise(F.levenshtein(a, b)).cast("long")


def clamp01(x):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


METRICS = ("ter_rate", "ter_effort_saved_raw", "ter_effort_saved", "character_edit_distance", "character_effort_saved_raw", "character_effort_saved", "soft_word_edit_distance", "soft_word_effort_saved_raw",
           "soft_word_effort_saved", "estimated_characters_saved", "suggestion_character_count", "final_character_count", "suggestion_word_count", "final_word_count")


def analyzed(df, selected="selected_text", final="final_text"):
    """df with the metrics of two of its columns, and `cosmetic`: whether they are equal but for case, accents, punctuation and white space. Null where either is null or the final has no words."""
    x, y = F.col(selected), F.col(final)
    has = x.isNotNull() & y.rlike(r"(?U)\S")
    # plain ASCII is composed as it is and compared without Python; every metric has a UDF of its own, so that those not asked for are not run
    form = lambda t: F.when(ascii_(t), t).otherwise(_composed(F.when(~ascii_(t), t)))
    both = ascii_(x) & ascii_(y)
    same = F.when(both, same_plain(x, y)).otherwise(_same(F.when(~both, x), F.when(~both, y)))
    d = df.withColumns({"__a": F.when(has, form(x)), "__b": F.when(has, form(y)), "__ter": _ter(x, y), "__soft": _soft(x, y), "__same": same})
    a, b = F.col("__a"), F.col("__b")
    # columns of their own, so that what several metrics need is computed once
    d = d.withColumns({"__far": distance(a, b), "__n": F.size(words(b))})
    n, size, far = F.col("__n").cast("double"), F.char_length(b), F.col("__far")
    rate, soft = F.col("__ter") / n, F.col("__soft")
    known = b.isNotNull()
    cols = {"ter_rate": rate, "ter_effort_saved_raw": 1 - rate, "ter_effort_saved": clamp01(1 - rate), "character_edit_distance": far, "character_effort_saved_raw": 1 - far / size, "character_effort_saved": clamp01(1 - far / size),
            "soft_word_edit_distance": soft, "soft_word_effort_saved_raw": 1 - soft / n, "soft_word_effort_saved": clamp01(1 - soft / n), "estimated_characters_saved": F.greatest(F.lit(0), size - far).cast("long"),
            "suggestion_character_count": F.char_length(a).cast("long"), "final_character_count": size.cast("long"), "suggestion_word_count": F.size(words(a)).cast("long"), "final_word_count": F.col("__n").cast("long")}
    return d.select(*[c for c in df.columns], *[F.when(known, e).alias(c) for c, e in cols.items()], F.col("__same").alias("cosmetic"))
