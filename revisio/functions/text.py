"""Post-edit text metrics as JVM-side expressions."""
from pyspark.sql import functions as F


def clamp01(x):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def tokens(x):
    """Words between white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda t: t != "")


def character_distance(a, b):
    """Code points inserted, deleted or replaced."""
    return F.levenshtein(a, b).cast("long")


def character_effort_saved(a, b):
    """1 - distance / length of b; null for an empty b."""
    return 1 - character_distance(a, b) / F.nullif(F.char_length(b), F.lit(0))


def word_distance(a, b):
    """Character distance over the longer length; 0 for two empty words."""
    return F.coalesce(F.levenshtein(a, b) / F.nullif(F.greatest(F.char_length(a), F.char_length(b)), F.lit(0)), F.lit(0.0))


def soft_word_distance(a, b):
    """Edit distance of two arrays of words, a replacement costing its word_distance. Work is the product of the two lengths."""
    def row(prev, w):
        def cell(cur, j):
            keep = F.get(prev, j - 1) + word_distance(w, F.get(b, j - 1))
            return F.concat(cur, F.array(F.least(F.get(cur, j - 1) + 1, F.get(prev, j) + 1, keep)))
        return F.aggregate(F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>")), F.array(F.get(prev, F.lit(0)) + 1), cell)
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: i.cast("double"))
    return F.element_at(F.aggregate(a, first, row), -1)


def edit_intensity(a, b):
    """LIGHT up to a distance of 0.1 of the longer text, MODERATE up to 0.3, else HEAVY."""
    r = character_distance(a, b) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return F.when(r <= 0.10, "LIGHT").when(r <= 0.30, "MODERATE").otherwise("HEAVY")
