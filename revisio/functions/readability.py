"""Readability measures of a text column, from built-in functions.

Words are runs of letters, digits and apostrophes; letters are letters and digits; sentences end at runs of '.', '!' and
'?' before white space or the end, one at least. A word has as many syllables as it has groups of a, e, i, o, u and y,
less one for a final e after another consonant than l, one at least; from three on it is polysyllabic. The formulas are
the published ones (Kincaid 1975, Smith and Senter 1967, Coleman and Liau 1975, Gunning 1952, Dale and Chall 1948).
Dale-Chall needs the list of familiar words; without one the score is null. Reading takes 14.69 ms a character that is
not white space. All measures are null for null and blank texts and for texts without words."""
from pyspark.sql import functions as F

FLOATS = ("flesch_kincaid_grade", "automated_readability_index", "coleman_liau_index", "gunning_fog", "dale_chall_readability_score", "estimated_reading_time_seconds")
COUNTS = ("sentence_count", "word_count", "syllable_count", "letter_count", "polysyllable_count")
MEASURES = FLOATS + COUNTS
GRADES = FLOATS[:4]
WORD, STOP, VOWELS, SILENT = r"[\p{L}\p{N}']+", r"[.!?]+(\s|$)", "[aeiouy]+", "[^aeiouyl]e$"


def measures(text, familiar=None):
    """A struct of the eleven measures. familiar: an array column of lower-case words."""
    # a lambda's argument is computed once, however often it is named
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def counted(low, syllables):
        return F.struct(F.greatest(F.lit(1), F.regexp_count(text, F.lit(STOP))).cast("long").alias("s"), F.size(low).cast("long").alias("w"), F.aggregate(syllables, F.lit(0), lambda a, x: a + x).cast("long").alias("y"),
                        F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")).cast("long").alias("l"), F.size(F.filter(syllables, lambda x: x >= 3)).cast("long").alias("p"), F.char_length(F.regexp_replace(text, r"(?U)\s+", "")).alias("c"))

    def scored(x, low):
        sentences, w, y, letters, p, c = (x[k].cast("double") for k in "swylpc")
        hard = F.lit(None).cast("double") if familiar is None else 100 * F.size(F.filter(low, lambda t: ~F.array_contains(familiar, t) & ~t.rlike("^[0-9]+$"))) / w
        dale = 0.1579 * hard + 0.0496 * w / sentences + F.when(hard > 5, 3.6365).otherwise(0.0)
        return F.struct((0.39 * w / sentences + 11.8 * y / w - 15.59).alias(FLOATS[0]), (4.71 * letters / w + 0.5 * w / sentences - 21.43).alias(FLOATS[1]),
                        (0.0588 * (100 * letters / w) - 0.296 * (100 * sentences / w) - 15.8).alias(FLOATS[2]), (0.4 * (w / sentences + 100 * p / w)).alias(FLOATS[3]), dale.alias(FLOATS[4]),
                        (c * 14.69 / 1000).alias(FLOATS[5]), x["s"].alias(COUNTS[0]), x["w"].alias(COUNTS[1]), x["y"].alias(COUNTS[2]), x["l"].alias(COUNTS[3]), x["p"].alias(COUNTS[4]))

    def measured(low):
        syllables = F.transform(low, lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit(VOWELS)) - w.rlike(SILENT).cast("int")))
        return F.when(F.size(low) > 0, once(syllables, lambda y: once(counted(low, y), lambda x: scored(x, low))))

    return once(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), measured)


def sql(text):
    """The measures as DuckDB SQL items, without Dale-Chall."""
    low = f"regexp_extract_all(lower({text}), '{WORD.replace(chr(39), chr(39) * 2)}')"
    y = f"list_transform({low}, lambda w: greatest(1, len(regexp_extract_all(w, '{VOWELS}')) - CASE WHEN regexp_matches(w, '{SILENT}') THEN 1 ELSE 0 END))"
    return (f"greatest(1, len(regexp_extract_all({text}, '{STOP}'))) AS s, len({low}) AS w, coalesce(CAST(list_sum({y}) AS BIGINT), 0) AS y, len(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]')) AS l, "
            f"len(list_filter({y}, lambda n: n >= 3)) AS p, length(regexp_replace({text}, '\\s+', '', 'g')) AS c")


FORMULAS = ("0.39E0 * w / s + 11.8E0 * y / w - 15.59E0", "4.71E0 * l / w + 0.5E0 * w / s - 21.43E0", "0.0588E0 * (1E2 * l / w) - 0.296E0 * (1E2 * s / w) - 15.8E0", "0.4E0 * (w / s + 1E2 * p / w)", "CAST(NULL AS DOUBLE)", "c * 14.69E0 / 1000", "s", "w", "y", "l", "p")
