"""Relational steps as SQL texts that run on more than one engine.

@us(a, b): microseconds from a to b. @hours(t, n), @secs(t, n): a later time. @blank(x): nothing but white space.
@fold(x): x without case by full folding; DuckDB folds what the test tables hold. @key(x): x trimmed and folded, null if
blank. @order(t, id): a key by t, nulls last, then id. @first(x, k), @last(x, k): x, null or not, of the row with the smallest and the largest k. @list(a, b): an array. @each(l): a row an element. {name} stands for a frame."""
import re

from revisio.shared import written

#: The inner replacements keep the optimizer from taking lower(upper(x)) for lower(x), and the dotless i from becoming i.
SPARK = {"us": "timestampdiff(MICROSECOND, {0}, {1})", "hours": "timestampadd(HOUR, CAST({1} AS INT), {0})", "secs": "timestampadd(SECOND, CAST({1} AS INT), {0})",
         "list": "array({all})", "each": "explode({0})", "blank": "({0} RLIKE r'(?U)^\\s*$')", "key": "nullif(@fold(regexp_replace({0}, r'(?U)^\\s+|\\s+$', '')), '')",
         "fold": "replace(replace(lower(replace(upper(replace(lower({0}), '\u0131', '\ue000')), '\ue001', '')), '\u03c2', '\u03c3'), '\ue000', '\u0131')", "order": "struct({0} IS NULL, {0}, {1})", "first": "min_by({0}, {1})", "last": "max_by({0}, {1})"}
DUCK = {"us": "(epoch_us({1}) - epoch_us({0}))", "hours": "({0} + to_hours(CAST({1} AS INTEGER)))", "secs": "({0} + to_seconds(CAST({1} AS INTEGER)))",
        "list": "[{all}]", "each": "unnest({0})", "blank": "regexp_full_match({0}, '\\s*')", "key": "nullif(@fold(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')), '')",
        "fold": "replace(replace(lower({0}), '\u00df', 'ss'), '\u03c2', '\u03c3')", "order": "({0} IS NULL, {0}, {1})", "first": "arg_min_null({0}, {1})", "last": "arg_max_null({0}, {1})"}


def _arguments(text, at):
    """Arguments of the call whose bracket opens at `at`, and where it ends."""
    depth, start, out = 0, at + 1, []
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return [*out, text[start:i].strip()], i + 1
        if depth == 1 and text[i] == ",":
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError("unbalanced brackets")


def spelled(text, words):
    while m := re.search(r"@(\w+)\(", text):
        args, end = _arguments(text, m.end() - 1)
        text = text[:m.start()] + words[m[1]].format(*args, all=", ".join(args)) + text[end:]
    return text


def _steps(text):
    """(name, text) of each WITH item and (None, text) of what follows; items are given as {name}."""
    steps, text = [], text.strip()
    if text.startswith("WITH "):
        at = 5
        while m := re.compile(r"\s*(\w+) AS \(").match(text, at):
            depth, i = 1, m.end()
            while depth:
                depth += (text[i] == "(") - (text[i] == ")")
                i += 1
            steps.append((m[1], text[m.end():i - 1]))
            at = i
            if text[at:at + 1] != ",":
                break
            at += 1
        text = text[at:]
    steps.append((None, text))
    names = [n for n, _ in steps if n]
    uses = re.compile(rf"\b(FROM|JOIN) ({'|'.join(names)})\b(?:( AS)? (?!(?:ON|WHERE|GROUP|LEFT|JOIN|CROSS|ORDER|UNION)\b)(\w+))?") if names else None
    return [(n, uses.sub(lambda m: f"{m[1]} {{{m[2]}}} AS {m[4] or m[2]}", t) if uses else t) for n, t in steps]


def frame(text, kept=(), **frames):
    """The result on Spark over the given frames. Each WITH item is analysed by itself, so a table may be used in several; those in `kept`, which grow and are read by several, are written once."""
    spark = next(iter(frames.values())).sparkSession
    for name, step in _steps(text):
        used = {n: f for n, f in frames.items() if "{" + n + "}" in step}
        out = spark.sql(spelled(step, SPARK), **used)
        if name:
            frames = frames | {name: written(out).hint("merge") if name in kept else out}
    return out


def duck(text, **names):
    return spelled(text, DUCK).format(**{n: v for n, v in names.items()})
