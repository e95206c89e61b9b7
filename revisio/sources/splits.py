"""Exact CSV records of files that Spark splits, also within quoted fields.

Spark's text source reads each split from its first line end on, so a split begins in one of three
states: at a record's start, in a quoted field, or in a field after an escaped line end. A first
pass parses every split from each state it may begin in and tells, for each, the state it ends
in, how many records begin, and how many lines at its two ends belong to records that it shares
with its neighbours; wrong guesses mostly die of a misplaced quote. The states of a file's splits
follow from one another, and so do the numbers of their first records. The second pass parses
the lines between. The shared lines go to one group a record and are parsed there.

What the driver holds is some numbers a split. A split that may begin in several states is held
as bytes (spark.sql.files.maxPartitionBytes); a file that cannot be split has one state and streams.
Both passes must see the same splits: if the session's parallelism changes in between, the
second fails. A quoted field that its file does not close fails in every dialect."""
import codecs
import csv
import io
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from revisio.sources import schema as schemas
from revisio.sources.convert import FILE, RECORD

HIDDEN = (FILE, RECORD)
#: States a split begins in.
RECORD_START, QUOTED, FIELD = range(3)
_STATES = "state int, after int, begun long, head long, tail long, error string"
_FOUND = f"key long, file string, start long, lines long, at array<int>, {_STATES}"
_BATCH = 5000


def splits(encoding):
    """Whether lines of this encoding can be found by their bytes."""
    name = codecs.lookup(encoding).name
    return not name.startswith(("utf-16", "utf-32", "utf-7", "iso2022", "hz")) and "\n,\"".encode(name if name != "utf-8-sig" else "utf-8") == b"\n,\""


class Feed:
    """Lines for a parser, counted; `over` says that it asked for more than there are."""

    def __init__(self, lines):
        self.lines, self.n, self.over = iter(lines), 0, False

    def __iter__(self):
        return self

    def __next__(self):
        try:
            line = next(self.lines)
        except StopIteration:
            self.over = True
            raise
        self.n += 1
        return line


class Job:
    def __init__(self, names, options, encoding, nulls):
        self.names, self.options, self.encoding, self.nulls = names, options, encoding, nulls
        self.schema = ", ".join([*(f"`{n}` string" for n in names), f"{FILE} string", f"{RECORD} long"])

    # --- lines ---

    def lines(self, raw, first):
        """Decoded lines with their ends, as io splits them; `raw` has no line feeds."""
        for i, b in enumerate(raw):
            t = b.decode(self.encoding if first and i == 0 else self.plain) + "\n"
            if "\r" in t[:-2]:
                yield from io.StringIO(t, newline="")
            else:
                yield t

    @property
    def plain(self):
        return "utf-8" if codecs.lookup(self.encoding).name == "utf-8-sig" else self.encoding

    def parser(self, lines):
        csv.field_size_limit(2**31 - 1)
        return csv.reader(lines, **self.options)

    def columns(self, header):
        """Where the schema's columns are."""
        schemas.same_names(header, [(n, None, None) for n in self.names])
        return [header.index(n) for n in self.names]

    # --- first pass ---

    def walked(self, lines, state):
        """What a split is from a state on: (state after it, records begun, lines of the head, lines of the tail, error, first record)."""
        lines = iter(lines)
        if state != RECORD_START:
            start = next(lines, None)
            lines = itertools.chain([] if start is None else [(self.options["quotechar"] if state == QUOTED else "x") + start], lines)
        feed, last = Feed(lines), []
        rows, whole, head, first = self.parser(feed), 0, 0, None
        try:
            while True:
                before = feed.n
                r = next(rows, None)
                if feed.over:
                    break
                if first is None:
                    first, head = r, feed.n if state != RECORD_START else 0
                whole += 1
        except csv.Error as e:
            if not feed.over:
                return None, whole - (state != RECORD_START), 0, 0, str(e), None
        tail = feed.n - before
        inner = whole - (state != RECORD_START and whole > 0)
        if not tail:
            return RECORD_START, inner, head, 0, None, first
        if not whole and state != RECORD_START:  # the record goes on through the whole split
            return -1, 0, feed.n, 0, None, None
        return -1, inner + 1, head, tail, None, first

    def after(self, lines, state, tail):
        """The state after a split that ends within a record: where a quote would close a field, it was quoted."""
        if self.options["escapechar"] is None:
            return QUOTED
        mark = self.options["quotechar"]
        start = {RECORD_START: "", QUOTED: mark, FIELD: "x"}[state]
        own = lines[len(lines) - tail:] if tail else [start + lines[0], *lines[1:]]
        for r in self.parser([*own, mark + "\n"]):
            return FIELD if r and r[-1].endswith(mark) else QUOTED

    def scan(self, batches):
        """One row a split and state it may begin in."""
        for key, start, file, raw in by_split(batches):
            found = []
            if start == 0 and self.options["escapechar"] is None:
                feed = Feed(self.lines(raw, True))
                found.append((RECORD_START, self.walked(feed, RECORD_START)))
                n = feed.n
            else:
                lines = list(self.lines(list(raw), start == 0))
                n = len(lines)
                states = (RECORD_START,) if start == 0 else (RECORD_START, QUOTED) if self.options["escapechar"] is None else (RECORD_START, QUOTED, FIELD)
                for s in states:
                    w = self.walked(lines, s)
                    found.append((s, (self.after(lines, s, w[3]), *w[1:]) if w[0] == -1 else w))
            at = None
            if start == 0:
                head = found[0][1]
                if head[4]:
                    raise ValueError(f"{file}: record {head[1]}: {head[4]}")
                if head[5] is None:
                    raise ValueError(f"{file}: no header, or one that is longer than a split")
                try:
                    at = self.columns(head[5])
                except ValueError as e:
                    raise ValueError(f"{file}: {e}") from None
            rows = [{"key": key, "file": file, "start": start, "lines": n, "at": at, "state": s, "after": QUOTED if after == -1 else after, "begun": begun, "head": h, "tail": t, "error": e} for s, (after, begun, h, t, e, _) in found]
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def planned(self, rows):
        """{split: (file, number of its first record, head, end of its own lines, columns, records of head and tail)} from what the first pass found."""
        files, plan = defaultdict(dict), {}
        for r in rows:
            files[r["file"]].setdefault(r["start"], {})[r["state"]] = r
        for file, found in files.items():
            state, number, at = RECORD_START, 0, None
            for start in sorted(found):
                r = found[start][state]
                at = at or r["at"]
                if r["error"]:
                    raise ValueError(f"{file}: record {number + r['begun']}: {r['error']}")
                begun = r["begun"]
                plan[r["key"]] = (file, number, r["head"], r["lines"] - r["tail"], at, number - 1 if r["head"] else None, number + begun - 1 if r["tail"] else None)
                number, state = number + begun, r["after"]
            if state != RECORD_START:
                raise ValueError(f"{file}: record {number - 1}: unexpected end of data")
        return plan

    # --- second pass ---

    def rows(self, file, number, records, at, width):
        part, numbers = [], []
        for n, r in enumerate(records, number):
            if n == 0:  # the header
                continue
            if len(r) != width:
                raise ValueError(f"{file}: record {n} has {len(r)} fields, not {width}")
            part.append([None if r[i] in self.nulls else r[i] for i in at])
            numbers.append(n)
            if len(part) == _BATCH:
                yield self.batch(file, part, numbers)
                part, numbers = [], []
        if part:
            yield self.batch(file, part, numbers)

    def batch(self, file, part, numbers):
        cols = [pa.array(c, pa.string()) for c in zip(*part)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([file] * len(part), pa.string()), pa.array(numbers, pa.int64())], names=[*self.names, *HIDDEN])

    def parsed(self, plan):
        def run(batches):
            for key, start, _, raw in by_split(batches):
                file, number, head, end, at, _, _ = known(plan.value, key)
                own = itertools.islice(self.lines(raw, start == 0), head, end)
                yield from self.rows(file, number, self.parser(own), at, len(at))
        return run

    def shared(self, plan):
        """Lines of records that several splits hold."""
        def run(batches):
            for key, start, _, raw in by_split(batches):
                file, _, head, end, _, first, last = known(plan.value, key)
                if first is None and last is None:
                    continue
                lines = list(self.lines(raw, start == 0))
                out = [(first, "".join(lines[:head]))] if first is not None else []
                out += [(last, "".join(lines[end:]))] if last is not None else []
                yield pa.RecordBatch.from_pylist([{FILE: file, RECORD: r, "start": start, "text": t} for r, t in out], _SHARED)
        return run

    def joined(self, columns):
        def run(t):
            t = t.sort_by("start")
            file, number = t[FILE][0].as_py(), t[RECORD][0].as_py()
            at = columns.value[file]
            rows = self.rows(file, number, self.parser(io.StringIO("".join(t["text"].to_pylist()), newline="")), at, len(at))
            return pa.Table.from_batches(rows)
        return run

    def split(self, spark, path):
        where = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
        lines = spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("raw"), F.xxhash64(*where).alias("key"), where[1].alias("start"), where[0].alias("file"))
        found = [r.asDict() for r in lines.mapInArrow(self.scan, _FOUND).collect()]
        plan = self.planned(found)
        told = spark.sparkContext.broadcast(plan)
        lines = lines.drop("file")
        out = lines.mapInArrow(self.parsed(told), self.schema)
        some = {p[0]: p[4] for p in plan.values() if p[5] is not None or p[6] is not None}
        if not some:
            return out
        pieces = lines.mapInArrow(self.shared(told), f"{FILE} string, {RECORD} long, start long, text string")
        return out.unionAll(pieces.groupBy(*HIDDEN).applyInArrow(self.joined(spark.sparkContext.broadcast(some)), self.schema))

    def whole(self, spark, path):
        """Each file in one task, for encodings whose lines cannot be told by bytes."""
        def run(batches):
            for b in batches:
                for file, content in zip(b["path"].to_pylist(), b["content"].to_pylist()):
                    records = self.parser(io.StringIO(content.decode(self.encoding), newline=""))
                    header = next(records, None)
                    if header is None:
                        raise ValueError(f"{file}: no header")
                    at = self.columns(header)
                    yield from self.rows(file, 1, records, at, len(header))

        return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content").mapInArrow(run, self.schema)


_ARROW = pa.schema([("key", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("at", pa.list_(pa.int32())), ("state", pa.int32()), ("after", pa.int32()), ("begun", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("error", pa.string())])
_SHARED = pa.schema([(FILE, pa.string()), (RECORD, pa.int64()), ("start", pa.int64()), ("text", pa.string())])


def known(plan, key):
    if key not in plan:
        raise RuntimeError("the splits of a CSV file changed between two passes; read it again")
    return plan[key]


def by_split(batches):
    """(key, start, file or null, iterator of raw lines) of neighbouring rows of one split."""
    def pieces():
        for b in batches:
            keys = b.column("key").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j > i:
                    yield int(keys[i]), b, i, j

    for key, group in itertools.groupby(pieces(), lambda p: p[0]):
        _, b, i, j = first = next(group)
        file = b.column("file")[i].as_py() if "file" in b.schema.names else None
        raw = (line for _, b, i, j in itertools.chain([first], group) for line in b.column("raw").slice(i, j - i).to_pylist())
        yield key, b.column("start")[i].as_py(), file, raw
