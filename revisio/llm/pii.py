"""Personal data: fixed rules, and a character BiLSTM with a CRF that adds spans.

The base spans of the four kinds follow fixed patterns. Around every digit, '@', ' at ',
'(at)' and '[at]' of a text (no added span is without one, see plausible(); a span that goes
on beyond them is followed) overlapping windows of characters are scored by a
bidirectional LSTM, decoded with CRF transitions, and reconciled over the whole text: a
character's tag comes from the window in whose middle it lies nearest. Decoded spans that
touch no base span are added. The net is trained in numpy from labelled spans that a fixed
seed writes, so every run has the same weights.

A null text counts as empty and has no spans. Each row of the input gives one row, repeated
rows too; null doc_ids are kept as null. An empty table gives no rows. Other columns are
ignored.
"""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
NEAR = re.compile(r"[0-9@]| at |\(at\)|\[at\]", re.I)
WORDED = re.compile(r"[\w%+-](?: at | ?\(at\) ?| ?\[at\] ?)[\w-]+(?:\.[\w-]+)+", re.I)
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text):
    """Leftmost matches, found from each '@' so that long runs cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base(text):
    """Spans (start, kind index, end) of the fixed patterns, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = "".join(DIGITS.findall(m[0]))
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(DIGITS.findall(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the net -------------------------------------------------------------------------------

SIZE, STEP, BATCH = 48, 24, 512
TAGS = 1 + 2 * len(KINDS)
DIM, HIDDEN = 10, 16
CODES = 104


def codes(text):
    """One small code per character: ASCII as it is, all other letters one code, the rest another."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(c < 32, 2, np.where(c < 127, c - 29, np.where(c >= 192, 99, 98)))


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    def __init__(self, seed=1):
        r = np.random.default_rng(seed)
        n = lambda *s: r.normal(size=s).astype(np.float32)
        self.p = {"emb": n(CODES, DIM) * 0.3, "out": n(2 * HIDDEN, TAGS) * 0.2, "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN:2 * HIDDEN] = 1
            self.p |= {f"w{d}": n(DIM + HIDDEN, 4 * HIDDEN) * 0.2, f"b{d}": b}

    def lstm(self, x, d, tape=None):
        """x: time x rows x DIM."""
        w, b, H = self.p[f"w{d}"], self.p[f"b{d}"], HIDDEN
        h = c = np.zeros((x.shape[1], H), np.float32)
        xs, out = x @ w[:DIM] + b, np.empty((*x.shape[:2], H), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = xs[t] + h @ w[DIM:]
            g = np.tanh(z[:, 3 * H:])
            s = sigmoid(z[:, :3 * H])
            c0, h0 = c, h
            c = s[:, H:2 * H] * c + s[:, :H] * g
            tc = np.tanh(c)
            h = s[:, 2 * H:] * tc
            out[t] = h
            if tape is not None:
                tape.append((t, s, g, c0, h0, tc))
        return out

    def back(self, x, d, tape, dout, grad):
        w, H = self.p[f"w{d}"], HIDDEN
        dx, dh, dc = np.zeros_like(x), 0.0, 0.0
        for t, s, g, c0, h0, tc in reversed(tape):
            dh = dh + dout[t]
            i, f, o = s[:, :H], s[:, H:2 * H], s[:, 2 * H:]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            grad[f"w{d}"][:DIM] += x[t].T @ dz
            grad[f"w{d}"][DIM:] += h0.T @ dz
            grad[f"b{d}"] += dz.sum(0)
            dx[t], dh, dc = dz @ w[:DIM].T, dz @ w[DIM:].T, dc * f
        return dx

    def emit(self, ids, tapes=None):
        x = self.p["emb"][ids.T]
        h = np.concatenate([self.lstm(x, d, None if tapes is None else tapes[d]) for d in "fb"], axis=2)
        return x, h, h @ self.p["out"] + self.p["bias"]

    def step(self, ids, tags):
        """Loss and gradients of the CRF's negative log-likelihood."""
        tapes = {"f": [], "b": []}
        x, h, e = self.emit(ids, tapes)
        T, B, _ = e.shape
        y, tr, rows = tags.T, self.p["trans"], np.arange(B)
        a, z = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, T):
            s = a[t - 1][:, :, None] + tr
            m = s.max(1)
            a[t] = m + np.log(np.exp(s - m[:, None]).sum(1)) + e[t]
        for t in range(T - 2, -1, -1):
            s = tr + (e[t + 1] + z[t + 1])[:, None, :]
            m = s.max(2)
            z[t] = m + np.log(np.exp(s - m[:, :, None]).sum(2))
        m = a[-1].max(1)
        logz = m + np.log(np.exp(a[-1] - m[:, None]).sum(1))
        de = np.exp(a + z - logz[None, :, None])
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = logz.sum()
        for t in range(T):
            loss -= e[t][rows, y[t]].sum()
            de[t][rows, y[t]] -= 1
            if t:
                loss -= tr[y[t - 1], y[t]].sum()
                grad["trans"] += np.exp(a[t - 1][:, :, None] + tr + (e[t] + z[t])[:, None, :] - logz[:, None, None]).sum(0)
                np.add.at(grad["trans"], (y[t - 1], y[t]), -1)
        grad["out"] = np.einsum("tbh,tbk->hk", h, de)
        grad["bias"] = de.sum((0, 1))
        dh = de @ self.p["out"].T
        dx = sum(self.back(x, d, tapes[d], dh[:, :, i * HIDDEN:(i + 1) * HIDDEN], grad) for i, d in enumerate("fb"))
        np.add.at(grad["emb"], ids.T, dx)
        return loss / B, {k: v / B for k, v in grad.items()}

    def decode(self, ids):
        """Best tag sequence of each window."""
        _, _, e = self.emit(ids)
        s, from_ = e[0], []
        for t in range(1, len(e)):
            c = s[:, :, None] + self.p["trans"]
            from_.append(c.argmax(1))
            s = c.max(1) + e[t]
        tag = s.argmax(1)
        out, rows = [tag], np.arange(len(tag))
        for f in reversed(from_):
            tag = f[rows, tag]
            out.append(tag)
        return np.array(out[::-1]).T


def example(rng):
    """Text with labelled spans (start, kind, end)."""
    word = lambda: "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    text, spans = "", []
    while len(text) < 300:
        kind = rng.randrange(9)
        if kind == 0:
            s = f"{word()}{rng.choice(['', '.', '_', '+'])}{digits(rng.randint(0, 3))}{rng.choice(['@', ' at ', '(at)', '[at]'])}{word()}.{rng.choice(['com', 'org', 'net', 'example'])}"
        elif kind == 1:
            s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        elif kind == 2:
            d, sep = digits(rng.choice([15, 16])), rng.choice(["", " ", "-"])
            d += next(c for c in "0123456789" if luhn(d + c))
            s = sep.join(d[i:i + 4] for i in range(0, len(d), 4))
        elif kind == 3:
            s = f"{rng.choice(['+1 ', '+44 ', '+33 ', '00', ''])}({digits(3)}) {digits(3)}-{digits(4)}"
        elif kind == 4:
            s = rng.choice([digits(rng.randint(1, 8)), f"{digits(2)}.{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f'"{word()}{digits(9)}{word()}{digits(12)}"', f"@{word()}", f"v{digits(1)}.{digits(1)}.{digits(1)}"])
        else:
            s = " ".join(word() for _ in range(rng.randint(1, 6)))
        if kind < 4:
            spans.append((len(text), kind, len(text) + len(s)))
        text += s + rng.choice([" ", ". ", ", ", "\n"])
    return text, spans


def tagged(text, spans):
    y = np.zeros(len(text), np.int64)
    for s, k, e in spans:
        y[s], y[s + 1:e] = 1 + 2 * k, 2 + 2 * k
    return y


def train(steps=300, rows=48, seed=11):
    rng, net = random.Random(seed), Tagger()
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    for i in range(1, steps + 1):
        ids, tags = [], []
        while len(ids) < rows:
            t, s = example(rng)
            c, y = codes(t), tagged(t, s)
            for k in range(0, len(c) - SIZE, SIZE + 3):
                ids.append(c[k:k + SIZE])
                tags.append(y[k:k + SIZE])
        _, g = net.step(np.array(ids), np.array(tags))
        scale = min(1.0, 5 / (1e-9 + np.sqrt(sum(float((x * x).sum()) for x in g.values()))))
        for k in g:
            m[k] = 0.9 * m[k] + 0.1 * scale * g[k]
            v[k] = 0.99 * v[k] + 0.01 * (scale * g[k]) ** 2
            net.p[k] = net.p[k] - np.float32(0.015 * (1 - 0.8 * i / steps)) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    return net


def windows(text):
    """Numbers of the windows that decide what plausible() cannot do without, and of those beside them."""
    end, need = final(len(text)), set()
    for m in NEAR.finditer(text):
        w = min(max(0, (m.start() - STEP // 2) // STEP), end)
        need.update((w - 1, w, w + 1))
    return sorted(w for w in need if 0 <= w <= end)


def final(n):
    """Number of the last window of n characters."""
    return (max(1, n - STEP) - 1) // STEP


def learned(net, texts, first=windows):
    """Decoded spans of each text. Where tags reach the edge of what was decoded, the next window follows, so spans are as if all windows were."""
    tags, done = [{} for _ in texts], [set() for _ in texts]

    def decode(part):
        ids = np.zeros((len(part), SIZE), np.int64)
        for k, (i, w) in enumerate(part):
            c = codes(texts[i][w * STEP:w * STEP + SIZE])
            ids[k, :len(c)] = c
        for (i, w), y in zip(part, net.decode(ids)):
            s, n = w * STEP, len(texts[i])
            lo, hi = (STEP // 2 if w else 0), (SIZE - STEP // 2 if w < final(n) else n - s)
            for k in np.flatnonzero(y[lo:hi]).tolist():
                tags[i][s + lo + k] = int(y[lo + k])
            for edge, v in ((lo, w - 1), (hi - 1, w + 1)):
                if hi > lo and y[edge] and 0 <= v <= final(n) and v not in done[i]:
                    done[i].add(v)
                    yield i, v

    todo = [(i, w) for i, t in enumerate(texts) for w in first(t)]
    for i, w in todo:
        done[i].add(w)
    while todo:
        todo = [x for k in range(0, len(todo), BATCH) for x in decode(todo[k:k + BATCH])]
    out = []
    for t in tags:
        spans = []
        for p in sorted(t):
            k = (t[p] - 1) // 2
            if spans and spans[-1][2] == p and spans[-1][1] == k and t[p] == 2 + 2 * k:
                spans[-1] = (spans[-1][0], k, p + 1)
            elif t[p] == 1 + 2 * k:
                spans.append((p, k, p + 1))
        out.append(spans)
    return out


def plausible(text, span):
    """An added span needs what its kind cannot be without."""
    s, k, e = span
    t = text[s:e]
    d = "".join(DIGITS.findall(t))
    if k == 0:
        return len(t) >= 6 and ("@" in t or WORDED.search(t) is not None)
    if k == 1:
        return IP.fullmatch(t) is not None and all(int(x) <= 255 for x in t.split("."))
    if k == 2:
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 and ("+" in t or "(" in t)


def find(net, texts):
    """(base spans, added spans) of each text."""
    out = []
    for t, more in zip(texts, learned(net, texts)):
        b = base(t)
        taken = np.zeros(len(t) + 1, bool) if more else None
        for s, _, e in b if more else ():
            taken[max(0, s - 1):e + 1] = True
        out.append((b, [x for x in more if plausible(t, x) and not taken[x[0]:x[2]].any()]))
    return out


def said(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _each(docs, work, schema):
    """Runs work over batches of rows, with the trained net sent once."""
    sent = docs.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        for b in batches:
            texts = b["text"].to_pylist()
            for k in range(0, max(1, len(texts)), 256):
                part = b.slice(k, 256)
                yield work(part, texts[k:k + 256], find(sent.value, [t or "" for t in texts[k:k + 256]]))

    return docs.mapInArrow(run, schema)


def spans(docs):
    def work(b, texts, found):
        n = [[sum(s[1] == k for s in f[0]) for f in found] for k in range(4)]
        sha = [hashlib.sha256(said(f[0]).encode()).hexdigest() for f in found]
        cols = [b["doc_id"], *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()), pa.array([said(f[0] + f[1]) for f in found], pa.string()), pa.array([len(f[1]) for f in found], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return _each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, OUT)


def hidden(text, spans):
    """text with every span replaced by its kind in brackets; overlapping spans go together."""
    out, end = [], 0
    for s, k, e in sorted(spans):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k]}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def mask(docs):
    """docs with personal data in text hidden; a null text stays null."""
    def work(b, texts, found):
        new = pa.array([t if t is None else hidden(t, f[0] + f[1]) for t, f in zip(texts, found)], pa.string())
        return b.set_column(b.schema.get_field_index("text"), "text", new)

    return _each(docs, work, docs.schema)
