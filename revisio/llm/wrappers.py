"""Main text of web pages by union-free regular expressions inferred per host.

A page's tokens form a tree of blocks. Its wrapper is an expression over the labels of the
blocks (tag and class words): siblings that repeat, alone or in groups of up to WIDTH, become
a repeated group; aligning two wrappers of a host turns what only one has into optional
groups, and texts that differ into text slots. Wrappers are merged per task, then per host
and salt, then per host, so no task gathers a host's pages.

The text of a page is what lies in blocks whose text is a slot in the wrapper (not the same,
to the last character, on all of at least COMMON pages that differ elsewhere). Where the page
has <article>, <main> or role=main, the slots in it count, or all of it if it has none; else
all slots that are mostly not links. Blocks named as menus, headers,
footers, sidebars, notices, adverts, forms or comments, by tag or by a whole class, never count,
nor inside an article by a part of a class; outside one the wrapper decides on those. An article
in a block so named by a whole class counts if the page has no other text.
Line breaks and inline tags do not end a block.

A null html is empty; a null url is a host of its own. Rows repeat as they come. Tags nested
deeper than DEPTH add their text to the block at that depth. An empty table gives no rows.
Other columns are ignored.
"""
import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import functions as F

from revisio.llm import graph

WIDTH, COMMON, DEPTH, SALTS = 4, 5, 100, 32
#: Wrappers of at most so many bytes in all are sent to every task.
SENT = 32 << 20
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg object canvas select".split())
AWAY = RAW | frozenset("head nav header footer aside form button dialog menu fieldset".split())
CLOSED_BY_BLOCK = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6"])
AWAY_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
dropdown footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion
related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo alert""".split())
#: Beside one of these, a word above tells of what an article says or shows, as in related-work or banner-image-caption.
CONTENT_WORDS = frozenset("caption captions figure image images photo picture work works result results study studies research theorem section text".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^<>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")


def _named(tag, tokens):
    """How surely class words mark a boilerplate block: 2 by a whole token (cookie-notice), 1 by a part of one (has-sidebar). Headers of an article don't, nor words of the page or article itself."""
    if tag in ("html", "body", "main", "article"):
        return 0
    fine = {"header"} if any(not {"article", "entry", "post", "story"}.isdisjoint(t) for t in tokens) else set()
    return max((0 if not AWAY_WORDS.intersection(t) - fine or not CONTENT_WORDS.isdisjoint(t) else 2 if AWAY_WORDS.issuperset(t) else 1 for t in tokens), default=0)


class Block:
    """A tag with its path of labels. mark: how surely it is boilerplate (3 by tag, 2 and 1 by class words), inside its article if it has one; main: whether it has one; around: the mark of what is around the article."""
    __slots__ = ("tag", "label", "mark", "main", "around", "kids", "parts", "links", "up")

    def __init__(self, tag, label, mark, main, around, up):
        self.tag, self.label, self.mark, self.main, self.around, self.up = tag, label, mark, main, around, up
        self.kids, self.parts, self.links = [], [], 0

    @property
    def away(self):
        """Boilerplate wherever it is: class words that are part of a token only count inside an article."""
        return max(self.mark, self.around) > 1 or self.main and self.mark > 0


def _tokens(rest):
    """Words of each class, id and role token, camel case parted."""
    return [t for m in ATTR.finditer(rest) for x in (m.group(2) or m.group(3) or m.group(4) or "").split() if (t := WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))]


def parse(page):
    """(root block, texts): texts are (block, words) runs in page order."""
    root = Block("", "", 0, False, 0, None)
    open_, texts, buf, at, links, inline = [root], [], [], 0, 0, []
    n, size = 0, len(page)

    def flush():
        t = " ".join(entities.unescape("".join(buf)).split())
        buf.clear()
        if t:
            texts.append((open_[-1], t))
            open_[-1].parts.append(t)

    while at < size:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text:
            buf.append(text)
            if links:
                open_[-1].links += len(text)
        if not m:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "a":
                links = 0
            if tag in INLINE and not (inline and any(b.tag == tag for b in inline)):
                continue
            where = next((k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == tag), 0)
            if where:
                flush()
                del open_[where:]
                inline = [b for b in inline if b in open_]
            elif tag not in INLINE:
                flush()
            continue
        rest = m.group(3) or ""
        if tag in RAW:
            flush()
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        tokens = _tokens(rest) if "=" in rest else []
        words = {w for t in tokens for w in t}
        mark = 3 if tag in AWAY and not (tag == "header" and open_[-1].main) else _named(tag, tokens)
        if tag in INLINE and (not mark or tag in VOID):
            links = int(tag == "a") or links
            if tag == "br":
                buf.append(" ")
            continue
        flush()
        links = 0
        if tag not in INLINE:
            same = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
            stop = same.get(tag, ())
            for k in range(len(open_) - 1, 0, -1):
                t = open_[k].tag
                if t in stop or not stop and t not in CLOSED_BY_BLOCK and t not in INLINE:
                    break
                if t == tag and stop or t in CLOSED_BY_BLOCK or {t, tag} == {"dt", "dd"} or {t, tag} == {"td", "th"}:
                    del open_[k:]
                    break
            inline = [b for b in inline if b in open_]
        if tag in VOID:
            continue
        up = open_[-1]
        main = up.main or tag in ("article", "main") or "role" in rest and "main" in words
        label = tag + "".join("." + w for w in sorted(words))
        outer = main and not up.main
        b = Block(tag, label, mark if outer else max(up.mark, mark), main, up.mark if outer else up.around, up)
        if len(open_) >= DEPTH:
            b.up = open_[DEPTH - 1]
        else:
            b.up.kids.append(b)
        open_.append(b)
        if tag in INLINE:
            inline.append(b)
        n += 1
    flush()
    return root, texts


def wrapper(block, page=()):
    """[label, optional, repeated, pages, text, chars, link chars, children]: pages are signatures, COMMON at most; text is None, a constant's digest or true for a slot."""
    t = " ".join(block.parts)
    return [block.label, False, False, list(page), hash_of(t) if t else None, len(t), min(block.links, len(t)), fold([wrapper(k, page) for k in block.kids])]


def hash_of(t):
    return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def signature(texts):
    """Pages that say the same outside boilerplate have one signature, so copies count as one page."""
    return [hash_of("\n".join(t for b, t in texts if not b.away))]


def either(a, b):
    """Signatures of two sets of pages, as many as matter."""
    return sorted({*a, *b})[:COMMON]


def join(a, b):
    """Two blocks of one label as one."""
    text = a[4] if b[4] is None else b[4] if a[4] is None else a[4] if a[4] == b[4] else True
    return [a[0], a[1] or b[1], a[2] or b[2], either(a[3], b[3]), text, a[5] + b[5], a[6] + b[6], align(a[7], b[7])]


def fold(kids):
    """Siblings with repeated runs of 1 to WIDTH labels taken together."""
    for width in range(1, WIDTH + 1):
        out = []
        for k in kids:
            out.append(k)
            while len(out) >= 2 * width and [x[0] for x in out[-width:]] == [x[0] for x in out[-2 * width:-width]]:
                last = out[-width:]
                del out[-width:]
                for i, x in enumerate(last, len(out) - width):
                    out[i] = join(out[i], x)
                    out[i][2] = True
        kids = out
    return kids


def align(a, b):
    """Two sequences of siblings: matched by label in order; what one lacks is optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [join(x, y) for x, y in zip(a, b)]
    out, i = [], 0
    for y in b:
        j = next((j for j in range(i, len(a)) if a[j][0] == y[0]), None)
        if j is None:
            out.append([y[0], True, *y[2:]])
        else:
            out += [[x[0], True, *x[2:]] for x in a[i:j]]
            out.append(join(a[j], y))
            i = j + 1
    return fold(out + [[x[0], True, *x[2:]] for x in a[i:]])


def merge(a, b):
    return join(a, b)


def fixed(w):
    """Paths of labels that are not content slots of a wrapper: constants of the host; links."""
    found, todo = {}, [((), w)]
    while todo:
        path, x = todo.pop()
        path = (*path, x[0])
        was = found.get(path, (None, 0, 0, ()))
        text = x[4] if was[0] in (None, x[4]) else True
        found[path] = (text, was[1] + x[5], was[2] + x[6], either(was[3], x[3]))
        todo += [(path, k) for k in x[7]]
    return {p for p, (text, _, _, pages) in found.items() if len(pages) >= COMMON and text not in (None, True)}, {p for p, (_, n, links, _) in found.items() if 2 * links > n}


def path(block):
    out = []
    while block is not None:
        out.append(block.label)
        block = block.up
    return tuple(reversed(out))


def extract(page, constants, links):
    """The main text of a page, given the paths its host's wrapper rules out. Articles under a marked block count if there is nothing better."""
    def slots(around):
        main = [(b, t) for b, t in texts if b.main and not b.mark and b.around == around]
        kept = [t for b, t in main if path(b) not in constants] if constants else []
        return kept or [t for _, t in main]

    _, texts = parse(page)
    kept = slots(0) or slots(1) or [t for b, t in texts if not b.away and path(b) not in constants and path(b) not in links] or slots(2)
    return "\n".join(kept)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def _infer(batches):
    found = {}
    for b in batches:
        for host, page in zip(b["host"].to_pylist(), b["html"].to_pylist()):
            root, texts = parse(page)
            w = wrapper(root, signature(texts))
            found[host] = merge(found[host], w) if host in found else w
            if len(found) >= 5000:
                yield _told(found)
                found = {}
    yield _told(found)


def _told(found):
    rows = [(h, json.dumps(w, ensure_ascii=False)) for h, w in found.items()]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["host", "wrapper"])


def _merged(batches):
    """Rows sorted by host, merged as they pass."""
    host, w = None, None
    for b in batches:
        done = {}
        for h, x in zip(b["host"].to_pylist(), b["wrapper"].to_pylist()):
            x = json.loads(x)
            if h == host:
                w = merge(w, x)
            else:
                if w is not None:
                    done[host] = w
                host, w = h, x
        yield _told(done)
    if w is not None:
        yield _told({host: w})


def _extracted(batches):
    memo = {}
    for b in batches:
        out = []
        for w, page in zip(b["wrapper"].to_pylist(), b["html"].to_pylist()):
            if w not in memo:
                if len(memo) > 1000:
                    memo.clear()
                memo[w] = fixed(json.loads(w))
            out.append(extract(page, *memo[w]))
        n = pa.array(map(len, out), pa.int64())
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(out, pa.string()), n], names=["page_id", "url", "text", "n_chars"])


def wrappers(pages):
    """host, wrapper of rows with host and html."""
    w = pages.select("host", "html").mapInArrow(_infer, "host string, wrapper string")
    w = w.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    for keys in (["host", "salt"], ["host"]):
        cols = [*keys, *(["wrapper"])]
        w = w.select(cols).repartition(*keys).sortWithinPartitions(*cols).select("host", "wrapper").mapInArrow(_merged, "host string, wrapper string")
        w = w.withColumn("salt", F.lit(0))
    return w.select("host", "wrapper")


def main_text(pages):
    """page_id, url, text, n_chars of each row."""
    spark = pages.sparkSession
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))
    w = graph.cut(wrappers(p), spark)
    if (w.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= SENT:
        p = p.join(F.broadcast(w), "host")
    else:
        w = w.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(w, ["host", "salt"])
    return p.select("page_id", "url", "html", "wrapper").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
