"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of the same host."""

from __future__ import annotations

import hashlib
import html
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut_lineage

# Elements by the part they play.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "select", "textarea", "button", "title", "object", "math")
CHROME = ("nav", "aside", "footer", "form", "menu", "dialog", "head")
MAIN = ("article", "main")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
REPEATED = ("p", "li", "tr", "td", "h2", "h3", "h4", "dt", "dd", "section", "blockquote")
# Words of a class or id that mark something other than the article.
MARKS = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "notice", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "disqus", "replies", "share", "social", "related", "newsletter", "subscribe", "popup", "modal")

# A tag that isn't closed before the next one begins, outside of quotes, is text; what is begun is taken once, so that a page of
# any length and any number of open tags is read in one go.
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b" + _ATTRS + r">.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>" + _ATTRS + r")>|<[!?][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CHROME, _MAIN, _INLINE, _VOID, _MARKS, _REPEATED = map(frozenset, (CHROME, MAIN, INLINE, VOID, MARKS, REPEATED))
#: Texts that so many different pages of a host share, at the article's edge, belong to the template.
AGREE = 3
#: Parts that the pages of a host are dealt into, by a hash of the page, so that one host may hold most pages.
CHUNKS = 64
#: Pairs of items that an alignment holds at a time.
CELLS = 1 << 24
#: Bytes of wrappers that are sent to every task at most.
BROADCAST_BYTES = 64 << 20


def _marked(name: str) -> bool:
    """Whether a class or id is a mark or made of marks only: ``cookie-notice`` is, ``no-sidebar`` and ``share-2`` are not."""
    return name in _MARKS or (words := set(re.split(r"[^a-z0-9]+", name)) - {""}) != set() and words <= _MARKS


def tokens(page: str) -> list[tuple[str, str]]:
    """(symbol, text) of a page: ``<tag``, ``<tag!`` for one marked as something else, ``>tag`` at its end, ``#`` for text
    with anything but white space. Inline elements leave no symbol of their own but white space at ``br``."""
    out: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            out.append(("#", text))
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in _INLINE:
                if tag in ("br", "img"):
                    out.append(("#", " "))
            elif m["end"]:
                out.append((">" + tag, ""))
            else:
                mark = ""
                if m["attrs"].strip():
                    for name, *values in _ATTR.findall(m["attrs"]):
                        name = name.lower()
                        if name == "hidden" or name in ("class", "id", "role") and any(map(_marked, "".join(values).lower().split())):
                            mark = "!"
                out.append(("<" + tag + mark, ""))
    # Neighbouring texts make one.
    joined: list[tuple[str, str]] = []
    parts: list[str] = []
    for sym, text in [*out, ("", "")]:
        if sym == "#":
            parts.append(text)
            continue
        if parts and not (whole := "".join(parts)).isspace():
            joined.append(("#", whole))
        parts = []
        joined.append((sym, text))
    return joined[:-1]


def _ends(symbols: list[str]) -> list[int]:
    """Of each opening token the place of its end, by the nesting of its own tag."""
    out, open_ = [len(symbols)] * len(symbols), {}
    for i, s in enumerate(symbols):
        if s[0] == "<":
            open_.setdefault(s[1:].rstrip("!"), []).append(i)
        elif s[0] == ">" and open_.get(s[1:]):
            out[open_[s[1:]].pop()] = i
    return out


def zones(symbols: list[str]) -> list[bool]:
    """Which tokens belong to the article, from the elements around them: within article or main where the page has one
    (else the body), but not within an element of another part. A mark, or a form, around main or around all articles
    counts for nothing."""
    mains = [(i, s) for i, s in enumerate(symbols) if s[0] == "<" and s[1:].rstrip("!") in _MAIN]
    has_main = bool(mains)
    ends = _ends(symbols) if has_main and any(s[-1] == "!" or s == "<form" for s in symbols) else []

    def holds(i: int) -> bool:
        held = [s for j, s in mains if i < j < ends[i]]
        return len(held) == len(mains) or any(s[1:].rstrip("!") == "main" for s in held)

    out, inside, skip, depth = [], 0, "", 0
    for i, s in enumerate(symbols):
        tag = s[1:].rstrip("!")
        if skip:
            if tag == skip and s[0] in "<>":
                depth += 1 if s[0] == "<" else -1
            over = not depth or s[0] == ">" and (tag in _MAIN or tag == "body")
            out.append(False)
            if over:
                skip = ""
                inside -= tag in _MAIN and s[0] == ">" and inside > 0
            continue
        if s[0] == "<":
            if tag not in _VOID and (s[-1] == "!" and tag not in _MAIN and tag not in ("body", "html") or tag in _CHROME or tag == "header" and not inside) and not (has_main and not inside and (tag == "form" or s[-1] == "!" and tag not in _CHROME) and holds(i)):
                skip, depth = tag, 1
                out.append(False)
                continue
            inside += tag in _MAIN
            out.append(bool(inside) or not has_main)
        elif s[0] == ">":
            out.append(bool(inside) or not has_main)
            inside -= tag in _MAIN and inside > 0
        else:
            out.append(bool(inside) or not has_main)
    return out


# A wrapper is a list of items: [kind, flag, symbol or items, text, pages]; kind one of "=" (a symbol), "?" (optional),
# "+" (repeated). ``text`` is what all ``pages`` that have the item say there, as [digest, speakers]; None (a slot) if they
# say different things, "" if they say nothing. Speakers are the keys of fewer than ``AGREE`` pages whose articles differ, or
# True for as many or more. The wrapper of some pages is [items, articles]: of each speaker, how many characters each text has.


def digest(text: str) -> str:
    """64 bits that stand for a text of the template."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def fold(found: list[tuple[str, bool, str]], page: str = "") -> list:
    """Join the neighbours that begin with the same repeated element into one repeated group. ``page`` is the key of who says
    the article's texts; within groups, and without it, they don't count."""

    def said(flag: bool, texts: list[str]):
        return [digest("\n".join(texts)), [page]] if page and flag and texts else ""

    out, i, n = [], 0, len(found)
    while i < n:
        s, flag, text = found[i]
        if s[0] != "<" or s[1:] not in _REPEATED:
            out.append(["=", flag, s, said(flag, [text] if text else []), 1])
            i += 1
            continue
        starts, j, kinds = [i], i + 1, set()
        while j < n and found[j][1] == flag:
            here = found[j][0]
            if here == s:
                kinds |= {x for x, _, _ in found[starts[-1] : j]}
                starts.append(j)
            elif here != ">" + s[1:] and len(starts) > 1 and here not in kinds or here[0] == "<" and here[1:] not in _REPEATED or here[0] == ">" and here[1:] not in _REPEATED:
                break
            j += 1
        ends = [*starts[1:], j]
        unit: list | None = None
        for a, b in zip(starts, ends):
            own = [["=", flag, s, "", 1], *fold(found[a + 1 : b])]
            unit = own if unit is None else align(unit, own)
        out.append(["+", flag, unit, said(flag, [t for _, _, t in found[i:j] if t]), 1])
        i = j
    return out


def _inner(x: list) -> list:
    return x[2][0] if x[0] == "?" else x


def _key(x: list) -> tuple:
    """Items of equal keys are the same part of the template."""
    x = _inner(x)
    return x[0], x[1], x[2] if x[0] == "=" else x[2][0][2]


def _said(x, y):
    """What two items say, if they agree, and who says it."""
    if not x or not y or x[0] != y[0]:
        return x if x == y else None
    return [x[0], True if x[1] is True or y[1] is True else x[1] + y[1]]


def _merge(a: list, b: list) -> list:
    x, y = _inner(a), _inner(b)
    what = align(x[2], y[2]) if x[0] == "+" else x[2]
    both = [x[0], x[1], what, _said(x[3], y[3]), x[4] + y[4]]
    return both if x is a and y is b else _optional(both)


def _optional(x: list) -> list:
    return x if x[0] == "?" else ["?", x[1], [x], None, x[4]]


def align(a: list, b: list) -> list:
    """A wrapper for whatever either covers: common items in order, what only one has as optional; texts that differ
    become slots."""
    numbers: dict[tuple, int] = {}
    x, y = (np.array([numbers.setdefault(_key(i), len(numbers)) for i in s], np.int32) for s in (a, b))
    k = min(len(x), len(y))
    same = x[:k] == y[:k]
    head = k if same.all() else int(same.argmin())
    same = x[len(x) - k + head :][::-1] == y[len(y) - k + head :][::-1]
    tail = len(same) if same.all() else int(same.argmin())
    out = [_merge(i, j) for i, j in zip(a[:head], b[:head])]
    out += _between(a[head : len(a) - tail], b[head : len(b) - tail], x[head : len(x) - tail], y[head : len(y) - tail])
    return out + [_merge(i, j) for i, j in zip(a[len(a) - tail :], b[len(b) - tail :])]


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The longest common subsequence of ``x`` with each beginning of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return row


def _between(a: list, b: list, x: np.ndarray, y: np.ndarray) -> list:
    """The alignment of two sequences, by a table of ``CELLS`` cells at most: longer ones are cut in halves where the longest
    common subsequences of both sides make most, which needs two rows of the table."""
    n, m = len(a), len(b)
    if n * m > CELLS and n > 1:
        half = n // 2
        cut = int((_common(x[:half], y) + _common(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _between(a[:half], b[:cut], x[:half], y[:cut]) + _between(a[half:], b[cut:], x[half:], y[cut:])
    # Longest common subsequences of all ends, row by row from the last.
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = np.maximum(best[i + 1, :m], best[i + 1, 1:] + (y == x[i]))
        best[i, :m] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            out.append(_merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1, j] >= best[i, j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return out


def _template(items: list) -> list:
    """Items as they are kept: texts stay only where they are part of the template, that is where ``AGREE`` pages say the
    same before the first slot of the article or after the last one; headings between slots are its own."""
    says = list(map(_inner, items))
    slots = [i for i, x in enumerate(says) if x[1] and x[3] is None]

    def kept(x: list, edge: bool) -> list:
        if x[0] == "?":
            return ["?", x[1], [kept(y, edge) for y in x[2]], None]
        what = x[2] if x[0] == "=" else [kept(y, False) for y in x[2]]
        return [x[0], x[1], what, x[3][0] if edge and x[1] and x[3] and x[3][1] is True else None]

    return [kept(x, bool(slots) and not slots[0] <= i <= slots[-1]) for i, x in enumerate(items)]


def _copied(article: dict[str, int], others: list[dict[str, int]]) -> bool:
    """Whether more than half of an article's text stands in the others."""
    return 2 * sum(n for t, n in article.items() if any(t in o for o in others)) > sum(article.values())


def _settle(items: list, articles: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
    """Leave of the speakers of each text those whose articles differ: a copy says nothing about the template. Returns the
    articles that further pages have to be held against."""
    used: set[str] = set()
    for x in map(_inner, items):
        if x[3] and x[3][1] is not True:
            own: list[str] = []
            for page in x[3][1]:
                if page not in own and not _copied(articles[page], [articles[o] for o in own]):
                    own.append(page)
            if len(own) >= AGREE:
                x[3] = [x[3][0], True]
            else:
                x[3] = [x[3][0], own]
                used.update(own)
    return {page: articles[page] for page in used}


def page_wrapper(page: str, key: str) -> list | None:
    """The wrapper of one page; None for one without tokens."""
    found = tokens(page)
    if not found:
        return None
    flags = zones([s for s, _ in found])
    texts = [" ".join(t.split()) if f else "" for (_, t), f in zip(found, flags)]
    article: dict[str, int] = {}
    for t in filter(None, texts):
        d = digest(t)
        article[d] = article.get(d, 0) + len(t)
    items = fold([(s, f, t) for (s, _), f, t in zip(found, flags, texts)], key)
    return [items, {key: article} if any(x[3] for x in items) else {}]


def joined(a: list, b: list) -> list:
    """The wrapper of the pages of two wrappers."""
    items = align(a[0], b[0])
    return [items, _settle(items, a[1] | b[1])]


class Wrapper:
    """A wrapper as a regular expression over one character per symbol; groups catch the article's parts, and within them
    the texts of the template."""

    def __init__(self, text: str):
        self.codes: dict[str, str] = {}
        self.said: list[str | None] = []  # of each group the digest of the template's text, None for a part of the article
        items = json.loads(text)
        self.regex = re.compile(self._sequence(items, True)) if items else None

    def _code(self, symbol: str) -> str:
        return self.codes.setdefault(symbol, chr(0xE000 + len(self.codes)))

    def _sequence(self, items: list, top: bool) -> str:
        out, open_ = "", False
        for kind, flag, what, text in items:
            if top and flag != open_:
                out += "(" if flag else ")"
                open_ = flag
                if flag:
                    self.said.append(None)
            if text:
                self.said.append(text)
            # Possessive, so that no page is tried in more than one way.
            own = self._code(what) if kind == "=" else f"(?:{self._sequence(what, False)}){'?+' if kind == '?' else '++'}"
            out += f"({own})" if text else own
        return out + ")" * open_

    def article(self, found: list[tuple[str, str]]) -> tuple[list[bool], int] | None:
        """Which tokens belong to the article, and how many texts of the template were left out of it; None where the page
        doesn't match."""
        if self.regex is None:
            return None
        codes = self.codes
        if not (m := self.regex.fullmatch("".join([codes.get(s, "\0") for s, _ in found]))):
            return None
        out, dropped = [False] * len(found), 0
        for (a, b), text in zip(m.regs[1:], self.said):
            if a < 0:
                continue
            if text is None:
                out[a:b] = [True] * (b - a)
            elif digest("\n".join(t for t in (" ".join(t.split()) for _, t in found[a:b]) if t)) == text:
                out[a:b] = [False] * (b - a)
                dropped += 1
        return out, dropped


def blocks(found: list[tuple[str, str]], keep: list[bool]) -> str:
    """The kept texts: characters decoded, white space to one space, one line per block."""
    lines = []
    for (symbol, text), ok in zip(found, keep):
        if ok and symbol == "#" and (line := " ".join((html.unescape(text) if "&" in text else text).split())):
            lines.append(line)
    return "\n".join(lines)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _join_rows(key: list[str], finish=None):
    """A task over rows sorted by ``key``: the wrappers of equal keys are joined in the order of the rows."""

    def run(batches):
        last, held, whole = None, None, None  # ``whole``: what is joined so far; a single row stays as it is

        def row():
            return [*last, finish(json.loads(held) if whole is None else whole) if finish else held if whole is None else json.dumps(whole)]

        names = [*key, "wrapper"]
        for b in batches:
            out = []
            for *k, made in zip(*(b.column(n).to_pylist() for n in names)):
                if k == last:
                    whole = joined(json.loads(held) if whole is None else whole, json.loads(made))
                    continue
                if last is not None:
                    out.append(row())
                last, held, whole = k, made, None
            yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(n).type) for n, c in zip(names, zip(*out))] if out else [b.column(n)[:0] for n in names], names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], b.schema.field(n).type) for n, v in zip(names, row())], names)

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper), inferred from all pages of each host.

    A page becomes a wrapper of its own, with digests for texts; those of a host are joined in ``CHUNKS`` parts, in the order
    of the pages' hashes, and the parts after that, so that the result doesn't depend on how rows are dealt."""

    def run(batches):
        for b in batches:
            made = [page_wrapper(x or "", str(k)) for x, k in zip(b.column("html").to_pylist(), b.column("wrap_key").to_pylist())]
            texts = pa.array([w and json.dumps(w) for w in made], pa.string())
            own = pa.RecordBatch.from_arrays([b.column("wrap_host"), b.column("wrap_chunk"), b.column("wrap_key"), texts], ["wrap_host", "wrap_chunk", "wrap_key", "wrapper"])
            yield own.filter(texts.is_valid())

    key = F.xxhash64("url", "html")
    keyed = pages.select(host(F.col("url")).alias("wrap_host"), F.pmod(key, F.lit(CHUNKS)).cast("int").alias("wrap_chunk"), key.alias("wrap_key"), "html")
    one = keyed.mapInArrow(run, "wrap_host string, wrap_chunk int, wrap_key long, wrapper string")
    parts = one.repartition("wrap_host", "wrap_chunk").sortWithinPartitions("wrap_host", "wrap_chunk", "wrap_key").mapInArrow(_join_rows(["wrap_host", "wrap_chunk"]), "wrap_host string, wrap_chunk int, wrapper string")
    return parts.repartition("wrap_host").sortWithinPartitions("wrap_host", "wrap_chunk").mapInArrow(_join_rows(["wrap_host"], lambda w: json.dumps(_template(w[0]))), "wrap_host string, wrapper string")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id``, ``url``, ``text`` of every page; ``by_wrapper``: whether its host's wrapper matched; ``n_template``: how
    many texts the wrapper left out because the host's other pages say the same there.

    Elements and names say first what may be the article (``zones``). Wrappers are fitted on all pages of each host
    (``wrappers``) by aligning pages, texts included: what differs is a slot, what repeats a group, and texts at the
    article's edge that are the same on all pages which have them are template and go. Wrappers are applied to every page whole, whatever its length. A page that its wrapper doesn't match, or of a host without one, is
    cut by the elements alone.

    Null html is empty; a null url is a host of its own; repeated rows give equal rows; very long pages are extracted whole;
    an empty table gives no rows; other columns are ignored, whatever their names. Wrappers of up to ``broadcast_bytes``
    in all are sent to every task; more are joined by a shuffle.
    """
    found = cut_lineage(wrappers(pages))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("wrap_host"))).first()[0] or 0
    kind = dict(pages.dtypes)["page_id"]
    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("wrap_host")).join(F.broadcast(found) if size <= broadcast_bytes else found, "wrap_host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        made: dict[str, Wrapper] = {}
        for b in batches:
            texts, matched, dropped = [], [], []
            for page, wrapper in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist()):
                own = tokens(page or "")
                if wrapper not in made:
                    if len(made) > 2000:
                        made.clear()
                    made[wrapper] = Wrapper(wrapper or "[]")
                got = made[wrapper].article(own)
                matched.append(got is not None)
                keep, n = got or (zones([s for s, _ in own]), 0)
                dropped.append(n)
                texts.append(blocks(own, keep))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(matched, pa.bool_()), pa.array(dropped, pa.int32())], ["page_id", "url", "text", "by_wrapper", "n_template"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, by_wrapper boolean, n_template int")


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the extraction of all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "by_wrapper", "n_template")
