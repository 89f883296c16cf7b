"""Main text of web pages by inferred wrappers (operator 4).

Pages of one host share a template.  From a bounded sample of a host's pages a
wrapper is inferred, a regular expression without unions over tags and text: the
first page is the first wrapper, neighbouring equal groups fold into repeats, and
each further page is aligned with the wrapper; text that differs becomes a slot,
what only one side has becomes optional, what recurs becomes a repeat.  The tags
that every page must have, in order, are the wrapper's landmarks.  All pages of
the host are cut at the landmarks, and what stands in each stretch is counted over
all of them: a kind of container that is boilerplate in a stretch on several pages
and main text on no other is none of the article, and neither is a constant of the
wrapper that stands apart from the varying text.  Where nothing was seen, a page's
own judgement holds; pages that do not fit their wrapper are judged by the same
rules on their own.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from trajspark.llm.common import Rows, slices, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|select)\b.*?(?:</\1\s*>|\Z)"
    r"|<[/!?]?[a-zA-Z](?:[^\"'<>]|\"[^\"]*\"|'[^']*')*>|<[/!?][^>]*>|[^<]+|<", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements that stay inside a line of text; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words in class, id or role, of what is not the article.
ASIDE_TAGS = frozenset("nav aside footer form button menu dialog".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies "
                        "consent disclaimer disqus footer form menu nav navbar navigation newsletter notice notices pagination "
                        "popup promo promoted related reply replies sidebar share sharing social sponsor sponsored subscribe "
                        "toolbar widget widgets contentinfo complementary search".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that hold parts of a page; lists, tables and paragraphs belong to the one around them.
BOXES = frozenset("div section body article main aside nav header footer form".split())


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """``(tag or '', text or landmark, belongs to an aside)`` in page order; scripts, styles and remarks left out."""
    for m in _TOKEN.finditer(page):
        raw = m.group()
        if raw[0] != "<" or raw == "<":
            yield "", raw, False
            continue
        t = _TAG.match(raw)
        if not t or m.group(1):
            continue
        name = t.group(2).lower()
        if t.group(1):
            yield "/" + name, "/" + name, False
            continue
        words = [w for n in _NAMED.findall(raw) for w in _WORD.findall("".join(n).lower())]
        yield name, ".".join([name, *words]), name in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(words)


class Piece:
    """A stretch of text between tags: its block, whether an aside or article holds it, links, landmark index, container."""
    __slots__ = ("text", "block", "aside", "article", "link", "at", "box", "kind")

    def __init__(self, text, block, aside, article, link, at, box, kind):
        self.text, self.block, self.aside, self.article, self.link, self.at = text, block, aside, article, link, at
        self.box, self.kind = box, kind


def pieces(page: str) -> tuple[list[Piece], list[str]]:
    """Text pieces with their surroundings, and the stream of tags (text as ``#...``)."""
    out, stream = [], []
    block = link = 0
    asides: list[tuple[str, int]] = []   # open asides: element, elements of that name open inside
    articles = headers = 0
    boxes: list[tuple[str, int, str]] = [("", 0, "")]   # open containers: element, place in the stream, tag
    for name, mark, aside in tokens(page):
        if not name:
            text = html.unescape(mark)
            if text.strip():
                out.append(Piece(text, block, bool(asides) or bool(headers and not articles), articles > 0, link > 0, len(stream),
                                 *boxes[-1][1:]))
                stream.append("#" + " ".join(text.split()))
            elif out and out[-1].block == block:
                out[-1].text += " "
            continue
        stream.append(mark)
        base = name.lstrip("/")
        if base in BOXES:
            if name[0] != "/":
                boxes.append((name, len(stream), mark))
            elif any(b[0] == base for b in boxes):
                while boxes.pop()[0] != base:
                    pass
        if base not in INLINE:
            block += 1
        elif name == "br" and out and out[-1].block == block:
            out[-1].text += " "
        if base == "a":
            link = max(0, link + (1 if name == "a" else -1))
        if name in ARTICLE:
            articles += 1
            if articles == 1:
                asides = []  # an article ends asides left open before it
        elif name[0] == "/" and base in ARTICLE:
            articles = max(0, articles - 1)
            asides = []
        elif name == "header":
            headers += 1
        elif name == "/header":
            headers = max(0, headers - 1)
        elif name in ("body", "/body", "/html"):
            asides, articles, headers = [], 0, 0
        if asides and base == asides[-1][0]:
            depth = asides[-1][1] + (1 if name[0] != "/" else -1)
            asides[-1] = (base, depth)
            if depth <= 0:
                asides.pop()
        elif aside and name not in VOID and name not in ("body", "html", *ARTICLE):
            asides.append((name, 1))
    return out, stream


# A wrapper is a list of nodes: str (tag), None (text slot), ("#", constant), ("?", nodes), ("+", nodes).

def _shape(node) -> str:
    if node is None or isinstance(node, tuple) and node[0] == "#":
        return "#"
    if isinstance(node, str):
        return node
    return f"({' '.join(map(_shape, node[1]))}){node[0]}"


def fold(nodes: list, longest: int = 24) -> list:
    """Neighbouring groups of equal shape become one repeat; short groups first."""
    for size in range(1, longest + 1):
        out, at, shapes = [], 0, [_shape(n) for n in nodes]
        while at < len(nodes):
            n = 1
            if shapes[at] != "#" or size > 1:
                while shapes[at:at + size] == shapes[at + n * size:at + (n + 1) * size] and at + (n + 1) * size <= len(nodes):
                    n += 1
            if n > 1:
                out.append(("+", [None if _shape(x) == "#" else x for x in nodes[at:at + size]]))
                at += n * size
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def align(wrapper: list, page: list) -> list:
    """The wrapper widened so that it takes the page too."""
    a, b = [_shape(n) for n in wrapper], [_shape(n) for n in page]
    bare = lambda s: s[1:-2] if s[-2:] in (")?", ")+") else s
    out: list = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, list(map(bare, a)), list(map(bare, b)), autojunk=False).get_opcodes():
        if kind == "equal":
            for x, y in zip(wrapper[i:j], page[k:m]):
                if _shape(x) == "#":
                    out.append(x if x == y else None)
                else:  # of x, (x)? and (x)+ the widest
                    out.append(max((x, y), key=lambda z: 0 if isinstance(z, str) else 1 + (z[0] == "+")))
            continue
        for part in (wrapper[i:j], page[k:m]):
            if len(part) == 1 and isinstance(part[0], tuple) and part[0][0] in "?+":
                out.append(("?", part[0][1]) if part[0][0] == "?" else ("?", part))
            elif part:
                out.append(("?", part))
    return fold(out)


def infer(streams: list[list[str]]) -> list:
    """Wrapper of pages given as streams of tags and ``#text``."""
    node = lambda s: ("#", s) if s[0] == "#" else s
    wrapper: list = []
    for k, stream in enumerate(streams):
        page = fold([node(s) for s in stream])
        wrapper = align(wrapper, page) if k else page
    return wrapper


def expression(wrapper: list) -> str:
    """The wrapper as text: tags, ``#`` for slots, quoted constants, ``( )?`` and ``( )+``."""
    def one(n):
        if n is None:
            return "#"
        if isinstance(n, str):
            return f"<{n}>"
        return json.dumps(n[1][1:], ensure_ascii=False) if n[0] == "#" else f"({' '.join(map(one, n[1]))}){n[0]}"
    return " ".join(map(one, wrapper))


def landmarks(wrapper: list) -> list[str]:
    return [n for n in wrapper if isinstance(n, str)]


def cut(stream: list[str], marks: list[str]) -> list[int] | None:
    """Place of each landmark in the stream, first fit in order; None if one is missing."""
    out, at = [], 0
    for mark in marks:
        try:
            at = stream.index(mark, at) + 1
        except ValueError:
            return None
        out.append(at - 1)
    return out


def _where(place: int, cuts: list[int]) -> int:
    lo, hi = 0, len(cuts)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if cuts[mid] < place else (lo, mid)
    return lo


def _main(ps: list[Piece]) -> list[bool]:
    """Per piece: part of the article?  Inside article elements if there are any, else what is no aside and not mostly links."""
    if any(p.article and not p.aside for p in ps):
        return [p.article and not p.aside for p in ps]
    size: dict[int, list[int]] = {}
    for p in ps:
        s = size.setdefault(p.block, [0, 0])
        s[0] += len(p.text)
        s[1] += len(p.text) * p.link
    return [not p.aside and size[p.block][1] * 2 <= size[p.block][0] for p in ps]


def learn_wrapper(pages: list[str]) -> dict:
    """Wrapper, landmarks and constants with the stretch between landmarks they stand in."""
    wrapper = infer([pieces(p)[1] for p in pages])
    constants, k = [], 0
    for n in wrapper:
        if isinstance(n, str):
            k += 1
        elif n is not None and n[0] == "#":
            constants.append([k, n[1][1:]])
    return {"wrapper": expression(wrapper), "marks": landmarks(wrapper), "constants": constants}


def _placed(ps: list[Piece], cuts: list[int]) -> list[tuple[int, str]]:
    return [(_where(p.at, cuts), " ".join(p.text.split())) for p in ps]


def tally(page: str, known: dict) -> dict[tuple[str, int, str], tuple[int, int]]:
    """What one page tells of its host; nothing if it does not fit.

    ``("page", 0, "")``: 1; ``("stream", 0, hash)``: 1; ``("box", stretch, tag of the
    container)``: holds other text, main text; ``("constant", stretch, text)``: is
    there, with main text that is no constant in its container.
    """
    ps, stream = pieces(page)
    cuts = cut(stream, known["marks"])
    if cuts is None:
        return {}
    constants, main, placed = set(map(tuple, known["constants"])), _main(ps), _placed(ps, cuts)
    varied = {p.box for p, m, at in zip(ps, main, placed) if m and at not in constants}
    out = {("page", 0, ""): (1, 0), ("stream", 0, hashlib.md5("\0".join(stream).encode("utf-8", "replace")).hexdigest()): (1, 0)}
    for p, m, at in zip(ps, main, placed):
        k = ("box", at[0], p.kind)
        other, inside = out.get(k, (0, 0))
        out[k] = (max(other, int(not m)), max(inside, int(m)))
        if at in constants:
            k = ("constant", *at)
            out[k] = (1, max(out.get(k, (0, 0))[1], int(m and p.box in varied)))
    return out


#: Pages that show a container as boilerplate, and different pages that show a constant, before either counts.
SEVERAL, DIFFERENT = 3, 4


def judge(known: dict, pages: int, streams: int, counts: Iterable[tuple[str, int, str, int, int]]) -> dict:
    """The wrapper with what the sums of all pages' tallies say of it."""
    veto, constant = [], []
    for kind, at, name, x, y in counts:
        # a page that asks has main text there itself, so 1 is no other page
        if kind == "box" and x >= SEVERAL and y <= 1:
            veto.append([at, name])
        elif kind == "constant" and streams >= DIFFERENT and x * 10 >= pages * 9:
            constant.append((at, name, y * 10 <= x))
    return {"wrapper": known["wrapper"], "marks": known["marks"], "veto": sorted(veto), "fixed": sorted({c[1] for c in constant}),
            "apart": sorted([at, name] for at, name, apart in constant if apart)}


def learn_host(pages: list[str]) -> dict:
    """Wrapper, landmarks, containers that are boilerplate, and the template's fixed strings, from all pages of a host."""
    known, sums = learn_wrapper(pages), {}
    for p in pages:
        for k, (x, y) in tally(p, known).items():
            a, b = sums.get(k, (0, 0))
            sums[k] = (a + x, b + y)
    return judge(known, sums.get(("page", 0, ""), (0, 0))[0], sum(k[0] == "stream" for k in sums), [(*k, *v) for k, v in sums.items()])


def main_text(page: str | None, known: dict | None) -> str:
    """Blocks of the main text, one per line."""
    if not page:
        return ""
    ps, stream = pieces(page)
    keep = _main(ps)
    cuts = cut(stream, known["marks"]) if known and known["marks"] else None
    if cuts is not None:
        placed, veto, apart = _placed(ps, cuts), set(map(tuple, known["veto"])), set(map(tuple, known["apart"]))
        # outside article elements, a container that is boilerplate on all other pages is so here
        keep = [k and (p.article or (at[0], p.kind) not in veto) for p, k, at in zip(ps, keep, placed)]
        # and a fixed string in its place is the template's, unless text that varies stands beside it
        varied = {p.box for p, k, at in zip(ps, keep, placed) if k and at not in apart}
        keep = [k and (p.article or at not in apart or p.box in varied) for p, k, at in zip(ps, keep, placed)]
    blocks: dict[int, list[str]] = {}
    for p, k in zip(ps, keep):
        if k:
            blocks.setdefault(p.block, []).append(p.text)
    lines = (" ".join("".join(b).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


@lru_cache(512)
def _known(raw: str) -> dict:
    return json.loads(raw)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  sample: int = 12) -> DataFrame:
    """``host, n_pages, learned`` (JSON): wrappers of at most ``sample`` pages a host, those with the smallest hash of their id.

    Pages without html are left out; pages without a host share one wrapper.
    """
    rank = F.row_number().over(W.partitionBy("host").orderBy("mark", "page"))
    picked = (pages.select(_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{id_col}`").cast("string").alias("page"),
                           F.col(f"`{html_col}`").cast("string").alias("html"))
              .where(F.length("html") > 0).withColumn("mark", F.xxhash64("page", F.length("html")))
              .withColumn("k", rank).where(F.col("k") <= sample))

    def run(key, table):
        own = table.sort_by([("k", "ascending")]).column("html").to_pylist()
        return pa.table({"host": [key[0].as_py()], "n_pages": pa.array([len(own)], pa.int64()),
                         "learned": [json.dumps(learn_wrapper(own), ensure_ascii=False)]})

    return picked.select("host", "k", "html").groupBy("host").applyInArrow(run, "host string, n_pages long, learned string")


_TALLIES = pa.schema([("host", pa.string()), ("kind", pa.string()), ("at", pa.int32()), ("name", pa.string()),
                      ("x", pa.int64()), ("y", pa.int64())])


def _with_learned(pages: DataFrame, known: DataFrame, *, id_col: str, url_col: str, html_col: str, how: str) -> DataFrame:
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html")).withColumn("host", _host(F.col("url")))
    return rows.join(known.select(F.col("host").alias("of"), "learned"), F.col("host") == F.col("of"), how)


def host_judgements(pages: DataFrame, wrappers: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """``host, learned`` (JSON): the wrappers judged by all pages of each host."""
    joined = _with_learned(pages, wrappers, id_col=id_col, url_col=url_col, html_col=html_col, how="inner").where(
        F.length("html") > 0).select("host", "html", "learned")

    def count(batches):
        sums: dict = {}
        streams: dict = {}

        def rest():
            rows = Rows(_TALLIES)
            for (host, *k), (x, y) in sums.items():
                rows.add(host, *k, x, y)
                if rows.ready():
                    yield rows.take()
            yield from rows.rest()
            sums.clear()
            streams.clear()

        for part in slices(batches):
            for host, raw, learned in zip(*(c.to_pylist() for c in part.columns)):
                for k, (x, y) in tally(raw, _known(learned)).items():
                    if k[0] == "stream":   # whether there are so many is all that is asked
                        met = streams.setdefault(host, set())
                        if len(met) >= DIFFERENT:
                            continue
                        met.add(k)
                    a, b = sums.get((host, *k), (0, 0))
                    sums[(host, *k)] = (a + x, b + y)
            if len(sums) > 50_000:
                yield from rest()
        yield from rest()

    counts = joined.mapInArrow(count, "host string, kind string, at int, name string, x long, y long").groupBy(
        "host", "kind", "at", "name").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    useful = F.when((F.col("kind") == "constant") | (F.col("kind") == "box") & (F.col("x") >= SEVERAL) & (F.col("y") <= 1),
                    F.struct("kind", "at", "name", "x", "y"))
    sums = counts.groupBy("host").agg(F.sum(F.when(F.col("kind") == "page", F.col("x"))).alias("pages"),
                                      F.count(F.when(F.col("kind") == "stream", 1)).alias("streams"),
                                      F.to_json(F.collect_list(useful)).alias("counts"))

    def run(batches):
        for part in slices(batches):
            out = []
            for raw, n, streams, counts in zip(*(part.column(c).to_pylist() for c in ("learned", "pages", "streams", "counts"))):
                rows = [(c["kind"], c["at"], c["name"], c["x"], c["y"]) for c in json.loads(counts or "[]")]
                out.append(json.dumps(judge(json.loads(raw), n or 0, streams or 0, rows), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(out, pa.string())], names=["host", "learned"])

    return wrappers.select("host", "learned").join(sums, "host", "left").mapInArrow(run, "host string, learned string")


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            sample: int = 12) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    The text is that of the article: character references decoded, white space in
    a block one space, blocks in page order, one per line.  Null and empty html give
    an empty text; null ids and urls stay null; repeated rows are extracted each;
    an empty table gives no rows; other columns are not read; pages of any length
    are read whole.
    """
    columns = {"id_col": id_col, "url_col": url_col, "html_col": html_col}
    wrappers = written(host_wrappers(pages, sample=sample, **columns), "wrappers")
    known = written(host_judgements(pages, wrappers, **columns), "judged-wrappers")
    joined = _with_learned(pages, known, how="left", **columns).select("page_id", "url", "html", "learned")

    def run(batches):
        rows = Rows(_TEXTS)
        for part in slices(batches):
            for page, url, raw, learned in zip(*(c.to_pylist() for c in part.columns)):
                text = main_text(raw, _known(learned) if learned else None)
                rows.add(page, url, text, len(text), weight=len(text))
            if rows.ready():
                yield rows.take()
        yield from rows.rest()

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
