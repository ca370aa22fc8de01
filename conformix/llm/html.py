"""Main text of web pages by consensus host paths."""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conformix.llm.common import checked_join, materialise

#: Elements that hold nothing of the article.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg canvas select button input textarea dialog menu head title annotation annotation-xml audio video".split())
#: Words of class and id attributes that mark such elements.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside rail widget header masthead "
    "footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended comments comment "
    "commentlist disqus respond reply replies discussion pagination pager toolbar copyright legal disclaimer skip".split()
)
#: Those of the words that a layout also gives to a container of the article itself.
SOFT = frozenset("form header legal login masthead modal overlay rail search share sharing social widget".split())
#: An element marked by such words only, or a form, is passed if it has so much text, and so many times that of all the rest.
LEAST, MOST = 200, 2.0
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
RAW = "script|style|noscript|template|iframe|svg|textarea|title|select|canvas"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var nobr ruby rt rp wbr br img math semantics mrow mi mn mo mtext mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mpadded mfenced".split())
CONTAINERS = frozenset("body main article section div td center blockquote".split())
#: Paths kept of a host, and the share of a page's own best container that a path's text must reach to be taken.
PATHS, COVER = 3, 0.25  # a page on none of them is extracted at its own best container, so nothing is lost by the number
#: What a start tag closes when it meets it open (up to the listed stops).
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\b[^>]*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


def _traits(tag: str, raw: str) -> tuple[str, int, bool]:
    """(generalised tag-class step of a path, marked as noise by its class or role: 1 by soft words only, hidden)."""
    name, noise, hidden = "", 0, False
    for m in ATTR.finditer(raw) if raw else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "class":
            name = ".".join(sorted({re.sub(r"\d+", "", x.lower()) for x in value.split()} - {""}))
        if key in ("class", "id"):
            found = {x.lower() for x in SPLIT.split(value)} & NOISE
            noise = max(noise, 2 if found - SOFT else 1 if found else 0)
        elif key == "role" and value.lower() in ROLES:
            noise = max(noise, 1 if value.lower() in SOFT else 2)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
    return (f"{tag}.{name}" if name else tag), noise, hidden


class Page:
    """Containers and text blocks of a page. nodes: (parent, tag, path, dropped, marked); blocks: [node, text, link length]."""

    def __init__(self, source: str):
        self.nodes: list[list] = [[-1, "", "", False, False]]
        self.blocks: list[list] = []
        stack: list[int] = [0]
        text: list[str] = []
        links, in_link, at = 0, 0, 0
        mute: tuple[str, int] | None = None  # an inline element whose text is noise, and where it began

        def flush():
            nonlocal links, mute
            if mute:
                del text[mute[1] :]
                mute = None
            if text:
                t = SPACE.sub(" ", _html.unescape("".join(text))).strip()
                if t:
                    self.blocks.append([stack[-1], t, links])
                text.clear()
            links = 0

        def pop_to(k: int):
            del stack[k:]

        nodes = self.nodes
        for m in TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at : m.start()]
                text.append(piece)
                links += len(piece) if in_link else 0
            at = m.end()
            if m[1]:
                continue
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            closing, raw = m[2] or m[5], m[4] or m[7] or ""
            if tag in INLINE:
                if tag == "a":
                    in_link = 0 if closing else 1
                elif tag == "br":
                    text.append(" ")
                if tag not in ("span", "a", "ins", "small"):
                    continue
                if not closing and "=" in raw and mute is None:
                    _, noise, hidden = _traits(tag, raw)
                    if noise or hidden:
                        mute = (tag, len(text))
                elif closing and mute and mute[0] == tag:
                    del text[mute[1] :]
                    mute = None
                continue
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]][1] == tag:
                        pop_to(k)
                        break
                continue
            if tag in VOID:
                continue
            in_link = 0
            opens, stops = CLOSES.get(tag, ({"p"}, CONTAINERS | {"li", "dd", "th"}))
            for k in range(len(stack) - 1, 0, -1):
                t = nodes[stack[k]][1]
                if t in opens:
                    pop_to(k)
                    break
                if t in stops:
                    break
            step, noise, hidden = _traits(tag, raw)
            parent = nodes[stack[-1]]
            inside = any(nodes[j][1] in ("article", "main") for j in stack)
            dropped = hidden or tag in DROPPED and tag != "form" and not (tag == "header" and inside)
            marked = max(noise, tag == "form") if tag not in ("html", "body", "article", "main", "h1", "p", "header" if inside else "") else 0
            nodes.append([stack[-1], tag, f"{parent[2]}/{step}" if parent[2] else step, dropped, marked])
            if not raw.rstrip().endswith("/") or tag in CONTAINERS:
                stack.append(len(nodes) - 1)
        tail = source[at:]
        if tail:
            text.append(tail)
            links += len(tail) if in_link else 0
        flush()
        self._pass_wrappers()
        # an element around the article itself is no menu or advert, whatever its class
        for node in nodes:
            if node[1] in ("article", "main"):
                up = node[0]
                while up > 0:
                    nodes[up][4] = 0
                    up = nodes[up][0]

    def _pass_wrappers(self):
        """Softly marked elements that hold most of the page's text, links aside, are wrappers of the article."""
        if not any(node[4] == 1 for node in self.nodes):
            return
        gone = [False]
        for node in self.nodes[1:]:
            gone.append(gone[node[0]] or node[3] or node[4] == 2)
        held = [0] * len(self.nodes)
        for node, t, link in self.blocks:
            held[node] += 0 if gone[node] else max(len(t) - 2 * link, 0)
        for k in range(len(self.nodes) - 1, 0, -1):
            held[self.nodes[k][0]] += held[k]
        for k, node in enumerate(self.nodes):
            if node[4] == 1 and held[k] >= LEAST and held[k] > MOST * (held[0] - held[k]):
                node[4] = 0

    def lost(self, marks: bool = True) -> list[bool]:
        """Of each node: it or something around it is dropped."""
        out = [False]
        for node in self.nodes[1:]:
            out.append(bool(out[node[0]] or node[3] or (marks or node[1] == "form") and node[4]))
        return out

    def scored(self, lost: list[bool]) -> dict[int, float]:
        """Scores of containers: text of their own blocks counts in full, that of the next level in half; link text counts against."""
        score: dict[int, float] = {}
        bonus = {"article": 1.5, "main": 1.3, "body": 0.8}
        for node, t, link in self.blocks:
            if lost[node]:
                continue
            gain = max(len(t) - 2 * min(link, len(t)), 0) + 0.01
            at, share, seen = node, 1.0, 0
            while at > 0 and seen < 3:
                if self.nodes[at][1] in CONTAINERS:
                    score[at] = score.get(at, 0.0) + gain * share
                    seen += 1
                    share *= 0.5
                at = self.nodes[at][0]
        return {k: v * bonus.get(self.nodes[k][1], 1.0) for k, v in score.items()}

    def whole(self, node: int) -> int:
        """The nearest article around a container, or else the nearest main; the container itself without either."""
        for tag in ("article", "main"):
            at = node
            while at > 0:
                if self.nodes[at][1] == tag:
                    return at
                at = self.nodes[at][0]
        return node

    def inside(self, roots: set[int], lost: list[bool]) -> str:
        held = [False] * len(self.nodes)
        for k in range(len(self.nodes)):
            held[k] = k in roots or k > 0 and held[self.nodes[k][0]]
        return "\n".join(t for node, t, _ in self.blocks if held[node] and not lost[node])


def votes(source: str | None) -> list[tuple[str, float]]:
    """The page's container paths with their shares of the page's score."""
    if not source:
        return []
    page = Page(source)
    score: dict[str, float] = {}
    for k, v in page.scored(page.lost()).items():
        score[page.nodes[k][2]] = max(score.get(page.nodes[k][2], 0.0), v)
    total = sum(score.values())
    return [(p, v / total) for p, v in sorted(score.items()) if total > 0]


def extract_text(source: str | None, paths: list[str] | None = None) -> str:
    """The page's article: at the first winning path whose text covers enough of the page's own best container; by that
    container; then by all of its body. A container stands for the article or main around it."""
    if not source:
        return ""
    page = Page(source)
    lost = page.lost()
    score = page.scored(lost)
    best = max(score, key=lambda k: (score[k], -k)) if score else None
    own = page.inside({page.whole(best)}, lost) if best is not None else ""
    # a body is no container of its own to hold a path against
    least = COVER * len(own) if own and page.nodes[best][1] != "body" else 0
    for place, path in enumerate(paths or ()):
        if place and best is not None and page.nodes[best][2].startswith(path + "/"):
            continue  # a runner-up around the page's own container only adds what is beside it
        found = page.inside({page.whole(k) for k, n in enumerate(page.nodes) if n[2] == path and not lost[k]}, lost)
        if found and len(found) >= least:
            return found
    if score:
        return own
    lost = page.lost(False)
    score = page.scored(lost)
    if score:
        return page.inside({page.whole(max(score, key=lambda k: (score[k], -k)))}, lost)
    return page.inside({0}, page.lost())


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, paths): the PATHS tag-class paths with most votes of each host's pages, best first; a host of any size is summed map-side first."""

    def run(batches):
        for b in batches:
            total: dict[tuple[str, str], list] = {}
            for h, source in zip(b.column(0).to_pylist(), b.column(1)):
                for p, v in votes(source.as_py()):
                    x = total.setdefault((h, p), [0.0, 0])
                    x[0] += v
                    x[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array([int(round(v[0] * 1e6)) for v in total.values()], pa.int64())], ["host", "path", "votes"])

    found = pages.select(host_of("url").alias("host"), "html").mapInArrow(run, "host string, path string, votes long")
    summed = found.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("path")))
    best = summed.withColumn("place", place).where(F.col("place") <= PATHS).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("b"))
    return best.select("host", F.col("b.path").alias("paths"))


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rows of pages (columns `keep`; all but html by default) with text and n_chars.

    First pass: each page's containers are scored and vote for their generalised tag-class path; votes are summed by host.
    Second pass: each page is extracted at a winning path of its host, or at its own best container where those have
    little of its text. The host table is broadcast only if it was counted and is small; else the join shuffles by host.

    null and empty html give empty text and 0; pages without a usable url share one host; columns named text or n_chars
    are replaced; repeated rows stay; an empty table stays empty; nothing is cut.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars", "html")]
    hosts = materialise(consensus(pages), "hosts")
    wide = checked_join(pages.select(host_of("url").alias("host"), F.col("html").alias("_html"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]), hosts, "host", "left", 300)
    wide = wide.select("_html", "paths", *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])
    schema = T.StructType([wide.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = [extract_text(s.as_py(), p) for s, p in zip(part.column(0), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*keep, "text", "n_chars"])

    return wide.mapInArrow(run, schema)
