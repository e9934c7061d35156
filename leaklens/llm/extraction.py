"""Main text of web pages by consensus: hosts vote on the paths of containers, pages are read along the winner."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaklens.llm.language import host_of
from leaklens.llm.shared import pieces, small_batches, stash

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)|<[!?][^<>]*+>|<[/!][^<>]*\Z", re.S | re.I)
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/<>=][^\s/<>=]*|=[^\s/<>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s<>]*")
_PART = re.compile(r"[A-Za-z]+")
_NAME = re.compile(r"[^\s]+")
#: Elements that never hold the article.
DROPPED = frozenset("nav footer aside button dialog menu head object audio video canvas fieldset label input datalist".split())
#: Words in a class, id or role that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu header masthead topbar footer sidebar side aside cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe signup login breadcrumb breadcrumbs pagination pager widget toolbar skip copyright contentinfo complementary search".split()
)
#: Words before a noise word that make a name one of the article's own, or a statement about the layout.
OF_ARTICLE = frozenset("has no with without post entry article story content page single blog news main wide full".split())
#: Words of what readers wrote, which may be longer than the article.
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: First and last words of a name that tells whether readers may write, not that they did.
STATES = frozenset("has no with without".split()), frozenset("enabled disabled open opened closed on off allowed active".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var br wbr img label".split())
#: A start tag of the left closes an open element of the right, up to a border.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that can be the article's container.
CONTAINERS = frozenset("body div article main section td center".split())
#: Hosts whose paths are broadcast, some 200 bytes each; with more, pages are shuffled by host and AQE splits large ones.
FEW_HOSTS = 200_000
#: Part of a page's prose that a container must hold to count fully.
ENOUGH = 0.7


def attributes(page: str, at: int, gone: set[str]) -> tuple[dict[str, str], int]:
    """The attributes of a start tag from behind its name, by lower-case name, the first of one name; and where the tag ends.

    Quoted values go to their closing quote, however far; one without is read like a bare value. -1: no tag, as it is cut
    off or another one opens in it. gone: quotes that do not occur any more, which are sought once a page.
    """
    found: dict[str, str] = {}
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= len(page) or page[at] == "<":
            return found, -1
        if page[at] == ">":
            return found, at + 1
        name = _ATTRIBUTE.match(page, at)
        at, value = name.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            close = page.find(quote, at + 1) if quote in ('"', "'") and quote not in gone else -1
            if close >= 0:
                value, at = page[at + 1 : close], close + 1
            else:
                if quote in ('"', "'"):
                    gone.add(quote)
                bare = _BARE.match(page, at)
                value, at = bare.group(), bare.end()
        found.setdefault(name.group().lower(), value)


def read(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """Blocks in order: the path of their containers, the text, and the characters of it in links.

    Elements that never hold the article are left out. One that only its names speak against stays if the page's
    first-level headline or article element is in it with more than half of the page's prose.
    """
    blocks: list[tuple[tuple[str, ...], str, int]] = []
    if not page:
        return blocks
    stack: list[tuple[str, str, bool, int]] = []  # name, step of the path, whether all in it is left out, innermost element in doubt
    text: list[str] = []
    links = 0
    doubts: list[tuple[int, bool]] = []  # the element in doubt around each, and whether it holds headline or article
    doubtful: list[int] = []  # of each block, its innermost element in doubt

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined and not (stack and stack[-1][2]):
                blocks.append((tuple(x[1] for x in stack if x[1]), joined, min(links, len(joined))))
                doubtful.append(stack[-1][3] if stack else -1)
            text.clear()
        links = 0

    def close(to: int) -> None:
        flush()
        del stack[to:]

    def put(raw: str) -> None:
        nonlocal links
        if raw and not (stack and stack[-1][2]):
            said = entities.unescape(raw) if "&" in raw else raw
            text.append(said)
            if inside_link:
                links += len(said)

    at = begin = inside_link = 0
    gone: set[str] = set()
    while m := _TOKEN.search(page, begin):
        marks, begin = {}, m.end()
        if m[3]:
            marks, begin = attributes(page, m.end(), gone)
            if begin < 0:  # text that looks like a tag, or a tag that is cut off
                begin = m.end()
                if page.find("<", begin) < 0 and page.find(">", begin) < 0:
                    put(page[at : m.start()])
                    at = len(page)
                continue
        put(page[at : m.start()])
        at = begin
        if not m[3]:
            if m[1]:
                text.append(" ")
            continue
        name, end = m[3].lower(), m[2]
        if name in INLINE and name != "label":
            if name == "a":
                inside_link = 0 if end else 1
            elif name in ("br", "wbr", "img"):
                text.append(" " if name == "br" else "")
            continue
        if name in VOID:
            flush()
            continue
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            else:
                flush()
            continue
        flush()
        inside_link = 0
        if name in CLOSES:
            own, border = CLOSES[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in border:
                    break
                if stack[i][0] in own:
                    close(i)
                    break
        for i in range(len(stack) - 1, -1, -1):  # any block closes an open paragraph
            if stack[i][0] == "p":
                close(i)
                break
            if stack[i][0] in CONTAINERS:
                break
        named = [w for k in ("class", "id", "role", "itemprop") if marks.get(k) for w in _NAME.findall(marks[k])]
        in_article = any(s[0] in ("article", "main") for s in stack)
        out = bool(stack and stack[-1][2]) or name in DROPPED or "hidden" in marks or marks.get("aria-hidden") == "true"
        doubt = stack[-1][3] if stack else -1
        if name in ("h1", "article", "main"):
            above = doubt
            while above >= 0 and not doubts[above][1]:
                doubts[above] = (doubts[above][0], True)
                above = doubts[above][0]
        if not out and name not in ("body", "html", "article", "main"):
            kinds = [speaks_against(w) for w in named]
            out = 2 in kinds
            if 1 in kinds or name == "form" or (name == "header" and not in_article):
                doubts.append((doubt, False))
                doubt = len(doubts) - 1
        step = ""
        if name in CONTAINERS:
            step = ".".join([name, *sorted({w.lower() for w in _PART.findall(marks.get("class") or "")})])
        stack.append((name, step, out, doubt))
    put(page[at:])
    flush()
    if not doubts:
        return blocks
    prose, total = [0.0] * len(doubts), 0.0
    for (_, joined, linked), d in zip(blocks, doubtful, strict=True):
        value = max(0.0, len(joined) - 2.0 * linked)
        total += value
        if d >= 0:
            prose[d] += value
    for d in range(len(doubts) - 1, -1, -1):  # what an inner element holds, its outer one holds
        if doubts[d][0] >= 0:
            prose[doubts[d][0]] += prose[d]
    stays = []
    for d, (outer, holds) in enumerate(doubts):
        stays.append((outer < 0 or stays[outer]) and holds and prose[d] > total / 2)
    return [b for b, d in zip(blocks, doubtful, strict=True) if d < 0 or stays[d]]


def speaks_against(name: str) -> int:
    """0: nothing in a class, id or role speaks against the element; 1: it is probably not the article; 2: readers wrote it.

    A name is read by its words: "post-header" and "has-sidebar" are the article's or tell of the layout, and
    "no-comments" or "comments-open" of what readers may do.
    """
    words = [w.lower() for w in _PART.findall(name)]
    found = [i for i, w in enumerate(words) if w in NOISE and not (i and words[0] in OF_ARTICLE)]
    if any(w in READERS for w in words):
        return 0 if words[0] in STATES[0] or words[-1] in STATES[1] else 2
    return int(bool(found))


def scores(blocks: list[tuple[tuple[str, ...], str, int]]) -> dict[str, float]:
    """Every container path's score: prose it holds, less its links, more for depth and for article elements.

    One that holds too little of the page's prose counts for less.
    """
    prose: dict[tuple[str, ...], float] = {}
    total = 0.0
    for path, text, links in blocks:
        value = max(0.0, len(text) - 2.0 * links)
        total += value
        for depth in range(1, len(path) + 1):
            prose[path[:depth]] = prose.get(path[:depth], 0.0) + value
    out = {}
    for path, value in prose.items():
        share = value / total if total else 0.0
        bonus = 2.0 if path[-1].split(".")[0] in ("article", "main") else 1.0
        out[" ".join(path)] = value * bonus * (1 + 0.05 * len(path)) * (1.0 if share >= ENOUGH else share * share)
    return out


def text_of(blocks: list[tuple[tuple[str, ...], str, int]], paths: list[str]) -> str:
    """Blocks under the first of the paths that the page has; without any, under the page's own best."""
    held = {" ".join(p[:d]) for p, _, _ in blocks for d in range(1, len(p) + 1)}
    path = next((p for p in paths if p in held), None)
    if path is None:
        own = scores(blocks)
        path = max(own, key=lambda k: (own[k], k)) if own and max(own.values()) > 0 else None
    if path is None:
        return "\n".join(t for _, t, _ in blocks)
    want = tuple(path.split(" "))
    return "\n".join(t for p, t, _ in blocks if p[: len(want)] == want)


def extract(pages: DataFrame, most_paths: int = 3) -> DataFrame:
    """page_id, url, text, n_chars, path: the article of every page.

    Each page's containers are scored, scores are summed over a host's pages by generalised path (tags and the
    letters of classes) in Spark, and each page is read along its host's winners: the best path and those with
    a third of its votes, at most `most_paths`; a page that has none of them is read along its own best.

    Null or empty html gives an empty text. A null or odd url has host null, a host of its own. Rows and nulls
    come back as often as they came; ties go by path; an empty table gives no rows; pages and attributes of any length are
    read whole, in time that grows with them. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))

    def vote(batches):
        for b in batches:
            hosts, paths, votes = [], [], []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, value in scores(read(page)).items():
                    if value > 0:
                        hosts.append(host)
                        paths.append(path)
                        votes.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.float64())], names=["host", "path", "votes"])

    votes = rows.select("host", "html").mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.round(F.sum("votes"), 3).alias("votes"))
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("rank") <= most_paths)
    best = ranked.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("rank", "votes", "path"))).alias("won"))
    best = stash(best.select("host", F.transform(F.filter("won", lambda x: x["votes"] * 3 >= F.col("won")[0]["votes"]), lambda x: x["path"]).alias("paths")), "paths")
    # A few paths a host: they go to the pages where these lie, unless there are too many hosts for that.
    if best.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        best = F.broadcast(best)

    def again(batches):
        for b in batches:
            for part in pieces(b, "html"):
                texts = [text_of(read(page), paths or []) for page, paths in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    id_type = dict(rows.dtypes)["page_id"]
    joined = rows.join(best, "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(again, f"page_id {id_type}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
