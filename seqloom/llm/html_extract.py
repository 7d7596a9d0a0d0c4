"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of text blocks, each with the path of the elements around it.  Folding a stream turns tandem repeats
into repeated groups.  A host's wrapper starts as one folded stream and is aligned with the next again and again:
matching places with different texts become text slots, places that only one side has become optional groups.  Streams
are merged in a tree (task, then salted part of a host, then host), so a host with a third of all pages is never one
group.

The wrapper decides what is main text:

* its main container is found from the root down: as long as one child holds most of the slots' text (text in links, and
  text that is the same on SEEN pages, counts for nothing) and no other child holds much, the child is the container;
* inside the container, places with the same text on SEEN pages are constants of the form and go, as do repeated groups
  that are nearly all links;
* elements that by their name hold no article text (menus, headers, footers, forms), or by a word of their class, id or
  role, go unless they are around the container or hold half of its slot text.  Names never empty an ancestor.

A page with little text in its host's container is unlike the form; its container is found in the same way from its own
stream, with the host's constants left out.

Edge cases: null or empty html has no text; pages with a null url share a wrapper; broken or unclosed markup is read as
far as it goes; very long pages are read whole, in one pass; repeated rows give repeated rows; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import materialise, table

#: Elements that end a block of text, that have no content, whose content is raw text, and whose content isn't shown.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "iframe", "noscript")}
HIDDEN = set("template svg math object canvas audio video".split())
#: Elements, and words of classes, ids and roles, that hold no article text.
NO_TEXT = set("head title nav header footer aside form menu search dialog button select label fieldset".split())
NO_TEXT_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup share sharing social related recommended comment comments respond reply replies discussion "
    "disqus sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer copyright login toolbar skip".split()
)
#: Those of them that say as much as part of a compound name (related-posts, cookie-notice).
IN_COMPOUNDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies popup modal newsletter subscribe comment comments respond "
    "disqus sidebar related recommended breadcrumb breadcrumbs pagination share sharing footer nav".split()
)
#: Elements that hold a page's text whatever their names say, and those that mark its main part.
ALWAYS_TEXT, MAIN = {"html", "body", "main", "article"}, {"main", "article"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NAME, END_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*"), re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=<][^\s/>=<]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s><]*")
WORDS = re.compile(r"[a-zA-Z]+")
#: Pages on which a text must be the same to be a constant; share of slot text that leads on to a child, that a second child
#: must not have, and under which a page is unlike its host's form; share of links that makes a group a menu.
SEEN, LEADS, SECOND, UNLIKE, MENU = 5, 0.5, 0.1, 0.3, 0.8
SALTS, LONGEST_GROUP, CELLS, LONGEST_WRAPPER = 32, 6, 40_000, 4000
#: Hosts whose wrappers are broadcast, and the bytes that these may have together.
HEAVY, HEAVY_BYTES = 10_000, 32 << 20


class Tags:
    """One pass over a page: (kind, name, names) with kind "text" (name: the text), "open", "single" or "close"."""

    def __init__(self, page: str):
        self.page, self.last = page, {}

    def find(self, what: str, at: int) -> int:
        """Like str.find, but a string that isn't found is looked for once only."""
        if self.last.get(what, -1) == -2:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.last[what] = -2
        return found

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = self.find("<", at)
            if lt < 0:
                yield "text", page[at:], ""
                return
            if lt > at:
                yield "text", page[at:lt], ""
            at = lt + 1
            if page.startswith("!--", at):
                end = self.find("-->", at + 1)
                at = n if end < 0 else end + 3
            elif page.startswith("![CDATA[", at):
                end = self.find("]]>", at)
                at = n if end < 0 else end + 3
            elif page[at : at + 1] in ("!", "?"):
                end = self.find(">", at)
                at = n if end < 0 else end + 1
            elif page[at : at + 1] == "/":
                m = END_NAME.match(page, lt)
                if m:
                    yield "close", m[1].lower(), ""
                    at = m.end()
                else:
                    end, again = self.find(">", at), self.find("<", at)
                    at = n if end < 0 and again < 0 else min(x for x in (end + 1 if end >= 0 else n, again if again >= 0 else n))
            else:
                m = NAME.match(page, at)
                tag = m and self.attributes(m.end())
                if not tag:
                    yield "text", "<", ""
                    continue
                name, (at, names, closed) = m[0].lower(), tag
                if name in RAW and not closed:
                    end = RAW[name].search(page, at)
                    at = n if end is None else end.start()
                    if end is not None:
                        end = self.find(">", at)
                        at = n if end < 0 else end + 1
                elif name in VOID or closed and name in HIDDEN:
                    yield "single", name, ""
                elif name not in RAW:
                    yield "single" if closed and name not in BLOCKS else "open", name, names

    def attributes(self, at: int) -> tuple[int, str, bool] | None:
        """End of the tag, values of class, id and role, whether it closes itself; none if no tag ends before the next one."""
        page, names, closed = self.page, [], False
        while True:
            m = ATTRIBUTE.match(page, at)
            if not m:
                while at < len(page) and page[at] in " \t\n\r\f/=":
                    closed = page[at] == "/"
                    at += 1
                if at >= len(page) or page[at] != ">":
                    return None
                return at + 1, " ".join(names), closed
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") and quote else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
                    if value.endswith("/") and page[at : at + 1] == ">":
                        value, at = value[:-1], at - 1
            if value and m[1].lower() in ("class", "id", "role"):
                names.append(value.lower())


def blocks_of(page: str | None) -> list[tuple[str, tuple[str, ...], str, int]]:
    """(path, flagged paths, text, characters in links) of each block with text, in page order.

    Flagged paths are those of elements around the block that by their name or names hold no article text.
    """
    out: list[tuple[str, tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str, tuple[str, ...], bool]] = []  # name, path, flagged paths, ends a block
    parts: list[str] = []
    links = hidden = linked = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                place = next((s for s in reversed(stack) if s[3]), ("", "", (), True))
                out.append((place[1], stack[-1][2] if stack else (), text, min(linked, len(text))))
            linked = 0

    def pop(to: int) -> None:
        nonlocal links, hidden
        while len(stack) > to:
            name, _, flags, block = stack[-1]
            if block or flags and (len(stack) < 2 or stack[-2][2] != flags):
                end_block()
            links -= name == "a"
            hidden -= name in HIDDEN
            stack.pop()

    for kind, name, names in Tags(page or ""):
        if kind == "text":
            if not hidden:
                parts.append(name)
                linked += len(name) if links else 0
            continue
        if kind == "close":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            flagged = at is not None and stack[at][2] != (stack[at - 1][2] if at else ())
            if at is not None and (name in BLOCKS or flagged or not any(s[3] for s in stack[at + 1 :])):
                pop(at)  # the end of <b> doesn't end a paragraph in it
            elif name in BLOCKS:
                end_block()
            continue
        if name == "br":
            parts.append(" ")
        if kind == "single":
            if name == "hr":
                end_block()
            continue
        if hidden:
            links, hidden = links + (name == "a"), hidden + (name in HIDDEN)
            stack.append((name, stack[-1][1], stack[-1][2], False))
            continue
        block = name in BLOCKS
        if block:
            end_block()
            # an open paragraph ends where the next block begins, an item where the next item does
            closes = {"p"} | ({name} if name in ("li", "dt", "dd", "td", "th", "tr", "option") else set())
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][3]), None)
            if at is not None and stack[at][0] in closes:
                pop(at)
        above = stack[-1] if stack else ("", "", (), True)
        words = WORDS.findall(names)
        bad = name in NO_TEXT or block and name not in ALWAYS_TEXT and not (NO_TEXT_WORDS.isdisjoint(names.split()) and IN_COMPOUNDS.isdisjoint(words))
        path = above[1]
        if block:
            path += "/" + name + "".join(f".{w}" for w in sorted(set(words))[:4])
        elif bad:
            end_block()
            path += f"/{name}"
        links += name == "a"
        hidden += name in HIDDEN
        stack.append((name, path if block else above[1], (*above[2], path) if bad else above[2], block))
    pop(0)
    end_block()
    return out


# ---- wrappers: lists of places [path, repeated, optional, constant text's hash or null, characters, of them in links,
# ---- least hashes of pages that have it (SEEN at most), flagged paths]

PATH, REPEATED, OPTIONAL, CONSTANT, CHARS, LINKED, PAGES, FLAGS = range(8)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 12


def stream_of(blocks: list[tuple[str, tuple[str, ...], str, int]]) -> list[list]:
    hashes = [text_hash(t) for _, _, t, _ in blocks]
    page = text_hash(repr(hashes))
    return fold([[path, False, False, h, len(t), linked, [page], list(flags)] for (path, flags, t, linked), h in zip(blocks, hashes, strict=True)])


def united(a: list, b: list, repeated: bool = False) -> list:
    """One place from two that match."""
    return [
        a[PATH], repeated or a[REPEATED] or b[REPEATED], a[OPTIONAL] or b[OPTIONAL], a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None,
        a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], sorted({*a[PAGES], *b[PAGES]})[:SEEN], a[FLAGS],
    ]


def fold(stream: list[list]) -> list[list]:
    """Tandem repeats of up to LONGEST_GROUP places become one group whose places are marked as repeated."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[list] = []
        for place in stream:
            out.append(place)
            while len(out) >= 2 * size and all(out[i - size][PATH] == out[i][PATH] for i in range(-size, 0)):
                last = out[-size:]
                del out[-size:]
                out[-size:] = [united(a, b, True) for a, b in zip(out[-size:], last, strict=True)]
        stream = out
    return stream


def matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; beyond CELLS, of common runs found from the longest down."""
    start, n, m = 0, len(a), len(b)
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    pairs = [(i, i) for i in range(start)]
    x, y = a[start:n], b[start:m]
    if len(x) * len(y) > CELLS:
        for i, j, size in SequenceMatcher(None, x, y, autojunk=True).get_matching_blocks():
            pairs += [(start + i + d, start + j + d) for d in range(size)]
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below, p = best[i], best[i + 1], x[i]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if p == y[j] else max(below[j], row[j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                pairs.append((start + i, start + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return pairs + [(n + i, m + i) for i in range(len(a) - n)]


def align(wrapper: list[list], stream: list[list]) -> list[list]:
    """The wrapper generalised so that it also accepts the stream."""
    out, i, j = [], 0, 0
    for a, b in [*matches([p[PATH] for p in wrapper], [p[PATH] for p in stream]), (len(wrapper), len(stream))]:
        for p in [*wrapper[i:a], *stream[j:b]]:
            p[OPTIONAL] = True
            out.append(p)
        if a < len(wrapper):
            out.append(united(wrapper[a], stream[b]))
        i, j = a + 1, b + 1
    out = fold(out)
    if len(out) > LONGEST_WRAPPER:  # a form without order: one repeated, optional place for each path
        by_path: dict[str, list] = {}
        for p in out:
            by_path[p[PATH]] = united(by_path[p[PATH]], p, True) if p[PATH] in by_path else p
        out = [[*p[:OPTIONAL], True, *p[CONSTANT:]] for p in by_path.values()]
    return out


def merged(wrappers: list[list[list]]) -> list[list]:
    wrapper = wrappers[0]
    for other in wrappers[1:]:
        wrapper = align(wrapper, other)
    return wrapper


def is_constant(place: list) -> bool:
    return place[CONSTANT] is not None and not place[REPEATED] and len(place[PAGES]) >= SEEN


def within(path: str, box: str) -> bool:
    return not box or path == box or path.startswith(f"{box}/")


def main_container(wrapper: list[list], known: frozenset = frozenset()) -> str:
    """Path of the element that holds the main text; ``known`` has (path, hash) of constants."""

    def weights(fair: bool) -> list[tuple[str, float]]:
        found = []
        for p in wrapper:
            if not (is_constant(p) or (p[PATH], p[CONSTANT]) in known):
                names = [f.rsplit("/", 1)[1].split(".")[0] for f in p[FLAGS]] if fair else []
                share = 0 if not NO_TEXT.isdisjoint(names) else 0.5 if names else 1  # words of classes only tip the scale
                found.append((p[PATH], share * (p[CHARS] - p[LINKED])))
        return [x for x in found if x[1] > 0]

    slots = weights(True) or weights(False)
    box, inside = "", slots
    while inside:
        total = sum(w for _, w in inside)
        children: dict[str, float] = {}
        deeper = set()
        for path, w in inside:
            rest = path[len(box) + 1 :].split("/") if path != box else [""]
            children[rest[0]] = children.get(rest[0], 0) + w
            if len(rest) > 1:
                deeper.add(rest[0])
        best = max(sorted(children), key=children.get)
        second = max((w for c, w in children.items() if c != best), default=0)
        main = [c for c in sorted(children) if c.split(".")[0] in MAIN and children[c] >= LEADS * total]
        if main:
            best = max(main, key=children.get)
        elif best not in deeper or children[best] < LEADS * total or second >= SECOND * children[best]:
            break
        box = f"{box}/{best}"
        inside = [x for x in inside if within(x[0], box)]
    return box


def decisions(wrapper: list[list]) -> dict:
    """What the wrapper says of a host's pages: container, flagged paths to keep, constants, paths of menus."""
    box = main_container(wrapper)
    slots = [p for p in wrapper if within(p[PATH], box) and not is_constant(p)]
    total, held = sum(p[CHARS] for p in slots), {}
    for p in slots:
        for f in p[FLAGS]:
            held[f] = held.get(f, 0) + p[CHARS]
    spared = sorted(f for f, chars in held.items() if within(box, f) or chars >= LEADS * total)
    constants = sorted([p[PATH], p[CONSTANT]] for p in wrapper if is_constant(p) and within(p[PATH], box))
    links: dict[str, list[int]] = {}
    for p in slots:
        if p[REPEATED] and p[PATH].rsplit("/", 1)[-1].split(".")[0] not in HEADINGS:
            of = links.setdefault(p[PATH], [0, 0])
            of[0] += p[LINKED]
            of[1] += p[CHARS]
    menus = sorted(path for path, (linked, chars) in links.items() if linked >= MENU * chars and chars < LEADS * total)
    return {"box": box, "spared": spared, "constants": constants, "menus": menus}


def main_text(blocks: list[tuple[str, tuple[str, ...], str, int]], form: dict | None) -> str:
    """The page's main text by its host's form, or by its own if it is unlike it."""
    own = None
    if form is None:
        form = own = decisions(stream_of(blocks))
    constants = frozenset(map(tuple, form["constants"]))

    def kept(form: dict) -> list[str]:
        spared, menus = set(form["spared"]), set(form["menus"])
        return [
            t for path, flags, t, _ in blocks
            if within(path, form["box"]) and path not in menus and all(f in spared or within(form["box"], f) for f in flags)
            and not (constants and (path, text_hash(t)) in constants)
        ]

    found = kept(form)
    if own is None:
        size = sum(map(len, found))
        if size < UNLIKE * sum(len(t) - linked for _, flags, t, linked in blocks if not flags):
            stream = stream_of(blocks)
            mine = decisions(stream)
            mine["box"] = main_container(stream, constants)
            other = kept(mine)
            if size < UNLIKE * sum(map(len, other)):
                found = other
    return " ".join(found)


def expression(wrapper: list[list]) -> str:
    """The wrapper as a regular expression over places: ( )+ repeated, ( )? optional, # a text slot, = a constant."""
    marks = (f"{p[PATH] or '/'}{'#' if p[CONSTANT] is None else '='}" for p in wrapper)
    ends = (("+" if p[REPEATED] else "") + ("?" if p[OPTIONAL] else "") for p in wrapper)
    return " ".join(f"({t}){e}" if e else t for t, e in zip(marks, ends, strict=True))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (as an expression), form (the wrapper's decisions), pages of each host."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One wrapper for each host of the task, in as many parts as keep memory bounded."""
        held: dict[str, list] = {}

        def give() -> pa.RecordBatch:
            rows = [(host, text_hash(d := json.dumps(w)) % SALTS, d, n) for host, (w, n) in held.items()]
            held.clear()
            columns = zip(*rows, strict=True) if rows else [()] * 4
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "salt", "wrapper", "pages"])

        for batch in slices(batches, 200):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                stream = stream_of(blocks_of(page))
                wrapper, n = held.get(host, (None, 0))
                held[host] = (stream if wrapper is None else align(wrapper, stream), n + 1)
            if sum(len(w) for w, _ in held.values()) >= 100 * LONGEST_WRAPPER:
                yield give()
        yield give()

    def united_wrappers(rows: pa.Table) -> tuple[list[list], int]:
        return merged([json.loads(w) for w in sorted(rows.column("wrapper").to_pylist())]), sum(rows.column("pages").to_pylist())

    def partly(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found, n = united_wrappers(rows)
        return pa.table({"host": [key[0].as_py()], "wrapper": [json.dumps(found)], "pages": [n]})

    def wholly(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found, n = united_wrappers(rows)
        return pa.table({"host": [key[0].as_py()], "wrapper": [expression(found)], "form": [json.dumps(decisions(found))], "pages": [n]})

    found = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(streams, "host string, salt int, wrapper string, pages long")
    found = found.groupBy("host", "salt").applyInArrow(partly, "host string, wrapper string, pages long")
    return found.groupBy("host").applyInArrow(wholly, "host string, wrapper string, form string, pages long")


def with_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """``rows`` with the form of their host.  Hosts with many pages get theirs by broadcast, of bounded number and size, so the
    html of those never travels; the others, if there are any, by a join in which no host has a large share."""
    most = forms.orderBy(F.desc("pages"), "host").limit(HEAVY)
    so_far = F.sum(F.octet_length("form")).over(Window.orderBy(F.desc("pages"), "host").rowsBetween(Window.unboundedPreceding, 0))  # HEAVY rows
    heavy = materialise(most.withColumn("so_far", so_far).where(F.col("so_far") <= HEAVY_BYTES).drop("so_far"), "heavy-hosts")
    of = F.broadcast(heavy.select(F.col("host").alias("of"), "form"))
    found = rows.join(of, F.col("host") == F.col("of"), "left")
    if heavy.count() == forms.count():
        return found.drop("of")
    light = forms.join(heavy.select("host"), "host", "left_anti").select(F.col("host").alias("of"), "form")
    rest = rows.join(F.broadcast(heavy.select(F.col("host").alias("of"))), F.col("host") == F.col("of"), "left_anti")
    return found.where("of IS NOT NULL").drop("of").unionByName(rest.join(light, F.col("host") == F.col("of"), "left").drop("of"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    forms = materialise(host_wrappers(pages).select("host", "form", "pages"), "host-forms")
    rows = with_forms(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in slices(batches, 200):
            texts = []
            for page, form in zip(batch.column("html").to_pylist(), batch.column("form").to_pylist(), strict=True):
                if form is not None and form not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[form] = json.loads(form)
                texts.append(main_text(blocks_of(page), known.get(form)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.select("page_id", "url", "html", "form").mapInArrow(run, "page_id long, url string, text string")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op5_html_extract": op5_html_extract}
