"""HTML extraction by consensus host paths.

Each page is read into its open elements once; text outside links counts for the container it stands in and half for
the one around it, text in links against them. A page's best container votes, in Spark, for its generalised path (tags
and classes from the root on, digits made "#") among the pages of its host; the path of most votes wins (of equal ones
that of the higher total score, then the first by name). Then every page is extracted again: all containers of the
winning path, or the page's own best one where it has none.

Winning paths, one row a host, go to every task while they take no more than ``MAX_BROADCAST_BYTES``, which is counted
first; beyond it pages and paths meet by a shuffle on host.

A page is read in time and memory in proportion to its length: tags are found from one "<" to the next, how an attribute
list with quotes goes on from a sign is worked out once, elements are looked up by tag, and a path is spelled only for the
container that is chosen.

Defined results. A null html has null path and text; html without text in a container has a null path and an empty text.
A null or unreadable url belongs to no host: its page goes by its own best container. Rows that repeat vote and are
extracted each for itself; null page_ids are kept. Pages are read whole, whatever their length, closed or not. Other
columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._text import chunks
from helixmill.session import cut

MAX_BROADCAST_BYTES = 32 << 20
_NAME = re.compile("(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SIGN = re.compile("[>\"']")
#: Characters within which most tags end.
_NEAR = 1000
#: Elements whose content is no markup, and what ends them.
_RAW = re.compile("(?i)(script|style|noscript|template|svg|iframe|textarea|select)\\b")
_RAW_FIRST = frozenset("sntiSNTI")
_RAW_END = {t: re.compile(rf"(?i)</{t}\s*>") for t in "script style noscript template svg iframe textarea select".split()}
_CLASS = re.compile(r"""(?i)\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("body main article section div td blockquote center form fieldset dd".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt table thead tbody tfoot tr th pre address figure figcaption header footer nav aside hr br html".split())
_ASIDE = frozenset("nav footer header aside head title button".split())
#: What an opening tag closes if it is open nearest.
_CLOSES = {t: frozenset({"p"}) for t in _BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "br", "html", "body"}} | {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
_FENCES = frozenset("table ul ol dl div article section main body".split())


def _step(tag: str, attributes: str) -> str:
    m = _CLASS.search(attributes) if attributes else None
    if not m:
        return tag
    names = sorted({re.sub(r"\d+", "#", c) for c in (m[1] or m[2] or m[3] or "").split()})
    return ".".join([tag, *names])


class _Ends:
    """Where the tag ends whose attributes go on at some place: at the first ">" outside of quotes; -1 if nowhere."""

    def __init__(self, source: str):
        self.source = source
        self._known: dict[int, int] = {}  # by the sign that comes next

    def find(self, at: int) -> int:
        source, known, seen = self.source, self._known, []
        end = -1
        while m := _SIGN.search(source, at):
            j = m.start()
            if j in known:
                end = known[j]
                break
            seen.append(j)
            if source[j] == ">":
                end = j
                break
            k = source.find(source[j], j + 1)
            if k < 0:
                break
            at = k + 1
        for j in seen:
            known[j] = end
        return end


def tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag; a comment, a declaration and an element whose content
    is no markup have no name. A "<" that begins none of these is text."""
    ends, at = _Ends(source), 0
    last = source.rfind(">")
    while (i := source.find("<", at)) >= 0:
        at = i + 1
        if i < last and (m := _NAME.match(source, at)):
            if source[at] in _RAW_FIRST and (raw := _RAW.match(source, at)):
                end = _RAW_END[raw[1].lower()].search(source, source.find(">", i) + 1)
                at = end.end() if end else len(source)
                yield i, at, False, "", ""
                continue
            a = m.end()
            j = source.find(">", a, a + _NEAR)
            attributes = source[a:j] if j >= 0 else "'"
            if "'" in attributes or attributes.count('"') & 1:  # else the ">" stands outside of quotes
                j = ends.find(a)
                attributes = source[a:j]
            if j >= 0:
                at = j + 1
                yield i, at, m[1] == "/", m[2].lower(), attributes
        elif source.startswith("<!--", i):
            j = source.find("-->", i + 4)
            at = j + 3 if j >= 0 else len(source)
            yield i, at, False, "", ""
        elif i < last and source.startswith(("<!", "<?"), i):
            at = source.find(">", i) + 1
            yield i, at, False, "", ""


class Page:
    """Containers of a page: path, score, and where their text lies among the page's pieces of text."""

    def __init__(self, source: str):
        self.scores: list[float] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.pieces: list[str] = []
        self._skip: list[bool] = []
        #: Of each container the element; of each element the one around it and its step; of each step its text.
        self._element: list[int] = []
        self._above: list[int] = []
        self._step: list[str] = []
        self._ids: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, int, int, bool]] = []  # tag, element, container, links, aside
        places: dict[str, list[int]] = defaultdict(list)  # by tag, where it is open in the stack
        fences: list[int] = []
        at = 0
        current, links, aside, element = -1, 0, False, -1
        parent: list[int] = []

        def text(s: str) -> None:
            if not s or s.isspace():
                if s and self.pieces and not self.pieces[-1].endswith((" ", "\n")):
                    self.pieces.append(" ")
                    self._skip.append(aside)
                return
            self.pieces.append(s)
            self._skip.append(aside)
            if current >= 0 and not aside:
                n = len(s) if not links else -len(s)
                self.scores[current] += n
                if parent[current] >= 0:
                    self.scores[parent[current]] += n / 2

        def pop(to: int) -> None:
            nonlocal current, links, aside, element
            for tag, _, container, _, _ in stack[to:]:
                places[tag].pop()
                if tag in _FENCES:
                    fences.pop()
                if tag in _CONTAINERS:
                    self.ends[container] = len(self.pieces)
            del stack[to:]
            if stack:
                _, element, current, links, aside = stack[-1]
            else:
                current, links, aside, element = -1, 0, False, -1

        for start, end, closes, tag, attributes in tags(source):
            if start > at:
                text(source[at:start])
            at = end
            if not tag:
                continue
            if tag in _BLOCKS and self.pieces and self.pieces[-1] != "\n":
                self.pieces.append("\n")
                self._skip.append(aside)
            if closes:
                if places[tag]:
                    pop(places[tag][-1])
                continue
            if tag in _CLOSES:
                fence = fences[-1] if fences else -1
                open_ones = [p for t in _CLOSES[tag] if (p := places[t]) and p[-1] > fence]
                if open_ones:  # the nearest; a row closes all of its kinds within the table
                    pop(min(p[bisect_right(p, fence)] for p in open_ones) if tag == "tr" else max(p[-1] for p in open_ones))
            if tag in _VOID or attributes.endswith("/"):
                continue
            key = (element, _step(tag, attributes))
            element = self._ids.setdefault(key, len(self._above))
            if element == len(self._above):
                self._above.append(key[0])
                self._step.append(key[1])
            links += tag == "a"
            aside = aside or tag in _ASIDE
            if tag in _CONTAINERS:
                parent.append(current)
                current = len(self.scores)
                self.scores.append(0.0)
                self.begins.append(len(self.pieces))
                self.ends.append(-1)
                self._element.append(element)
            places[tag].append(len(stack))
            if tag in _FENCES:
                fences.append(len(stack))
            stack.append((tag, element, current, links, aside))
        if at < len(source):
            text(source[at:])
        pop(0)

    def path(self, container: int) -> str:
        steps, element = [], self._element[container]
        while element >= 0:
            steps.append(self._step[element])
            element = self._above[element]
        return ">".join(reversed(steps))

    def of_path(self, path: str) -> list[int]:
        """Containers of a path: each element is compared with its own part of it."""
        size: list[int] = []  # of each element's path where it is the beginning of this one, else -1
        for above, step in zip(self._above, self._step):  # an element comes after the one around it
            begin = 0 if above < 0 else size[above] + 1
            fits = begin == 0 if above < 0 else size[above] >= 0 and path.startswith(">", size[above])
            size.append(begin + len(step) if fits and path.startswith(step, begin) else -1)
        return [i for i, e in enumerate(self._element) if size[e] == len(path)]

    def best(self) -> int:
        """The container of the highest score, the first of equal ones; -1 if none has any."""
        top = max(range(len(self.scores)), key=lambda i: (self.scores[i], -i), default=-1)
        return top if top >= 0 and self.scores[top] > 0 else -1

    def text(self, containers: list[int]) -> str:
        """Their text, asides left out, a line to each block."""
        out, done = [], 0
        for i in containers:
            a, b = max(self.begins[i], done), self.ends[i]
            out += [p for p, skip in zip(self.pieces[a:b], self._skip[a:b]) if not skip]
            out.append("\n")
            done = max(done, b)
        lines = (" ".join(x.split()) for x in _html.unescape("".join(out)).split("\n"))
        return "\n".join(x for x in lines if x)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            found = []
            for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                page = Page(source)
                if (i := page.best()) >= 0:
                    found.append((host, page.path(i), page.scores[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.float64()))], ["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            paths, texts = [], []
            for source, winner in zip(part.column("html").to_pylist(), part.column("path").to_pylist()):
                if source is None:
                    paths.append(None)
                    texts.append(None)
                    continue
                page = Page(source)
                chosen = page.of_path(winner) if winner else []
                if not chosen and (i := page.best()) >= 0:
                    chosen = [i]
                paths.append(page.path(chosen[0]) if chosen else None)
                texts.append(page.text(chosen))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("host"), pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["page_id", "host", "path", "text"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path) by the votes of a host's pages."""
    votes = pages.select("host", "html").filter("host is not null and html is not null").mapInArrow(_votes, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("score") * 2).cast("long").alias("total"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("total"), "path")
    return counted.withColumn("k", F.row_number().over(order)).filter("k = 1").select("host", "path")


def extract(pages: DataFrame, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, text) of every row."""
    host = F.lower(F.regexp_extract("url", "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = pages.select("page_id", "html", F.when(host != "", host).alias("host"))
    winners = cut(winning_paths(pages))
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    winners = winners.select(F.col("host").alias("__host"), "path")
    if size <= max_broadcast_bytes:
        winners = F.broadcast(winners)
    return pages.join(winners, F.col("host") == F.col("__host"), "left").select("page_id", "host", "html", "path").mapInArrow(_extract, "page_id long, host string, path string, text string")
