"""HTML extraction: the page's own structure, and differencing against the page with the nearest url.

Pages are range-partitioned by host, path and id, so that neighbours meet in one task whatever the
size of a host.  Each page becomes text lines (one per block) that know whether they stand inside an
article and inside something that is never main text (menus, forms, adverts, ...).  It is paired with
the page of the same host whose path shares the longest beginning (the earlier one in a tie), the
lines of both are aligned by their longest common subsequence, and shared lines are deleted.  Inside
the page's own article element whole boxes go: a div, section, list, table or the like, with the
lines that lie in no smaller box, when all of these are shared.  Of what lies in the article itself,
shared lines go by twos and more in a row.  The main heading stays, and a box with it or with most of
the text; nothing outside the article counts as a line of such a row.

Two pages that share most of their text may be copies.  A run of such pages looks beyond the run,
for pages before and after it that it does not share most with.  If its host has no other pages, an
article stays whole, and pages without one are still compared with the nearest that differs: there
short pages in one large frame are likelier.  Pages of equal text delete nothing from each other.
Runs that wait for their end leave memory for a temporary file.

The main text are the lines of the article and main elements if the page has any, else those of the
body, without what is never main text.  Null pages are empty; a page without text gives the empty
string.  Pages without a host pair among themselves.  Unclosed elements and cut-off pages end with
the page; a cut-off tag is no text.  Repeated rows extract alike.  An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import tempfile
from bisect import bisect_left
from dataclasses import dataclass
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encircle.llm.url_filter import url_parts

#: Characters of text after which a task hands over a batch, or puts waiting pages into a file.
BATCH_CHARS = 4 << 20
#: Pages that share more than this part of their text may be copies.
COPY_SHARE = 0.5

#: HTML elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe math menu nav noscript object search "
    "select style script svg template textarea title video".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg".split())
ARTICLE = frozenset(("article", "main"))
#: Boxes inside an article, and its main heading.
BOXES = frozenset("center details dir div dl fieldset figure hgroup ol section table ul".split())
HEADING = "h1"
#: Elements that a following block closes by itself.
AUTO_CLOSED = frozenset("dd dt li option p td th tr".split())
#: Words in class, id and role that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pager "
    "pagination popup promo promoted related replies search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|<(?=[a-zA-Z/!?])[^>]*\Z|<|[^<]+", re.S
)
_MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I | re.S)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[^a-z]+")


@dataclass
class Line:
    text: str
    article: bool
    never: bool
    box: int = 0  # innermost box inside the article, 0 for the article itself
    heading: bool = False


def _never(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NEVER_TEXT:
        return not (tag == "header" and in_article)
    if not attributes or tag in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    return any(
        part in MARKS for found in _MARKED.findall(attributes) for part in _PARTS.split(found.strip("\"'").lower())
    )


def page_lines(page: str | None) -> list[Line]:
    """Text blocks of a page in order, white space collapsed, references decoded."""
    lines: list[Line] = []
    # open elements: name, inside an article, never text, innermost box, inside the main heading
    stack: list[tuple[str, bool, bool, int, bool]] = []
    outside = ("", False, False, 0, False)
    boxes = 0
    text: list[str] = []

    def close_block() -> None:
        joined = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if joined:
            lines.append(Line(joined, *(stack[-1] if stack else outside)[1:]))

    at, end, page = 0, len(page or ""), page or ""
    while at < end:
        token = _TOKEN.match(page, at)
        at = token.end()
        closing, tag, attributes = token.group(1), token.group(2), token.group(3)
        if tag is None:
            if token.group()[0] != "<" or token.group() == "<":
                text.append(token.group())
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag in BLOCKS:
                close_block()
            elif tag == "br":
                text.append(" ")
            continue
        if closing:
            if tag in BLOCKS:
                close_block()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][2] or tag in ARTICLE:
                        close_block()
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            if tag in BLOCKS:
                close_block()
            continue
        _, article, never, box, heading = stack[-1] if stack else outside
        mine = _never(tag, attributes, article)
        if tag in BLOCKS or mine:
            close_block()
            while stack and stack[-1][0] in AUTO_CLOSED and tag in BLOCKS and (stack[-1][0] == tag or stack[-1][0] == "p"):
                stack.pop()
            _, article, never, box, heading = stack[-1] if stack else outside
        if (tag in BLOCKS or mine) and not attributes.endswith("/"):
            if article and tag in BOXES:
                boxes += 1
                box = boxes
            stack.append((tag, article or tag in ARTICLE and not mine, never or mine, box, heading or tag == HEADING))
    close_block()
    return lines


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence; the k-th of equal lines meets the k-th."""

    def numbered(lines: list[str]) -> list[tuple[str, int]]:
        seen: dict[str, int] = {}
        result = []
        for line in lines:
            seen[line] = seen.get(line, -1) + 1
            result.append((line, seen[line]))
        return result

    places = {line: j for j, line in enumerate(numbered(b))}
    tails: list[int] = []  # smallest last place in b of an increasing run of each length
    ends: list[int] = []
    before: dict[int, int | None] = {}
    for i, line in enumerate(numbered(a)):
        j = places.get(line)
        if j is None:
            continue
        k = bisect_left(tails, j)
        before[i] = ends[k - 1] if k else None
        tails[k : k + 1] = [j]
        ends[k : k + 1] = [i]
    found, i = set(), ends[-1] if ends else None
    while i is not None:
        found.add(i)
        i = before[i]
    return found


def _body(lines: list[Line]) -> list[int]:
    own = any(line.article and not line.never for line in lines)
    return [i for i, line in enumerate(lines) if not line.never and (line.article or not own)]


def _shared(lines: list[Line], neighbour: list[Line]) -> set[int]:
    return common_lines([line.text for line in lines], [line.text for line in neighbour])


def may_be_copies(a: list[Line], b: list[Line]) -> bool:
    """Whether each shows most of its main text in the other; a page without text shows no frame."""
    for lines, other in ((a, b), (b, a)):
        body, shared = _body(lines), _shared(lines, other)
        total = sum(len(lines[i].text) for i in body)
        if total and sum(len(lines[i].text) for i in body if i in shared) <= COPY_SHARE * total:
            return False
    return True


def main_text(lines: list[Line], neighbour: list[Line] | None) -> str:
    """Lines of the article or body, without those that the neighbour shows as part of the frame."""
    body = _body(lines)
    if neighbour:
        shared = _shared(lines, neighbour)
        boxes: dict[int, list[int]] = {}
        for i in body:
            if lines[i].article:
                boxes.setdefault(lines[i].box, []).append(i)
        total = sum(len(lines[i].text) for i in body)
        stays = {
            box for box, held in boxes.items()
            if not box or not shared.issuperset(held) or any(lines[i].heading for i in held)
            or sum(len(lines[i].text) for i in held) > COPY_SHARE * total
        }

        def loose(i: int) -> bool:
            line = lines[i] if 0 <= i < len(lines) else None
            return i in shared and line.article and not line.never and not line.box and not line.heading

        frame = {
            i for i in shared
            if not lines[i].article or lines[i].box not in stays or loose(i) and (loose(i - 1) or loose(i + 1))
        }
        if not all(i in shared for i in body):  # else the pages have the same text
            body = [i for i in body if i not in frame]
    return "\n".join(lines[i].text for i in body)


class _Run:
    """Pages of a host one after the other that may be copies of each other, by equal lines.

    A group is its lines and the ``page_id, url, path`` of its pages.  All but the last go to a
    file when they hold more than BATCH_CHARS.
    """

    def __init__(self, host: str | None):
        self.host, self.last = host, None
        self.held, self.groups, self.file = 0, [], None

    def add(self, page: tuple, lines: list[Line]) -> None:
        self.held += len(page[1] or "")
        if self.last and self.last[0] == lines and self.held <= BATCH_CHARS:
            self.last[1].append(page)
            return
        self.held += sum(len(line.text) for line in lines)
        if self.last:
            self.groups.append(self.last)
        if self.held > BATCH_CHARS:
            self.file = self.file or tempfile.TemporaryFile()
            for group in self.groups:
                pickle.dump(group, self.file)
            self.held, self.groups = 0, []
        self.last = (lines, [page])

    def _all(self):
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield pickle.load(self.file)
            self.file.close()
        yield from self.groups
        yield self.last

    def texts(self, earlier: tuple | None, later: tuple | None):
        """``page_id, url, text, n_chars`` of all pages, with the groups before and after the run."""
        before = current = None
        for following in chain(self._all(), [None]):
            if current and (following is None or following[0] != current[0]):
                yield from _settled(current, before, earlier, following, later)
                before = current
            elif current:  # equal lines that were parted by the limit
                yield from _settled(current, before, earlier, None, later)
            current = following


def _settled(group, before, earlier, after, later):
    lines, pages = group
    # a group before gives its last path, one after its first
    others = [(g[0], g[1][k][2]) for g, k in ((before, -1), (earlier, -1), (after, 0), (later, 0)) if g]
    copies = [may_be_copies(lines, other) for other, _ in others]
    article = any(line.article and not line.never for line in lines)
    found: dict[int | None, str] = {}
    for page_id, url, path in pages:
        near = sorted(range(len(others)), key=lambda k: -len(commonprefix([others[k][1], path])))
        best = next((k for k in near if not copies[k]), near[0] if near and not article else None)
        if best not in found:
            found[best] = main_text(lines, others[best][0] if best is not None else None)
        yield page_id, url, found[best], len(found[best])


def _extracted(batches):
    """Pages arrive in the order of host, path and id; a run waits until the next one begins."""

    def rows_of():
        run, earlier = _Run(None), None
        for batch in batches:
            for page_id, url, host, path, source in zip(*(c.to_pylist() for c in batch.columns)):
                lines = page_lines(source)
                if not lines:  # shows no frame to others
                    yield page_id, url, "", 0
                    continue
                if run.last and not (run.host == host and (run.last[0] == lines or may_be_copies(run.last[0], lines))):
                    same = run.host == host
                    yield from run.texts(earlier, (lines, [(page_id, url, path)]) if same else None)
                    run, earlier = _Run(host), run.last if same else None
                run.host = host
                run.add((page_id, url, path), lines)
        if run.last:
            yield from run.texts(earlier, None)

    def batch_of(rows):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "url", "text", "n_chars"])

    rows, held = [], 0
    for row in rows_of():
        rows.append(row)
        held += row[3] + len(row[1] or "")
        if held >= BATCH_CHARS:
            yield batch_of(rows)
            rows, held = [], 0
    yield batch_of(rows)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    slim = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    parts = url_parts("url")
    rows = slim.select("page_id", "url", parts["host"].alias("host"), parts["path"].alias("path"), "html")
    order = ["host", "path", "page_id"]
    near = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return near.mapInArrow(_extracted, "page_id LONG, url STRING, text STRING, n_chars LONG")
