"""Main text of web pages as the maximum-scoring run of words and tags.

A page is read once into blocks: a sequence of words, which score positive, and tags, which score
negative by a weight learned from labelled pages: the share of the tag's uses that lies outside
the article, times a scale at which the scan finds the marked articles. One linear scan (the
largest sum of a contiguous run) over the whole page gives the content region. Inside the region
elements that are never content (by name, or by a class or id that labelled pages only have
outside their article, never inside or around it) are passed over with all they hold; an element
around the article of a labelled page never is. The words of the other blocks are the text.

Labelled pages are those that mark their article themselves (exactly one ``article`` or
``main`` element). Weights are fitted on at most LABELLED_PAGES of them, chosen by hash; the
region of a page is always found by its scores, also where it has such an element.

Defined results: null and empty pages have empty text. Character references are decoded, white
space inside a block becomes one space, blocks are joined by a line feed, empty blocks vanish.
An unclosed comment or script reaches to the end of the page, an unclosed element to the end tag
of an element around it; p, li, dt, dd, td, th, tr, option and head end where HTML ends them without a tag. A region that lies in passed-over elements gives way to the best run of the other words; a page whose
words all lie in such elements is read again by element names alone. Equal scores keep the
earliest and then the longest region. Repeated rows give repeated results, null keys stay null,
extra columns are ignored. No rows give no rows.
"""

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the pages that weights are fitted on, and uses needed before a class or id counts as learned.
LABELLED_PAGES, LEARNED_USES = 2_000, 20
#: Score of a word, of a tag that is only ever used outside (inside: near zero) and of one the labelled pages lack, before the tags' scale.
WORD, TAG, UNSEEN = 1.0, -1.0, -0.1
#: Scales that the tags' scores are tried at.
SCALES = tuple(2.0 ** k for k in range(-2, 11))

# Element names and the words of class and id names that are not content.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
OUTSIDE = frozenset("nav header footer aside form button dialog menu head figure-menu".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar widget "
    "comment comments commentlist reply replies disqus respond cookie cookies consent notice notices alert gdpr popup "
    "modal overlay newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs nav navbar "
    "navigation menu topbar header footer masthead copyright pagination pager toolbar login search".split())
BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd article section main table thead tbody tfoot tr caption blockquote pre hr "
    "address figure figcaption details summary fieldset legend center body html".split())
SPACE = frozenset("br td th wbr img input".split())
WHOLE = frozenset("html body main article".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
#: Elements with this name or around it hold blocks; an end tag of another name does not reach past them.
_OUTER = BLOCK | OUTSIDE | frozenset("td th".split())
# End tags that may be left out. Start tag to (elements it ends, elements whose inside it does not reach out of).
_CELLS, _GROUPS, _PARAGRAPH = ("td", "th"), ("tbody", "thead", "tfoot"), (("p",), ("table", "td", "th", "caption", "button"))
_LISTS = ("ul", "ol", "menu", "dl", "table", "td", "th", "blockquote", "section", "article", "main", "aside", "nav", "form", "figure", "details")
_ENDS = {n: [_PARAGRAPH] for n in (
    "address article aside blockquote center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section summary table ul").split()}
_ENDS["li"] = [_PARAGRAPH, (("li",), _LISTS)]
_ENDS |= {n: [_PARAGRAPH, (("dd", "dt"), _LISTS)] for n in ("dd", "dt")}
_ENDS |= {n: [(_CELLS, ("table",))] for n in _CELLS}
_ENDS["tr"] = [(("tr", "caption", *_CELLS), ("table",))]
_ENDS |= {n: [(("tr", "caption", *_CELLS, *_GROUPS), ("table",))] for n in _GROUPS}
_ENDS |= {"option": [(("option",), ("datalist",))], "optgroup": [(("option", "optgroup"), ("datalist",))]}
# an end tag of these stays within the innermost of the others
_WITHIN = {"li": ("ul", "ol", "menu"), "p": _PARAGRAPH[1], "dd": ("dl",), "dt": ("dl",)} | dict.fromkeys(("tr", *_CELLS, *_GROUPS), ("table",))
_IN_HEAD = frozenset("html head meta link base".split())
_PARTS, _ABOUT = re.compile("[-_]+").split, frozenset("has no with without is js".split())


def _keys(name, attrs):
    """What a tag is known by: its name, and the words of its class, id and role."""
    keys = [name]
    if attrs and "=" in attrs:
        for m in _NAMES.finditer(attrs):
            for w in (m[1] or m[2] or m[3] or "").lower().split():
                parts = _PARTS(w)
                # main-menu and ad-slot say what they are, has-sidebar and content-with-sidebar do not
                keys += ["." + k for k in dict.fromkeys((w, parts[0], parts[-1]) if _ABOUT.isdisjoint(parts) else (w,))]
    return keys


def events(page: str):
    """("text", s), ("open", name, keys) and ("close", name) in page order; raw elements are left out."""
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            yield "text", "<"
            at = lt + 1
            continue
        name, at = m[1].lower(), m.end()
        if page[lt + 1] == "/":
            yield "close", name
        elif name in RAW:
            end = _CLOSE[name].search(page, at)
            at = n if end is None else end.end()
        else:
            yield "open", name, _keys(name, m[2]), m[2].rstrip().endswith("/")


class Open:
    """The open elements of a page as (name, event number), outermost first."""

    def __init__(self):
        self.stack, self.at, self.outer = [], {}, []

    def _cut(self, i):
        while len(self.stack) > i:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in _OUTER:
                self.outer.pop()

    def _last(self, names):
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def start(self, name):
        """End the elements whose end tags may be left out before this start tag."""
        if self.at.get("head") and name not in _IN_HEAD:
            self._cut(self.at["head"][-1])
        for ended, within in _ENDS.get(name, ()):
            low = self._last(within)
            at = [self.at[n][-1] for n in ended if self.at.get(n) and self.at[n][-1] > low]
            if at:
                self._cut(min(at))

    def open(self, name, number):
        self.at.setdefault(name, []).append(len(self.stack))
        if name in _OUTER:
            self.outer.append(len(self.stack))
        self.stack.append((name, number))

    def close(self, name, skipped=-1):
        """End the innermost element of this name and what it holds; only a block's end tag, or that
        of the element at ``skipped``, ends blocks."""
        at = self.at.get(name)
        if not at or name in ("html", "body") or at[-1] < self._last(_WITHIN.get(name, ())):
            return
        if name in _OUTER or at[-1] == skipped or not self.outer or self.outer[-1] < at[-1]:
            self._cut(at[-1])


def _outside(keys, learned):
    if keys[0] in WHOLE:
        return False
    return keys[0] in OUTSIDE or any(k[1:] in BOILERPLATE or k in learned for k in keys[1:])


def _root(page):
    """The name of the one element that marks the article, or None."""
    low = page.lower()
    return next((r for r in ("article", "main") if len(re.findall(rf"<{r}[\s>]", low)) == 1), None)


def _around(page, root):
    """Event numbers of the elements around the article, or None if it never opens."""
    tree = Open()
    for n, e in enumerate(events(page)):
        if e[0] == "close":
            tree.close(e[1])
        elif e[0] == "open":
            tree.start(e[1])
            if e[1] == root:
                return {k for _, k in tree.stack}
            if e[1] not in VOID and not e[3]:
                tree.open(e[1], n)
    return None


def tag_uses(page: str):
    """Key to (uses inside, outside and around the article) of a page that marks one article, else nothing."""
    root = _root(page)
    around = None if root is None else _around(page, root)
    if around is None:
        return {}
    uses, tree, held = {}, Open(), None
    for n, e in enumerate(events(page)):
        if e[0] == "close":
            tree.close(e[1])
        elif e[0] == "open":
            tree.start(e[1])
            if held is not None and len(tree.stack) <= held:
                held = math.inf
            if e[1] == root:
                held = len(tree.stack)
            else:
                # the article ends with its own end tag or with that of an element around it
                inside = held is not None and len(tree.stack) > held
                for k in set(e[2]):
                    uses.setdefault(k, [0, 0, 0])[2 if n in around else 0 if inside else 1] += 1
            if e[1] not in VOID and not e[3]:
                tree.open(e[1], n)
        if held is not None and len(tree.stack) <= held:
            held = math.inf
    return uses


def weights(pages: DataFrame, page_id="page_id", page="html", limit=LABELLED_PAGES):
    """(tag weights, learned boilerplate classes) from at most ``limit`` labelled pages.

    Uses are counted on the executors and added up per key; keys are bounded by the sample. A second pass counts,
    for every scale, the pages whose marked article the scan alone finds; tags weigh by the scale that finds most
    (the middle one of several).
    """
    def run(batches):
        for b in batches:
            total = {}
            for t in b.column(0):
                for k, n in tag_uses(t.as_py() or "").items():
                    total[k] = [a + b for a, b in zip(total.get(k, (0, 0, 0)), n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), *(pa.array([v[j] for v in total.values()], pa.int64()) for j in range(3))],
                ["key", "i", "o", "h"])

    marked = pages.where(F.col(page).rlike("(?i)<(article|main)[\\s>]"))
    # ids are chosen first, so that no task gathers pages of all others
    chosen = marked.select(F.xxhash64(page_id).alias("_h"), page_id).orderBy("_h", page_id).limit(limit).select(page_id)
    sample = marked.join(F.broadcast(chosen), page_id, "left_semi").select(page)
    rows = sample.repartition(8).mapInArrow(run, "key string, i long, o long, h long").groupBy("key").agg(*[F.sum(c).alias(c) for c in "ioh"]).collect()
    tags = {r["key"]: TAG * r["o"] / (r["i"] + r["o"]) for r in rows if not r["key"].startswith(".") and r["i"] + r["o"]}
    learned = {r["key"] for r in rows if r["key"].startswith(".") and r["i"] == r["h"] == 0 and r["o"] >= LEARNED_USES}

    def tried(batches):
        for b in batches:
            found = [0] * len(SCALES)
            for t in b.column(0):
                blocks = _blocks(t.as_py() or "", tags, learned)
                if any(marked for *_, marked in blocks):
                    found = [n + finds_article(blocks, scale) for n, scale in zip(found, SCALES)]
            yield pa.RecordBatch.from_arrays([pa.array(SCALES, pa.float64()), pa.array(found, pa.int64())], ["scale", "n"])

    if not tags:
        return tags, learned
    found = {r["scale"]: r["n"] for r in sample.repartition(8).mapInArrow(tried, "scale double, n long").groupBy("scale").agg(F.sum("n").alias("n")).collect()}
    best = sorted(k for k, n in found.items() if n == max(found.values()))
    scale = best[(len(best) - 1) // 2] if best and found[best[0]] else 1.0
    return {k: scale * w for k, w in tags.items()}, learned


def _blocks(page, tags, learned, outside=_outside):
    """Blocks of a page: (text, tag score before it, tag score within it, words, in a passed-over element, in the marked article)."""
    out, run, tree = [], [], Open()
    before = within = pending = 0.0
    state = (False, False)
    skip = held = None
    root = _root(page)
    around = _around(page, root) or () if root else ()

    def flush():
        nonlocal run, before, within, pending
        words = html.unescape("".join(run)).split() if run else []
        if words:
            out.append((" ".join(words), before, within, len(words), *state))
        else:
            pending += before + within
        run, before, within = [], 0.0, 0.0

    for n, e in enumerate(events(page)):
        if e[0] == "text":
            if e[1].isspace():
                run.append(e[1])
                continue
            now = (skip is not None, held is not None and len(tree.stack) > held)
            if now != state:
                flush()
                state = now
            if any(not r.isspace() for r in run):
                within += pending
            else:
                before += pending
            pending = 0.0
            run.append(e[1])
            continue
        name, holds = e[1], e[0] == "open" and e[1] not in VOID and not e[3]
        if e[0] == "close":
            tree.close(name, -1 if skip is None else skip)
        else:
            tree.start(name)
        if skip is not None and len(tree.stack) <= skip:
            skip = None
        if held is not None and len(tree.stack) <= held:
            held = math.inf
        passed = holds and skip is None and n not in around and outside(e[2], learned)
        if passed or name in BLOCK:
            flush()
        elif name in SPACE:
            run.append(" ")
        if e[0] == "open" and name == root and held is None:
            held = len(tree.stack)
        if holds:
            tree.open(name, n)
        if passed:
            skip = len(tree.stack) - 1
        pending += tags.get(name, UNSEEN)
    flush()
    return out


def _outside_by_name(keys, learned):
    return keys[0] in OUTSIDE and keys[0] != "form"


def _region(blocks, scale=1.0, words=None):
    """[start, end) of the contiguous run of blocks with the largest sum; the tags before its first block do not count."""
    best, best_at, total, start = -math.inf, (0, 0), 0.0, 0
    for i, (_, before, within, n, passed, _) in enumerate(blocks):
        total += scale * before
        if i == 0 or total <= 0:
            total, start = 0.0, i
        total += scale * within + WORD * (n if words is None else words(n, passed))
        if total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def finds_article(blocks, scale):
    """Whether the scan alone finds the marked article: all its blocks (passed-over ones may miss) and none else."""
    start, end = _region(blocks, scale)
    return all((start <= i < end) if marked and not passed else marked or not start <= i < end
               for i, (_, _, _, _, passed, marked) in enumerate(blocks))


def main_text(page: str, tags: dict, learned: set) -> str:
    """Text of the best contiguous run of blocks, without the passed-over elements in it."""
    for outside in (_outside, _outside_by_name):
        blocks = _blocks(page, tags, learned, outside)
        # where the best run holds nothing but passed-over elements, their words score nothing
        for words in (None, lambda n, passed: 0 if passed else n):
            start, end = _region(blocks, words=words)
            kept = [b[0] for b in blocks[start:end] if not b[4]]
            if kept:
                return "\n".join(kept)
    return ""


def extract(pages: DataFrame, page_id="page_id", url="url", page="html", fitted=None) -> DataFrame:
    """page_id, url, text and n_chars of every page. ``fitted``: weights of other pages, else fitted here."""
    tags, learned = fitted or weights(pages, page_id, page)

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py() or "", tags, learned) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
