"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of text between block-level tags, with the open tags above them. Broken markup is read
as browsers do in the usual cases: a block tag closes an open paragraph, an end tag closes what is open inside its element,
unknown end tags are ignored, and what is never closed ends with the page. Scripts, styles, comments and declarations hold
no text. A block's features are its ancestors' tags, the words of their class, id and role attributes, and shapes of its text;
neighbouring blocks are linked, and the best labelling is found by Viterbi.

The field is fitted on labelled pages: at most TRAIN_PAGES pages, drawn by a hash of page_id, whose blocks are labelled by the
document that the url names (long blocks whose text is part of the document, and other blocks under the same parents), and
SEEDS, small pages in usual layouts with menus, sidebars, notices, adverts, forms and reader comments.

Defined cases: a null html is empty; a page without blocks has an empty text; a page without markup is one block; character
references are decoded, a title element is no block, white space (no-break spaces too) becomes one space; pages of any length are read whole; a null url
or page_id is returned as it is; repeated rows are treated alike; an empty table gives no rows; other columns are ignored.
"""

import html as entities
import itertools
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postmill.llm import crf
from postmill.llm.registry import query, table
from postmill.llm.urltree import host_and_path

TRAIN_PAGES = 300
TRAIN_CHARS = 200_000
#: Blocks from this many characters on are labelled by the document.
LONG = 25
TEXTS = "page_id long, url string, text string"

#: Where markup may begin, a comment or declaration, and a tag.
LEAD, DECLARED = re.compile(r"<(?:[!?]|/?[a-zA-Z])"), re.compile(r"<[!?]")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Fixed values of HTML: elements without content, elements whose content is not text, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is never markup, up to their end tag or the page's end; and others that are left out, up to their end
#: tag: those of the first kind of these end at a block tag too, the others do if they are never closed.
HIDDEN = frozenset("title script style iframe noscript".split())
DRAWN, INERT = frozenset(("svg", "math")), frozenset(("object", "template"))
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td textarea tfoot th thead tr ul".split())
AROUND_P = BLOCK - {"p"}
#: An opening tag closes these open ones, as far as the nearest element of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}


class Path:
    """An open element with those around it, root first when iterated over as (tag, words of attributes). Paths that are equal
    are one object within a page; tags and words are those of the whole path."""

    __slots__ = ("up", "tag", "own", "tags", "words", "below")

    def __init__(self, up=None, tag="", own=frozenset()):
        self.up, self.tag, self.own, self.below = up, tag, own, {}
        if up is None:
            self.tags = self.words = frozenset()
        else:
            self.tags = up.tags if tag in up.tags else up.tags | {tag}
            self.words = up.words if own <= up.words else up.words | own

    def down(self, tag, own):
        if (tag, own) not in self.below:
            self.below[tag, own] = Path(self, tag, own)
        return self.below[tag, own]

    def __iter__(self):
        out, path = [], self
        while path.up is not None:
            out.append((path.tag, path.own))
            path = path.up
        return reversed(out)


def _end_of(tag, page, at, missing):
    """Where the content of an element that is left out ends; `missing` remembers tags without a further end tag."""
    end = None
    if tag in DRAWN:
        end = re.compile(rf"</{tag}\s*>|(?=<(?:{'|'.join(sorted(BLOCK))})[\s/>])", re.I).search(page, at)
    elif tag not in missing:
        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
        if end is None:
            missing.add(tag)
    if end is None and tag in INERT:
        end = re.compile(rf"(?=<(?:{'|'.join(sorted(BLOCK))})[\s/>])", re.I).search(page, at)
    return end.end() if end else len(page)


def blocks(page):
    """[(path, text, characters in links)] of the leaf blocks in page order; path is a Path."""
    out, stack, parts, linked = [], [Path()], [], 0
    places, missing = {}, set()  # where in the stack each tag is open; tags that have no further end tag

    def close():
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((stack[-1], text, linked))
        parts, linked = [], 0

    def add(text):
        nonlocal linked
        parts.append(text)
        if places.get("a"):
            linked += len(text)

    def pop(wanted, until):
        """Close the innermost of the wanted elements, unless one of `until` is nearer."""
        def last(tags):
            return max((places[tag][-1] for tag in tags if places.get(tag)), default=0)

        place = last(wanted)
        if place and place > last(until):
            for path in stack[place:]:
                places[path.tag].pop()
            del stack[place:]

    at, size = 0, len(page)
    ends = page.rfind(">") + 1  # no tag goes beyond the last of these
    while at < size:
        lead = LEAD.search(page, at)
        start = lead.start() if lead else size
        if start > at:
            add(page[at:start])
        if not lead:
            break
        if page[start + 1] in "!?":
            stop = page.find("-->", start + 4) if page.startswith("<!--", start) else page.find(">", start)
            at = size if stop < 0 else page.index(">", stop) + 1
            continue
        if start >= ends:
            declared = DECLARED.search(page, start)
            add(page[start:declared.start() if declared else size])
            break
        found = TAG.match(page, start)
        at, tag = found.end(), found[2].lower()
        if found[1]:
            if tag in BLOCK:
                close()
            pop({tag}, {"body", "html"} if tag not in ("body", "html") else set())
        elif tag in HIDDEN or tag in DRAWN or tag in INERT:
            if not found[3].endswith("/"):
                at = _end_of(tag, page, at, missing)
        elif tag == "br" or tag in VOID:
            if tag == "hr":
                close()
            add(" ")
        else:
            if tag in BLOCK:
                close()
                if places.get("p"):
                    pop({"p"}, AROUND_P)
                if tag == "body":
                    pop({"head"}, set())
                elif tag in CLOSES:
                    pop(*CLOSES[tag])
            words = frozenset(w for _, value in ATTRIBUTE.findall(found[3]) for w in re.split(r"[^a-z]+", value.lower()) if w)
            if not found[3].endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                stack.append(stack[-1].down(tag, words))
    close()
    return out


def features(path, text, linked):
    """Features of one block."""
    words, n = text.split(), len(text)
    out = [f"t:{tag}" for tag in path.tags] + [f"w:{w}" for w in path.words]
    out += [f"own:{path.tag}", f"up:{path.up.tag if path.up else ''}", f"words:{min(len(words), 40).bit_length()}",
            f"links:{min(9, 10 * linked // max(n, 1))}", f"end:{text[-1] in '.!?:;'}"]
    return out + ["sign"] if "©" in text else out


def _chain(page):
    got = blocks(page)
    return got, [features(*block) for block in got]


def main_text(page, model):
    """The main text of one page."""
    weights, bias, trans = model
    got, own = _chain(page or "")
    states = crf.viterbi([bias + sum(weights.get(f, 0.0) for f in block) for block in own], trans)
    return "\n\n".join(text for (_, text, _), s in zip(got, states) if s)


#: Layouts of the labelled seed pages: (opening tags, closing tags, kind of text, is main text).
SEED_PARTS = {
    "before": [('<nav class="menu"><ul>', "</ul></nav>", "links", 0), ('<header class="site-header"><div class="logo">', "</div></header>", "short", 0),
               ('<div id="cookie-notice" class="notice banner">', "</div>", "text", 0), ('<div class="ad advert sponsored">', "</div>", "text", 0),
               ('<div class="breadcrumb">', "</div>", "links", 0), ('<form class="search"><label>', "</label><button>Go</button></form>", "short", 0),
               ('<header><h1>', "</h1></header>", "short", 0), ('<div class="navbar navigation topbar">', "</div>", "links", 0)],
    "main": [("<article><h1>", "</h1>{body}</article>", "short", 1), ('<main><div class="content post entry"><h1>', "</h1>{body}</div></main>", "short", 1),
             ('<div id="content" class="article main"><h2>', "</h2>{body}</div>", "short", 1), ('<main><article><header><h1>', "</h1></header>{body}</article></main>", "short", 1),
             ("<section class=\"story text\"><h1>", "</h1>{body}</section>", "short", 1)],
    "after": [('<aside class="sidebar related"><h3>Related</h3><ul>', "</ul></aside>", "links", 0), ('<aside class="widget">', "</aside>", "text", 0),
              ('<section id="comments" class="comments"><h3>Comments</h3><div class="comment reply"><p>', "</p></div></section>", "text", 0),
              ('<ul class="comment-list"><li class="comment"><p>', "</p></li></ul>", "text", 0), ('<form class="newsletter subscribe"><p>', '</p><input><button>Send</button></form>', "text", 0),
              ('<div class="share social">', "</div>", "links", 0), ('<div class="ad promo banner">', "</div>", "text", 0),
              ('<footer class="footer">&copy; ', "</footer>", "text", 0), ('<div class="footer copyright legal">', "</div>", "text", 0),
              ('<div class="popup modal notice consent"><p>', "</p></div>", "text", 0)]}


def seeds(count=120):
    """Labelled pages as [(features of each block, marks)], made from SEED_PARTS in a fixed order."""
    rng, out = random.Random(7), []
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    mains = itertools.cycle(SEED_PARTS["main"])
    for _ in range(count):
        page = "<!DOCTYPE html><html><head><title>" + sentence(4) + "</title></head><body>"
        parts = rng.sample(SEED_PARTS["before"], 3) + [next(mains)] + rng.sample(SEED_PARTS["after"], rng.randint(1, 5))
        for opening, closing, kind, main in parts:
            wrapped = "".join(f"<p>{sentence(rng.randint(3, 40))}</p>" for _ in range(rng.randint(1, 4)))
            text = {"short": sentence(5)[:-1], "text": wrapped if rng.random() < 0.6 else sentence(rng.randint(6, 40)),
                    "links": "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(5))}[kind]
            mark = "⁣" if main else ""  # an invisible mark in the text of main blocks
            body = "".join(f"<{t}>{mark}{sentence(rng.choice([1, 3, 12, 40]))}</{t}>" for t in rng.choices(["p", "p", "p", "li", "h2", "blockquote"], k=rng.randint(2, 8)))
            page += opening + mark + text + closing.replace("{body}", body)
        got = blocks(page + "</body></html>")
        marks = [int("⁣" in text) for _, text, _ in got]
        got = [(path, text.replace("⁣", ""), linked) for path, text, linked in got]
        out.append(([features(*block) for block in got], marks))
    return out


def labelled(page, document):
    """(features, marks) of a page whose main text is known from a document, or None if nothing of it is found."""
    got, own = _chain(page)
    whole = " ".join(document.split())
    found = [len(text) >= LONG and text in whole for _, text, _ in got]
    parents = {path.up or path for (path, _, _), yes in zip(got, found) if yes}
    marks = [int(yes or (len(text) < LONG and (path.up or path) in parents)) for (path, text, _), yes in zip(got, found)]
    return (own, marks) if any(marks) else None


def training_pages(pages: DataFrame, documents: DataFrame, count=TRAIN_PAGES, chars=TRAIN_CHARS):
    """[(html, text)] of at most `count` pages with the document that their url names."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, r"(\d{1,18})(\.\w+)?/?$", 1)
    order = F.xxhash64("page_id", "url")
    drawn = pages.where(F.length("html") <= chars).select(
        "html", F.when(number != "", number.cast("long")).alias("_doc"), order.alias("at")).where("_doc IS NOT NULL").orderBy(
        "at", "_doc").limit(count)
    texts = documents.select(F.col("doc_id").cast("long").alias("_doc"), "text").where(F.length("text") <= chars)
    # One text for each drawn page: a bounded number of bounded rows.
    rows = texts.join(F.broadcast(drawn), "_doc").groupBy("_doc", "at", "html").agg(F.min("text").alias("text")).collect()
    return [(r["html"], r["text"]) for r in sorted(rows, key=lambda r: (r["at"], r["_doc"], r["text"]))]


def fit(pages):
    """A model from [(html, text of the document)] and the seed pages."""
    known = [x for page, text in pages if (x := labelled(page, text))]
    return crf.fit(known + seeds(), steps=150)


def extract(pages: DataFrame, model) -> DataFrame:
    """page_id, url and text per page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # bounded by the training pages

    def extract_part(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [main_text(page.as_py(), sent.value) for page in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract_part, TEXTS)


@query("op10_main_text")
def op10(spark, sf_dir):
    """Extracts the main text of all pages with a model fitted on a sample of them."""
    pages = table(spark, sf_dir, "pages")
    model = fit(training_pages(pages, table(spark, sf_dir, "documents")))
    return extract(pages, model).withColumn("n_chars", F.length("text").cast("long"))
