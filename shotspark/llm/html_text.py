"""Main text of web pages by equivalence-class template deduction.

A page is read as a sequence of tokens: opened elements with their path, and text blocks with
their path. Over all pages of a host, each token has an occurrence vector (how often it stands in
each page); tokens with the same vector form an equivalence class. Pages of a host with the same main
text (article, else main element, else all text) are one page here, so copies have one vote. Vectors
are compared by their support and the combined hash of (page, count), so no vector is ever gathered. A class is valid
if it covers at least half of the host's pages (and MIN_PAGES of them) and its tokens come in the
same order everywhere. The tokens of all valid classes by position are the host's template (which
class stands within which is not kept); the blocks between its tokens are the slots.

The text of a page are the slots of its article. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments are regions that hold no text, by element or role. A class
or id only hints at such a region: the host's template has to hold the element too; on a host without
a template (fewer than MIN_PAGES pages) the hint decides. Names of reader comments decide by themselves,
since a page may be the only one of its host that readers have answered. Names with digits belong to a
page and are no part of a path. Text blocks (articles, headings, paragraphs,
tables, inline elements) are never left out by name. The article is told by its element, else the main element, else the whole body counts.
Blocks of the template are left out there too, unless nothing of an article or main element would
be left.

A block is the text between the bounds of block elements; character references are decoded, white
space becomes one space, inline elements and line breaks do not end a block.

Cases: null and empty pages have no text; pages without a readable host share one host; rows may
repeat; broken markup is read as far as it goes (elements that are never closed end with their
parent); an empty table gives an empty result. Only page_id, url and html are read, so further
columns cannot clash.
"""

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotspark.llm.common import slices, stored, table

MIN_PAGES = 3  # pages that a template token stands in at least
SHARE = 0.5  # share of the host's pages that it stands in at least
TOKEN = pa.struct([("role", pa.int64()), ("n", pa.int64()), ("at", pa.int64())])

# Element kinds of the HTML standard (fixed values).
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
NO_TEXT = set(
    "nav footer aside form button select textarea dialog template noscript iframe object svg canvas audio video map "
    "menu script style head title noembed noframes".split()
)
NO_TEXT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold the text itself: their class and id say nothing about boilerplate.
TEXT_BLOCKS = HEADINGS | INLINE | set(
    "html body main article p pre blockquote figure figcaption table caption thead tbody tfoot tr td th dl dt dd hgroup details summary".split()
)
#: An element that opens closes these, up to one of the second list.
CLOSES = {
    "li": (["li"], ["ul", "ol", "menu"]), "dt": (["dt", "dd"], ["dl"]), "dd": (["dt", "dd"], ["dl"]),
    "tr": (["tr"], ["table"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]),
    "option": (["option"], ["select"]),
}

NAMED = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|post|article|blog|user|reader|side|web|left|right)[-_]?)?"
    r"(?:nav|navigation|navbar|menu|header|masthead|footer|sidebar|aside|ads?|advert|adverts|advertisement|sponsor|sponsored|"
    r"banner|cookie|cookies|consent|notice|popup|modal|overlay|comments?|commentlist|replies|disqus|respond|promo|promotion|"
    r"share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|subscribe|subscription|newsletter|signup|login|"
    r"search|widget|toolbar|skip|copyright)"
    r"(?:[-_]?(?:bar|list|box|wrap|wrapper|container|section|area|block|inner|links?|banner|notice|popup|form|slot|unit|top|"
    r"bottom|left|right|message|panel|thread|items?|content|posts?|articles?|\d+))*"
)
#: Names of reader comments, which need no other page of the host to say so.
COMMENTS = re.compile(
    r"(?:(?:post|article|blog|user|reader|site|page|main|wp)[-_]?)?(?:comments?|commentlist|commentary|replies|disqus|respond|discussion)"
    r"(?:[-_]?(?:list|box|wrap|wrapper|container|section|area|block|inner|thread|threads|items?|content|body|text|form|respond|\d+))*"
)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""",
    re.S,
)
DIGIT = re.compile(r"\d")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")


class Element:
    __slots__ = ("name", "path", "dead", "article", "main", "header", "named")

    def __init__(self, name, path, dead, article, main, header, named=()):
        self.name, self.path, self.dead = name, path, dead
        self.article, self.main, self.header, self.named = article, main, header, named


def _attributes(text: str) -> dict:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text.strip() else {}


def _without_text(name: str, attributes: dict) -> bool:
    if name in ("html", "body", "main"):
        return False
    if name in NO_TEXT:
        return True
    if not attributes:
        return False
    if attributes.get("role", "").lower() in NO_TEXT_ROLES or "hidden" in attributes:
        return True
    return attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _names(name: str, attributes: dict) -> list[str]:
    """Class and id names, where they can tell boilerplate."""
    if name in TEXT_BLOCKS or not attributes:
        return []
    return (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split()


def _named(name: str, attributes: dict) -> bool:
    """Class or id hint at boilerplate."""
    return any(NAMED.fullmatch(n) for n in _names(name, attributes))


def _answers(name: str, attributes: dict) -> bool:
    """Class or id name reader comments."""
    return any(COMMENTS.fullmatch(n) for n in _names(name, attributes))


def tokens(page: str | None):
    """Tokens in page order: ("open", path) and ("text", path, text, article, main, named); text without
    a place in the main text is left out, its elements are not. ``named`` has the paths of the elements
    around the text whose class or id hints at boilerplate."""
    source = page or ""
    stack = [Element("", "", False, False, False, False)]
    out, text = [], []

    def flush():
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            top = stack[-1]
            if block and not top.dead and not (top.header and top.name not in HEADINGS):
                out.append(("text", top.path, block, top.article, top.main, top.named))

    def pop_to(i):
        del stack[i:]

    at = 0
    while True:
        m = MARKUP.search(source, at)
        if m is None:
            text.append(source[at:])
            break
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = m[1] or m[4], m[3] or m[6] or ""
        if name in INLINE and not rest.strip():
            if name == "br":
                text.append(" ")
            continue
        inline = name in INLINE
        if closing:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if not inline:
                flush()
            elif found:
                flush()
            if found:
                pop_to(found)
            continue
        attributes = _attributes(rest)
        dead = _without_text(name, attributes) or _answers(name, attributes)
        if inline and not dead:
            if name == "br":
                text.append(" ")
            continue
        flush()
        top = stack[-1]
        if not inline and top.name == "p":
            pop_to(len(stack) - 1)
        elif not inline and name in CLOSES:
            closed, bounds = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in bounds:
                    break
                if stack[i].name in closed:
                    pop_to(i)
                    break
        top = stack[-1]
        own = [f".{n}" for n in sorted(attributes.get("class", "").split())] + [f"#{n}" for n in attributes.get("id", "").split()]
        marks = "".join(n for n in own if not DIGIT.search(n))  # numbered names belong to a page
        path = f"{top.path}/{name}{marks}"
        out.append(("open", path))
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in VOID or rest.endswith("/"):
            continue
        stack.append(
            Element(
                name, path, (top.dead or dead) and name != "main", top.article or (name == "article" and not top.dead),
                top.main or name == "main" or attributes.get("role", "").lower() == "main",
                top.header or name == "header",
                () if name == "main" else (*top.named, path) if _named(name, attributes) else top.named,
            )
        )
    flush()
    return out


def role(token) -> int:
    """Number of a token's place and text, as a signed 64-bit value."""
    v = xxhash.xxh64_intdigest("\0".join(token[:3]).encode("utf-8", "surrogatepass"))
    return v - (1 << 64) if v >= 1 << 63 else v


def host_of(url) -> F.Column:
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))


def deduce_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """host, template (token roles in page order) of each host that has one."""

    def occurrences(batches):
        """Host, hash of the main text and occurring tokens (role, count, first position) of each page."""
        for whole in batches:
            for batch in slices(whole, "html"):
                contents, tables = [], []
                for source in batch.column("html").to_pylist():
                    found, counts = tokens(source), {}
                    for i, t in enumerate(found):
                        counts.setdefault(role(t), [0, i])[0] += 1
                    contents.append(role(["\0".join(t[2] for t in main_blocks(found))]))
                    tables.append([{"role": r, "n": n, "at": i} for r, (n, i) in sorted(counts.items())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("host"), pa.array(contents, pa.int64()), pa.array(tables, pa.list_(TOKEN))],
                    ["host", "content", "tokens"],
                )

    rows = _pages(pages).select("host", "html").mapInArrow(
        occurrences, "host string, content long, tokens array<struct<role: long, n: long, at: long>>"
    )
    # copies count once, so that they cannot make their own text a template
    once, _ = stored(rows.groupBy("host", "content").agg(F.min("tokens").alias("tokens")), "contents")
    sizes = once.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("pages"))
    vectors, _ = stored(
        once.select("host", "content", F.explode("tokens").alias("t"))
        .groupBy("host", F.col("t.role").alias("role"))
        .agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("content", "t.n")).alias("mark"),
            F.min("t.at").alias("low"), F.max("t.at").alias("high"),
        ),
        "vectors",
    )
    often = vectors.filter(F.col("n") >= min_pages).join(
        sizes, (F.col("host") == F.col("_host")) & (F.col("n") >= F.col("pages") * share)
    )
    # tokens of a host that stand in half of its pages are no more than twice the tokens of a page
    classes = often.groupBy("host", "n", "mark").agg(F.array_sort(F.collect_list(F.struct("low", "high", "role"))).alias("t"))
    ordered = F.forall(
        F.sequence(F.lit(1), F.size("t")),
        lambda i: (i == F.size("t")) | F.coalesce(F.get("t", i - 1)["high"] <= F.get("t", i)["high"], F.lit(True)),
    )
    return (
        classes.filter(ordered)
        .groupBy("host")
        .agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
        .select("host", F.transform("t", lambda x: x["role"]).alias("template"))
    )


def main_blocks(found: list, template=frozenset()) -> list:
    """Text blocks of the article, else of the main element, else all. Elements whose names hint at
    boilerplate are left out if the host's template has them, or if there is none to ask."""
    asked: dict = {}

    def confirmed(path):
        if path not in asked:
            asked[path] = not template or role(("open", path)) in template
        return asked[path]

    blocks = [t for t in found if t[0] == "text" and not any(map(confirmed, t[5]))]
    for inside in (3, 4):
        region = [t for t in blocks if t[inside]]
        if region:
            return region
    return blocks


def main_text(found: list, template: set) -> str:
    """Text of the slots between the template's tokens: of the article, else of main, else of all."""
    blocks = main_blocks(found, template)
    chosen = [t for t in blocks if role(t) not in template]
    if not chosen and blocks and (blocks[0][3] or blocks[0][4]):
        chosen = blocks  # an article or main element keeps its text when all of it is shared
    return "\n".join(t[2] for t in chosen)


def extract_text(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    joined = _pages(pages).join(templates, "host", "left").select("page_id", "url", "html", "template")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType())])

    def extract(batches):
        for whole in batches:
            for batch in slices(whole, "html"):
                rows = zip(batch.column("html").to_pylist(), batch.column("template").to_pylist())
                texts = [main_text(tokens(source), set(template or ())) for source, template in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    return joined.mapInArrow(extract, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    pages = table(spark, sf_dir, "pages")
    templates, _ = stored(deduce_templates(pages), "templates")
    return extract_text(pages, templates).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
