"""Main body of web pages (problem 4).

Method: layout-aware rendering. A tree builder turns a page into a tree of boxes. HTML is read with
implied end tags; text that a crawler already flattened has lost its tags, so each line is given the
tag that its layout implies (link bar, breadcrumb, menu, related list and its entries, notice, page
tool, legal line, heading, list item, paragraph), and the boxes open and close by the same rules: a
run of menu words is one navigation box, a related heading opens a list that lasts as long as its
entries do, a notice takes in the buttons below it. Visibility rules then hide navigation, related
lists, notices, tools and footers, and the renderer emits all visible text with block spacing, list
markers and aligned table cells.

Defined cases: null and empty fields have no lines; blank lines have no row; a menu word that may
be a heading stays where it stands alone between other lines; a page that is all boilerplate has an empty body;
repeated rows repeat their result; lines are those of split by "\\n", counted from 1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of navigation menus.
MENU = frozenset(
    w.casefold()
    for w in """Home|Careers|Jobs|About us|About|Contact|Contact us|Locations|News|Press|Blog|Students|Graduates|Investors|Benefits|Teams|Life here|My profile|Profile|Search jobs|Log in|Login|Sign in|Sign up|Create account|Register|FAQ|Help|Support|Menu|Products|Services|Company|Culture|Our story|Newsroom|Partners|Legal|Saved jobs|Job alerts|Departments
|Startseite|Karriere|Jobsuche|Über uns|Kontakt|Standorte|Presse|Studierende|Anmelden|Hilfe|Teams|Stellenangebote|Registrieren|Aktuelles|Unternehmen|Absolventen
|首页|关于我们|联系我们|新闻中心|校园招聘|社会招聘|登录|注册|帮助|招聘首页|企业文化|职位搜索|人才招聘
|Accueil|Carrières|À propos|Contactez-nous|Actualités|Connexion|Aide|Inicio|Empleo|Sobre nosotros|Contacto|Noticias|Ayuda|ホーム|会社情報|採用情報|お問い合わせ|ログイン|ニュース""".replace("\n", "").split("|")
)
# Menu words that are headings of a posting where they stand alone.
HEADINGS = frozenset("benefits culture products services company support profile teams students about our\xa0story unternehmen leistungen".split(" "))
LEGAL = frozenset(
    w.casefold()
    for w in """Privacy policy|Privacy|Terms of use|Terms|Terms of service|Cookie settings|Cookie policy|Cookies|Sitemap|Accessibility|Imprint|Legal notice|Status|Help centre|Help center|Do not sell my data|Modern slavery statement
|Impressum|Datenschutz|Barrierefreiheit|AGB|Nutzungsbedingungen|Cookie-Einstellungen|隐私政策|使用条款|网站地图|法律声明|Mentions légales|Aviso legal|利用規約|プライバシーポリシー""".replace("\n", "").split("|")
)
RELATED = re.compile(r"(?i)(?:more jobs at this company|related (?:openings|jobs|positions|roles)|similar (?:jobs|openings|roles|positions)|you may also like|people also viewed|recommended (?:jobs|for you)|other (?:openings|jobs|roles)(?: at .{1,40})?|more (?:openings|like this|jobs)|recently viewed|jobs you might like|ähnliche (?:stellen|jobs|stellenangebote)|weitere (?:stellen|jobs|stellenangebote)(?: .{1,30})?|das könnte (?:sie|dich) auch interessieren|相关职位|相似职位|推荐职位|更多职位|猜你喜欢|热门职位|offres similaires|empleos similares|関連求人):?")
SKIP = re.compile(r"(?i)(?:skip (?:to (?:main )?content|navigation|to search)|jump to (?:main )?content|zum (?:haupt)?inhalt springen|navigation überspringen|跳到主要内容|跳转到.{2,6}|aller au contenu(?: principal)?|saltar al contenido)")
TOOL = re.compile(
    r"(?i)(?:☰.{0,12}|🔍.{0,20}|≡ ?menu|language: .{2,20}|english \| .{2,20}|(?:[A-Z]{2} ){1,5}[A-Z]{2}|text size: .{1,10}|(?:schriftgröße|字体大小).{0,12}|rate this page.*|[\d,.]+ (?:people|candidates|applicants|visitors) viewed this (?:page|job|posting).*|previous job \| next job|← ?.{2,30}|.{2,30} ?→|result \d+ of \d+|treffer \d+ von \d+"
    r"|apply now\s+.{1,3} ?save\s+.{1,3} ?share|(?:save|share|print|e-?mail|report)(?: this)? (?:job|posting|page|opening)s?(?:: .*)?|save|print|share|tweet|copy link|report this (?:job|posting|page)|sign in to save this job|apply now|back to top ?.?|nach oben ?.?|返回顶部|zurück zu.{2,30}|back to (?:results|search|list).*|advertisement|anzeige|werbung|广告|sponsored|chat with us!.*|get jobs like this by e-?mail|your e-?mail address\s+.*|subscribe(?: .{0,30})?"
    r"|join our talent community.*|follow us(?: for updates| on .{2,60})?|folgen sie uns.*|关注我们.*|site version [\d.]+.*|sign in|create account|log in|scan the qr code.*|分享.{0,12}|收藏.{0,8}|drucken|teilen|merken|was this page helpful\??.*|loading…?|show more|read more|mehr anzeigen|(?:expand|collapse) all|page \d+ of \d+|select language.*|feedback)"
)
COOKIE = re.compile(
    r"(?i)(?:(?:we|this (?:site|website|page)|our (?:site|website)|we and our partners|our partners and we) (?:use|uses|store|stores)\b.{0,60}\bcookies?\b.*|by (?:continuing|using|browsing).{0,60}\bcookies?\b.*|we value your privacy\b.*|this (?:site|website) (?:uses|stores) cookies.*|cookies help us.*|your cookie (?:choices|preferences|settings).*"
    r"|(?:wir verwenden|diese (?:website|seite|webseite) (?:nutzt|verwendet)|wir nutzen) cookies.*|cookies helfen uns.*|.{0,14}cookie.{0,16}(?:体验|政策|设置).*|(?:nous utilisons|ce site utilise) des cookies.*|(?:utilizamos|este sitio usa) cookies.*|当サイトではcookie.*)"
)
BUTTONS = re.compile(r"(?i)(?:(?:accept(?: all)?|reject(?: all)?|settings|manage choices|learn more|ok(?:, got it)?|got it|only necessary|alle akzeptieren|nur notwendige|ablehnen|einstellungen|mehr erfahren|接受全部|仅必要|拒绝|设置|tout accepter|refuser|aceptar todo|rechazar)(?:\s*[|·/–-]\s*|\s{2,}|$)){1,4}")
RIGHTS = re.compile(r"(?i)(?:©|\(c\)|copyright\b|版权所有).{0,12}\b(?:19|20)\d\d\b.{0,120}|(?:©|\(c\)) .{0,80}(?:all rights reserved|alle rechte vorbehalten)\.?|all rights reserved\.?|.{3,80}, powered by \S+|powered by \S+|.{0,8}icp备.{0,20}")
SEPARATED = re.compile(r"\s+[|·•/»›>]\s+|\s{2,}|\s*[|·•»›]\s*")
CRUMB = re.compile(r"(?i)(?:home|start|startseite|首页|careers|jobs|accueil|inicio)\s*[/»›>→]\s*\S.*")
ENTRY = (
    re.compile(r"[›»→▸•] .{3,80} · .{2,50}(?: · .{1,20})?"),
    re.compile(r".{3,80} \| .{2,50} \| .{1,24}"),
    re.compile(r"(?P<t>[A-ZÀ-Þ][^,(|–;:.!?]{2,70}?)(?:, | \(| – | - )(?P<p>[A-ZÀ-Þ][^,|;:!?\d]{1,45}?)\)?"),
)
_MARKER = re.compile(r"\s*(?:[-*•·‣▪]|\d{1,2}[.)])\s+")
_SMALL = frozenset("of for and the in on at to de di da du des la le les el los las del en und von der die das für im am sur et y e do dos".split())


def _folded(line: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", line).split())


def _parts(line: str) -> list[str]:
    return [p.strip() for p in SEPARATED.split(unicodedata.normalize("NFKC", line).strip().replace("\xa0", " ")) if p.strip()]


def _titled(words: str) -> bool:
    """Written like a title or a name: every word but small ones begins with a capital or sign."""
    ws = words.split()
    return bool(ws) and all(w[0].isupper() or not w[0].isalpha() or w in _SMALL for w in ws)


def is_entry(text: str) -> bool:
    """One posting of a list of other postings."""
    if ENTRY[0].fullmatch(text) or ENTRY[1].fullmatch(text):
        return True
    m = ENTRY[2].fullmatch(text)
    return bool(m and not text.endswith((".", "!", "?")) and len(m["t"].split()) <= 7 and len(m["p"].split()) <= 5 and _titled(m["t"]) and _titled(m["p"]))


def implied_tag(line: str) -> str:
    """The tag a line's layout implies: skip, menu, bar, crumb, related, notice, buttons, tool, legal, rights, li or p."""
    text = _folded(line)
    low = text.casefold()
    if not text:
        return "blank"
    if low in MENU:
        return "menu"
    if low in LEGAL:
        return "legal"
    if SKIP.fullmatch(text):
        return "skip"
    if RELATED.fullmatch(text):
        return "related"
    if COOKIE.fullmatch(text):
        return "notice"
    if RIGHTS.fullmatch(text):
        return "rights"
    if TOOL.fullmatch(text):
        return "tool"
    if BUTTONS.fullmatch(text):
        return "buttons"
    parts = _parts(line)
    if len(parts) >= 2:
        lows = [p.casefold() for p in parts]
        known = sum(p in MENU or p in LEGAL for p in lows)
        if known >= 2 and known >= 0.6 * len(parts) or len(parts) == 2 and known == 2:
            return "bar"
    if CRUMB.fullmatch(text) and not text.endswith("."):
        return "crumb"
    slashed = [p.strip().casefold() for p in re.split(r"\s*/\s*", text)]
    if len(slashed) >= 2 and all(p in MENU or p in LEGAL for p in slashed):
        return "bar"
    return "li" if _MARKER.match(line) else "p"


class Box:
    """A node of the page's tree: a tag, whether it shows, and children (boxes or (line number, text))."""

    __slots__ = ("tag", "hidden", "children", "text")

    def __init__(self, tag: str, hidden: bool = False):
        self.tag, self.hidden, self.children, self.text = tag, hidden, [], ""


HIDDEN = frozenset("nav aside dialog footer tools".split())
_CONTAINER = {"skip": "nav", "bar": "nav", "crumb": "nav", "related": "aside", "notice": "dialog", "buttons": "dialog", "tool": "tools", "legal": "footer", "rights": "footer"}


def build_lines(lines: list[str]) -> Box:
    """The tree of a page whose tags are implied by its lines."""
    root = Box("body")
    tags = [implied_tag(x) for x in lines]
    filled = [i for i, t in enumerate(tags) if t != "blank"]
    near = {i: (tags[filled[k - 1]] if k else "", tags[filled[k + 1]] if k + 1 < len(filled) else "") for k, i in enumerate(filled)}
    box: Box | None = None
    for i in filled:
        tag, text = tags[i], lines[i]
        before, after = near[i]
        if tag == "menu" and "menu" not in (before, after) and _folded(text).casefold() in HEADINGS:
            tag = "p"  # alone, such a word is a heading
        if box is not None and box.tag == "aside" and tag in ("p", "li") and is_entry(_folded(text)):
            box.children.append((i + 1, text))
            continue
        if tag == "buttons" and before not in ("notice", "buttons") and len(_parts(text)) < 2:
            tag = "p"
        kind = "nav" if tag == "menu" else _CONTAINER.get(tag)
        if kind is None:
            box = None
            leaf = Box(tag)
            leaf.children.append((i + 1, text))
            root.children.append(leaf)
            continue
        if box is None or box.tag != kind or kind == "aside":
            box = Box(kind, kind in HIDDEN)
            root.children.append(box)
        box.children.append((i + 1, text))
    return root


# --- HTML -------------------------------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg head title iframe object nav aside footer dialog select button".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figure figcaption form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_OFF = re.compile(r"""(?i)(?:^|\s)(?:hidden(?=[\s=>/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)|role\s*=\s*["']?(?:navigation|banner|contentinfo|complementary|search|dialog|alertdialog))""")
_CLASSES = re.compile(r"""(?i)(?:^|\s)(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Class names of boxes beside the main body, as whole names.
OFF_CLASSES = frozenset(f"{a}{b}" for a in ("cookie", "consent", "navbar", "breadcrumb", "breadcrumbs", "sidebar", "footer", "related-jobs", "share-bar", "newsletter", "site-footer", "page-footer", "main-nav", "site-nav") for b in ("", "-banner", "-notice", "-bar", "-box", "-popup", "-signup"))
WHOLE = frozenset("html body main article".split())


def is_off(name: str, attrs: str) -> bool:
    """Whether a box is hidden by its tag, its attributes or one of its class names; the page as a whole never is by its class."""
    if name in UNSEEN or _OFF.search(attrs):
        return True
    return name not in WHOLE and any(not OFF_CLASSES.isdisjoint("".join(m).lower().split()) for m in _CLASSES.findall(attrs))


def build_html(html: str) -> Box:
    """The tree of an HTML text; missing end tags are implied, unknown ones ignored."""
    root = Box("body")
    stack, at = [root], 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            stack[-1].children.append((0, unescape(html[at : m.start()])))
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name), None)
            if depth is not None:
                del stack[depth:]
            continue
        while (closes := next((k for k in range(len(stack) - 1, 0, -1) if name in CLOSED_BY.get(stack[k].tag, ())), None)) is not None:
            if any(b.tag in ("table", "ul", "ol", "dl") for b in stack[closes + 1 :]):
                break
            del stack[closes:]
        if name in BLOCK and stack[-1].tag == "p":
            stack.pop()
        box = Box(name, is_off(name, m["attrs"]))
        stack[-1].children.append(box)
        if name in ("script", "style", "noscript", "template", "svg") and name not in VOID:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if end:
                at = end.start()
        if name not in VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append(box)
    if at < len(html):
        stack[-1].children.append((0, unescape(html[at:])))
    return root


def _rows(table: Box) -> list[Box]:
    out, todo = [], list(reversed(table.children))
    while todo:
        c = todo.pop()
        if isinstance(c, Box) and not c.hidden:
            if c.tag == "tr":
                out.append(c)
            elif c.tag in ("tbody", "thead", "tfoot"):
                todo += reversed(c.children)
    return out


def _table_text(table: Box) -> str:
    """The cells of a table's rows, aligned; tables inside its cells have their text already."""
    rows = [[" ".join(_flow(c).split()) for c in r.children if isinstance(c, Box) and c.tag in ("td", "th") and not c.hidden] for r in _rows(table)]
    widths = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max((len(r) for r in rows), default=0))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows if any(r))


def _flow(root: Box) -> str:
    """The visible text of a box whose tables have their text."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = "\n".join(" ".join(x.split()) for x in "".join(line).split("\n")).strip()
        line.clear()
        if text:
            blocks.append(text)

    todo: list[Box | tuple | None] = list(reversed(root.children))  # a stack of its own: deep trees do not meet the recursion limit
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, tuple):
            line.append(node[1])
        elif node.hidden:
            continue
        elif node.tag == "br":
            line.append("\n")
        elif node.tag == "table":
            flush()
            if node.text:
                blocks.append(node.text)
        else:
            if node.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(node.children)
            if node.tag == "li":
                line.append("• ")
    flush()
    out = ""
    for k, b in enumerate(blocks):
        close = k and b.startswith("• ") and blocks[k - 1].startswith("• ")
        out += ("\n" if close else "\n\n" if k else "") + b
    return out


def render(root: Box) -> str:
    """All visible text: blocks on lines of their own, paragraphs apart, list markers, cells of a table aligned; inner tables first."""
    tables, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, Box) and not node.hidden:
            if node.tag == "table":
                tables.append(node)
            todo += node.children
    for table in reversed(tables):  # a table stands behind the one around it
        table.text = _table_text(table)
    return _flow(root)


def looks_like_html(text: str) -> bool:
    return bool(re.search(r"</?(?:p|div|br|li|ul|ol|table|td|tr|span|a|h[1-6]|html|body|nav|footer|section)\b[^<>]*>", text, re.I))


def hidden_lines(text: str | None) -> list[int]:
    """Numbers of the non-blank lines of a flattened page that are not main body."""
    if not text:
        return []
    return [n for box in build_lines(text.split("\n")).children if box.hidden for n, _ in box.children]


def main_text(text: str | None) -> str | None:
    """The rendered main body of a page, HTML or flattened."""
    if text is None:
        return None
    if looks_like_html(text):
        text = render(build_html(text))
    return "\n".join(t.rstrip() for box in build_lines(text.split("\n")).children if not box.hidden for _, t in box.children)


def boilerplate(pages: DataFrame) -> DataFrame:
    """(field, row_id, text) -> (field, row_id, line_no) of each non-blank line that is not main body; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [hidden_lines(t) for t in batch["text"]]
            counts = [len(x) for x in lines]
            yield pd.DataFrame({"field": np.repeat(batch["field"].to_numpy(), counts), "row_id": np.repeat(batch["row_id"].to_numpy(), counts), "line_no": np.array([n for x in lines for n in x], dtype=np.int32)})

    return pages.where("text is not null and row_id is not null").mapInPandas(run, "field string, row_id long, line_no int")


def bodies(pages: DataFrame) -> DataFrame:
    """(field, row_id, text) -> (field, row_id, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"field": batch["field"], "row_id": batch["row_id"], "body": [main_text(t) for t in batch["text"]]})

    return pages.mapInPandas(run, "field string, row_id long, body string")


def workspace_pages(load) -> DataFrame:
    """The three page fields of a workspace in long form."""
    details = load("job_detail").select(F.col("detail_id").alias("row_id"), F.explode(F.create_map(F.lit("job_detail.jd"), "jd", F.lit("job_detail.requirements"), "requirements")).alias("field", "text"))
    return details.select("field", "row_id", "text").unionByName(load("job_item").select(F.lit("job_item.snippet").alias("field"), F.col("ord").alias("row_id"), F.col("snippet").alias("text")))
