"""Which elements are page furniture, and where the content stands."""

from __future__ import annotations

import re
from dataclasses import dataclass

from skein.html.tree import HEADINGS, Document, Node

# Elements that are dropped, that are page furniture, and that prose tests don't apply to.
DROPPED = frozenset(
    "script style noscript template svg canvas iframe object embed form input select textarea button label fieldset dialog audio video map area link meta base".split()
)
CHROME = frozenset("nav footer aside menu".split())
EXEMPT = frozenset("table thead tbody tfoot tr th td caption colgroup col pre code samp kbd".split())
ROLES = frozenset("navigation banner complementary search contentinfo alert dialog".split())


def _vocabulary(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[-_\s])(?:{'|'.join(words.split())})(?:[-_\s]|$)", re.I)


# Words of class and id attributes.
COMMERCIAL = _vocabulary(
    "ads? adbox adslot adunit advert adverts advertising advertisement advertisements sponsors? sponsored sponsorship promos? promoted promotions? banners? "
    "adsense adsbygoogle doubleclick googlead googleads taboola outbrain revcontent zergnet mgid criteo popups? interstitials? paywall cookies? consent gdpr"
)
CONCLUSIVE = _vocabulary(
    "ads? adbox advert advertisement sponsors? sponsored promos? promotions? banners? popups? modals? overlays? interstitials? cookies? consent gdpr "
    "newsletters? subscribe signup paywall shares? sharing socials? comments? disqus livefyre related recommend recommended recirc outbrain taboola trending "
    "breadcrumbs? pagination pagers? navbars? navigation navbox navboxes masthead footers? toolbars? skip sr-only screen-reader visually-hidden noprint "
    "references? reference-list reflist refbegin refend citations? footnotes? catlinks authority-control mw-editsection mw-references printfooter sitesub "
    "jump-link mw-jump-link"
)
SUGGESTIVE = _vocabulary(
    "ad ads adbox advert advertisement sponsor sponsored promo promotion banner popup modal overlay interstitial cookie consent gdpr newsletter subscribe "
    "signup paywall share sharing social follow comment comments disqus livefyre reply sidebar side-bar widget related recommend recirc outbrain taboola "
    "trending popular breadcrumb pagination pager paging nav navbar navigation menu masthead footer header topbar toolbar utility skip hidden invisible "
    "screen-reader sr-only visually-hidden meta byline tags tag-list author-box bio cta newsl toc table-of-contents infobox navbox metadata mw-editsection "
    "reference citation footnote"
)
CONTENT = _vocabulary(
    "article articlebody post postbody post-content entry entry-content content contents main maincontent story storybody body bodytext text prose markdown "
    "readme blog page-content rich-text document paragraph section-content mw-parser-output mw-content-text"
)
#: ``header`` and ``footer`` of a component, which say nothing about the page.
COMPONENT = re.compile(r"(?:^|[-_\s])(?:sticky|table|col|column|row|grid|data|sort|sortable|cell|group|thead|tfoot)[-_](?:headers?|footers?)(?=[-_\s]|$)", re.I)
_CONTRIBUTORS = frozenset("p pre td blockquote article section div li dd".split())
_COMMAS, _STOPS = ",，、;", ".。?!？！"


@dataclass(frozen=True)
class DenoiseConfig:
    drop_chrome: bool = True
    drop_by_class: bool = True
    keep_tables: bool = True
    min_block_len: int = 25
    max_link_density: float = 0.6
    min_text_ratio: float = 0.02


def described(node: Node) -> str:
    return COMPONENT.sub(" ", node.signature)


def class_weight(node: Node) -> float:
    words = described(node)
    if not words:
        return 0.0
    bad = any(v.search(words) for v in (SUGGESTIVE, CONCLUSIVE, COMMERCIAL))
    return (25.0 if CONTENT.search(words) else 0.0) - (25.0 if bad else 0.0)


def is_hidden(node: Node) -> bool:
    if node.get("hidden") is not None or node.get("aria-hidden") == "true":
        return True
    style = (node.get("style") or "").replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style


def mostly_code(node: Node) -> bool:
    """Whether at least half of the text stands in code elements."""
    inside, stack = 0, [node]
    while stack:
        x = stack.pop()
        if x.name in ("pre", "code"):
            inside += x.text_len
        else:
            stack.extend(x.children)
    return node.text_len > 0 and 2 * inside >= node.text_len


def is_noise(doc: Document, node: Node, cfg: DenoiseConfig) -> bool:
    """Whether an element is furniture. What holds most of the page's text never is, except by its tag or by being hidden."""
    name = node.name
    if not name:
        return False
    if name in DROPPED or (cfg.drop_chrome and name in CHROME) or (name == "table" and not cfg.keep_tables) or is_hidden(node):
        return True
    if doc.dominant(node):
        return False
    if node.get("role") in ROLES:
        return True
    if cfg.drop_by_class:
        words = described(node)
        if words:
            content = CONTENT.search(words)
            if COMMERCIAL.search(words) or (not content and CONCLUSIVE.search(words)):
                return True
            if not content and node.text_len < 400 and SUGGESTIVE.search(words):
                return True
    if name in EXEMPT:
        return False
    if node.text_len >= cfg.min_block_len and node.link_density > cfg.max_link_density and name not in HEADINGS:
        return True
    return node.size > 512 and node.text_ratio < cfg.min_text_ratio and not mostly_code(node)


def content_root(doc: Document, cfg: DenoiseConfig) -> Node | None:
    """The element that the page's prose speaks for: each prose block votes for its three nearest ancestors."""
    votes: dict[Node, float] = {}
    for node in doc.nodes:
        if node.name not in _CONTRIBUTORS or node.has_block or node.text_len < cfg.min_block_len or node.link_density > cfg.max_link_density:
            continue
        text = node.inner_text()
        value = 1.0 + sum(map(text.count, _COMMAS)) + 0.5 * sum(map(text.count, _STOPS)) + min(3.0, node.text_len / 100)
        for share, up in zip((1.0, 0.5, 1 / 3), node.ancestors(3)):
            votes[up] = votes.get(up, 0.0) + value * share

    def final(node: Node) -> float:
        return (votes.get(node, 0.0) + class_weight(node)) * (1 - node.link_density)

    outer = ("body", "html", "#page")
    ranked = [(final(x), -x.order, x) for x in votes if x.name not in outer]
    best = max(ranked, default=None, key=lambda r: r[:2])
    if best is None or best[0] <= 0:
        return None
    score, _, root = best
    while root.parent is not None and root.parent.name not in outer and final(root.parent) > score:
        root = root.parent
        score = final(root)
    return root
