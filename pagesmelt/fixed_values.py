"""Word lists, patterns and messages whose values decide the results.

Everything in this module is a fixed value: changing one changes what a page converts to.
"""

# --- fixed values: HTML vocabulary ------------------------------------------------------------
VOID_TAGS = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr",
    "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param",
    "source", "spacer", "track", "wbr",
)
# Strings in these elements are not part of a page's readable text.
OPAQUE_TAGS = ("script", "style", "template", "rt", "rp")
# Elements ignored when judging whether a static capture has visible text.
INERT_TAGS = ("script", "style", "template", "noscript")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")

# --- fixed values: cleaning -------------------------------------------------------------------
DROP_TAGS = ("script", "style", "noscript", "template", "svg", "link", "meta")
DROP_ROLES = ("banner", "contentinfo", "dialog", "navigation")
NOISE_TOKEN = (
    r"(^|[-_])(ad|ads|advert|advertisement|cookie|consent|social-share|share-buttons)($|[-_])"
)
HIDDEN_STYLE = r"(?i)(display\s*:\s*none|visibility\s*:\s*hidden)"

# --- fixed values: content candidates ---------------------------------------------------------
CONTENT_TAGS = ("article", "main")
CONTENT_CLASS = r"(?i)(^|[-_])(article|content|entry|main|post)([-_]|$)"
PUNCTUATION = r"[.!?。！？]"
STRUCTURE_TAGS = ("h1", "h2", "h3", "pre", "table", "blockquote")
PARAGRAPH_POINTS, PUNCTUATION_POINTS, STRUCTURE_POINTS = 80, 12, 40
MAX_DENSITY_DISCOUNT = 0.9
MIN_TEXT_LENGTH, MAX_LINK_DENSITY, MIN_STRUCTURE = 80, 0.65, 2

REASON_FULL = "full mode requested"
REASON_READABILITY = "readability candidate passed quality checks"
REASON_NO_CANDIDATE = "no DOM candidates found"
REASON_TOO_SHORT = "best candidate is too short (%d characters)"
REASON_LINK_DENSITY = "best candidate has high link density (%.2f)"
REASON_NO_STRUCTURE = "best candidate lacks paragraph and document structure"
REASON_DOM_AFTER_READABILITY = (
    "readability candidate failed quality checks; selected DOM candidate"
)
REASON_DOM = "highest-quality DOM candidate"

# --- fixed values: metadata, the attribute and value of the tags read, first ones first ---------
META_TITLE = (("property", "og:title"),)
META_DESCRIPTION = (("name", "description"), ("property", "og:description"))
META_AUTHOR = (("name", "author"), ("property", "article:author"))
META_PUBLISHED = (
    ("property", "article:published_time"), ("name", "date"), ("name", "datePublished"))
LINK_CANONICAL = "canonical"

# --- fixed values: captures -------------------------------------------------------------------
HTML_MEDIA_TYPES = ("text/html", "application/xhtml+xml")
JS_SHELL_MARKERS = (
    "enable javascript",
    "javascript is required",
    "please turn on javascript",
    "you need to enable javascript",
)
META_CHARSET = r"""(?i)<meta[^>]+charset\s*=\s*['"]?\s*([\w.-]+)"""
SNIFF_BYTES = 4096
MIN_VISIBLE_TEXT, MIN_VISIBLE_TEXT_IN_ROOT, MIN_VISIBLE_PARAGRAPHS = 200, 80, 2

# --- fixed values: Markdown -------------------------------------------------------------------
# Block elements at whose inner and outer edges white space is not content.
TRIMMED_BLOCKS = (
    "p", "blockquote", "article", "div", "section", "ol", "ul", "li", "dl", "dt", "dd",
    "table", "thead", "tbody", "tfoot", "tr", "td", "th",
)
BULLETS = ("*", "+", "-")
CODE_CLASS = r"(?i)^(?:language-|lang-)([A-Za-z0-9_+.-]+)$"
CODE_NAME = r"^[A-Za-z0-9_+.-]+$"
MARKDOWN_LINK = r"(?<!!)\[[^\]]+\]\([^)]+\)"

# --- fixed values: published readability heuristic --------------------------------------------
READABILITY_UNLIKELY = (
    r"(?i)combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|sidebar|"
    r"sponsor|ad-break|agegate|pagination|pager|popup|tweet|twitter"
)
READABILITY_MAYBE = r"(?i)and|article|body|column|main|shadow"
READABILITY_POSITIVE = (
    r"(?i)article|body|content|entry|hentry|main|page|pagination|post|text|blog|story"
)
READABILITY_NEGATIVE = (
    r"(?i)combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|"
    r"related|scroll|shoutbox|sidebar|sponsor|shopping|tags|tool|widget"
)
READABILITY_CLASS_WEIGHT = 25
READABILITY_PARAGRAPH_TAGS = ("p", "pre", "td")
READABILITY_TAG_POINTS = {
    5: ("article", "div"),
    3: ("blockquote", "pre", "td"),
    -3: ("address", "dd", "dl", "dt", "form", "li", "ol", "ul"),
    -5: ("footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "nav", "th"),
}
# Inside an article: always cut, and cut when their subtree reads like navigation.
READABILITY_FORM_TAGS = ("form", "textarea", "iframe")
READABILITY_BLOCK_TAGS = (
    "table", "ul", "div", "aside", "header", "footer", "section",
)
READABILITY_MIN_PARAGRAPH = 25
READABILITY_MIN_ARTICLE = 250

# --- fixed values: white space ----------------------------------------------------------------
# Characters Unicode-aware trimming removes.
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
