"""Patterns, word lists and limits that decide results. They are data, kept together and in one place."""

# -- fixed values: white space ---------------------------------------------------------------------------------
#: White space of web text, for use inside a character class (Java's own \s knows ASCII only).
WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
S = f"[{WS}]"

# -- fixed values: HTML ----------------------------------------------------------------------------------------
#: Tag, attribute and kind of links that are read from one attribute, in order of emission within the ranks below.
LINK_ATTRIBUTES = {
    "form": [("form", "action")],
    "iframe": [("iframe", "src")],
    "area": [("area", "href")],
    "script": [("script", "src")],
    "link": [("link", "href")],
    "image": [("img", "src")],
    "media": [("video", "src"), ("audio", "src"), ("source", "src"), ("embed", "src"), ("object", "data")],
}
VALUE = rf"""{S}*={S}*(?:"([^"]*)"|'([^']*)'|([^>{WS}]+))"""
ANCHOR = rf"(?i)<a{S}+[^>]*href{VALUE}[^>]*>([\s\S]*?)</a>"
FORM = rf"(?i)<form{S}+([^>]*)>([\s\S]*?)</form>"
SRCSET = rf"""(?i)<img{S}+[^>]*srcset{S}*={S}*["']([^"']+)["'][^>]*>"""
META_REFRESH = rf"""(?i)<meta{S}+[^>]*content{S}*={S}*["'][^"']*url{S}*={S}*([^"'{WS}>]+)["'][^>]*>"""
CANONICAL = rf"""(?i)<link{S}+[^>]*rel{S}*={S}*["']canonical["'][^>]*href{VALUE}[^>]*>"""
CSS_URL = rf"""(?i)url{S}*\({S}*(?:["']?([^"')]+)["']?){S}*\)"""
CSS_IMPORT = rf"""(?i)@import{S}+["']([^"']+)["']"""
STYLE = r"(?i)<style[^>]*>([\s\S]*?)</style>"
JS_URL = rf"""["'](https?://[^"'{WS}]+)["']"""
JS_ENDPOINT = r"""(?i)["'](/?(?:api|v[0-9]+|graphql|rest|ajax|data|json|xml|rss|feed)[^"']*?)["']"""
DATA_URL = rf"(?i)data-(?:url|src|href|link|image|background){VALUE}"
INPUT = rf"(?i)<input{S}+([^>]*)>"
SELECT = rf"(?i)<select{S}+([^>]*)>([\s\S]*?)</select>"
TEXTAREA = rf"(?i)<textarea{S}+([^>]*)>"
TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
HTML_LANG = rf"""(?i)<html{S}+[^>]*lang{S}*={S}*["']([^"']+)["'][^>]*>"""
#: ASCII word limits, spelled out: Java's \b takes all letters for word characters. The class of the last label holds a bar.
BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EMAIL = BOUND + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}" + BOUND
#: Sources of links to pages and of links to resources.
NAVIGABLE = ("anchor", "form", "iframe", "meta")
RESOURCES = ("script", "link", "image", "css")
#: Beginnings of links that lead nowhere, as they are written.
SKIPPED = ("javascript:", "mailto:", "tel:", "data:", "blob:", "#")

# -- fixed values: robots files
#: Signs of a robots pattern that stand for themselves.
ROBOTS_LITERAL = r"([.+?^{}()|\[\]\\])"

# -- fixed values: the filter language -------------------------------------------------------------------------
#: A clause: namespace, field, operator, value.
CLAUSE = r'(req|resp)\.(host|path|url|method)\.(eq|ne|cont|ncont|regex|nregex|like|nlike)\s*:\s*("(?:[^"\\]|\\.)*"|\S+)'

# -- fixed values: URLs by kind --------------------------------------------------------------------------------
URL_CLASSES = {
    "HTML": r"\.html?\z",
    "PHP": r"\.php\z",
    "ASP": r"\.aspx?\z",
    "JSP": r"\.jsp\z",
    "CSS": r"\.css\z",
    "JS": r"\.js\z",
    "JSON": r"\.json\z",
    "XML": r"\.xml\z",
    "IMAGES": r"\.(png|jpg|jpeg|gif|webp|svg|ico|bmp)\z",
    "PDF": r"\.pdf\z",
    "DOCUMENTS": r"\.(pdf|doc|docx|xls|xlsx|ppt|pptx)\z",
    "VIDEO": r"\.(mp4|webm|avi|mov|mkv)\z",
    "AUDIO": r"\.(mp3|wav|ogg|flac|aac)\z",
    "API": r"/api/",
    "GRAPHQL": r"/graphql",
    "REST": r"/v[0-9]+/",
    "LOGIN": r"/(login|signin|auth)",
    "LOGOUT": r"/(logout|signout)",
    "REGISTER": r"/(register|signup)",
    "ADMIN": r"/(admin|dashboard)",
    "SITEMAP": r"sitemap.*\.xml\z",
    "ROBOTS": r"robots\.txt\z",
}
RESOURCE_CLASSES = ("CSS", "JS", "IMAGES", "VIDEO", "AUDIO", "DOCUMENTS")
PAGE_CLASSES = ("HTML", "PHP", "ASP", "JSP")
STATIC_EXTENSIONS = (".js", ".css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".webp", ".mp4", ".webm", ".mp3", ".wav", ".pdf")

# -- fixed values: limits --------------------------------------------------------------------------------------
LOG_LINES = 500
SESSION_BLOCK_SCORE = 8.0
MAX_SESSIONS = 10
MAX_SESSION_AGE_MS = 3_600_000
RATE_WINDOW_MS = 60_000


#: Attributes that links are read from.
LINK_NAMES = ("action", "src", "href", "data", "srcset", "url", "content")
_CLOSED = rf"(?=[{WS}>]|/>)"
#: A tag that is not closed plainly: its quotes don't pair up, or one that closes could be taken for one that opens a value.
UNCLEAR = rf"""(?i)[^>]\z|(?:{"|".join(LINK_NAMES)}){S}*={S}*["'](?:[{WS}>]|/>)"""


def any_tag(names: tuple[str, ...]) -> str:
    """Beginnings of these tags; the whole tag where its quotes pair up and hold no other quotes and no angle brackets."""
    return rf"""(?i)<(?:{"|".join(names)}){S}+(?:(?:[^<>"']++|"[^"'<>]*+"{_CLOSED}|'[^"'<>]*+'{_CLOSED})*+>)?+"""


def of_tag(tag: str, attribute: str) -> str:
    """The tag with a value of the attribute; of several in one tag the last counts. Groups: double-quoted, single-quoted, bare."""
    return rf"(?i)<{tag}{S}+[^>]*{attribute}{VALUE}[^>]*>"


def of_meta(key: str, name: str) -> str:
    return rf"""(?i)<meta{S}+[^>]*{key}{S}*={S}*["']{name}["'][^>]*content{S}*={S}*["']([^"']+)["'][^>]*>"""
