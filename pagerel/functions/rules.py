"""Fixed values that must equal the reference's behaviour for equal results:
word lists, patterns and limits. Kept together, in natural order, as text.

Patterns are written for Java regex (Spark ``rlike``) and avoid lookarounds
so the same strings run on RE2 (DuckDB oracle) unchanged; where the original
rule used lookaheads it is split into conjunctions (see ``functions.classes``).
"""

# JS ``\s``: ASCII whitespace plus the Unicode space separators, spelled out
# (Java's and RE2's ``\s`` are ASCII-only). One character, no quantifier.
JS_SPACE = ("[\t\n\u000b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]")

# --- fixed values: class-token kinds -----------------------------------------
STATE_CLASS = (
    r"(?i)^(?:is-|has-|ng-|v-enter|v-leave|js-is-)|^(?:active|selected|current|hover|hovered|"
    r"focus|focused|focus-visible|open|opened|closed|expanded|collapsed|show|showing|shown|"
    r"visible|invisible|hidden|disabled|enabled|checked|loading|loaded|odd|even|first|last|in|"
    r"fade|animated|clearfix|cf|lazyload|lazyloaded|lazyloading)$"
)
DYNAMIC_CLASS = (
    r"^(?:css|sc|jsx|svelte|emotion|styled|tss|makeStyles|jss)[-_]|[0-9]{3,}|"
    r"__[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*$|^_[A-Za-z0-9]{5,}$"
)
UTILITY_CLASS = (
    r"[:/\[\]!%@.]|^-?(?:[mp][trblxyse]?|gap|space-[xy]|w|h|min-w|min-h|max-w|max-h|inset|top|"
    r"left|right|bottom|z|order|col|col-span|row-span|basis|grow|shrink|leading|tracking|indent|"
    r"opacity|rounded|border|ring|shadow|blur|text|font|bg|from|via|to|fill|stroke|decoration|"
    r"outline|divide|place|items|justify|content|self|overflow|object|cursor|select|transition|"
    r"duration|delay|ease|animate|scale|rotate|translate|skew|origin|aspect|columns|break|"
    r"line-clamp|d|align|float|g|gx|gy|offset|fs|fw|lh|ms|me|ps|pe)-|^(?:flex|grid|block|inline|"
    r"inline-block|inline-flex|contents|relative|absolute|fixed|sticky|static|container|"
    r"container-fluid|truncate|underline|uppercase|lowercase|capitalize|italic|grow|shrink|"
    r"sr-only|row|col|pull-left|pull-right)$"
)

# --- fixed values: id stability ------------------------------------------------
ID_HEXLIKE = r"(?i)[0-9a-f]{8}-?[0-9a-f]{4}"
ID_FRAMEWORK_PREFIX = (
    r"(?i)^(?::|ember[0-9]|react-|mui-|radix-|headlessui-|yui_|ext-gen|ui-id-|__BVID__|gwt-|j_id|"
    r"vaadin-|rc_|rc-|downshift-|aria-|tippy-|popover-|tooltip-|select2-|chakra-|_)"
)

# --- fixed values: attribute lists (in priority order) --------------------------
TEST_ATTRS = ["data-testid", "data-test-id", "data-test", "data-qa", "data-cy",
              "data-automation-id", "data-automation"]
NAME_ATTRS = ["name", "itemprop", "aria-label", "title", "alt", "placeholder", "for",
              "data-field", "data-role"]
WEAK_ATTRS = ["role", "type", "rel", "href", "src", "value", "aria-labelledby"]
MODEL_ATTR = (r"^(?:data-[A-Za-z0-9_-]+|aria-label|role|name|type|title|alt|placeholder|itemprop|"
              r"itemtype|rel|href|src|for|value|lang|dir|target|method|action)$")
# Attributes tried for relative (row -> field) selectors, in order.
REL_ATTRS = TEST_ATTRS + ["itemprop", "name", "data-field", "data-role"]
URL_ATTRS = r"(?i)^(?:href|src|action|poster|data-src|data-href|data-url|data-original)$"

# --- fixed values: tags ---------------------------------------------------------
SKIP_TAGS = ["script", "style", "noscript", "template", "iframe", "object", "embed", "canvas",
             "head", "meta", "link", "svg"]
INLINE_FORMAT = ["b", "i", "em", "strong", "small", "sup", "sub", "br", "mark", "u", "s", "del",
                 "ins", "code", "abbr", "cite", "q", "wbr", "span", "font", "bdi", "bdo", "dfn",
                 "kbd", "samp", "var"]
NAV_TAGS = ["nav", "header", "footer"]
NAV_ROLES = ["navigation", "menu", "menubar"]
CLICKABLE_TAGS = ["a", "button"]
CLICKABLE_ROLES = ["button", "link"]
CLICKABLE_INPUT_TYPES = ["submit", "button"]
FORM_CONTROLS = ["button", "fieldset", "input", "optgroup", "option", "select", "textarea"]

# --- fixed values: naming ---------------------------------------------------------
GENERIC_WORDS = (
    r"(?i)^(?:wrapper|wrap|container|inner|outer|content|contents|body|box|block|section|row|col|"
    r"column|cell|item|items|el|element|component|module|text|label|value|info|detail|details|"
    r"data|main|left|right|top|bottom|link|links|media|figure|card|list|grid|flex|holder|area|"
    r"group|meta|js|c|ui|field|line|part|unit|entry|tile|cont|txt)$"
)
ABBREVIATIONS = {
    "desc": "Description", "descr": "Description", "img": "Image", "pic": "Picture",
    "qty": "Quantity", "addr": "Address", "tel": "Phone", "num": "Number", "no": "Number",
    "pos": "Position", "cat": "Category", "loc": "Location", "btn": "Button", "amt": "Amount",
    "dt": "Date", "ts": "Timestamp", "usr": "User",
}
PRICE = (
    r"(?i)(?:[$€£¥₹₩₽₺]|\b(?:CHF|USD|EUR|GBP|JPY|CAD|AUD|SEK|NOK|DKK|PLN)\b)" + JS_SPACE + r"?[0-9]|"
    r"[0-9]" + JS_SPACE + r"?(?:[$€£¥₹₩₽₺]|\b(?:CHF|USD|EUR|GBP|kr|zł|Fr)\b)"
)
_NS = JS_SPACE[:-1] + "@]"          # neither space nor '@'
EMAIL = "^[^" + _NS[1:] + "+@[^" + _NS[1:] + "+\\.[^" + _NS[1:] + "+\\z"
PHONE_CHARS = r"^\+?(?:[0-9().-]|" + JS_SPACE + r"){7,}\z"
PHONE_DIGITS = r"[0-9]{3}"
RATING = r"(?i)^[0-9.,]+" + JS_SPACE + r"*(?:/" + JS_SPACE + r"*5|stars?|out of 5)"
NUMBER = r"^-?[0-9.,]+%?\z"
HREF_NOT_URL_NAME = r"(?i)link|url"
SRC_IMAGE_NAME = r"(?i)image|img|photo|picture|thumb|logo|avatar|icon"

# --- fixed values: pagination -----------------------------------------------------
NEXT_WORDS = (r"(?i)^(?:next|next page|more|load more|show more|›|»|>|→|weiter|nächste|suivant|"
              r"siguiente|avanti|próxima|volgende|następna|далее|次へ|下一页)$")
DISABLED_CLASS = r"(?i)(?:^|\s|-|_)disabled(?:$|\s)"

# --- fixed values: limits ---------------------------------------------------------
SIMILARITY_MIN = 0.34
COLUMN_MIN_FILL = 0.2
CELL_LEAVES_MAX = 1.2
PREVIEW_ROWS = 50
CELL_MAX_CHARS = 32767

# --- fixed values: recipe defaults --------------------------------------------------
RECIPE_DEFAULTS = {"type": "none", "max_pages": 10, "delay_ms": 800, "timeout_ms": 20000,
                   "dedupe": True, "append": False, "page_url": False}
VALUE_MODES = ["text", "href", "src", "ownText", "value", "html", "outerHtml", "attr"]
PAGINATION_TYPES = ["none", "next", "scroll", "loadmore"]
TIMEOUT_MIN_MS = 3000
SCROLL_TIMEOUT_CAP_MS = 10000
