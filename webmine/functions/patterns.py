"""Fixed values.

The strings in the first block must equal the crawler's for results to match; they are stated as they are, in the
order the crawler lists them, changed only where the Java regex dialect needs it (noted per entry).
The second block is this engine's own contract for behaviour that lives outside the crawler's tree.
"""

# ---------------------------------------------------------------------------------------------------------------
# FIXED VALUES (must equal the crawler's)
# ---------------------------------------------------------------------------------------------------------------

# Quoted-path pattern used for link extraction from response bodies.
LINK_PATTERN = (
    r"""(?:"|')(?:(((?:[a-zA-Z]{1,10}:(?:\\)?/(?:\\)?/|//)[^"'/]{1,}\.[a-zA-Z]{2,}[^"']*)|((?:/|\.\./|\./|\\/)"""
    r"""[^"'><,;|*()(%%$^/\\\[\]][^"'><,;|()]*[^"'><,;|()]*))|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]*\.[a-zA-Z0-9_]+"""
    r"""(?:[\?|#][^"|']*)?)|([a-zA-Z0-9_\-/]{1,}/[a-zA-Z0-9_\-/]{3,}(?:[\?|#][^"|']*)?)|([a-zA-Z0-9_\-]+"""
    r"""(?:\.[a-zA-Z0-9_]{1,})+)|([a-zA-Z0-9_\-/]+/))(?:"|')"""
)

# Java form of the link pattern: the same match set (and group spans), written so that Java's backtracking engine stays
# linear and keeps no stack where Go's RE2 is linear by construction:
#  - no alternative's text holds a quote, so the closing quote is the next quote: a lookahead asks for it first, and an
#    unclosed quote costs one scan to the end of the text;
#  - runs whose next character isn't in the run's class are possessive;
#  - alternative 2: two adjacent identical stars become one possessive star;
#  - alternatives 3 and 4 ("dir/file.ext", "dir/name"): a lookahead checks the "/" at position >= 1 (and, for 4,
#    three more characters after it), then the path run is taken possessively; the "?"/"#" tail is possessive;
#  - alternative 5 (dotted names): the group and the runs in it are possessive. Java walks a possessive group in a loop,
#    but any other repeated group by recursion, which overflows the stack after some thousand repetitions.
# The DuckDB oracle runs the original pattern above; tests/test_link_pattern.py checks both agree on random input.
LINK_PATTERN_JAVA = (
    r"""["'](?=[^"']*+["'])(?:(((?:[a-zA-Z]{1,10}:(?:\\)?/(?:\\)?/|//)[^"'/]{1,}\.[a-zA-Z]{2,}[^"']*+)|((?:/|\.\./|\./|\\/)"""
    r"""[^"'><,;|*()(%%$^/\\\[\]][^"'><,;|()]*+))|((?=[a-zA-Z0-9_\-/]+/)[a-zA-Z0-9_\-/]*+\.[a-zA-Z0-9_]++"""
    r"""(?:[\?|#][^"|']*+)?)|((?=[a-zA-Z0-9_\-/]+/[a-zA-Z0-9_\-/]{3})[a-zA-Z0-9_\-/]*+(?:[\?|#][^"|']*+)?)|([a-zA-Z0-9_\-]++"""
    r"""(?:\.[a-zA-Z0-9_]++)++)|([a-zA-Z0-9_\-/]+/))["']"""
)

# robots.txt rule pattern. Java's "." also stops at \r and Unicode line ends; Spark gets a (?d) prefix (UNIX_LINES).
ROBOTS_PATTERN = r"(?:Allow|Disallow): \s*(.*)"
ROBOTS_EXTENSION = r"/\.[a-z0-9]+$"

# Parameter extractors, in the order they run (first extractor to claim a name wins).
PARAM_FORM_INPUT = r"""<input[^>]*\bname\s*=\s*["']?([^"'\s>]+)"""
PARAM_FORM_TEXTAREA = r"""<textarea[^>]*\bname\s*=\s*["']?([^"'\s>]+)"""
PARAM_FORM_SELECT = r"""<select[^>]*\bname\s*=\s*["']?([^"'\s>]+)"""
PARAM_JS_FETCH = r"""fetch\s*\(\s*["']([^"']+)"""
PARAM_JS_XHR = r"""(?:xhr|xmlhttp)\.open\s*\(\s*["'][^"']*["']\s*,\s*["']([^"']+)"""
PARAM_JS_POST_DATA = r"""(?:data|body)\s*:\s*(?:JSON\.stringify\()?\{([^}]*)\}"""
PARAM_FETCH_BODY = r"""body\s*:\s*(?:JSON\.stringify\()?\{([^}]*)\}"""
PARAM_JS_AJAX_DATA = r"""\$\.(?:post|ajax)\s*\([^,]*,?\s*\{([^}]*)\}"""
PARAM_DATA_ATTR = r"""data-([a-zA-Z][a-zA-Z0-9-]*)\s*="""
PARAM_HIDDEN_INPUT = (
    r"""<input[^>]*(?:type\s*=\s*["']?hidden["']?[^>]*name\s*=\s*["']?([^"'\s>]+)|name\s*=\s*["']?([^"'\s>]+)"""
    r"""[^>]*type\s*=\s*["']?hidden["']?)"""
)
PARAM_META_CONTENT = r"""<meta[^>]*name\s*=\s*["']([^"']+)["'][^>]*content\s*=\s*["']([^"']*api[^"']*)["']"""
# Java reads "[" inside a class as a nested class, so the brackets are escaped here (same match set).
PARAM_GRAPHQL_VAR = r"""\$([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*[a-zA-Z!\[\]]+"""
PARAM_WEBSOCKET_URL = r"""new\s+WebSocket\s*\(\s*["']([^"']+)"""
PARAM_OBJECT_KEY = r"""["']?([a-zA-Z_][a-zA-Z0-9_]*)["']?\s*:"""

# Java forms of the extractors above: the same names in the same order, written so that Java's backtracking engine does
# not scan one stretch of text again for every start or every brace in it. The oracle runs the originals;
# tests/test_param_patterns.py checks both agree on random input. Two ideas:
#  - runs whose next character isn't in the run's class are possessive;
#  - where a start fails, the run that it covers is matched as a whole with an empty group (dropped afterwards): a later
#    start in that run ends at the same place and has fewer positions to try, so it fails too.
_REGION = r"(?:%s|[^>]*+)"
PARAM_FORM_INPUT_JAVA = "<input" + _REGION % r"""[^>]*\bname\s*+=\s*+["']?([^"'\s>]++)"""
PARAM_FORM_TEXTAREA_JAVA = "<textarea" + _REGION % r"""[^>]*\bname\s*+=\s*+["']?([^"'\s>]++)"""
PARAM_FORM_SELECT_JAVA = "<select" + _REGION % r"""[^>]*\bname\s*+=\s*+["']?([^"'\s>]++)"""
# Meta tags, one tag at a time. A name whose value runs beyond the tag's ">" is the last one with an open quote, so it is
# tried first. Else content that counts must follow the first whole name, which is asked for once (an atomic group); the
# name is the last whole one before the last content that counts. A tag without either is matched as a whole.
_META_CONTENT = r"""content\s*+=\s*+["'](?=[^"']*?api)[^"']*+["']"""
_META_OPEN = r"""[^>]*name\s*+=\s*+["']([^"'>]*+>[^"']*+)["'][^>]*""" + _META_CONTENT
META_TAG = rf"""<meta(?:{_META_OPEN}|(?>[^>]*?name\s*+=\s*+["'][^"'>]++["'])[^>]*{_META_CONTENT}|[^>]*+)"""
META_OPEN_NAME = rf"^<meta{_META_OPEN}$"
META_BEFORE_CONTENT = rf"(?s)^(.*){_META_CONTENT}$"
META_LAST_NAME = r"""(?s)^<meta.*name\s*+=\s*+["']([^"'>]++)["']"""
PARAM_DATA_ATTR_JAVA = r"""data-(?:([a-zA-Z][a-zA-Z0-9-]*+)\s*+=|[a-zA-Z][a-zA-Z0-9-]*+)"""
PARAM_OBJECT_KEY_JAVA = r"""["']?(?:([a-zA-Z_][a-zA-Z0-9_]*+)["']?\s*+:|[a-zA-Z_][a-zA-Z0-9_]*+)"""
# Object bodies: group 1 is the body with its braces, or has no closing brace where there is none in the text.
PARAM_JS_POST_DATA_JAVA = r"""(?:data|body)\s*+:\s*+(?:JSON\.stringify\()?(\{[^}]*+\}?+)"""
PARAM_FETCH_BODY_JAVA = r"""body\s*+:\s*+(?:JSON\.stringify\()?(\{[^}]*+\}?+)"""
# The brace that opens the body is the one after the first comma, else the last one before that comma that is closed:
# either the very last, or an earlier one that closes before the next opens. Where the one after the comma never closes and
# nothing before it does, nothing later can match: the rest of the text is taken.
PARAM_JS_AJAX_DATA_JAVA = (
    r"""\$\.(?:post|ajax)\s*+\((?:(?:[^,]*+,\s*+(?=\{[^}]*+\})|[^,]*(?=\{[^,{]*+(?:,|\z))(?=\{[^}]*+\})"""
    r"""|[^,]*(?=\{[^{}]*+\}))(\{[^}]*+\})|[^,]*+(?:,\s*+\{[^}]*+\z)?+)"""
)
# Hidden inputs, one tag (from "<input" to ">") at a time; group numbers differ from the original's.
HIDDEN_TAG = r"<input[^>]*+"
HIDDEN_LAST_TYPE = r"""(?s)^(.*)type\s*+=\s*+["']?hidden(.*)$"""
HIDDEN_NAME_AFTER = r"""(?s)^.*name\s*+=\s*+["']?([^"'\s>]++)"""
HIDDEN_NAME_BEFORE = r"""(?s)^<input.*name\s*+=\s*+["']?([^"'\s>]++)"""
HIDDEN_OPEN_NAME = r"""name\s*=\s*["']?\z"""

# Valid parameter name: 1 to 50 characters, a letter or "_" first, then letters, digits, "_" or "-".
PARAM_NAME_VALID = r"^[a-zA-Z_][a-zA-Z0-9_-]{0,49}\z"

# Names dropped from object-key extractors; compared against the lower-cased name.
COMMON_NON_PARAMS = [
    "type", "class", "style", "src", "href", "alt", "title",
    "width", "height", "method", "action", "target", "rel",
    "version", "status", "code", "message", "error", "success",
    "length", "size", "count", "total", "offset", "limit",
    "prototype", "constructor", "toString", "valueOf", "hasOwnProperty",
    "div", "span", "button", "form", "input", "img", "a",
]

# Words that mark a redirect target as a catch-all page (case-sensitive substring match).
CATCH_ALL_WORDS = [
    "NotFound", "404", "not-found", "notfound",
    "error", "Error", "ERROR",
    "missing", "Missing",
    "invalid", "Invalid",
    "default", "Default",
]

# MIME-like prefixes: extracted strings starting with one of these are not links.
MIME_PREFIXES = ["audio/", "application/", "font/", "image/", "multipart/", "text/", "video/"]

# Certainty levels (low is defined but no extractor assigns it).
CERTAINTY_HIGH, CERTAINTY_MEDIUM, CERTAINTY_LOW = "high", "medium", "low"

# Redirects: a chain is followed for at most this many requests.
MAX_REQUESTS_PER_CHAIN = 10
# Bodies at or above this similarity (of 100) to an earlier body of the same host are dropped.
BODY_SIMILARITY_CUT = 97

# ---------------------------------------------------------------------------------------------------------------
# Our own contracts for behaviour outside the crawler's tree
# ---------------------------------------------------------------------------------------------------------------

# RFC 3986 appendix B split: 2 scheme, 3 "//"+authority, 4 authority, 5 path, 6 "?"+query, 7 query, 8 "#"+frag, 9 frag.
URL_SPLIT = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
HAS_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
DOMAIN_NAME = r"(?i)^([a-z0-9-]+\.)+[a-z]{2,}\z"
# Java form, possessive throughout: a label's run ends before its dot, and Java walks only possessive groups without
# recursion.
DOMAIN_NAME_JAVA = r"(?i)^(?:[a-z0-9-]++\.)++[a-z]{2,}+\z"
# Unprintable or binary text: a control character or the replacement character.
UNPRINTABLE = r"[\p{Cc}\x{FFFD}]"
# A percent sign not followed by two hex digits makes a URL unparsable.
BAD_ESCAPE = r"%([^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?\z)"
MEDIA_EXTENSIONS = [
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "ico", "tif", "tiff", "avif",
    "mp3", "wav", "ogg", "flac", "aac", "m4a",
    "mp4", "avi", "mov", "wmv", "flv", "mkv", "webm", "mpeg", "mpg",
    "woff", "woff2", "ttf", "otf", "eot",
]
