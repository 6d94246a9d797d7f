"""The patterns that decide results, written for Java's regex engine.

White space is JavaScript's; word boundaries and digits are ASCII; the end is \\z. Where Java's own classes differ they are
spelled out.
"""

#: White space as JavaScript's \s has it: for character classes, and its characters for trimming.
SPACE_CLASS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_CHARS = "\t\n\x0b\x0c\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
S = f"[{SPACE_CLASS}]"
NS = f"[^{SPACE_CLASS}]"
#: ASCII word boundary before and after a word character.
B = "(?<![A-Za-z0-9_])"
E = "(?![A-Za-z0-9_])"
DOT = r"[^\n\r\u2028\u2029]"

HEADING = r"(?i)^(?:references|bibliography)\z"
MARKER = rf"^(?:\[[0-9]{{1,3}}\]|[1-9][0-9]{{0,2}}[.)]){S}+"
BRACKET_MARKER = rf"^\[([0-9]{{1,3}})\]{S}+"
NUMBER_MARKER = rf"^([1-9][0-9]{{0,2}})[.)]{S}+"
#: Where a marker inside running text begins (zero width), for text and for layout blocks.
INLINE_START = rf"(?<!{NS})(?=(?:\[[0-9]{{1,3}}\]|[1-9][0-9]{{0,2}}[.)]){S}+[A-Za-z\"'“])"
INLINE_START_BLOCK = rf"(?U)(?<!{NS})(?=(?:\[\d{{1,3}}\]|[1-9]\d{{0,2}}[.)]){S}+[\w\"'“])"
_CAPITAL = "A-ZÀ-ÖØ-Þ"
_NAME = rf"[{_CAPITAL}][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+"
AUTHOR_DATE_START = rf"^{_NAME}(?:{S}+{_NAME}){{0,3}},{S}+{DOT}+\((?:19|20)[0-9]{{2}}[,;)]"
YEAR_IN_PARENTHESES = r"\((?:19|20)[0-9]{2}[,;)]"
STOP_WORDS = "abstract|introduction|conclusion|appendix|acknowledgments|data availability|funding"
STOP_TEXT = rf"(?i)^(?:{STOP_WORDS})"
STOP_BLOCK = rf"(?i)^(?:{STOP_WORDS})(?U)\b"
NUMBERED_LINE = r"^(?:\[[0-9]+\]|[0-9]+[.)])"

ANY_MARKER = rf"^(?:\[[0-9]+\]|[0-9]+[.)]){S}*"
DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
DOI_TAIL = r"[.,;:]+\z"
YEAR = rf"{B}(?:19|20)[0-9]{{2}}{E}"
QUOTED = r"[“\"]([^”\"]{3,})[”\"]"
TAIL = rf"[,;:{SPACE_CLASS}]+\z"
OPENING_TAIL = rf"[{SPACE_CLASS}(\[{{]+\z"
INITIAL_AT_END = rf"(?:^|[{SPACE_CLASS},])[A-Z]\.\z"
SEGMENT = rf"\.{S}*"
NOT_A_TITLE = r"(?i)(?:journal|proc|transactions|conference|press|springer|ieee|acm|arxiv|doi|https?)"
VENUE_WORD = r"(?i)(?:journal|proc|proceedings|conference|transactions|education|review|communications|press|springer|ieee|acm|sage|wiley)"
ARXIV_ID = rf"(?i){B}arXiv:{NS}+"
DOI_WITH_PREFIX = rf"(?i){B}doi:{S}*10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+"
DOI_WORD = rf"(?i){B}{DOI}"
URL = rf"(?i)https?://{NS}+"
PAGE_RANGE = rf"{B}([0-9]+{S}*[–—-]{S}*[0-9]+){E}"
DASH = rf"{S}*[–—-]{S}*"
VOLUME = rf"(?i){B}vol\.{S}*([A-Za-z0-9-]+)"
ISSUE = rf"(?i){B}no\.{S}*([A-Za-z0-9-]+)"
PAGES = rf"(?i){B}pp?\.{S}*([^,.;]+)"
LAST_YEAR = rf"(?:^|,{S}*)((?:19|20)[0-9]{{2}})[.;{SPACE_CLASS}]*\z"
FROM_VOLUME = rf"(?i){B}vol\.{S}*[A-Za-z0-9-]+.*\z"
FROM_PAGES = rf"(?i){B}pp?\.{S}*[^,.;]+.*\z"
LEADING_IN = rf"(?i)^{S}*in{S}+"
UP_TO_ACRONYM = rf"^(.+\([^)]*\)),{S}*.+\z"
_DATED = r"\([^)]*(?:19|20)[0-9]{2}[^)]*\)"
_PAGES_AFTER = r"([^.;]+(?:[–—-][^.;]+)?)"
JOURNAL_WITH_ISSUE = rf"^(.+?){S}+([0-9]+[A-Za-z]?),{S}*([A-Za-z0-9-]+){S}*{_DATED},{S}*{_PAGES_AFTER}"
JOURNAL = rf"^(.+?){S}+([0-9]+[A-Za-z]?){S}*{_DATED},{S}*{_PAGES_AFTER}"
ARTICLE = rf"(?i)^(.+?){S}+([0-9]+[A-Za-z]?),{S}*([A-Za-z0-9-]+),{S}*(Article{S}+[^,(]+).*?,{S}*([^.;]*pages?)"
PROCEEDINGS = rf"(?i){B}(?:In{S}+)?(Proceedings[^.]+)\."
VENUE_START = rf"(?i){B}((?:ACM|IEEE|Journal|Computers?|Education|Educational|Interactive|Technology|Research|Review|Communications|Transactions|Conference|Proc\.)[^.]+)\."
WRAPPED_DOI = rf"(?i)(doi:{S}*10\.[0-9]{{4,9}}/{NS}+){S}+([A-Za-z0-9])"
WRAPPED_DOI_TAIL = rf"(?i)(10\.[0-9]{{4,9}}/{NS}*[-./]){S}+([A-Za-z0-9])"
DOI_LINK_PREFIX = r"(?i)^https?://(?:dx\.)?doi\.org/"
