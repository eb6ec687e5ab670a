"""Patterns, keywords, and thresholds that results depend on."""

# --- fixed values -----------------------------------------------------------------------

# Unicode white space, spelled out because \s is ASCII-only in Java and RE2 regexes.
# Single Latin-1 characters come first and one by one: Java tests those with one table lookup.
WS_RARE = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x{85}\x{a0}"
    r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = r"[\x20" + WS_RARE + "]"
WS_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
LINE_BREAK = r"(?:\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}])"

# Link removal, applied in this order.
LINK_PATTERNS = [
    (r"(http://|https://)?t\.me/joinchat/[a-zA-Z0-9_-]{5,32}", ""),
    (r"(http://|https://)?t\.me/[a-zA-Z0-9_]{5,32}", ""),
    (r"@[a-z0-9_A-Z]+", ""),
    (r"<img[^<>]+(>|$)", " image_token "),
    (r"<[^<>]+(>|$)", ""),
    (r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+", ""),
]

# Characters that text cleaning keeps besides white space and the hyphen. The second line lists
# the code points that fold to a-z or to Cyrillic letters when case is ignored.
LETTERS = r"a-zA-Zа-яА-Я" r"\x{130}\x{131}\x{17f}\x{1c80}-\x{1c86}\x{212a}"

# A handle after a site prefix or mention sign, and a bare handle.
HANDLE_IN_TEXT = r"(t\.me/|@)([a-zA-Z0-9_]{5,32})"
HANDLE_ALONE = r"^([a-zA-Z0-9_]{5,32})" + WS + r"?$"

# Header lines that start with a mention or a link (the rule a caller passes for `header_text`).
MENTION_LINE = r"@[a-zA-Z0-9_]+|(?:http://|https://)?t\.me/[a-zA-Z0-9_]{5,32}"

# Code points with the Unicode property Emoji, without the digits, '#' and '*'.
EMOJI = (
    r"\x{a9}\x{ae}\x{203c}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21a9}\x{21aa}\x{231a}\x{231b}"
    r"\x{2328}\x{23cf}\x{23e9}-\x{23f3}\x{23f8}-\x{23fa}\x{24c2}\x{25aa}\x{25ab}\x{25b6}\x{25c0}"
    r"\x{25fb}-\x{25fe}\x{2600}-\x{2604}\x{260e}\x{2611}\x{2614}\x{2615}\x{2618}\x{261d}\x{2620}"
    r"\x{2622}\x{2623}\x{2626}\x{262a}\x{262e}\x{262f}\x{2638}-\x{263a}\x{2640}\x{2642}"
    r"\x{2648}-\x{2653}\x{265f}\x{2660}\x{2663}\x{2665}\x{2666}\x{2668}\x{267b}\x{267e}\x{267f}"
    r"\x{2692}-\x{2697}\x{2699}\x{269b}\x{269c}\x{26a0}\x{26a1}\x{26a7}\x{26aa}\x{26ab}\x{26b0}"
    r"\x{26b1}\x{26bd}\x{26be}\x{26c4}\x{26c5}\x{26c8}\x{26ce}\x{26cf}\x{26d1}\x{26d3}\x{26d4}"
    r"\x{26e9}\x{26ea}\x{26f0}-\x{26f5}\x{26f7}-\x{26fa}\x{26fd}\x{2702}\x{2705}"
    r"\x{2708}-\x{270d}\x{270f}\x{2712}\x{2714}\x{2716}\x{271d}\x{2721}\x{2728}\x{2733}\x{2734}"
    r"\x{2744}\x{2747}\x{274c}\x{274e}\x{2753}-\x{2755}\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}"
    r"\x{27a1}\x{27b0}\x{27bf}\x{2934}\x{2935}\x{2b05}-\x{2b07}\x{2b1b}\x{2b1c}\x{2b50}\x{2b55}"
    r"\x{3030}\x{303d}\x{3297}\x{3299}"
    r"\x{1f004}\x{1f0cf}\x{1f170}\x{1f171}\x{1f17e}\x{1f17f}\x{1f18e}\x{1f191}-\x{1f19a}"
    r"\x{1f201}\x{1f202}\x{1f21a}\x{1f22f}\x{1f232}-\x{1f23a}\x{1f250}\x{1f251}"
    r"\x{1f300}-\x{1f321}\x{1f324}-\x{1f393}\x{1f396}\x{1f397}\x{1f399}-\x{1f39b}"
    r"\x{1f39e}-\x{1f3f0}\x{1f3f3}-\x{1f3f5}\x{1f3f7}-\x{1f4fd}\x{1f4ff}-\x{1f53d}"
    r"\x{1f549}-\x{1f54e}\x{1f550}-\x{1f567}\x{1f56f}\x{1f570}\x{1f573}-\x{1f57a}\x{1f587}"
    r"\x{1f58a}-\x{1f58d}\x{1f590}\x{1f595}\x{1f596}\x{1f5a4}\x{1f5a5}\x{1f5a8}\x{1f5b1}"
    r"\x{1f5b2}\x{1f5bc}\x{1f5c2}-\x{1f5c4}\x{1f5d1}-\x{1f5d3}\x{1f5dc}-\x{1f5de}\x{1f5e1}"
    r"\x{1f5e3}\x{1f5e8}\x{1f5ef}\x{1f5f3}\x{1f5fa}-\x{1f64f}\x{1f680}-\x{1f6c5}"
    r"\x{1f6cb}-\x{1f6d2}\x{1f6d5}-\x{1f6d7}\x{1f6dc}-\x{1f6e5}\x{1f6e9}\x{1f6eb}\x{1f6ec}"
    r"\x{1f6f0}\x{1f6f3}-\x{1f6fc}\x{1f7e0}-\x{1f7eb}\x{1f7f0}\x{1f90c}-\x{1f93a}"
    r"\x{1f93c}-\x{1f945}\x{1f947}-\x{1f9ff}\x{1fa70}-\x{1fa7c}\x{1fa80}-\x{1fa89}"
    r"\x{1fa8f}-\x{1fac6}\x{1face}-\x{1fadc}\x{1fadf}-\x{1fae9}\x{1faf0}-\x{1faf8}"
)
# One emoji with its variation selector, skin tone or tag letters; joined emoji; flags; keycaps.
_ONE_EMOJI = "[" + EMOJI + r"][\x{fe0f}\x{1f3fb}-\x{1f3ff}\x{e0020}-\x{e007f}]*"
# A cheap superset of the first characters, tested before the long class.
EMOJI_START = r"[#*0-9\x{a9}\x{ae}\x{203c}-\x{3299}\x{1f004}-\x{1faf8}]"
EMOJI_SEQUENCE = (
    _ONE_EMOJI + r"(?:\x{200d}" + _ONE_EMOJI + ")*"
    r"|[\x{1f1e6}-\x{1f1ff}]{2}|[0-9#*]\x{fe0f}?\x{20e3}"
)

SENTENCE_END = ".!?…"
TOKEN = r"[\p{L}\p{N}_]{2,}"  # a term of the tf-idf vocabulary

# Thresholds.
RECENT_AFTER = "2021-05-31"  # messages strictly after this day
LONG_MESSAGE_WORDS = 7  # a long message has more words than this
WORD_VECTOR_TOKENS = 3  # the word-vector encoder needs more tokens than this
MIN_SENTENCE_WORDS = 7
MIN_MESSAGES = 20
MIN_SENTENCES = 50
MAX_SENTENCES = 500
MAX_DESCRIPTION_SENTENCES = 20
MIN_PAGE_WORDS = 3
MAX_TOKENS = 64
ENCODER_BATCH = 128
NEIGHBOURS = 50
RESULTS = 5
COMMUNITY_THRESHOLD = 0.85
COMMUNITY_MIN_SIZE = 200
TFIDF_MIN_DF = 5
TFIDF_MAX_FEATURES = 10_000

# Page classes of the header, the messages and the subscriber line.
HEADER_CLASS = "tgme_channel_info_description"
MESSAGE_CLASS = "tgme_widget_message_text"
EXTRA_CLASS = "tgme_page_extra"

# Menu texts of the request router.
BY_CHANNEL = "Поиск по каналу"
BY_DESCRIPTION = "Поиск по описанию"
RANDOM = "Случайный канал"
HELP = "Помощь"

# Community names of the published map, by label.
COMMUNITY_NAMES = {
    0: "Остальное",
    1: "Английский сегмент",
    2: "Узбекский сегмент",
    3: "Психология, саморазвитие и др.",
    4: "Инвестиции и финансы",
    5: "Работа и образование",
    6: "Новости и политика",
    7: "Спорт",
}

# --- end of fixed values ----------------------------------------------------------------
