"""Word lists, patterns, weights and thresholds that results depend on.

All are stated as they are used; nothing here is computed.
"""

# Hosts.
SHORTENERS = ["bit.ly", "cutt.ly", "goo.gl", "is.gd", "lnkd.in", "ow.ly", "rebrand.ly", "s.id", "shorturl.at", "t.co", "tiny.cc", "tinyurl.com"]
SAFE_HOSTS = ["github.com", "gitlab.com", "youtube.com", "youtu.be", "wikipedia.org", "openai.com"]

# Text cleaning.
ZERO_WIDTH = "[\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]"
EMOJI = r"[\x{1F300}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]"
LEET_FROM, LEET_TO = "013457@$!|", "oieastasii"
URL = r"((?:https?://|www\.)[^\s<>()]+|(?:t|telegram)\.me/[^\s<>()]+)"
CHAT_LINK = r"((?:https?://)?(?:t|telegram)\.me/[A-Za-z0-9_+/?=&.-]+)"
AFTER_LINK = r"""[.,);\]"']+$"""

# Patterns on links.
BOT_LINK, BOT_START = r"(?:t|telegram)\.me/[a-z0-9_]*bot(?:\?|/)?", r"(?:start|startapp)="
INVITE_LINK = r"(?:t|telegram)\.me/(?:joinchat/|\+)"

# Patterns on deobfuscated text, and terms in it without separators.
PORN_PATTERNS = [
    r"free\s+porn",
    r"leaked?\s+(?:video|pics?)",
    r"18\+",
    r"watch\s+(?:before|b4)\s+(?:deleted|removed|takedown|ban)",
    r"private\s+(?:channel|group).*(?:girls|video|leak)",
    r"(?:hidden\s+cam|private\s+tape|full\s+tape|view\s+full\s+scene|watch\s+uncut)",
    r"(?:hot\s+)?instagram\s+girl.{0,60}(?:exposed|naked|riding|cock)",
    r"(?:got\s+exposed|exposed).{0,60}(?:riding|cock|naked|p\s*ssy|pussy|dick)",
    r"sex\s+video",
]
PORN_TERMS = ["freeporn", "leakedvideo", "18+video", "watchbeforedeleted", "watchbeforetakedown", "hiddencam", "privatetape", "viewfullscene", "watchuncut", "instagramgirlgotexposed", "hotinstagramgirl", "ridingcock"]
ADULT_PATTERNS = [
    r"\b(?:xxx|nsfw|onlyfans)\b",
    r"\bwet\s+dreams?\b",
    r"\b(?:hidden\s+cam|private\s+tape|full\s+tape|uncut\s+video|full\s+scene)\b",
    r"\b(?:leaked?|caught|spotted|banned|deleted|exclusive|live|hidden)\b.{0,60}\b(?:naked|p\s*ssy|pussy|dick|cock|f\s*cked|fucked|sex|swallowed|pounded|riding|balls\s+deep)\b",
    r"\b(?:step\s*sis|stepsis|stepmom|coworker|cousin|babysitter|maid|roommate|gym\s+girl|instagram\s+girl|hot\s+instagram\s+girl|masseuse|massageuse)\b.{0,90}\b(?:naked|xxx|p\s*ssy|pussy|dick|f\s*cked|fucked|swallowed|pounded|riding|cock|legs\s+wide|shower|exposed)\b",
    r"\b(?:naked|p\s*ssy|pussy|dick|cock|f\s*cked|fucked|sex)\b.{0,60}\b(?:video|tape|cam|full|watch|unlock|scene)\b",
    r"\b(?:hot\s+)?instagram\s+girl\b.{0,80}\b(?:got\s+)?exposed\b",
    r"\briding\s+cock\b",
]
ADULT_TERMS = ["xxx", "onlyfans", "hiddencam", "privatetape", "fulltape", "uncutvideo", "fullscene", "fcked", "pussy", "dick", "cock", "ridingcock", "gotexposed", "instagramgirl", "hotinstagramgirl", "stepmom", "stepsis", "gymgirl"]
CALL_PATTERNS = [
    r"\b(?:watch\s+now|see\s+more|view\s+full\s+(?:scene|video)?|tap\s+to\s+watch|tap\s+to\s+play|unlock\s+video|click\s+here)\b",
    r"\b(?:watch|view|unlock|tap|click)\b.{0,35}\b(?:full|video|scene|tape|uncut|here|now)\b",
    r"\bfull\b",
]
URGENCY_PATTERNS = [
    r"\blink\s+expires\s+in\s+\d+\s*(?:s|sec|secs|seconds|m|min|mins|minutes)\b",
    r"\b(?:watch|view|tap|click)\b.{0,45}\b(?:before|b4)\b.{0,25}\b(?:takedown|deleted|removed|ban)\b",
    r"\bleaked?\s+(?:just\s+)?\d+\s*(?:s|sec|secs|m|min|mins|minutes)\s+ago\b",
    r"\blast\s+chance\s+to\s+watch\b",
    r"\bprivate\s+tape\s+inside\b",
]
URGENCY_TERMS = ["linkexpiresin", "watchbeforetakedown", "watchbeforedeleted", "watchbeforeban", "leakedjust", "lastchancetowatch", "privatetapeinside"]
CRYPTO_PHRASES = ["airdrop", "connect wallet", "claim token", "crypto giveaway", "double your crypto", "wallet verification"]
REWARD_PHRASES = ["free telegram premium", "claim reward", "free gift", "you won", "limited reward", "nitro giveaway"]
LOGIN_PHRASES = ["login to continue", "telegram login", "verify your account", "click bot to verify", "scan qr to login"]
PROMOTION = r"\b(join|subscribe|follow)\b.{0,40}\b(channel|group|private)\b"
OBFUSCATED = r"[a-z][._\-* ]{1,3}[a-z][._\-* ]{1,3}[a-z]"
MENTION = r"@[A-Za-z0-9_]{3,}"

# Fixed values: (feature, weight, reason), summed in this order.
RULE_WEIGHTS = [
    ("domain_blocked", 0.86, "blocked domain"),
    ("bot_start", 0.42, "Telegram bot start link"),
    ("invite", 0.34, "Telegram invite link"),
    ("story", 0.18, "forwarded Telegram story"),
    ("shortener", 0.22, "shortened URL"),
    ("porn_bait", 0.44, "porn-bait wording"),
    ("adult_call", 0.38, "adult spam call-to-action"),
    ("urgency", 0.24, "urgent watch/expiry lure"),
    ("adult_story", 0.35, "adult clickbait story lure"),
    ("crypto", 0.40, "crypto scam wording"),
    ("reward", 0.34, "fake reward wording"),
    ("login", 0.46, "login phishing wording"),
    ("zero_width", 0.18, "zero-width characters"),
    ("obfuscated", 0.14, "obfuscated text"),
    ("many_emojis", 0.10, "many emojis"),
    ("mentions", 0.12, "excessive mentions"),
    ("promotion", 0.18, "channel promotion pattern"),
    ("repeated", 0.22, "repeated message"),
    ("joined", 0.10, "recently joined sender"),
    ("frequent", 0.12, "high message frequency"),
    ("violations", 0.18, "previous violations"),
]
# The signals that are counted, in order.
SIGNALS = ["has_url", "chat_link", "bot_start", "invite", "story", "shortener", "porn_bait", "adult_call", "urgency", "adult_story", "crypto", "reward", "login", "many_emojis", "obfuscated", "zero_width", "repeated", "joined", "frequent", "violations", "domain_blocked", "mentions", "promotion"]
# The classifier's lure of a feature and its reason; later ones win.
LURES = [
    ("domain_blocked", None, "blocked domain"),
    ("bot_start", "suspicious_bot_link", "suspicious bot start link"),
    ("invite", "suspicious_invite_link", "suspicious invite link"),
    ("porn_bait", "porn_bait", "porn-bait phrase"),
    ("adult_call", "porn_bait", "adult spam call-to-action"),
    ("urgency", "porn_bait", "urgent watch/expiry lure"),
    ("adult_story", "porn_bait", "adult clickbait story lure"),
    ("crypto", "crypto_scam", "crypto scam phrase"),
    ("reward", "fake_giveaway", "fake reward phrase"),
    ("login", "phishing", "login phishing language"),
]
# Private chats.
ABUSE = r"\b(?:fuck\s+you|stupid\s+bot|idiot|moron|bitch|shut\s+up|useless\s+bot)\b"
INAPPROPRIATE = r"\b(?:send\s+nudes?|nudes?|onlyfans|xxx|porn|sex\s+video|explicit\s+video)\b"
MALICIOUS = r"(?:rm\s+-rf\s+/|curl\s+\S+\s*\|\s*(?:sh|bash)|wget\s+\S+\s*\|\s*(?:sh|bash)|powershell\b.*-enc(?:odedcommand)?|subprocess\.(?:popen|run)\(|os\.system\(|eval\s*\(\s*base64|document\.cookie|<script\b|drop\s+table\b)"

# What makes an event worth reviewing.
REVIEW_WORDS = ["adult", "bait", "blocked", "crypto", "domain", "invite", "link", "obfuscated", "phishing", "porn", "reward", "scam", "spam", "suspicious", "telegram", "zero-width"]
REVIEW_TEXT = r"\b(?:watch\s+now|see\s+more|tap\s+to\s+watch|link\s+expires|onlyfans|xxx|nsfw|porn|naked|pussy|cock|dick|fucked|swallowed|riding|hot\s+instagram|instagram\s+girl|hidden\s+cam|private\s+tape|claim\s+reward|connect\s+wallet|verify\s+your\s+account)\b|(?:t|telegram)\.me/[a-z0-9_]*bot(?:\?|/)?"

# Support messages.
ISSUE_PHRASES = {
    "broken_link": ["broken", "expired", "expire", "fix", "not working", "dead link", "invalid link", "link expired", "link issue", "please fix"],
    "missing_episode": ["missing episode", "episode missing", "no episode", "missing ep"],
    "banned": ["banned", "copyright", "removed", "taken down", "takedown"],
    "playback": ["not playing", "cannot play", "won't play", "sound", "subtitles"],
}
REQUEST_PHRASES = ["request", "requesting", "need", "i need", "can i get", "send", "looking for", "find", "where can i", "where is", "do you have", "upload", "add", "search"]
NOT_BARE_TITLES = ["admin", "admins", "bro", "done", "good", "great", "hello", "hey", "hi", "lol", "nice", "no", "ok", "okay", "please", "pls", "seen", "thanks", "thank you", "this is good", "wow", "www", "yes"]
NOT_TITLES = ["help", "it", "link", "links", "me", "movie", "please", "season", "series", "show", "subtitle", "subtitles", "that", "this"]
HOWTO_PHRASES = ["how to download", "how do i download", "how to play", "how do i play", "how to watch", "tutorial", "guide"]
RELEASE_PHRASES = ["release date", "when will", "when is", "when does", "is it out", "is out", "released", "new season", "new episode", "next episode", "next season"]
CATEGORY_WORDS = {"movie": ["movie", "film"], "anime": ["anime"], "tv": ["series", "season", "episode", "tv show", "show"]}
STOP_PREFIXES = ["please", "pls", "plz", "hi", "hello", "can you", "could you", "can i get", "do you have", "where can i find", "where can i watch", "where is", "i need", "need", "requesting", "request for", "request", "send", "drop", "for", "upload", "add", "search for", "looking for", "link", "links", "when does", "when is", "when will"]
POLITE_SUFFIXES = ["please", "pls", "plz", "thanks", "thank you"]
MISSING_EPISODE = r"\bmissing\s+(?:episode|ep|e)\s*\d+\b|\b(?:episode|ep|e)\s*\d+\b.{0,24}\b(?:missing|not\s+there|not\s+available)\b"
# What is cut from a message, in this order, to leave a title.
TITLE_CUTS = [
    r"https?://\S+",
    r"\b(?:how\s+(?:to|do\s+i)\s+(?:download|play|watch)|tutorial|guide)\b",
    r"\b(?:click\s+here|new\s+episode\s+update|new\s+episodes?|updated?|download|open|watch|complete|full\s+episode)\b",
    r"\bmissing\s+(?:episode|ep|e)\s*\d+(?:\s*(?:-|–)\s*\d+)?\b",
    r"\b(?:episode|ep|e)\s*\d+(?:\s*(?:-|–)\s*\d+)?\s+(?:missing|not\s+there|not\s+available)\b",
    r"\b(?:broken|not\s+working|dead\s+link|invalid\s+link|missing\s+episode|episode\s+missing|banned|copyright|removed|taken\s+down|not\s+playing|cannot\s+play|won't\s+play|sound|subtitles?|expired|expire|please\s+fix|fix|thanks)\b",
    r"\bs\d{1,3}\s*e\d{1,4}(?:\s*(?:-|–)\s*\d{1,4})?\b",
    r"\b(?:season|series)\s*\d+\b",
    r"\bs\s*\d+\b",
    r"\b(?:episode|ep)\s*\d+(?:\s*(?:-|–)\s*\d+)?\b",
    r"\be\s*\d+(?:\s*(?:-|–)\s*\d+)?\b",
]
TITLE_KINDS = r"\b(?:movie|film|anime|series|season|episode|tv\s+show|show)\b"
TITLE_ENDS = [r"\s+(?:is|are)$", r"\s+(?:out|released|available|coming|coming\s+out)$"]
KEY_FILLERS = r"\b(?:requesting|request|please|pls|plz|fix|link|links|broken|expired|missing|banned|removed|movie|show|tv)\b"
PART_ONLY = [r"(?:season|series|s)\s*\d+(?:\s*(?:episode|ep|e)\s*\d+(?:\s*(?:-|–)\s*\d+)?)?", r"(?:episode|ep|e)\s*\d+(?:\s*(?:-|–)\s*\d+)?"]
CONTEXT_CUTS = [r"https?://\S+", r"\b(?:season|series)\s*\d+.*$", r"\b(?:episode|ep)\s*\d+(?:\s*(?:-|–)\s*\d+)?.*$", r"\b(?:click\s+here|new\s+episode\s+update|new\s+episodes?|download|complete)\b"]
SEASON_EPISODE = r"\bs0*(\d{1,3})\s*e0*(\d{1,4})\b"
SEASON = r"\b(?:season|series|s)\s*0*(\d{1,3})\b"
EPISODE = r"\b(?:episode|ep)\s*0*(\d{1,4})(?:\s*(?:-|–)\s*\d{1,4})?\b"
SHORT_EPISODE = r"\be0*(\d{1,4})\b"
EPISODE_RANGES = [r"\b(?:episode|ep|e)\s*0*(\d{1,4})(?:\s*(?:-|–)\s*0*(\d{1,4}))?\b", r"\bs\d{1,3}\s*e0*(\d{1,4})(?:\s*(?:-|–)\s*0*(\d{1,4}))?\b"]
NOT_READY = ["future_movie", "future_tv", "future_season", "future_episode", "season_unconfirmed", "episode_unlisted", "unknown_episode_date", "unknown_season_date"]
# Thresholds of a group, and modes as (mode, silent, ban).
THRESHOLDS = {"delete": 0.88, "ban": 0.96, "low": 0.55, "high": 0.87}
MODES = ["normal", "auto_delete", "silent", "monitor_only", "aggressive"]
EXAMPLES_SEEN, EXAMPLES_KEPT, HISTORY_SEEN, HISTORY_KEPT = 100, 4, 250, 10
