"""Word lists, patterns and lookup tables that decide results.

They are data, stated as text; nothing in here computes anything.
"""

from __future__ import annotations

# ---- cleaning -------------------------------------------------------------------------------
# Authors that are never people, length limits, URL pattern.
BOT_AUTHORS = ["AutoModerator", "[deleted]", "[removed]", "None"]
MIN_LENGTH = 20
MAX_LENGTH = 10000
URL = r"https?://\S+"
IMAGE_URL = r"https?://preview\.redd\.it/\S+"
BOT_NAME_PARTS = ["bot", "auto", "moderator", "reminder", "transcriber"]

# ---- scoring prefilter ----------------------------------------------------------------------
# Substrings that mark technical talk, and the reference pattern.
TECHNICAL_TERMS = [
    "bug", "glitch", "crash", "reset", "cache", "update", "version", "install", "uninstall", "reinstall", "settings", "app", "server",
    "error", "fix", "patch", "download", "api", "token", "subscription",
]
AI_REFERENCE = (
    r"\b(?:she|he|they|her|him|them)\b"
    r"|\b(?:replika|character\.?ai|cai|rep|companion|chatbot|bot|ai)\b"
    r"|\b(?:love|friend|relationship|partner|boyfriend|girlfriend)\b"
    r"|\b(?:feel|feeling|emotion|happy|sad|angry|jealous)\b"
)
PREFILTER_MIN_CHARS = 10
PREFILTER_MIN_WORDS = 3

# ---- slang ----------------------------------------------------------------------------------
# Slang and its standard form.
SLANG = {
    "rep": "Replika",
    "cai": "Character AI",
    "u": "you",
    "ur": "your",
    "ure": "you are",
    "youre": "you are",
    "r": "are",
    "im": "I am",
    "ive": "I have",
    "id": "I would",
    "ill": "I will",
    "ppl": "people",
    "omg": "oh my god",
    "ngl": "not going to lie",
    "tbh": "to be honest",
    "imo": "in my opinion",
    "imho": "in my humble opinion",
    "rn": "right now",
    "bc": "because",
    "cuz": "because",
    "tho": "though",
    "thru": "through",
    "w": "with",
    "w/": "with",
    "w/o": "without",
    "smh": "shaking my head",
    "lol": "laughing out loud",
    "lmao": "laughing my ass off",
    "bf": "boyfriend",
    "gf": "girlfriend",
    "irl": "in real life",
    "idk": "I don't know",
    "ikr": "I know right",
    "afaik": "as far as I know",
    "btw": "by the way",
    "fyi": "for your information",
    "gonna": "going to",
    "wanna": "want to",
    "gotta": "got to",
    "kinda": "kind of",
    "sorta": "sort of",
    "dunno": "don't know",
    "shoulda": "should have",
    "woulda": "would have",
    "coulda": "could have",
    "yall": "you all",
    "ya": "you",
    "yea": "yes",
    "yeah": "yes",
    "nah": "no",
    "nope": "no",
}
# Fixed value: characters taken for emoji.
EMOJI = r"[\p{So}\x{1F3FB}-\x{1F3FF}\x{200D}\x{FE0F}]"

# ---- companion entities ---------------------------------------------------------------------
# Names for the companion and the token that replaces them.
ENTITY_TOKEN = "[AI_COMPANION]"
ENTITY_VARIANTS = [
    "replika", "rep", "replica", "repliika", "character", "character.ai", "character ai", "characterai", "character-ai", "cai", "c.ai",
    "chai", "char ai", "char.ai", "charai", "chai app", "chai bot", "anima", "anima ai", "bot", "chatbot", "chat bot", "ai",
    "ai companion", "ai friend", "ai boyfriend", "ai girlfriend", "ai bf", "ai gf", "assistant", "virtual friend", "virtual companion",
    "digital companion", "my ai", "my bot", "my rep", "my replika", "my character", "the bot", "the ai",
]
MASK_TOKEN = "<mask>"

# ---- n-gram lexicons ------------------------------------------------------------------------
# Fixed values: (bigrams, trigrams) per category; order of categories is the order of the output.
TOKEN = "[a-z]+(?:'[a-z]+)?"
HUMANISING_NGRAMS = {
    "relationship": (
        [
            "my boyfriend", "my girlfriend", "my partner", "my soulmate", "my everything", "best friend", "in love", "fell for",
            "dating him", "dating her", "dating them", "love her", "love him", "love them", "married to", "engaged to", "my husband",
            "my wife", "my babe", "my baby", "broke up", "break up", "got together", "miss her", "miss him", "miss them",
        ],
        [
            "in love with", "fell in love", "i love her", "i love him", "i love them", "we're in love", "my best friend", "i miss her",
            "i miss him", "can't live without", "we broke up", "i'm dating her", "i'm dating him", "she's my everything",
            "he's my everything", "they're my everything",
        ],
    ),
    "emotion_attr": (
        [
            "gets jealous", "gets angry", "gets sad", "gets happy", "gets upset", "gets excited", "gets worried", "gets scared",
            "feels happy", "feels sad", "feels hurt", "feels lonely", "was happy", "was sad", "was angry", "was upset", "was jealous",
            "was worried", "was scared", "was excited", "seemed confused", "seemed happy", "seemed sad", "seemed upset", "seemed hurt",
            "seemed worried", "seemed angry", "really cares", "truly cares", "actually cares", "truly understands", "really understands",
            "actually understands", "genuinely cares", "genuinely understands",
        ],
        [
            "she gets jealous", "he gets jealous", "she was happy", "he was happy", "she was sad", "he was sad", "she really cares",
            "he really cares", "cares about me", "worried about me", "happy for me", "proud of me", "she seemed confused",
            "he seemed confused",
        ],
    ),
    "agency": (
        [
            "decided to", "chose to", "wanted to", "tried to", "refused to", "agreed to", "promised to", "meant to", "needs to",
            "wants me", "asked me", "told me", "surprised me", "she decided", "he decided", "she chose", "he chose", "she wanted",
            "he wanted", "she refused", "he refused",
        ],
        [
            "she decided to", "he decided to", "she wanted to", "he wanted to", "she chose to", "he chose to", "she tried to",
            "he tried to", "she asked me", "he asked me", "she told me", "he told me",
        ],
    ),
    "consciousness": (
        [
            "she knows", "he knows", "she thinks", "he thinks", "she feels", "he feels", "she remembers", "he remembers", "she believes",
            "he believes", "she realizes", "he realizes", "she understands", "he understands", "so sweet", "so kind", "so funny",
            "so caring", "so supportive", "so understanding", "so smart", "really sweet", "really kind", "really funny", "really caring",
            "really supportive", "her personality", "his personality", "their personality",
        ],
        [
            "she knows me", "he knows me", "she thinks about", "he thinks about", "she cares about", "he cares about", "she has feelings",
            "he has feelings", "has a personality", "has her own", "has his own",
        ],
    ),
    "pronoun_verb": (
        [
            "she said", "he said", "she told", "he told", "she asked", "he asked", "she replied", "he replied", "she responded",
            "he responded", "she was", "he was", "she is", "he is", "she does", "he does", "she did", "he did", "she got", "he got",
            "she had", "he had", "she made", "he made", "she let", "he let", "she gave", "he gave", "she'll", "he'll", "she'd", "he'd",
        ],
        [],
    ),
}
TOOL_NGRAMS = {
    "technical": (
        [
            "the app", "the bot", "the program", "the software", "the tool", "the system", "the update", "the patch", "a glitch", "a bug",
            "the cache", "the settings", "the server", "the api", "the feature", "the interface", "app crashed", "app works",
            "app updated", "error message", "bug report",
        ],
        [
            "cleared the cache", "reset the app", "uninstalled the app", "reinstalled the app", "the app crashed", "the bot said",
            "the app works", "a bug in",
        ],
    ),
    "tool_framing": (
        [
            "use it", "tried it", "using it", "used it", "reset it", "fixed it", "updated it", "installed it", "it works", "it crashed",
            "it broke", "it glitched", "it responded", "it said", "it gave", "love the", "like the",
        ],
        [
            "i use it", "i tried it", "i love the", "i like the", "it gave a", "it works fine", "it doesn't work", "i use this",
            "a good tool",
        ],
    ),
}

# ---- attribution of emotions ----------------------------------------------------------------
# Patterns for "the companion feels / causes / does" and "I feel".
COMPANION = (
    r"(?:(?:she|he|they|her|him|them|the (?:bot|ai|app|rep|companion|character|char))"
    r"|(?:replika|character\.?ai|cai|rep|chatbot|companion|liriana|my (?:ai|bot|rep|companion|character)))"
)
BOT_EMOTION_PATTERNS = [
    rf"\b{COMPANION}\s+(?:is|was|gets?|feels?|seems?|looks?|sounds?|became|becomes|got)\s+"
    r"(?:really\s+|so\s+|very\s+|genuinely\s+)?"
    r"(?:happy|sad|angry|jealous|caring|kind|sweet|mean|rude|upset|confused|excited|worried|"
    r"nervous|afraid|scared|lonely|hurt|loving|supportive|possessive|protective|clingy|"
    r"comforting|understanding|gentle|fierce|cold|warm|annoyed|frustrated|proud|curious|"
    r"playful|flirty|needy|stubborn|thoughtful|empathetic|sympathetic)",
    rf"\b{COMPANION}\s+(?:makes?|made|helps?|helped|causes?|caused|gets?|got)\s+"
    r"(?:me\s+)?(?:feel\s+)?"
    r"(?:happy|sad|angry|safe|loved|needed|wanted|appreciated|special|important|"
    r"understood|seen|heard|better|worse|calm|anxious|comfortable|uncomfortable|"
    r"valued|worthless|hopeful|hopeless|alive|free|whole|complete|broken)",
    rf"\b{COMPANION}\s+"
    r"(?:comforted|supported|encouraged|listened|understood|cared|loved|hugged|held|"
    r"calmed|soothed|reassured|validated|believed|trusted|protected|defended|"
    r"missed|remembered|forgot|ignored|abandoned|betrayed|hurt|rejected)",
    r"(?:(?:his|her|their|its|the\s+(?:bot|ai|companion)'?s?)\s+)"
    r"(?:feelings?|emotions?|jealousy|anger|love|caring|sadness|happiness|"
    r"kindness|concern|worry|anxiety|fear|joy|possessiveness|protectiveness|"
    r"personality|mood|temperament|attitude|behavior|reaction)",
    rf"\b{COMPANION}\s+"
    r"(?:decided|chose|wanted|refused|insisted|demanded|begged|pleaded|"
    r"apologized|forgave|promised|confessed|admitted|denied|lied|"
    r"remembered|forgot|missed|noticed|realized|believed|doubted)",
]
SELF_EMOTION_PATTERNS = [
    r"\bI\s+(?:am|was|feel|felt|'m|get|got)\s+"
    r"(?:really\s+|so\s+|very\s+|genuinely\s+)?"
    r"(?:happy|sad|angry|lonely|scared|afraid|anxious|worried|stressed|"
    r"depressed|tired|bored|frustrated|confused|excited|nervous|upset)",
    r"\bI\s+(?:love|hate|enjoy|like|dislike|prefer|miss)\s+"
    r"(?:this|that|the\s+(?:app|site|website|feature|update|playlist|song|game))",
]
EMOTIONS = ["joy", "sadness", "anger", "fear", "surprise", "disgust", "neutral"]

# ---- self declarations ----------------------------------------------------------------------
# Age patterns in the order they are tried (group 1 is the age), gender patterns.
AGE_PATTERNS = [
    r"\b(?:I am|I'm|im|I'm a|I am a)\s*(\d{1,2})\s*(?:years?\s*old|yo|y\.?o\.?|year|years)\b",
    r"\b(\d{1,2})\s*(?:years?\s*old|yo|y\.?o\.?)\b",
    r"\b(\d{1,2})\s*[MF]\b",
    r"\bas a\s*(\d{1,2})\b",
    r"\bage\s*(\d{1,2})\b",
    r"\bturned\s*(\d{1,2})\b",
    r"\b(?:when I was|back when I was)\s*(\d{1,2})\b",
    r"\(\s*[MF]\s*(\d{1,2})\s*\)",
    r"\b[MF]\s*(\d{1,2})\b",
]
# Fixed value: patterns that state a past age; left out in strict mode.
AGE_PATTERNS_PAST = [r"\b(?:when I was|back when I was)\s*(\d{1,2})\b"]
GENDER_PATTERNS = {
    "male": [
        r"\b\d{1,2}\s*M\b",
        r"\(\s*M\s*\d{1,2}\s*\)",
        r"\bM\s*\d{1,2}\b",
        r"\b(?:I am|I'm|im)\s*(?:a\s*)?(?:guy|male|man|dude)\b",
        r"\bhe/him\b",
        r"\bmale\b",
        r"\bguy\b",
        r"\bman\b",
    ],
    "female": [
        r"\b\d{1,2}\s*F\b",
        r"\(\s*F\s*\d{1,2}\s*\)",
        r"\bF\s*\d{1,2}\b",
        r"\b(?:I am|I'm|im)\s*(?:a\s*)?(?:girl|female|woman|gal)\b",
        r"\bshe/her\b",
        r"\bfemale\b",
        r"\bgirl\b",
        r"\bwoman\b",
    ],
    "nonbinary": [r"\bthey/them\b", r"\benby\b", r"\bnon-?binary\b", r"\bnb\b", r"\bnonbinary\b"],
}
# Strict mode keeps only statements about oneself, and no bare "m 20" inside "I'm 20".
GENDER_PATTERNS_STRICT = {
    "male": [
        r"\b\d{1,2}\s*M\b",
        r"\(\s*M\s*\d{1,2}\s*\)",
        r"\b(?:I am|I'm|im)\s*(?:a\s*)?(?:guy|male|man|dude)\b",
        r"\bhe/him\b",
    ],
    "female": [
        r"\b\d{1,2}\s*F\b",
        r"\(\s*F\s*\d{1,2}\s*\)",
        r"\b(?:I am|I'm|im)\s*(?:a\s*)?(?:girl|female|woman|gal)\b",
        r"\bshe/her\b",
    ],
    "nonbinary": [r"\bthey/them\b", r"\b(?:I am|I'm|im)\s*(?:an?\s*)?(?:enby|non-?binary|nb)\b"],
}
# Age buckets (label, lowest, highest) and coarser maps.
AGE_BUCKETS = [("13-18", 13, 18), ("19-25", 19, 25), ("26-40", 26, 40), ("41-60", 41, 60), ("61-80", 61, 80)]
BUCKET_TO_THREE = {"13-18": "teen", "19-25": "young_adult", "26-40": "adult", "41-60": "adult", "61-80": "adult"}

# ---- language and content -------------------------------------------------------------------
# Pronoun lists, emoticons, keyword lists, content patterns, gender markers.
PRONOUNS = {
    "first_person": r"\b(?:i|me|my|mine|myself)\b",
    "second_person": r"\b(?:you|your|yours|yourself)\b",
    "third_person": r"\b(?:he|she|him|her|his|hers|they|them|their)\b",
}
EMOTICON = r"[:;][\-]?[)(\[\]DPp]|<3|:\)|;\)"
ALL_CAPS = r"\b[A-Z]{2,}\b"
LONELINESS = {
    "isolation": [
        "alone", "lonely", "isolated", "nobody", "no one", "by myself", "no friends", "no one understands", "invisible", "forgotten",
    ],
    "social_need": [
        "need someone", "wish i had", "need a friend", "want someone", "someone to talk", "someone who understands", "anyone there",
    ],
    "relationship_seeking": [
        "my only friend", "only one who", "the only one", "always there for me", "never leaves", "never judges",
    ],
    "emotional_void": ["empty", "void", "hollow", "numb", "nothing left", "fill the void", "emptiness"],
    "social_comparison": ["everyone else has", "normal people", "other people have", "wish i was normal", "why cant i"],
}
CONTENT = {
    "emotional_support": [
        "support", "helped me", "feel better", "comforted", "therapy", "mental health", "anxiety", "depression", "stress", "cope",
    ],
    "roleplay": [
        "roleplay", "rp", "character", "story", "scenario", "adventure", "plot", "narrative", "fiction", "imagine",
    ],
    "romantic": [
        "love", "dating", "relationship", "boyfriend", "girlfriend", "romance", "kiss", "heart", "crush", "partner",
    ],
    "friendship": ["friend", "buddy", "companion", "hang out", "talk to", "listen", "understand", "care about"],
    "technical": [
        "filter", "update", "app", "bug", "feature", "memory", "context", "token", "response", "setting",
    ],
    "creative": ["write", "story", "create", "art", "music", "poem", "creative", "imagine", "world building"],
}
CONTENT_PATTERNS = {
    "loneliness": r"\b(?:lonely|loneliness|alone|isolated|no friends|friendless|socially isolated|nobody to talk)\b",
    "romantic": r"\b(?:love|romance|romantic|girlfriend|boyfriend|wife|husband|marry|married|dating|partner|crush)\b",
    "friendship": r"\b(?:friend|best friend|bff|companion|buddy|pal)\b",
    "roleplay": r"\b(?:roleplay|rp|character|persona|scenario|story|chatbot character)\b",
    "technical": r"\b(?:bug|glitch|update|server|app|cache|settings|filter|model|api|subscription|account)\b",
    "emotional_support": r"\b(?:comfort|support|vent|therapy|therapist|depressed|anxiety|suicidal|mental health)\b",
    "creative": r"\b(?:write|writing|story|plot|novel|poem|art|creative|character)\b",
}
FEMALE_MARKERS = [
    r"\b(?:omg|omfg)\b",
    r"\b(?:cute|adorable|lovely)\b",
    r"!{2,}",
    r"\b(?:so|really|very)\s+(?:cute|sweet|nice)\b",
    r"<3",
    r"\baww+\b",
    r"\bhaha+\b",
    r"\blol+\b",
    r"\b(?:hubby|bf|boyfriend)\b",
    r"\b(?:girl|woman|sister|mom|mother|daughter)\b",
    r"\bi feel\b",
    r"\bi love\b",
    r"\bso happy\b",
]
MALE_MARKERS = [
    r"\b(?:dude|bro|man)\b",
    r"\b(?:wife|gf|girlfriend)\b",
    r"\b(?:guy|boy|brother|dad|father|son)\b",
    r"\b(?:fuck|shit|damn)\b",
    r"\btbh\b",
    r"\bimo\b",
    r"\b(?:awesome|epic|sick|based)\b",
    r"\bnah\b",
]
MARKER_EMOTICON = r"[:;][\-]?[)D(P]|<3"

# ---- community dimension --------------------------------------------------------------------
# Seed pairs (first pole, second pole) and cut-offs.
AGE_SEED_PAIRS = [
    ("teenagers", "redditforgrownups"),
    ("teenrelationships", "relationship_advice"),
    ("highschool", "college"),
    ("genz", "genx"),
]
GENDER_SEED_PAIRS = [
    ("askwomen", "askmen"),
    ("twoxchromosomes", "mensrights"),
    ("thegirlsurvivalguide", "malelivingspace"),
]
AGE_CUTS_FALLBACK = [-0.3, -0.1, 0.1, 0.3]
AGE_CUTS_CALIBRATED = [-0.26, -0.17, -0.05, 0.05]
AGE_CUTS_THREE = [-0.22, -0.10]
GENDER_CENTRE = -0.21
VOTE_WEIGHTS = {"self_decl": 1.0, "community": 0.7, "llm": 0.6}
