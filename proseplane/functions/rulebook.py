"""The style rules and plain-English replacements that scores depend on."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class ListRule:
    """Counts hits of words or phrases; up to `soft` hits weigh half."""

    name: str
    weight: int
    soft: int
    hard: int
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class RegexRule:
    """Counts hits of regular expressions, all of them together."""

    name: str
    weight: int
    hard: int
    patterns: tuple[str, ...]


@dataclass(frozen=True)
class SignalRule:
    """Weighs each signal short of `least` in texts of at least `min_length` characters."""

    name: str
    weight: int
    least: int
    min_length: int
    ignore_case: bool
    pattern: str
    #: Characters that every hit begins with one of, as in a character class; empty: any.
    begins: str = ""


VERSION = "0.4.0"

# The lists, weights, thresholds and patterns below must stay as they are for equal scores.

WORDS = (
    ListRule("abstract_possessives", 3, 2, 5, (
        "body's", "earth's", "person's", "country's", "people's", "individual's", "company's", "family's", "world's", "nation's", "child's",
        "patient's", "client's", "customer's", "user's",
    )),
    ListRule("ai_hedging_adverbs", 2, 3, 8, (
        "carefully", "ultimately", "additionally", "specifically", "generally", "typically", "particularly", "essentially", "fundamentally",
        "primarily", "predominantly", "subsequently",
    )),
    ListRule("ai_categorical_nouns", 2, 3, 8, (
        "variety", "factors", "challenges", "goals", "preferences", "recommendations", "considerations", "aspects", "elements", "components",
        "characteristics",
    )),
    ListRule("liang_2024_lexical_tells", 4, 1, 3, (
        "delve", "delves", "delving", "meticulous", "meticulously", "tapestry", "realm", "realms", "intricate", "intricately", "landscape",
        "ecosystem", "paradigm", "multifaceted", "navigate", "navigating", "embark", "foster", "fosters", "harness", "harnessing",
    )),
    ListRule("corporate_filler", 3, 1, 2, (
        "utilize", "utilizes", "utilizing", "utilization", "facilitate", "facilitates", "facilitating", "optimize", "optimizes", "optimizing",
        "optimization", "streamline", "streamlines", "streamlining", "synergy", "synergies", "synergistic", "leverage", "leverages", "leveraging",
    )),
    ListRule("ai_amplifiers", 2, 3, 6, (
        "incredibly", "remarkably", "truly", "vital", "crucial", "essential", "paramount", "pivotal",
    )),
    ListRule("hollow_grand_claims", 4, 0, 2, (
        "transformative", "groundbreaking", "revolutionary", "cutting-edge", "state-of-the-art", "next-generation", "innovative", "trailblazing",
        "pioneering",
    )),
)

PHRASES = (
    ListRule("meta_hedge", 8, 0, 1, (
        "it's important to note", "it is important to note", "it's worth noting", "it is worth noting", "it's worth mentioning",
        "it is worth mentioning", "it should be noted that", "it should be mentioned", "i would like to point out", "i'd like to point out",
        "please note that",
    )),
    ListRule("structural_summary", 6, 0, 1, (
        "in conclusion", "in summary", "to summarize", "to sum up", "overall, the", "ultimately, the", "in essence",
    )),
    ListRule("structural_transitions", 3, 2, 5, (
        "moreover", "furthermore", "additionally,", "consequently,", "on the other hand", "in contrast,", "nevertheless,", "nonetheless,",
    )),
    ListRule("ai_safety_disclaimer", 15, 0, 0, (
        "as an ai language model", "as an ai assistant", "i'm just an ai", "i am just an ai", "i don't have personal", "i do not have personal",
        "i don't have opinions", "i'm sorry but i can't", "i'm sorry, i can't", "i'm unable to provide", "it's important to note that i",
    )),
    ListRule("reflexive_helpers", 4, 0, 2, (
        "can be a great way to", "is a great way to", "is one of the best ways", "may help to", "may help you", "good idea to consult",
        "always a good idea to", "it's always a good idea",
    )),
    ListRule("exemplar_padding", 6, 0, 1, (
        "including but not limited to", "such as but not limited to", "to name a few", "just to name a few", "among other things", "among others",
    )),
    ListRule("generic_caveat", 4, 1, 3, (
        "depending on a variety of factors", "depends on a number of factors", "depending on a number of factors", "varies depending on",
        "depending on your individual", "depending on your specific", "factors such as", "a variety of factors",
    )),
    ListRule("enumeration_padding", 4, 1, 3, (
        "here are a few", "here are some", "there are several", "there are a few", "below are some", "the following are",
    )),
    ListRule("important_to_X", 5, 1, 3, (
        "important to remember", "important to consider", "important to understand", "essential to understand", "crucial to understand",
        "key to understanding",
    )),
)

#: weight, least characters, threshold
HEADING_DENSITY = (5, 500, 3.0)
LIST_DENSITY = (5, 500, 0.5)
#: weight, least sentences, threshold
SENTENCE_LENGTH_CV = (10, 5, 0.35)
#: weight, least characters, least sentences, threshold
SHORT_SENTENCE_RATIO = (4, 300, 5, 0.02)
#: weight, least paragraphs, threshold
PARAGRAPH_UNIFORMITY = (6, 3, 0.3)
#: weight, openings without penalty, pattern
PARA_OPENING_ENUMERATION = (5, 2, r"^\s*(first(?:ly)?,|second(?:ly)?,|third(?:ly)?,|finally,|lastly,|moreover,|furthermore,|additionally,|in\s+addition,|on\s+the\s+other\s+hand,|in\s+contrast,|\d+[\.\)]\s+|[-*•]\s+)")

PRETENCE = (
    RegexRule("vague_personal_experience", 5, 1, (
        r"\bin my (?:personal )?experience\b",
        r"\bfrom my (?:personal )?experience\b",
        r"\bbased on my experience\b",
        r"\bspeaking from (?:personal )?experience\b",
        r"\bas someone who (?:has|is) (?:been|worked|lived|tried|used)\b",
        r"\bi['’]ve been (?:\w+ing )?for \d+ (?:years|months)\b",
        r"\bfor the past \d+ years\b(?!.*\b(?:studies|research|reports|data)\b)",
        r"\bi['’]ve found that\b",
        r"\bin my \d+ years of\b",
    )),
    RegexRule("generic_authority_claim", 5, 1, (
        r"\btrust me\b,",
        r"\bbelieve me\b,",
        r"\bi strongly believe that\b",
        r"\bi firmly believe that\b",
        r"\bi can assure you\b",
    )),
)

SIGNALS = (
    SignalRule("concrete_specifics", 5, 2, 300, False, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b\d{2,}\b|\b(?:19|20)\d{2}\b", r"A-Z\d"),
    SignalRule("contrarian_hinge", 5, 1, 300, True, r"\b(?:but|however,|actually,|unless|although|despite|yet,)\b", "abduhy"),
)

#: Buckets in order; within one, longer keys come first. Case matters; keys are plain substrings.
REPLACEMENTS = {
    "safety_disclaimer": (
        ("As an AI language model, ", ""),
        ("As an AI assistant, ", ""),
        ("I'm just an AI. ", ""),
        ("I am just an AI. ", ""),
        ("I'm just an AI, ", ""),
        ("I am just an AI, ", ""),
        ("I don't have personal opinions, but ", ""),
        ("I do not have personal opinions, but ", ""),
        ("I don't have personal opinions. ", ""),
        ("I do not have personal opinions. ", ""),
        ("I don't have opinions, but ", ""),
        ("It's important to note that I ", "I "),
        ("It is important to note that I ", "I "),
        ("I'm unable to provide ", "I can't share "),
        ("I am unable to provide ", "I can't share "),
    ),
    "corporate_filler": (
        ("utilization", "use"),
        ("utilizing", "using"),
        ("utilizes", "uses"),
        ("utilize", "use"),
        ("facilitating", "helping"),
        ("facilitates", "helps"),
        ("facilitate", "help"),
        ("leveraging", "using"),
        ("leverages", "uses"),
        ("leverage", "use"),
        ("optimization", "improvement"),
        ("optimizing", "improving"),
        ("optimizes", "improves"),
        ("optimize", "improve"),
        ("streamlining", "simplifying"),
        ("streamlines", "simplifies"),
        ("streamline", "simplify"),
        ("in order to ", "to "),
        ("prior to ", "before "),
        ("subsequent to ", "after "),
        ("in the event that ", "if "),
        ("with respect to ", "about "),
        ("pertaining to ", "about "),
        ("regarding ", "about "),
        ("commences", "starts"),
        ("commenced", "started"),
        ("commence", "start"),
        ("sufficient", "enough"),
        ("numerous", "many"),
        ("a number of ", "some "),
    ),
    "empty_grand": (
        ("transformative", "useful"),
        ("groundbreaking", "new"),
        ("revolutionary", "new"),
        ("state-of-the-art", "modern"),
        ("cutting-edge", "modern"),
        ("next-generation", "newer"),
        ("trailblazing", "early"),
        ("pioneering", "early"),
        ("paradigm shift", "big change"),
        ("game-changer", "big change"),
        ("game-changing", "big"),
        ("unparalleled", "unmatched"),
    ),
    "meta_hedge": (
        ("It's important to note that ", ""),
        ("It is important to note that ", ""),
        ("It's worth noting that ", ""),
        ("It is worth noting that ", ""),
        ("It's worth mentioning that ", ""),
        ("It is worth mentioning that ", ""),
        ("It should be noted that ", ""),
        ("It should be mentioned that ", ""),
        ("I would like to point out that ", ""),
        ("I'd like to point out that ", ""),
        ("Please note that ", ""),
        ("It is worth highlighting that ", ""),
        ("It's worth highlighting that ", ""),
    ),
    "delve_class": (
        ("delves into", "looks at"),
        ("delving into", "looking at"),
        ("delve into", "look at"),
        ("meticulously", "carefully"),
        ("meticulous", "careful"),
        ("tapestry of", "mix of"),
        ("tapestry", "mix"),
        ("intricately", "carefully"),
        ("intricate", "detailed"),
        ("multifaceted", "many-sided"),
        ("navigating the", "handling the"),
        ("navigate the", "handle the"),
        ("embarking on", "starting"),
        ("embark on", "start"),
        ("harnessing the", "using the"),
        ("harness the", "use the"),
        ("fostering", "building"),
        ("fosters", "builds"),
        ("foster ", "build "),
    ),
    "filler_opener": (
        ("In conclusion, ", ""),
        ("To conclude, ", ""),
        ("In summary, ", ""),
        ("To summarize, ", ""),
        ("To sum up, ", ""),
        ("Overall, ", ""),
        ("Ultimately, ", ""),
        ("In essence, ", ""),
        ("Moreover, ", ""),
        ("Furthermore, ", ""),
        ("Additionally, ", ""),
        ("Consequently, ", "So "),
        ("First and foremost, ", "First, "),
    ),
}

#: Linking phrases, counted in any case at word bounds.
TRANSITIONS = (
    "moreover", "furthermore", "additionally", "in addition", "besides", "however", "nevertheless", "nonetheless", "on the other hand", "conversely",
    "in contrast", "on the contrary", "therefore", "consequently", "thus", "hence", "as a result", "for instance", "for example", "in particular",
    "specifically", "in other words", "that is to say", "in summary", "in conclusion", "to summarize", "to sum up", "ultimately", "overall",
    "it's important to note", "it is important to note", "it's worth noting", "it is worth noting", "it's worth mentioning", "it is worth mentioning",
)

#: Name, mean, standard deviation and coefficient of each feature of the logistic model.
CALIBRATION = (
    ("perplexity", 2778.674931410775, 2379.524329574862, 0.26769727440762087),
    ("avg_log_prob", -7.737973563821527, 0.583228291024364, 0.21312363274785076),
    ("burstiness", 0.0741375538278637, 0.04826163358752878, -0.2740377591918127),
    ("entropy_cv", 0.011085057602255534, 0.029621208706059724, -0.025943038867493398),
    ("mean_entropy", 0.9022681374357217, 1.9222719903021703, 2.848878965273533),
    ("transition_density", 3.752936689102643, 6.248075947514381, 0.45886886586339964),
    ("sentence_cv", 0.3425283322181211, 0.22664430606657737, 0.0006556829978419533),
    ("short_frac", 0.0405378792521593, 0.10463660192969437, -0.33556481553829826),
    ("equal_mid_frac", 0.3519446272575413, 0.25835020205010295, 0.45997018910144266),
    ("word_mattr", 0.6269209878416784, 0.2961409395228702, 0.7991436469047888),
    ("comma_density", 4.655709322584045, 2.9479940895419414, 1.01517696412352),
    ("punct_density", 6.047458286372713, 4.077693659793569, -1.2964936217248448),
)
INTERCEPT = 0.7523581843398434

#: Bands of a score: least score, key, label.
BANDS = (
    (75.0, "VERY_HIGH", "VERY HIGH (almost certainly AI)"),
    (50.0, "HIGH", "HIGH (likely AI-generated)"),
    (25.0, "MEDIUM", "MEDIUM (some AI traces)"),
    (0.0, "LOW", "LOW (looks human-written)"),
)


# Wordings of samples (formats; {top} and {least} are thresholds) and of reports.
SAMPLES = {
    "heading_density": "%d markdown headings (%.1f/1k chars > {top})",
    "list_density": "%d/%d lines are list items (%.0f%% > {top:.0%}%)",
    "sentence_length_cv": "sentence CV=%.2f < {top} (uniform sentence lengths)",
    "short_sentence_ratio": "short-sentence ratio=%.1f%% < {top:.1%}%",
    "paragraph_uniformity": "paragraph-length CV=%.2f < {top} (uniform paragraphs)",
    "para_opening_enumeration": "%d paragraphs open with enumeration/transition markers (>{top})",
    "signals": "found %d signal(s), need >= {least}",
}
REPORT = {
    "verdict": "## Final verdict: ",
    "publishable": "✅ publishable",
    "revise": "❌ needs revision",
    "best_theses": "Strongest judgements",
    "worst_ai_sections": "Most AI-flavoured passages",
    "unsupported_claims": "Unsupported claims",
    "template_smell": "Template-smell issues",
    "fake_human_details": "Fabricated human details",
    "risk": " ⚠️ High risk",
    "rewrite_brief": "### Rewrite brief\n",
    "error": "[judge] error: ",
    "parse_error": "[judge] JSON parse failure: ",
    "no_json": "no json found",
}


@dataclass(frozen=True)
class RuleSet:
    """All rules of a scoring; without arguments the ones above."""

    version: str = VERSION
    words: tuple[ListRule, ...] = WORDS
    phrases: tuple[ListRule, ...] = PHRASES
    pretence: tuple[RegexRule, ...] = PRETENCE
    signals: tuple[SignalRule, ...] = SIGNALS
    heading_density: tuple | None = HEADING_DENSITY
    list_density: tuple | None = LIST_DENSITY
    sentence_length_cv: tuple | None = SENTENCE_LENGTH_CV
    short_sentence_ratio: tuple | None = SHORT_SENTENCE_RATIO
    paragraph_uniformity: tuple | None = PARAGRAPH_UNIFORMITY
    para_opening_enumeration: tuple | None = PARA_OPENING_ENUMERATION


DEFAULT = RuleSet()
#: What a rule file that can't be read gives: no rules, so that scoring goes on.
EMPTY = RuleSet("0.0.0-unloadable", (), (), (), (), None, None, None, None, None, None)


def only(name: str, rules: RuleSet = DEFAULT) -> RuleSet:
    """The rules with nothing but the one of that name."""
    groups = {g: tuple(r for r in getattr(rules, g) if r.name == name) for g in ("words", "phrases", "pretence", "signals")}
    singles = ("heading_density", "list_density", "sentence_length_cv", "short_sentence_ratio", "paragraph_uniformity", "para_opening_enumeration")
    return replace(rules, **groups, **{k: None for k in singles if k != name})
