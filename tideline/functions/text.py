"""Column builders over text. Everything is a JVM expression that stays inside whole-stage code generation.

Letters, digits and underscores are matched for every script (``[\\p{L}\\p{N}_]``), as Java's ``\\w`` is ASCII only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
URL = r"https?://\S+"

# --- fixed values: word lists and patterns ----------------------------------------------------------------------------
STATEMENT_VERBS = (
    r"\b(is|are|was|were|be|been|being|has|have|had|having|do|does|did|done|doing|will|would|shall|should|can|could|may|might|must|said|says|say|saying|claims?|claimed|claiming|announced?|announcing|reported?|reporting|confirmed?|confirming|"
    r"denied?|denying|stated?|stating|declared?|declaring|revealed?|revealing|showed?|shown|showing|found|finds?|finding|won|wins?|winning|lost|loses?|losing|voted?|voting|killed?|killing|arrested?|arresting|charged?|charging|elected?|electing)\b"
)
QUESTION = r"^(who|what|when|where|why|how|which|whose|whom)\s|\?\s*$|^(is|are|was|were|do|does|did|can|could|will|would|should|have|has|had)\s+(you|we|they|it|he|she)\b"
REACTION_START = (
    r"^(lol|lmao|omg|wow|wtf|smh|ikr|tbh|imo|imho|fr|ngl|idk|rn|af|bruh|yikes|oof|mood|same|facts?|true|this|exactly|periodt?|deadass|cap|no cap|slay|fire|lit|goat|based|cringe|cope|seethe|ratio)\b"
)
SPELLED_NUMBERS = r"\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|trillion)\b"
ACRONYMS = ("API", "URL", "CEO", "USA", "PDF", "RSS", "IBM", "AWS", "GPU", "CPU", "RAM", "SSD", "NLP", "LLM")
CORRUPTED = ("#NAME?", "#REF!", "#VALUE!", "#DIV/0!", "#NULL!", "#N/A")
SLANG = {"u": "you", "r": "are", "ur": "your", "pls": "please", "plz": "please", "thx": "thanks", "btw": "by the way", "imo": "in my opinion", "idk": "i do not know", "afaik": "as far as i know", "govt": "government", "dept": "department", "gov": "governor"}
CONTRACTIONS = {"won't": "will not", "can't": "cannot", "n't": " not", "'re": " are", "'ll": " will", "'ve": " have", "'m": " am", "'d": " would"}
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
#: Yes-or-no features of a text in lower case: any of the patterns.
LOWER_FEATURES = {
    "has_precise_number": [r"\d+\.\d+", r"\d+\s*%", r"\bpercent\b", r"\$\s*\d+", r"\d+\s*dollars?\b"],
    "has_large_scale": [r"\b(million|billion|trillion)s?\b"],
    "has_range": [r"\bfrom\s+\d+\s+to\s+\d+", r"\bbetween\s+\d+\s+and\s+\d+", r"\d+\s*[-–—]\s*\d+", r"\d+\s+to\s+\d+"],
    "has_delta": [r"\b(by|up|down)\s+\d+", r"\b(twice|half|double|triple|quadruple)d?\b", r"\b(doubled|tripled|halved)\b"],
    "has_relative_time": [r"\b(last|this|next)\s+(year|month|week|decade)\b", r"\byesterday\b", r"\b(in the past|over the past|in the last)\s+\d+", r"\b\d+\s*(years?|months?|weeks?|days?)\s+ago\b", r"\brecently\b"],
    "has_temporal_anchor": [r"\bsince\s+(19|20)\d{2}\b", r"\bsince\s+(the|last|january|february|march|april|may|june|july|august|september|october|november|december)\b", r"\b(until|before|after)\s+(19|20)\d{2}\b", r"\b(before|after)\s+the\s+\w+\b"],
    "has_source_attribution": [r"\baccording to\b", r"\breport\s+(says?|shows?|found|indicates?)\b", r"\bstudy\s+(says?|shows?|found|indicates?)\b", r"\bdata\s+(says?|shows?|found|indicates?)\b"],
    "has_evidence_noun": [r"\b(report|data|study|survey|statistics|records?|analysis|research|evidence|findings?)\b"],
    "has_said_claimed": [r"\b(said|says|claimed|claims|stated|states|reported|reports)\s+that\b"],
    "has_comparative": [r"\b(more|less|fewer|higher|lower|better|worse|greater|larger|smaller)\s+than\b"],
    "has_superlative": [r"\b(first|last|worst|best|highest|lowest|largest|smallest|biggest|greatest|most|least|record)\b"],
    "has_ranking": [r"\b(ranked|ranking|number one|number two|top\s+\d+|bottom\s+\d+|#\d+)\b"],
    "has_increase_decrease": [r"\b(increased?|decreased?|grew|grown|fell|fallen|rose|risen|dropped|gained|lost|surged|plunged|spiked|declined?)\b"],
    "has_voted": [r"\b(voted?|voting)\s+(for|against|to|on)\b"],
    "has_negation_claim": [r"\b(did not|didn't|does not|doesn't|has not|hasn't|have not|haven't)\b", r"\b(never|no one|nobody|nothing|none of)\b", r"\b(failed to|refused to|denied)\b"],
    "has_first_person_stance": [r"\b(i think|i believe|i feel|in my opinion|in my view|my view is|i'm convinced)\b"],
    "has_desire_intent": [r"\b(i want|i hope|i wish|we should|we must|we need to|we have to|should be|ought to)\b"],
    "has_future_modal": [r"\b(will be|will have|going to|gonna|expect to|plan to|intend to)\b"],
    "has_hedge": [r"\b(probably|likely|possibly|perhaps|maybe|seems|appears|might|could be|may be|sort of|kind of)\b"],
    "has_vague_quantifier": [r"\b(many people|some people|a lot of|lots of|everyone knows|people say|they say)\b"],
    "has_rhetorical_filler": [r"\blet me\b", r"\blet's\b", r"\b(look|listen),", r"\bhere's the (thing|deal|point)\b", r"\byou know what\b"],
    "has_fact_assertion": [r"\b(the fact is|the truth is|the reality is|fact of the matter|in fact)\b"],
}
#: The same on the text as written.
CASED_FEATURES = {
    "has_specific_year": [r"\b(19|20)\d{2}\b"],
    "has_official_source": [r"\b(CBO|FBI|CDC|BLS|CIA|DOJ|EPA|IRS|NSA|DEA|ATF|DHS|FEMA)\b", r"\b(Congress|Senate|House|Pentagon|White House)\b", r"\b(Federal Reserve|Treasury|State Department)\b", r"\b(United Nations|UN|NATO|WHO|IMF|World Bank)\b"],
    "has_transcript_artifact": [r"\[.+\]", r"^[A-Z]+:", r"\b(APPLAUSE|LAUGHTER|CROSSTALK)\b"],
}
TOPIC_PATTERNS = {
    "health": r"\b(vaccin|hospital|patient|dialys|insulin|flu)", "economy": r"\b(tax|wage|unemploy|price|bank|trade|budget)", "energy": r"\b(power|coal|wind|solar|gas|oil|nuclear)", "transport": r"\b(bus|rail|ferry|toll|e-scooter|cycle lane)",
    "elections": r"\b(ballot|vot(e|ing|er)|poll|election|recount)", "housing": r"\b(rent|tenant|landlord|housing)", "education": r"\b(school|exam|teacher|student|lecturer)", "security": r"\b(crime|police|prison|border|street camera)",
    "technology": r"\b(chat model|data centre|face scanner|translation bot|satellite)", "environment": r"\b(sewage|glyphosate|flood|wolf|mosquito|climate)",
}
# ------------------------------------------------------------------------------------------------------------------------


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def topic_clean(c: Column) -> Column:
    """Lower case; links, handles and non-ASCII become spaces; hash signs go; spaces squeeze."""
    c = F.regexp_replace(F.lower(c), URL, " ")
    c = F.regexp_replace(c, "@" + WORD + "+", " ")
    c = F.regexp_replace(c, "#", "")
    return squeeze(F.regexp_replace(c, r"[^\x00-\x7F]", " "))


def gate_clean(c: Column) -> Column:
    """Links, handles and hash signs removed, spaces squeezed."""
    c = F.regexp_replace(c, URL, "")
    c = F.regexp_replace(c, "@" + WORD + "+", "")
    return squeeze(F.regexp_replace(c, "#", ""))


def minimal_clean(c: Column) -> Column:
    """Links and handles removed, spaces squeezed; the form for counting volume."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, URL, ""), "@" + WORD + "+", ""))


def unescape(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), c)


def tweet_clean(c: Column) -> Column:
    """Entities, links, handles as @USER, letters repeated three times or more to two, repeated marks to one, hash signs, spaces."""
    c = F.regexp_replace(unescape(c), URL, "")
    c = F.regexp_replace(c, r"(^|\s)@" + WORD + "+", "$1@USER")
    c = F.regexp_replace(c, r"(.)\1{2,}", "$1$1")
    c = F.regexp_replace(c, r"([!?.])\1+", "$1")
    return squeeze(F.regexp_replace(c, "#(" + WORD + "+)", "$1"))


def expand_contractions(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), CONTRACTIONS.items(), F.replace(c, F.lit("’"), F.lit("'")))


def expand_slang(c: Column) -> Column:
    """Each token that the slang table has is replaced; one map literal, no join."""
    table = F.create_map(*[F.lit(x) for kv in SLANG.items() for x in kv])
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.coalesce(F.element_at(table, F.lower(t)), t)), " ")


def segment_hashtags(c: Column) -> Column:
    """CamelCase hashtags become words."""
    return F.regexp_replace(F.regexp_replace(c, r"([a-z])([A-Z])", "$1 $2"), "#", "")


def preprocess(c: Column, urls: bool = True, mentions: bool = True, hashtags: bool = True, repeats: bool = True, contractions: bool = False, emojis: bool = False) -> Column:
    """The switches of a preprocessing configuration as one expression."""
    if urls:
        c = F.regexp_replace(c, URL, "")
    if mentions:
        c = F.regexp_replace(c, "@" + WORD + "+", "@USER")
    if hashtags:
        c = F.regexp_replace(c, "#", "")
    if repeats:
        c = F.regexp_replace(c, r"(.)\1{2,}", "$1$1")
    if contractions:
        c = expand_contractions(c)
    if emojis:
        c = F.regexp_replace(c, r"\p{So}", "")
    return squeeze(c)


def word_count(c: Column) -> Column:
    """Tokens between white space; 0 for an empty text."""
    s = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def any_of(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def linguistic_features(c: Column) -> dict[str, Column]:
    """35 features of a text in one projection: quantities, time, sources, comparison, change, hedging, rhetoric, counts, interactions."""
    low = F.lower(c)
    f = {k: any_of(low, v) for k, v in LOWER_FEATURES.items()} | {k: any_of(c, v) for k, v in CASED_FEATURES.items()}
    f["has_number"] = c.rlike(r"\d+") | low.rlike(SPELLED_NUMBERS)
    f["number_count"] = F.regexp_count(c, F.lit(r"\d+")) + F.regexp_count(low, F.lit(SPELLED_NUMBERS))
    f["is_question"] = F.rtrim(c).endswith("?")
    n = word_count(c)
    f["word_count"] = n
    f["avg_word_length"] = F.when(n == 0, 0.0).otherwise(F.round(F.length(F.regexp_replace(c, r"\s+", "")) / F.greatest(n, F.lit(1)), 2))
    f["alpha_ratio"] = alpha_ratio(c)
    timed = f["has_specific_year"] | f["has_relative_time"]
    f["has_number_and_time"] = f["has_number"] & timed
    f["has_number_and_comparative"] = f["has_number"] & f["has_comparative"]
    f["has_change_and_time"] = f["has_increase_decrease"] & timed
    f["has_source_and_number"] = (f["has_source_attribution"] | f["has_evidence_noun"] | f["has_official_source"]) & f["has_number"]
    return f


def alpha_ratio(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0.0).otherwise(F.round(F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1)), 3))


def pattern_flags(c: Column) -> dict[str, Column]:
    words = F.split(c, r"[^\p{L}\p{N}_]+")  # word boundaries mean different things to regex engines
    caps = F.filter(words, lambda w: w.rlike("^[A-Z]{3,}$") & ~w.isin(*ACRONYMS))
    return {
        "mention_count": F.regexp_count(c, F.lit("@" + WORD + "+")),
        "is_reply_tweet": c.startswith("@"),
        "is_manual_retweet": c.rlike("^RT @"),
        "has_via_attribution": c.rlike("(?i)via @"),
        "has_question": c.contains("?"),
        "has_exclamation": c.contains("!"),
        "has_all_caps": F.size(caps) > 0,
        "has_numbers": c.rlike(r"\d"),
        "has_stats": c.rlike(r"[$€£]\d|\d%"),
        "is_truncated": c.rlike(r"\.{3}$|…$"),
        "excessive_hashtags": F.regexp_count(c, F.lit("#" + WORD + "+")) > 5,
        "has_urls": c.rlike(URL),
        "has_many_urls": F.regexp_count(c, F.lit(URL)) > 2,
        "has_cashtags": c.rlike(r"\$[A-Za-z]{1,6}\b"),
    }


def bot_score(flags: dict[str, Column]) -> Column:
    """Weighted sum of flags, clipped to 0..20."""
    weights = {"has_cashtags": 1, "has_urls": 1, "has_many_urls": 2, "excessive_hashtags": 2, "is_manual_retweet": 2, "has_all_caps": 1, "is_reply_tweet": -1}
    total = reduce(lambda a, b: a + b, [flags[k].cast("int") * w for k, w in weights.items()])
    return F.least(F.greatest(total + (flags["mention_count"] > 3).cast("int"), F.lit(0)), F.lit(20))


def quality_flags(c: Column) -> dict[str, Column]:
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    tokens = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    tags = F.size(F.filter(tokens, lambda t: t.startswith("@") | t.startswith("#")))
    n = word_count(c)
    sentences = F.regexp_count(c, F.lit(r"[.!?]+(?:\s|$)"))
    return {
        "is_fragment": (n <= 8) & ~F.lower(c).rlike(STATEMENT_VERBS),
        "is_long": F.length(c) > 500,
        "is_compound": sentences > 1,
        "is_all_caps": (F.length(letters) >= 5) & (F.length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) > 0.8 * F.length(letters)),
        "is_mostly_tags": (n >= 2) & (tags > 0.5 * n),
        "is_retweet": F.upper(F.trim(c)).startswith("RT "),
        "is_question": F.rtrim(c).endswith("?"),
        "has_numbers": c.rlike(r"\d+"),
        "word_count": n,
        "char_count": F.length(c),
        "sentence_count": sentences,
        "alpha_ratio": alpha_ratio(c),
    }


def is_corrupted(c: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(p) for p in CORRUPTED]) | (c == ""), F.lit(True))


def exclusion_reason(c: Column) -> Column:
    """Reasons joined by ``|``; empty where the text stays."""
    return F.concat_ws("|", F.when(is_corrupted(c), "corrupted"), F.when(word_count(c) < 3, "too_short"), F.when(F.length(c) > 500, "too_long"))


def stream_gate(c: Column, least: int = 4, most: int = 150, questions: bool = False, reactions: bool = True, verbs: bool = False, retweets: bool = False, cleaned: Column | None = None, n: Column | None = None) -> Column:
    """Reason why a text isn't claim-like, empty where it passes; ordered tests.

    ``cleaned`` and ``n`` may be columns made before (`with_stream_gate`), so the branches don't each clean the text again."""
    cleaned = gate_clean(c) if cleaned is None else cleaned
    n = word_count(cleaned) if n is None else n
    test = F.when(c.isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == ""), "empty")
    if retweets:
        test = test.when(c.rlike(r"(?i)^RT\s+@"), "retweet")
    test = test.when(cleaned == "", "empty_after_clean").when(n < least, F.concat(F.lit("too_short_"), n, F.lit("_words"))).when(n > most, F.concat(F.lit("too_long_"), n, F.lit("_words")))
    if questions:
        test = test.when(cleaned.rlike("(?i)" + QUESTION), "question")
    if reactions:
        test = test.when(F.lower(cleaned).rlike(REACTION_START) | cleaned.rlike(r"^[^\p{L}\p{N}_\s]*$"), "reaction")
    if verbs:
        test = test.when(~F.lower(cleaned).rlike(STATEMENT_VERBS), "no_verb")
    return test.otherwise("")


def with_stream_gate(df: DataFrame, text: str, name: str = "reason", **settings) -> DataFrame:
    """The gate as a column, the cleaned text and its words computed once a row."""
    d = df.withColumn("_cleaned", gate_clean(F.col(text))).withColumn("_words", word_count(F.col("_cleaned")))
    return d.withColumn(name, stream_gate(F.col(text), cleaned=F.col("_cleaned"), n=F.col("_words"), **settings)).drop("_cleaned", "_words")


def batch_gate(c: Column, chars: int = 20, least: int = 5, most: int = 100) -> Column:
    """The gate of the batch pipeline; ``passed`` where the text is claim-like. Verbs come from the lexicon."""
    t = F.trim(c)
    n = word_count(t)
    low = F.lower(t)
    reaction = r"^(lol|lmao|omg|wow|haha|hahaha|yes|no|ok|okay|thanks|thank you|congrats|congratulations)!*$|^(great|awesome|amazing|cool|nice)!*$"
    return (
        F.when(c.isNull(), "null_or_invalid").when(F.length(t) < chars, "too_short_chars").when(n < least, "too_few_words").when(n > most, "too_many_words")
        .when(t.endswith("?") | low.rlike("^(who|what|where|when|why|how) "), "is_question").when(low.rlike(reaction), "is_reaction").when(~low.rlike(STATEMENT_VERBS), "no_verb").otherwise("passed")
    )


def postprocess_claim(c: Column) -> Column:
    """A model's claim without quotes, lead-ins, later lines and trailing dots, closed by a full stop."""
    def unquote(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, r"""^(["'])(.*)\1$""", "$2"))

    c = unquote(F.trim(c))
    c = F.regexp_replace(c, r"(?i)^(normalized\s*claim\s*:\s*|the\s*claim\s*is\s*:\s*|the\s*claim\s*is\s+that\s+|the\s*normalized\s*claim\s*:\s*|claim\s*:\s*|output\s*:\s*|answer\s*:\s*|here\s*is\s*the\s*normalized\s*claim\s*:\s*)", "")
    c = F.trim(F.element_at(F.split(c, "\n"), 1))
    c = unquote(F.trim(F.regexp_replace(c, r"\.\.\.$", "")))
    c = F.regexp_replace(c, r"^[*_`]+|[*_`]+$", "")
    return F.when((c != "") & ~c.rlike(r"[.!?]$"), F.concat(c, F.lit("."))).otherwise(c)


def entities(c: Column) -> Column:
    """Distinct numbers, dates, month days and capitalised phrases of a text, lower case."""
    def get(p: str, x: Column = c) -> Column:
        return F.transform(F.regexp_extract_all(x, F.lit(f"({p})"), 1), F.lower)

    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    return F.array_distinct(F.concat(
        get(r"\$?\d+(?:,\d{3})*(?:\.\d+)?%?"), get(r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"), get(rf"(?i)\b(?:{months})\s+\d{{1,2}}(?:,?\s+\d{{4}})?\b"), get(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"),
    ))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Overlap of two arrays of distinct values; ``both_empty`` where both are, 0 where one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def numbered_list(texts: Column, most: int = 5, chars: int = 280) -> Column:
    """``1. text`` lines for a prompt: at most ``most``, each cut with dots."""
    one = F.transform(F.slice(texts, 1, most), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("..."))).otherwise(t)))
    return F.array_join(one, "\n")


def topics(c: Column, most: int = 2) -> Column:
    """First ``most`` topics whose pattern the text matches."""
    low = F.lower(c)
    every = F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in TOPIC_PATTERNS.items()])
    return F.slice(F.filter(every, lambda x: x.isNotNull()), 1, most)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")
