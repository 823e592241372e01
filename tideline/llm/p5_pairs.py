"""Problem 5: broken prompt and response pairs.

Method: a suffix automaton of the input's words is traversed by the answer's words, which gives the spans of the answer that are copied;
their coverage decides what is a copy and is reported for every answer (`report`); an Aho-Corasick automaton of refusal phrases, a stack of delimiters, and votes of stop words for languages find
the other defects. Whether an answer without a closing mark breaks off is decided by counts over the whole corpus: how often
its last words (names and numbers masked) end a sentence there, and how often they go on.

Order of tests: empty, copy, refusal, truncated, other_language; an answer has at most one defect.

Cases: null ids or answer names give no row; a null input can't be copied nor set a language; answers and inputs of any length are
whole; repeated rows are one record (rows of one key with different answers: the smallest defect name stands); broken JSON is read
up to its break; empty tables give empty results; extra columns are ignored."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.textforms import consistent
from tideline.operators.staging import stage

# --- fixed values: phrases and words -----------------------------------------------------------------------------------
#: A refusal has a phrase of inability or unwillingness and a phrase naming the task or regret, or one phrase that is both.
UNABLE = [
    "i can't", "i cannot", "i can not", "i'm unable", "i am unable", "i'm not able", "i am not able", "i won't", "i will not", "i won’t", "i can’t", "i'd rather not", "i would rather not", "i’d rather not", "i have to decline", "i must decline",
    "i decline", "isn't possible for me", "is not possible for me", "isn’t possible for me", "not going to", "i refuse", "i am not comfortable", "do not feel comfortable", "don't feel comfortable", "i'm not comfortable", "won't be able", "unable to",
    "no puedo", "no me es posible", "prefiero no", "debo declinar", "no podré", "je ne peux pas", "je ne suis pas en mesure", "je dois décliner", "je préfère ne pas", "je refuse", "il ne m'est pas possible", "ich kann nicht", "ich kann dabei nicht", "ich kann diese", "ich kann das nicht", "ich bin nicht in der lage", "ich möchte nicht", "ich muss ablehnen", "não posso", "não consigo", "prefiro não", "я не могу", "не могу", "вынужден отказаться", "我无法", "我不能", "无法",
]
TASK = [
    "help with", "help you", "assist", "comply", "produce", "restate", "rephrase", "assess", "rate this", "rate the", "give a rating", "rating here", "write that", "write this", "write the", "process this", "process that", "evaluat", "analy", "answer", "complete this", "fulfil",
    "normalis", "normaliz", "summari", "provide a", "provide the", "provide that", "do that", "do this", "engage with", "respond to", "work on this", "generate", "judge this", "judge statements", "discuss",
    "ayudar", "ayudarte", "evaluar", "responder", "analizar", "procesar", "reformular", "cumplir", "con esta solicitud", "con eso", "aider", "évaluer", "répondre", "analyser", "traiter cette", "reformuler", "cette demande", "helfen", "bewerten", "beantworten", "umformulieren", "bearbeiten", "anfrage", "ajudar", "avaliar", "помочь", "оценить", "выполнить", "帮助", "评估", "回答", "提供", "处理",
]
OPENER = ["sorry", "apologies", "apologi", "regrettably", "unfortunately", "thanks for asking", "lo siento", "lamentablemente", "desafortunadamente", "désolé", "malheureusement", "je regrette", "leider", "tut mir leid", "entschuldigung", "desculpe", "infelizmente", "к сожалению", "извините", "抱歉", "对不起"]
BOTH = [
    "against my guidelines", "against my policy", "violates my", "due to policy", "policy restrictions", "as a language model", "as an ai", "consult a professional", "can't be completed", "cannot be completed", "not something i can", "va en contra de mis", "en contra de mis directrices", "contre mes directives", "gegen meine richtlinien", "como modelo de lenguaje", "en tant que modèle de langage", "als sprachmodell", "作为语言模型", "作为一个",
]
FILLERS = {"", "n/a", "na", "null", "none", "nil", "nan", "-", "--", "...", "…", ".", "?", "todo", "tbd", "unknown", "undefined", "no answer", "no reasoning", "empty", "not available", "no response", "{}", "[]", "\"\"", "n.a.", "(empty)", "(none)"}
#: Function words only: articles, pronouns, prepositions, conjunctions, auxiliaries, negations, question words and adverbs of place, time and degree.
STOPWORDS = {
    "en": "the a an this that these those i me my we us our you your he him his she her it its they them their who whom whose which what and or but nor so if because as until while although though since unless whether than of in on at to from for with by about against between into through during before after above below up down over under near out off within without toward is are was were be been being am has have had having do does did will would shall should can could may might must not no never only own same too very just now then once here there when where why how all any both each few more most other some such again also yet still even ever every either neither per upon among across around",
    "es": "el la los las lo un una unos unas y e o u ni que si no como cuando donde quien quienes cual cuyo porque pues aunque mientras de del a al en por para con sin sobre entre hasta desde hacia según durante contra tras ante bajo yo tú él ella ello nosotros ellos ellas usted ustedes me te se nos le les mi tu su mis tus sus nuestro nuestra este esta esto estos estas ese esa eso esos esas aquel aquella es son era eran fue fueron ser sido está están estaba ha han había haber hay he más menos muy tan también ya sólo solo nada nadie ningún ninguna ninguno algo alguien algún alguna todo toda todos todas otro otra otros cada después antes nunca siempre sí cerca qué quién cómo dónde cuándo",
    "fr": "le la les un une des du de et ou ni mais donc or car que qui quoi dont où si ne pas plus moins jamais rien personne aucun aucune je tu il elle on nous vous ils elles me te se lui leur leurs y en mon ma mes ton ta tes son sa ses notre nos votre vos ce cet cette ces cela ça à au aux dans par pour sur avec sans sous entre vers chez contre depuis pendant avant après selon malgré dès jusque près est sont était étaient été être a ont avait avoir eu fait comme quand lorsque puisque parce aussi très trop bien encore déjà toujours même tout toute tous toutes autre autres chaque quel quelle comment pourquoi peu alors ainsi",
    "de": "der die das den dem des ein eine einen einem einer eines kein keine keinen keiner und oder aber denn sondern dass weil wenn ob als wie obwohl während bevor nachdem damit um zu in im an am auf aus bei beim mit nach von vom zum zur für durch gegen ohne über unter vor hinter zwischen neben seit bis laut nahe wegen trotz ich du er sie es wir ihr mich dich sich uns euch ihn ihm ihnen mein dein sein seine seinen seiner ihre ihren ihrer unser dieser diese dieses diesem diesen jeder jede jedes jener welche welcher ist sind war waren bin sein gewesen hat haben hatte hatten wird werden wurde wurden worden kann können muss müssen soll sollen darf will nicht nichts nie noch nur auch schon sehr mehr weniger man so da dann doch hier dort was wer wo wann warum alle alles viel viele jedoch etwas niemand",
    "pt": "o a os as um uma uns umas e ou nem mas que se não como quando onde quem qual porque pois embora de do da dos das em no na nos nas por pelo pela pelos pelas para com sem sobre entre até desde contra segundo durante após ante sob eu tu ele ela nós eles elas você vocês me te lhe lhes meu minha seu sua seus suas nosso nossa este esta isto esse essa isso aquele aquela é são era foi foram ser sido está estão há tem têm tinha ter mais menos muito também já só nada ninguém nenhum nenhuma algum alguma tudo todo toda todos todas outro outra cada depois antes nunca sempre sim ao aos à às",
    "it": "il lo la i gli le un uno una e ed o ma né che chi cui se non come quando dove perché poiché mentre di del dello della dei degli delle a al allo alla ai agli alle da dal dalla dai in nel nella nei nelle con su sul sulla per tra fra senza contro secondo durante dopo prima verso io tu lui lei noi voi loro mi ti si ci vi mio mia suo sua nostro questo questa questi queste quello quella è sono era erano fu essere stato ha hanno aveva avere più meno molto anche già solo niente nulla nessuno ogni tutto tutti altro altra ancora sempre mai",
    "nl": "de het een en of maar want dat die dit deze als dan toen omdat hoewel terwijl van in op te aan met voor door bij naar uit over onder tussen tegen zonder om tot sinds volgens na ik jij je hij zij ze wij we jullie hem haar hun ons mijn zijn onze is was waren ben geweest heeft hebben had hadden wordt worden werd niet geen nooit niets niemand ook nog al zeer meer minder er hier daar waar wie wat hoe waarom alle elke",
    "ru": "и в не на что с по как это из у за о от для но к же бы только было его она они мы все так после при без до или ещё во",
}
# ------------------------------------------------------------------------------------------------------------------------

_STOP: dict[str, list[str]] = {}
for _lang, _list in STOPWORDS.items():
    for _w in set(_list.split()):
        _STOP.setdefault(_w, []).append(_lang)
_ENGLISH_ENDS = frozenset("s t re ve ll d m".split())
_ELISIONS = frozenset("l d qu n s j c m t jusqu lorsqu puisqu".split())
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PLAIN = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,:]\d+)*|[^\w\s]")
_HAN, _CYRILLIC, _GREEK, _ARABIC = (re.compile(x) for x in ("[一-鿿]", "[Ѐ-ӿ]", "[Ͱ-Ͽ]", "[؀-ۿ]"))
_OTHER_SCRIPT = re.compile("[一-鿿Ѐ-ӿͰ-Ͽ؀-ۿ]")
_SPACED = re.compile(r"\S+")
_CLOSED = re.compile(r"[.!?。！？…‽؟]['\"”’»)\]】」]*$|[.!?。！？…]\s*(?:[#@]\S+\s*)*$")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("unable", UNABLE), ("task", TASK), ("opener", OPENER), ("both", BOTH)):
        for p in phrases:
            a.add_word(p, kind)
    a.make_automaton()
    return a


_REFUSALS = _automaton()


class SuffixAutomaton:
    """All substrings of a word sequence; the longest match ending at each position of another sequence in one pass."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.next)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.size[p] + 1 == self.size[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.size.append(self.size[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def matches(self, words: list[str], least: int = 1) -> list[tuple[int, int]]:
        """(start, end) of the spans of ``words`` that stand in the sequence: maximal matches of at least ``least`` words, overlaps merged."""
        state = length = 0
        spans: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            if length >= least:
                start = i - length + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans

    def copied(self, words: list[str], least: int = 1) -> int:
        """Words that lie in a match of at least ``least`` words."""
        return sum(e - s for s, e in self.matches(words, least))


class Prompt:
    """An input's words, and its automaton once an answer asks for it."""

    def __init__(self, given: str):
        self.words = _PLAIN.findall(consistent(given).lower())
        self.pairs = set(zip(self.words, self.words[1:]))

    @cached_property
    def automaton(self) -> SuffixAutomaton:
        return SuffixAutomaton(self.words)


#: Answers to one input lie together, so few inputs need to be remembered.
prompt = lru_cache(maxsize=512)(Prompt)


def copied_share(answer: str | None, given: str | None) -> tuple[float, bool]:
    """(share of the answer's words in matches of two or more words with the input, whether the answer is a copy of the input)."""
    if not answer or not given:
        return 0.0, False
    p, a = prompt(given), _PLAIN.findall(consistent(answer).lower())
    if not a or not p.words or (p.pairs and p.pairs.isdisjoint(zip(a, a[1:]))):
        return 0.0, False  # no match of two words
    return p.automaton.copied(a, min(2, len(p.words))) / len(a), copies(p.automaton, a, p.words)


def copies(automaton: SuffixAutomaton, a: list[str], g: list[str], added: int = 3) -> bool:
    """The whole input in its order, with at most ``added`` words more: all but ``added`` words are covered by matches, and the input is
    used up in its order (an exact check of what coverage alone leaves open)."""
    if not len(g) <= len(a) <= len(g) + added or automaton.copied(a) < len(g):
        return False
    it = iter(a)
    return all(any(w == x for x in it) for w in g)


def is_copy(answer: str, given: str | None) -> bool:
    return copied_share(answer, given)[1]


_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"")
_SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|[。！？]")


def is_refusal(answer: str) -> bool:
    """Decided by what sentences say outside quotations, whatever the answer's length: the first three, which open the answer, and the
    last, which concludes it. A phrase of kind "both" is enough alone; inability needs the task or regret beside it."""
    plain = _QUOTED.sub(" ", answer.lower().strip().strip("\"“”„«»").strip())
    sentences = [x for x in _SENTENCE_END.split(plain) if any(c.isalnum() for c in x)]
    if _speaks_refusal(". ".join(sentences[:3])):
        return True
    return len(sentences) > 3 and _speaks_refusal(sentences[-1])


def _speaks_refusal(plain: str) -> bool:
    kinds = {kind for _, kind in _REFUSALS.iter(plain)}
    if "both" in kinds:
        return True
    if "unable" not in kinds or not kinds & {"task", "opener"}:
        return False
    # inability to confirm a detail, followed by an assessment, is none
    return not re.search(r"\b(?:cannot|can't|can’t|unable to|not able to) (?:confirm|verify|check|tell|say|see|find)\b.*\bbut\b", plain)


def votes(text: str | None) -> list[list[str]]:
    """The languages each stop word votes for, one entry a word; an elision votes for French or English, a script decides alone."""
    text = text or ""
    if _OTHER_SCRIPT.search(text):
        letters = sum(map(str.isalpha, text))
        for name, script, share in (("zh", _HAN, 0.4), ("ru", _CYRILLIC, 0.5), ("el", _GREEK, 0.5), ("ar", _ARABIC, 0.5)):
            if letters and len(script.findall(text)) > share * letters:
                return [[name]] * letters
    out = []
    for w in _WORD.findall(text.lower()):
        langs = _STOP.get(w)
        if langs is None and ("'" in w or "’" in w):
            head, tail = re.split("['’]", w, maxsplit=1)
            langs = ["fr"] if head in _ELISIONS else ["en"] if tail in _ENGLISH_ENDS else None
        if langs:
            out.append(langs)
    return out


@lru_cache(maxsize=512)
def languages(text: str | None) -> list[str]:
    """The language with most votes and those within a vote of it; empty without votes."""
    count = Counter(lang for langs in votes(text) for lang in langs)
    most = max(count.values(), default=0)
    return [lang for lang, n in count.items() if n >= max(1, most - 1)]


def answers_in_other_language(answer: str, given: str | None, least: int = 2, times: int = 3) -> bool:
    """Some language beats each one the input may be in: of the words that only one of the two has, at least ``least`` and ``times``
    as many are its own."""
    mine = languages(given)
    if not mine:
        return False
    got = votes(answer)

    def beats(lang: str, other: str) -> bool:
        own, its = sum(lang in v and other not in v for v in got), sum(other in v and lang not in v for v in got)
        return own >= least and own >= times * its

    return any(all(beats(lang, m) for m in mine) for lang in {x for v in got for x in v} if lang not in mine)


def open_delimiters(text: str) -> int:
    """Brackets and directed quotes still open at the end."""
    stack = []
    pairs = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
    for ch in text:
        if ch in "([{“«":
            stack.append(ch)
        elif ch in pairs and stack and stack[-1] == pairs[ch]:
            stack.pop()
    return len(stack)


def reasoning_of(response: str | None, field: str = "reasoning") -> tuple[str | None, bool]:
    """(text of the field, whether the JSON breaks off inside it)."""
    if response is None or not response.strip():
        return None, False
    try:
        got = json.loads(response)
        value = got.get(field) if isinstance(got, dict) else None
        return (None if value is None else value if isinstance(value, str) else json.dumps(value)), False
    except ValueError:
        pass
    m = re.search(rf'"{field}"\s*:\s*"((?:[^"\\]|\\.)*)("?)', response, re.S)
    if not m:
        return (None if response.lstrip().startswith("{") else response), response.lstrip().startswith("{") and f'"{field}"' in response
    body = m.group(1)
    try:
        body = json.loads(f'"{body}"', strict=False)
    except ValueError:
        body = body.rstrip("\\")
    return body, not m.group(2)


def masked(text: str) -> list[str]:
    """Tokens with names (capitalised words, one after another) as X and numbers as 0."""
    out: list[str] = []
    for t in _TOKEN.findall(text):
        t = "0" if t[0].isdigit() else "X" if t[0].isupper() else t
        if t == "X" and out and out[-1] == "X":
            continue
        out.append(t)
    return out


def goes_on_in(answer: str, given: str | None, tail: int = 4) -> bool:
    """Whether the input has the answer's last ``tail`` words (all of an answer of two or three) and goes on right there, inside a word
    or with a word in lower case or a number."""
    starts = [m.start() for m in _SPACED.finditer(answer)]
    if not given or len(starts) < 2:
        return False
    end = answer[starts[-min(tail, len(starts))] :].lower()
    low, i = given.lower(), -1
    while (i := low.find(end, i + 1)) >= 0:
        if (i == 0 or not low[i - 1].isalnum()) and re.match(r"[^\W_]|[ ][^\WA-ZÀ-ÖØ-Þ_]", given[i + len(end) :]):
            return True
    return False


_END = frozenset(".!?。！？…")


def tails(text: str) -> list[str]:
    """Keys of the last three, two and one tokens of a text without a closing mark."""
    t = masked(text)
    return ["\t".join(t[-k:]) for k in (3, 2, 1) if len(t) >= k]


def continuations(texts: DataFrame) -> DataFrame:
    """``tail``, ``ends``, ``goes_on``: over all of the corpus, how often one to three tokens stand before a closing mark or before more text.

    Counted per task first, so each task sends one row a tail."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(k, *v) for k, v in counts.items()], columns=["tail", "ends", "goes_on"])

        for pdf in batches:
            for text in pdf["text"]:
                t = masked(text)
                for i in range(1, len(t)):
                    end = t[i] in _END
                    for k in (1, 2, 3):
                        if i >= k:
                            counts.setdefault("\t".join(t[i - k : i]), [0, 0])[0 if end else 1] += 1
            if len(counts) > 300_000:
                yield out()
                counts.clear()
        yield out()

    return texts.select("text").where("text is not null").mapInPandas(run, "tail string, ends long, goes_on long").groupBy("tail").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))


def first_tests(answers: DataFrame) -> DataFrame:
    """Adds ``defect`` where the record alone decides, ``copied`` (share of the answer that the input covers), ``other`` (language differs)
    and ``tails`` where the corpus decides about truncation.

    answers: ``src, sentence_id, answer_of, answer, given, failed, broken``."""

    def judge(answer: str | None, given: str | None, broken: bool) -> tuple[str | None, float, bool, list[str] | None]:
        text = (answer or "").strip()
        if text.lower().strip(" \t\r\n\"'`*_") in FILLERS or not any(c.isalnum() for c in text):
            return "empty", 0.0, False, None
        share, copy = copied_share(text, given)
        if copy and not broken:
            return "copy", share, False, None
        if is_refusal(text):
            return "refusal", share, False, None
        if broken:
            return "truncated", share, False, None
        other = answers_in_other_language(text, given)
        if _CLOSED.search(text) or re.search(r"https?://\S+$|[#@]\w+$|[\U0001F300-\U0001FAFF☀-➿️]$", text):
            return ("other_language" if other else None), share, other, None
        if open_delimiters(text) or goes_on_in(text, given):
            return "truncated", share, other, None
        return None, share, other, tails(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [judge(a, g, bool(b)) for a, g, b in zip(pdf["answer"], pdf["given"], pdf["broken"])]
            yield pdf[["src", "sentence_id", "answer_of"]].assign(defect=[x[0] for x in got], copied=[x[1] for x in got], other=[x[2] for x in got], tails=[x[3] for x in got])

    return answers.mapInPandas(run, "src string, sentence_id string, answer_of string, defect string, copied double, other boolean, tails array<string>")


def defects(answers: DataFrame, texts: DataFrame) -> DataFrame:
    """``src, sentence_id, answer_of, defect`` of every defective answer; ``texts`` (a ``text`` column) is the corpus for the counts."""
    return defects_of(stage(first_tests(answers), "judged"), texts)


def defects_of(judged: DataFrame, texts: DataFrame) -> DataFrame:
    clear = judged.where("defect is not null")
    open_ = judged.where("defect is null and tails is not null")
    asked = open_.select("src", "sentence_id", "answer_of", "other", F.posexplode("tails").alias("pos", "tail"))
    wanted = asked.select("tail").distinct()
    seen = continuations(texts).join(wanted, "tail", "left_semi")
    # the longest tail with evidence decides: unseen even as one token, or never an end, is a break
    votes = asked.join(seen, "tail", "left").groupBy("src", "sentence_id", "answer_of", "other").agg(
        F.min_by(F.struct("ends", "goes_on"), F.when(F.coalesce("ends", F.lit(0)) + F.coalesce("goes_on", F.lit(0)) >= 2, F.col("pos"))).alias("v"),
    )
    broken = F.col("v").isNull() | (F.col("v.ends") < 0.05 * (F.col("v.ends") + F.col("v.goes_on")))
    late = votes.select("src", "sentence_id", "answer_of", F.when(broken, "truncated").when(F.col("other"), "other_language").alias("defect")).where("defect is not null")
    every = clear.select("src", "sentence_id", "answer_of", "defect").unionByName(late)
    return every.where("sentence_id is not null and answer_of is not null").groupBy("src", "sentence_id", "answer_of").agg(F.min("defect").alias("defect"))


def together(rows: DataFrame) -> DataFrame:
    """Repeated rows once, rows of a sentence one after another: its input is then read once. Ids are unique but for a few answers each;
    rows without an id, which give no answer, are left out rather than gathered."""
    return rows.where("sentence_id is not null").repartition("sentence_id").distinct().sortWithinPartitions("sentence_id")


def answers_of_responses(raw: DataFrame) -> DataFrame:
    """Answers of raw_responses: the reasoning; the input is the claim in the last user message of the prompt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given, answer, broken = [], [], []
            for p, r in zip(pdf["prompt_messages"], pdf["response_json"]):
                try:
                    user = [m.get("content", "") for m in json.loads(p) if m.get("role") == "user"][-1]
                    given.append(re.sub(r"^\s*(?:Claim|Text|Post|Sentence)\s*:\s*", "", user))
                except (ValueError, TypeError, IndexError, AttributeError):
                    given.append(None)
                a, b = reasoning_of(r)
                answer.append(a)
                broken.append(b)
            yield pd.DataFrame({"src": "raw_responses", "sentence_id": pdf["sentence_id"], "answer_of": pdf["module"], "answer": answer, "given": given, "failed": pdf["error"].notna(), "broken": broken})

    return together(raw.select("sentence_id", "module", "prompt_messages", "response_json", "error")).mapInPandas(run, _ANSWERS)


_ANSWERS = "src string, sentence_id string, answer_of string, answer string, given string, failed boolean, broken boolean"


def answers_of_normalizations(norm: DataFrame) -> DataFrame:
    """Answers of normalizations: the claim, or the model's words that error quotes; has_claim false without error is no answer at all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answer, broken = [], []
            for c, e in zip(pdf["normalized_claim"], pdf["error"]):
                a, b = c, False
                if c is None and e is not None:
                    m = re.match(r"\s*(?:Parse (?:failed|error)|Could not parse|Invalid (?:JSON|response)|Unparsable[^:]*)\s*:\s*(.*)$", e, re.S | re.I)
                    a = m.group(1) if m else None
                    if a is not None and a.lstrip().startswith("{"):
                        a, b = reasoning_of(a, "normalized_claim")
                answer.append(a)
                broken.append(b)
            yield pd.DataFrame({"src": "normalizations", "sentence_id": pdf["sentence_id"], "answer_of": pdf["model_name"], "answer": answer, "given": pdf["text"], "failed": pdf["error"].notna(), "broken": broken})

    rows = norm.where("not (normalized_claim is null and error is null and not coalesce(has_claim, false))")
    return together(rows.select("sentence_id", "model_name", "text", "normalized_claim", "error")).mapInPandas(run, _ANSWERS)


def corpus(raw: DataFrame, norm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, texts of the corpus)."""
    answers = stage(answers_of_responses(raw).unionByName(answers_of_normalizations(norm)), "answers")
    return answers, answers.select(F.col("answer").alias("text")).unionByName(norm.select("text").distinct())


def found(raw: DataFrame, norm: DataFrame) -> DataFrame:
    return defects(*corpus(raw, norm))


def report(raw: DataFrame, norm: DataFrame) -> DataFrame:
    """Per source, answer's origin and defect ("none" for sound answers): answers, and the mean and largest share of their words copied from the input."""
    answers, texts = corpus(raw, norm)
    judged = stage(first_tests(answers), "judged")
    key = ["src", "sentence_id", "answer_of"]
    each = judged.where("sentence_id is not null and answer_of is not null").groupBy(*key).agg(F.max("copied").alias("copied")).join(defects_of(judged, texts), key, "left")
    one = each.groupBy("src", "answer_of", F.coalesce("defect", F.lit("none")).alias("defect"))
    return one.agg(F.count("*").alias("answers"), F.round(F.avg("copied"), 4).alias("copied"), F.round(F.max("copied"), 4).alias("most_copied"))
