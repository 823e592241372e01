"""Problem 3: personal data in free text, found and replaced.

Method: surrogate generation. Detection (pii_detect) gives typed pieces; each becomes a typed placeholder in ``redacted``
and, in ``surrogate``, a replacement of the same type, script and format, drawn by a keyed hash: without the secret, which the caller
must give, it can't be traced back by trying out names or numbers. Given names become listed ones of the same script and ending (the
ending carries the gender in most languages of the list, a list of names alone has no better sign); of names and addresses every
word but the street's type is replaced. The same entity (whatever its spelling) gets the same surrogate in every table, different
entities different ones, and none gets what is a real entity of these tables: collisions are found by an aggregation over all entities
and resolved by a number, again until there are none.

Cases: a null text gives no pieces and null outputs; empty texts stay empty; texts of any length are scanned once; repeated rows
give repeated rows (found types are distinct); extra columns are ignored; an empty name list leaves names to cues."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.pii_detect import STREET_AFTER, STREET_BEFORE, STREET_CLEAR, STREET_JOINED, entity, find
from tideline.llm.textforms import consistent, script
from tideline.operators.staging import stage

#: A name list longer than this isn't sent to the tasks; a list of given names is bounded by nature.
MOST_NAMES = 100_000
_SYLLABLES = ("bar", "den", "fal", "gor", "hul", "jen", "kal", "lom", "mer", "nol", "pra", "rem", "sol", "tav", "vel", "wes")
_FAMILY_ENDS = ("berg", "dahl", "feld", "gaard", "holt", "lund", "mark", "stein", "thal", "wall")

#: Words of an address that stay: types of street, small words, parts of a number.
_ADDRESS_KEPT = frozenset(f"{STREET_AFTER}|{STREET_BEFORE}|{STREET_CLEAR}|{STREET_JOINED}".split("|")) | frozenset("de del du des da do dos la las le los apt flat unit suite apartment bis ter n no º ª".split())
#: Letters of other scripts that stand for the syllables' Latin ones, in their order a to z.
_LETTERS = {"CYRILLIC": "абцдефгхийклмнопкрстувхиз", "GREEK": "αβγδεφγηιζκλμνοπκρστυβωξψζ", "HEBREW": "אבגדעפגהיזכלמנופקרסתובוחיז", "ARABIC": "ابجدهفغحيزكلمنوبقرستوفوخيز"}
_HAN = "明华文国建春海志平安林江云山河岚晨松青岩"
_JOINED = re.compile(rf"[^\W\d_]+?({STREET_JOINED})", re.I)
#: After so many collisions the format of numbers has no room left, and a number is added.
_CROWDED = 20


def given_names(names: DataFrame) -> frozenset[str]:
    """Given names of the list, lower case. The list is counted first; one beyond ``MOST_NAMES`` is refused."""
    rows = names.where("kind = 'given' and name_form is not null").select(F.lower("name_form").alias("n")).distinct()
    got = [r.n for r in rows.limit(MOST_NAMES + 1).collect()]
    if len(got) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} given names")
    return frozenset(got)


def pieces(df: DataFrame, key: str, text: str, given: frozenset[str]) -> DataFrame:
    """One row a piece: ``key``, ``pii_type``, ``at``, ``till``, ``piece``, ``entity``; positions are in the consistent form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"]):
                t = consistent(t)
                out += [(k, kind, s, e, t[s:e], entity(kind, t[s:e])) for kind, s, e in find(t, given)]
            yield pd.DataFrame(out, columns=["key", "pii_type", "at", "till", "piece", "entity"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInPandas(run, "key string, pii_type string, at int, till int, piece string, entity string")


def _seed(secret: bytes, *what: object) -> int:
    """64 bits of a keyed hash (BLAKE2, which is a MAC when keyed)."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), key=secret, digest_size=8).digest(), "big")


def _word(seed: int, like: str, end: str = "", syllables: int = 3) -> str:
    """A made-up word in the script and the case of ``like``."""
    kind = script(like[0])
    if kind in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL"):
        return "".join(_HAN[(seed >> (5 * i)) % len(_HAN)] for i in range(min(len(like), 4)))
    made = chr(ord("a") + seed % 26) if len(like) == 1 else "".join(_SYLLABLES[(seed >> (5 * i)) % len(_SYLLABLES)] for i in range(syllables))
    letters = _LETTERS.get(kind)
    made = (made if letters is None else "".join(letters[min(ord(c) - 97, len(letters) - 1)] for c in made)) + end
    return made.upper() if like.isupper() and len(like) > 1 or len(like) == 1 and like.isupper() else made.capitalize() if like[0].isupper() else made


def _address(secret: bytes, who: str, turn: int, piece: str) -> str:
    """Digits and every word but the street's type replaced, by their places in the order of words."""
    count = iter(range(10_000))

    def other(m: re.Match) -> str:
        word, h = m.group(), _seed(secret, "address", who, turn, next(count))
        if word.isdigit():
            return "".join(str(1 + (h >> (3 * i)) % 9) for i in range(len(word)))
        if word.lower() in _ADDRESS_KEPT:
            return word
        joined = _JOINED.fullmatch(word)
        return _word(h, word, joined.group(1).lower() if joined else "")

    return re.sub(r"\d+|[^\W\d_]+", other, piece)


def _name(secret: bytes, who: str, turn: int, piece: str, names: tuple[str, ...]) -> str:
    """Each word of the name replaced: the given name by a listed one of its script with the longest like ending, the others by made-up ones."""
    first = who.split(" ")[0]
    known = {w.lower() for w in re.findall(r"[^\W\d_]+", piece)}

    def given(like: str) -> str:
        same = [x for x in names if x not in known and script(x[0]) == script(like[0])]
        for size in (3, 2, 1):
            some = [x for x in same if x.endswith(first[-size:])]
            if len(some) > 2:
                return some[_seed(secret, "given", who, turn) % len(some)]
        return same[_seed(secret, "given", who, turn) % len(same)] if same and first[-1:] not in "aeiouáéíóúаеиоуыэюя" else ""

    def other(m: re.Match) -> str:
        word = m.group()
        h = _seed(secret, "name", who, turn, word.lower())
        if word.lower() == first:
            listed = given(word)
            if listed:
                return listed.upper() if word.isupper() else listed if word.islower() else listed.capitalize()
            return _word(h, word, first[-1:] if first[-1:] in "aaаяо" else "", 2)
        ends = "" if script(word[0]) != "LATIN" or len(word) == 1 else _FAMILY_ENDS[(h >> 40) % len(_FAMILY_ENDS)]
        made = _word(h, word, ends)
        return made.upper() if word.isupper() else made

    return re.sub(r"[^\W\d_]+", other, piece)


def surrogate(kind: str, piece: str, who: str, secret: bytes, turn: int, names: tuple[str, ...]) -> str:
    """A replacement of the same type and format; ``turn`` sets apart entities whose first replacement was taken."""
    count = iter(range(1000))
    digit = lambda: _seed(secret, kind, who, turn, next(count)) % 10
    if kind in ("phone", "id_number"):
        if not any(c.isdigit() for c in piece):  # spelt out: digits in words
            words = "zero one two three four five six seven eight nine".split()
            return re.sub(r"[A-Za-z]+", lambda m: words[digit()], piece)
        return re.sub(r"\d", lambda m: str(digit()), piece) + (f"-{_seed(secret, kind, who, turn) % 10**8:08d}" if turn >= _CROWDED else "")
    if kind == "email":
        h = _seed(secret, kind, who, turn)
        made = "".join(_SYLLABLES[(h >> (5 * i)) % len(_SYLLABLES)] for i in range(2)) + f"{h % 100000:05d}@mail.example"
        return made.upper() if piece.isupper() else made
    return _address(secret, who, turn, piece) if kind == "address" else _name(secret, who, turn, piece, names)


def key_of(secret: str) -> bytes:
    if not secret:
        raise ValueError("surrogates need a secret")
    return hashlib.blake2b(secret.encode(), digest_size=32).digest()


def _turns(entities: DataFrame, secret: bytes, names: tuple[str, ...], rounds: int = 64) -> DataFrame:
    """Entities (``pii_type``, ``entity``; distinct, staged) whose plain surrogate is taken, with a number that sets them apart; few rows.

    Taken is what another entity has, or what is itself a real entity. A new surrogate may be taken as well, so this goes on until none is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(made=[entity(k, surrogate(k, e, e, secret, n, names)) for k, e, n in zip(pdf["pii_type"], pdf["entity"], pdf["turn"])])

    def made(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(run, "pii_type string, entity string, turn int, made string")

    state = stage(made(entities.withColumn("turn", F.lit(0))), "surrogates")
    for _ in range(rounds):
        clash = state.groupBy("pii_type", "made").agg(F.min(F.struct("turn", "entity")).alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = state.join(clash, ["pii_type", "made"]).where("struct(turn, entity) > first").select("pii_type", "entity", "turn")
        real = state.join(entities.select("pii_type", F.col("entity").alias("made")), ["pii_type", "made"], "left_semi").select("pii_type", "entity", "turn")
        later = stage(shared.unionByName(real).distinct().select("pii_type", "entity", (F.col("turn") + 1).cast("int").alias("turn")), "clashes")
        if later.isEmpty():
            return state.where("turn > 0").select("pii_type", "entity", "turn")
        state = stage(state.join(later.select("pii_type", "entity"), ["pii_type", "entity"], "left_anti").unionByName(made(later)), "surrogates")
    raise RuntimeError(f"surrogates still shared after {rounds} rounds; give more")


_PIECES = "array<struct<kind string, at int, till int, who string>>"


def replaced(tables: list[tuple[str, DataFrame, str, str]], given: frozenset[str], secret: str) -> DataFrame:
    """``src``, ``rec_id``, ``redacted`` (typed placeholders) and ``surrogate`` (keyed replacements) of every row whose text isn't null.

    tables: (name, table, key column, text column) each; entities are told apart over all of them. Texts are scanned once: their pieces
    are written beside them, and the replacements are made from these. Texts without pieces pass through unchanged."""
    names, mac = tuple(sorted(given)), key_of(secret)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            forms = [consistent(t) for t in pdf["text"]]
            got = [[{"kind": k, "at": a, "till": b, "who": entity(k, t[a:b])} for k, a, b in find(t, given)] for t in forms]
            yield pd.DataFrame({"src": pdf["src"], "rec_id": pdf["rec_id"], "form": forms, "pieces": got})

    rows = None
    for src, df, key, text in tables:
        one = df.select(F.lit(src).alias("src"), F.col(key).cast("string").alias("rec_id"), F.col(text).cast("string").alias("text")).where("text is not null")
        rows = one if rows is None else rows.unionByName(one)
    scanned = stage(rows.mapInPandas(scan, f"src string, rec_id string, form string, pieces {_PIECES}").withColumn("place", F.monotonically_increasing_id()), "scanned")
    each = scanned.select("place", F.explode("pieces").alias("p")).select("place", F.col("p.kind").alias("pii_type"), F.col("p.who").alias("entity"))
    turns = _turns(stage(each.select("pii_type", "entity").distinct(), "entities"), mac, names)
    # few entities clash; their numbers come back as one small map a text, a written table whose size Spark knows, so the texts
    # are only shuffled where it is too large to send along
    marks = each.join(turns, ["pii_type", "entity"]).groupBy("place").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "pii_type", "entity"), "turn"))).alias("turns"))
    marks = stage(marks, "turns")

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            red, sur = [], []
            for t, pieces_, turn in zip(pdf["form"], pdf["pieces"], pdf["turns"]):
                turn = dict(turn) if turn else {}
                r, s, at = [], [], 0
                for p in pieces_:
                    kind, a, b, who = p["kind"], p["at"], p["till"], p["who"]
                    r += [t[at:a], f"[{kind}]"]
                    s += [t[at:a], surrogate(kind, t[a:b], who, mac, turn.get(f"{kind}|{who}", 0), names)]
                    at = b
                red.append("".join([*r, t[at:]]))
                sur.append("".join([*s, t[at:]]))
            yield pd.DataFrame({"src": pdf["src"], "rec_id": pdf["rec_id"], "redacted": red, "surrogate": sur})

    plain = scanned.where("size(pieces) = 0").select("src", "rec_id", F.col("form").alias("redacted"), F.col("form").alias("surrogate"))
    some = scanned.where("size(pieces) > 0").join(marks, "place", "left").select("src", "rec_id", "form", "pieces", "turns")
    return plain.unionByName(some.mapInPandas(replace, "src string, rec_id string, redacted string, surrogate string"))


def found(df: DataFrame, key: str, text: str, src: str, given: frozenset[str]) -> DataFrame:
    """``src``, ``rec_id``, ``pii_type``: one row for each type present in a record's text."""
    rows = pieces(df, key, text, given).where("key is not null")
    return rows.select(F.lit(src).alias("src"), F.col("key").alias("rec_id"), "pii_type").distinct()
