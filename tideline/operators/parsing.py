"""Reading JSON as models write it: broken, wrapped in text, with token probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESPONSE = "reasoning string, confidence double"


def valid_json(c: Column) -> Column:
    """Whether a string parses to an object, by the JVM's parser."""
    return c.isNotNull() & F.try_parse_json(c).isNotNull() if hasattr(F, "try_parse_json") else F.get_json_object(c, "$").isNotNull()


def _read(c: Column) -> Column:
    x = F.from_json(c, RESPONSE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return F.when(x["_corrupt"].isNull() & (x["reasoning"].isNotNull() | x["confidence"].isNotNull()), F.struct(x["reasoning"].alias("reasoning"), x["confidence"].alias("confidence")))


def parse_response(df: DataFrame, column: str = "response_json") -> DataFrame:
    """``reasoning``, ``confidence``, ``parse_failed``: as it is, with an opening brace before it, the braces inside other text, fields by pattern."""
    c = F.col(column)
    by_fields = F.struct(F.nullif(F.regexp_extract(c, r'"reasoning"\s*:\s*"((?:[^"\\]|\\.)*)', 1), F.lit("")).alias("reasoning"), F.regexp_extract(c, r'"confidence"\s*:\s*"?(-?\d+(?:\.\d+)?)', 1).try_cast("double").alias("confidence"))
    any_field = F.when(by_fields["reasoning"].isNotNull() | by_fields["confidence"].isNotNull(), by_fields)
    got = F.coalesce(_read(c), _read(F.concat(F.lit('{"'), c)), _read(F.regexp_extract(c, r"(?s)(\{.*\})", 1)), any_field)
    rest = [x for x in df.columns if x not in (column, "response_raw")]
    return df.select(*rest, got.alias("_g")).select(*rest, F.col("_g.reasoning").alias("reasoning"), F.col("_g.confidence").alias("confidence"), F.col("_g").isNull().alias("parse_failed"))


def ternary(df: DataFrame, column: str = "logprobs") -> DataFrame:
    """Normalised probabilities of true, false and uncertain over token variants; a third each where no token has mass; entropy in bits, margin."""
    tokens = F.from_json(column, "array<struct<token string, logprob double>>")

    def mass(names: list[str]) -> Column:
        hits = F.filter(F.col("_t"), lambda x: F.lower(F.trim(F.regexp_replace(x["token"], '["\\s]', ""))).isin(names))
        return F.aggregate(hits, F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]))

    rest = [x for x in df.columns if x != column]
    d = df.select(*rest, F.coalesce(tokens, F.expr("CAST(array() AS array<struct<token:string,logprob:double>>)")).alias("_t"))
    d = d.select(*rest, mass(["true", "yes"]).alias("t"), mass(["false", "no"]).alias("f"), mass(["uncertain", "unclear", "unknown"]).alias("u"))
    total = F.col("t") + F.col("f") + F.col("u")
    share = lambda c: F.when(total == 0, 1 / 3).otherwise(F.col(c) / F.nullif(total, F.lit(0.0)))
    d = d.select(*rest, share("t").alias("p_true"), share("f").alias("p_false"), share("u").alias("p_uncertain"))
    h = lambda c: F.when(F.col(c) > 0, -F.col(c) * F.log2(c)).otherwise(0.0)
    top = F.array_sort(F.array("p_true", "p_false", "p_uncertain"))
    return d.select(*rest, *[F.round(c, 6).alias(c) for c in ("p_true", "p_false", "p_uncertain")], F.round(h("p_true") + h("p_false") + h("p_uncertain"), 6).alias("entropy"), F.round(F.element_at(top, 3) - F.element_at(top, 2), 6).alias("margin"))
