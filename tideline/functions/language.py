"""Language of a text by its script and votes of stop words; one JVM expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: stop words ---------------------------------------------------------------------------------
STOPWORDS = {
    "en": "the|of|and|to|is|that|for|it|with|was|are|this|by|from|have|not|which|they|were|than|since|has|no",
    "es": "el|los|las|del|que|por|para|se|su|como|una|según|más|lo|pero|con|le|desde",
    "fr": "le|les|des|et|est|que|dans|pour|une|du|pas|sur|au|aux|ont|selon|près|malgré",
    "de": "der|die|das|und|den|von|mit|nicht|ein|eine|auf|für|ist|hat|im|als|laut|nahe|sagen",
    "pt": "os|da|dos|em|não|uma|ao|pelo|são|segundo|mais|foi",
}
# --------------------------------------------------------------------------------------------------------------


def guess(c: Column) -> Column:
    low = F.lower(c)
    letters = F.greatest(F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.lit(1))
    votes = F.array(*[F.struct(F.regexp_count(low, F.lit(rf"(?U)\b(?:{w})\b")).alias("v"), F.lit(k).alias("k")) for k, w in STOPWORDS.items()])
    best = F.array_max(votes)
    return (
        F.when(F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}]", "")) > 0.3 * letters, "zh")
        .when(F.length(F.regexp_replace(c, r"[^\x{0400}-\x{04FF}]", "")) > 0.5 * letters, "ru")
        .when(best["v"] > 0, best["k"])
    )
