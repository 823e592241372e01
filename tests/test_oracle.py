"""Every registered core query against its SQL; those without SQL against known numbers of rows and what must hold of them."""

import pytest

from tests.oracle import compare, connection
from tideline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connection(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, con, name):
    compare(QUERIES[name](spark, folder), con, SQL[name])


#: Queries that SQL can't express: number of rows, and what must hold of all rows.
GOLDEN = {
    "ev06_bootstrap": (1, lambda r: r[0].low <= r[0].mid <= r[0].high <= 1 and abs(r[0].mid - 0.9104) < 0.02),
    "ev10_power": (4, lambda r: r[0].n == 50 and abs(r[0].power - 0.211843) < 1e-6 and all(x.power <= y.power and x.mde >= y.mde for x, y in zip(r, r[1:]))),
    "js01_json_fallbacks": (105, lambda r: sum(x.parse_failed for x in r) < 0.2 * len(r) and all(x.reasoning or x.parse_failed or x.confidence is None or x.reasoning in ("", None) for x in r)),
    "ma09_logprobs": (29, lambda r: all(abs(x.p_true + x.p_false + x.p_uncertain - 1) < 1e-5 and 0 <= x.entropy <= 1 + 1e-6 for x in r)),
    "sf03_tweet_clean": (980, lambda r: all("https://" not in (x.cleaned or "") for x in r) and all(x.emoji_count >= 0 for x in r) and len({x.tweet_id for x in r}) > 900),
    "sf04_normalised_forms": (100, lambda r: all(x.ascii is None or x.ascii.isascii() for x in r)),
    "sf17_language": (100, lambda r: sum(bool(x.agrees) for x in r) >= 0.7 * sum(x.stored is not None for x in r)),
    "sf18_entities": (104, lambda r: all(x.in_text >= 0 and x.in_claim >= 0 and 0 <= x.overlap <= 1 for x in r) and any(x.overlap > 0 for x in r)),
    "sf19_postprocess": (104, lambda r: all(x.claim is None or (not x.claim.endswith(" ") and "..." not in x.claim[-4:]) for x in r)),
    "sm08_mini_batch": (500, lambda r: all(x.similarity >= 0.75 - 1e-6 for x in r) and len({x.vec_id for x in r}) == 500),
    "sm08_online_clusters": (500, lambda r: all(x.similarity >= 0.75 - 1e-6 for x in r) and len({x.vec_id for x in r}) == 500),
    "sm10_ensemble": (766, lambda r: all(x.trigger == "none" or x.n >= 10 for x in r) and {x.path for x in r} <= {"sparse", "mature"}),
    "sm13_claim_registry": (500, lambda r: len({x.vec_id for x in r}) == 500 and all(x.claim >= 0 for x in r)),
    "sm17_topics": (500, lambda r: len({x.topic for x in r}) > 1),
    "ud06_event_classifier": (44, lambda r: all(0 <= x.probability <= 1 for x in r)),
    "ud07_text_vectors": (100, lambda r: all(x.dims == 64 and abs(x.norm2 - 1) < 1e-6 for x in r)),
    "ud09_checkworthiness": (35, lambda r: all(0 <= x.probability <= 1 for x in r) and {x.truth for x in r} == {0, 1}),
    "ud17_hybrid": (500, lambda r: all(1 <= x.place <= 5 for x in r) and all(x.score >= y.score for x, y in zip(*[sorted(r, key=lambda z: (z.query, z.place))[i:] for i in (0, 1)]) if x.query == y.query)),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_values(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    count, holds = GOLDEN[name]
    assert len(rows) == count and holds(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
