"""Queries against their SQL on small tables of the cases that the given small ones lack."""

import datetime as dt

import duckdb
import pytest

from marginalia.plans import registry
from tests.test_oracle import plain

TEXTS = [
    'TOKEN = "9233A8ECF7C5B09FE5949719"! Then TIINST met Horge of TOKEN. The TIINST uses Alpha.',
    "A camelCase word and x9Delta2y, Beta_Gamma with Delta. Beta and camelCase with Gamma again. Nothing here.",
    "Straße9Öster and ÉcoleÖ2 of École by ABC1ABC. ABC and École met. ab1Cde2FGHi.",
    None,
    "",
]


@pytest.fixture(scope="module")
def check(spark, tmp_path_factory):
    """Compares a query with its SQL over tables of given rows."""

    def run(name, **tables):
        sf, con = str(tmp_path_factory.mktemp(name)), duckdb.connect()
        con.sql("SET TimeZone = 'UTC'")
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf}/{t}.parquet")
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
        got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
        return rows

    return run


@pytest.mark.parametrize(
    "name",
    "adjacent_pairs confidence_calibration context_relations cooccurrence_pairs delete_documents enhanced_relations entity_topk fuzzy_entities merged_relations provider_relations provider_results".split(),
)
def test_capitals_inside_words_and_beside_digits(check, name):
    docs = [(i + 1, t) for i, t in enumerate(TEXTS)]
    assert check(name, documents=(docs, "doc_id long, text string"))


def test_comprehension_of_a_half(check):
    texts = [(1, 0, "x" * 25), (2, 0, "y" * 50), (3, 0, "z" * 50), (3, 1, "w" * 25), (4, 0, "v" * 24), (5, 0, "short")]
    rows = check("reflection_prompts", conversations=([(c, t, "user", x) for c, t, x in texts], "conv_id long, turn long, role string, text string"))
    assert ("1.0", "asked,connect,learned,apply") not in rows and ("1.0", "connect,learned,apply") in rows


@pytest.mark.parametrize("name", ["sm2_fold", "scheduler_export"])
def test_intervals_on_a_half(check, name):
    """Answers whose intervals fall on halves that sums of rounded tenths miss, and one that outgrows 32 bits."""
    logs = [(3, 3, 4, 3, 3, 3, 3, 5, 3), (3, 3, 4, 3, 4, 3, 3, 3, 4), (3, 3, 4, 3, 4, 4, 3, 3, 5), (3, 3, 4, 4, 3, 3, 4, 3, 5), (5, 1, 0, 2, 4), (5,) * 18]
    start = dt.datetime(2024, 1, 1)
    events = [(100 * u + i, start + dt.timedelta(days=i), u, "view", float(q), "{}") for u, log in enumerate(logs) for i, q in enumerate(log)]
    check(name, events=(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))


@pytest.mark.parametrize("name", ["provider_relations", "provider_results"])
def test_questions_that_differ_after_their_key(check, name):
    """A key holds 100 characters of a context of 120: the rest says what is answered, in even documents and in odd ones."""
    head = "Alpha saw Gamma " + "x" * 86  # 102 characters
    docs = [(1, f"{head} and here."), (2, f"{head} of those."), (3, f"{head} with all."), (4, "Beta and Delta.")]
    docs += [(11, f"Zeta met Theta {'y' * 90} and more."), (12, f"Zeta met Theta {'y' * 90} none at all."), (13, "Iota and Kappa.")]
    assert len(check(name, documents=(docs, "doc_id long, text string"))) > 1
