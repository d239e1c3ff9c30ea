import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weekloom.llm import infill, lexical, phrases
from weekloom.llm.infill import INFILL_SQL, fill_in_middle
from weekloom.llm.lexical import LEXICAL_SQL, ranked_search
from weekloom.llm.phrases import CONTAMINATION_SQL, contamination, phrase_matches
from weekloom.llm.terms import terms

DOCS = "doc_id long, text string, item_id long, n int, rank string"
ITEMS = "item_id long, text string, doc_id string, score int"


def words(rng, n, most=30):
    return [f"w{min(rng.randrange(most), rng.randrange(most))}" for _ in range(n)]


def tables(seed=5):
    """Documents and items with nulls, repeats, ties, copies, odd characters and one long text."""
    rng = random.Random(seed)
    items = [(i, " ".join(words(rng, rng.choice((3, 9, 10, 14, 40))))) for i in range(12)]
    items += [(3, " ".join(words(rng, 15))), (None, "w1 w2"), (40, None), (41, ""), (42, " -- "), (43, "Ünï_wörd w1"), (44, "never seen"), (-5, "W1 w1 w1")]
    docs = []
    for i in range(90):
        own = words(rng, rng.randrange(0, 60))
        if i % 4 == 0:
            quote = items[rng.randrange(12)][1].split()
            own[5:5] = quote[: rng.choice((len(quote), 12))]
        docs.append((i, rng.choice((" ", "\n", ", ", "_")).join(own)))
    docs += [(7, docs[7][1]), (7, "w1 w2 w3"), (None, docs[8][1]), (None, None), (91, None), (92, ""), (93, " .,; "), (94, "ÜNÏ wörd ünï_wörd W1"), (95, " w1 "), (96, " ".join(words(rng, 4000)))]
    docs += [(200 + i, docs[12][1]) for i in range(70)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in docs], DOCS).repartition(3), spark.createDataFrame([(*r, "x", 1) for r in items], ITEMS)


def in_duckdb(sql, docs, items):
    con = duckdb.connect()
    con.execute("create table d(doc_id bigint, text varchar)")
    con.execute("create table i(item_id bigint, text varchar)")
    con.executemany("insert into d values (?, ?)", docs)
    con.executemany("insert into i values (?, ?)", items)
    rel = con.sql(sql.format(docs="d", items="i"))
    return ordered(rel.columns, rel.fetchall())


def ordered(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def result(df):
    return ordered(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search_equals_sql(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical, "SHARD_DOCS", 5)
        monkeypatch.setattr(lexical, "OPENED", 2)
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
        monkeypatch.setattr(lexical, "MERGES", 2)
    docs, items = tables()
    assert result(ranked_search(*frames(spark, docs, items))) == in_duckdb(LEXICAL_SQL, docs, items)


def test_tree_keeps_the_order_of_impacts():
    import numpy as np

    rng = np.random.default_rng(2)
    ids = np.arange(100)
    term_of = np.repeat(np.arange(3), 100)
    shard = lexical.Shard(ids, np.ones(100, bool), np.tile(ids, 3), term_of, rng.integers(1, 1000, 300), 3)
    tree = shard.tree
    for t in range(3):
        stack = [(0, 0, shard.starts[t], shard.starts[t + 1])]
        while stack:
            level, first, a, b = stack.pop()
            assert (np.diff(tree.impacts[level, a:b]) <= 0).all()
            if level < tree.levels:
                (az, ao), (bz, bo) = (tree.children(np.array(level), np.array(x)) for x in (a, b))
                assert bz - az + bo - ao == b - a
                stack += [(level + 1, 2 * first, az, bz), (level + 1, 2 * first + 1, ao, bo)]
            else:
                assert b - a == (first < 100)


def test_searches_of_nothing(spark):
    docs, items = frames(spark, *tables())
    for search in (ranked_search, contamination):
        assert search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    none = contamination(docs, items.limit(0))
    assert none.count() == docs.count() and none.where("contaminated or n_hit > 0 or n_items > 0").isEmpty()


@pytest.mark.parametrize("small", [False, True])
def test_contamination_equals_sql(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(phrases, "SEGMENT_WORDS", 100)
        monkeypatch.setattr(phrases, "BLOCK_WORDS", 60)
        monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    docs, items = tables()
    got = result(contamination(*frames(spark, docs, items)))
    assert got == in_duckdb(CONTAMINATION_SQL, docs, items)
    assert sum(r[0] for r in got) > 20


def test_proximity_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT_WORDS", 150)
    docs, items = tables(9)
    docs = [(i, t) for i, (_, t) in enumerate(docs) if i != 99]
    width, slop = 4, 3
    found = phrase_matches(*frames(spark, docs, items), width, slop).collect()
    asked = {}
    for i, t in items:
        own = terms((t or "").encode())
        if i is not None and own:
            asked.setdefault(i, set()).update(tuple(own[s : s + width]) for s in range(max(1, len(own) - width + 1)))

    def shortest(own, window):
        """Length of the shortest span that holds all terms."""
        best = None
        for a in range(len(own)):
            missing = set(window)
            for b in range(a, min(len(own), a + len(window) + slop)):
                missing.discard(own[b])
                if not missing:
                    best = min(best or b + 1 - a, b + 1 - a)
                    break
        return best

    for r in found:
        own = terms((dict(docs)[r.doc_id] or "").encode())
        want = {(i, n) for i, ws in asked.items() for w in ws if (n := shortest(own, w))}
        assert {m.item_id for m in r.near} == {i for i, _ in want}
        for m in r.near:
            assert any(set(w) <= set(own[m.start : m.end]) and m.end - m.start <= len(w) + slop for w in asked[m.item_id])
        for i in {m.item_id for m in r.near}:
            assert min(m.end - m.start for m in r.near if m.item_id == i) == min(n for j, n in want if j == i)
        assert {m.item_id for m in r.exact} <= {m.item_id for m in r.near}


def test_fill_in_middle_equals_sql(spark):
    docs, items = tables()
    docs += [(300 + i, "a\nb\n\nc<P>"[: i + 1]) for i in range(9)] + [(400, "\n"), (401, "no end"), (402, "é\n😀\r\n\nx y"), (403, "<M>"), (-1, "a\nb"), (2**62, "a\nb\n")]
    got = result(fill_in_middle(frames(spark, docs, items)[0], with_output=False))
    assert got == in_duckdb(INFILL_SQL, docs, items)
    assert {r[1] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(frames(spark, docs[:1], items)[0].limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\tc<PSM>é😀", max_size=40), st.integers(0, 50), st.sampled_from(infill.UNITS))
def test_infill_rebuilds_the_text(text, key, unit):
    n, form, before, inside, output = infill.cut(text, str(key), unit, "7", 100, 50)
    assert infill.restore(output, form) == text
    if unit == "char":
        assert n == len(text)
    if form != "plain":
        assert output.count("<M>") == 1 and len(output) == len(text) + 9 and before + inside <= len(text)


def test_infill_shares(spark):
    df = spark.createDataFrame([(i, "a b\nc d\n") for i in range(2000)], "doc_id long, text string")
    forms = {r.form: r["count"] for r in fill_in_middle(df, unit="word", share=60, spm=25).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 800) < 90 and abs(forms["spm"] - 300) < 70
    with pytest.raises(ValueError):
        fill_in_middle(df, unit="page")
