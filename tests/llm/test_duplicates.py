import itertools
import random
import re

from pyspark.sql import functions as F

from weekloom.llm import substring_dedup
from weekloom.llm.jaccard_join import jaccard_join
from weekloom.llm.shared import connected_components
from weekloom.llm.substring_dedup import repeated_passages, tuned_bands


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, num, den):
    top = {d: d for d, _ in docs}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(d, shingles(t, k)) for d, t in docs]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            r, s = sorted((root(a), root(b)))
            top[s] = r
    return {d: root(d) for d, _ in docs}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu".split()) + str(rng.randrange(40))
    base = [[word() for _ in range(rng.choice((1, 2, 3, 12, 60, 150)))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 4))):
            w[rng.randrange(len(w))] = word()
        docs.append((i, rng.choice((" ", "\n", " \t ")).join(w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, docs[0][1].upper())]


def test_jaccard_join_equals_brute_force(spark):
    for seed, k, num in ((1, 3, 90), (2, 5, 80)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n", "3 as prefix")
        got = {r.doc_id: r for r in jaccard_join(df, k=k, num=num, den=100).collect()}
        assert {d: r.component_id for d, r in got.items()} == brute(docs, k, num, 100)
        assert all(got[d].n_shingles == len(shingles(t, k)) for d, t in docs)


def test_near_copies_in_one_large_group(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 70):
        w = list(base)
        for j in rng.sample(range(150), rng.choice((1, 1, 2, 3))):
            w[j] = f"x{i}_{j}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join(df, k=3, num=90).collect()} == brute(docs, 3, 90, 100)


def test_repeated_ids_null_ids_and_nothing(spark):
    text = " ".join(f"a{i}" for i in range(30))
    other = " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, other), (3, text), (9, other), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join(df).collect())[1:] == [(3, 26, 3), (5, 26, 3), (5, 26, 3), (9, 26, 3)]
    assert jaccard_join(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 30), (30, 35), (50, 50)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 35: 30, 40: 30}


def test_repeated_passages(spark):
    rng = random.Random(7)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**7)}" for _ in range(n)]
    passage, line = fresh(60), fresh(60)
    near = list(line)
    near[30] = "changed"
    docs = [
        (1, " ".join(fresh(30) + passage + fresh(30))),
        (2, " ".join(fresh(45) + passage + fresh(10))),
        (3, " ".join(fresh(200))),
        (4, "\n".join([" ".join(fresh(20)), " ".join(line), " ".join(fresh(20))])),
        (5, "\n".join([" ".join(near), " ".join(fresh(25))])),
        (6, "\n".join([" ".join(x := fresh(50)), " ".join(x)])),
        (7, None), (8, ""), (9, "a b c"), (10, "a b c"), (None, " ".join(passage)),
    ]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d for d, r in got.items() if r.n_repeats} == {1, 2, 4, 5} and set(got) == set(range(1, 11))
    assert got[1].removed_words == 0 and got[2].removed_words >= 30 and got[4].removals == "" and got[5].removals == "0:60"
    assert got[4].components == got[5].components != []
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_lines_in_one_large_group(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    hub, link = fresh(60), fresh(60)
    docs = [(0, " ".join(hub))]
    for i in range(1, 1050):
        w = list(hub)
        w[rng.randrange(60)] = f"x{i}"
        docs.append((i, " ".join(w)))
    for i in range(2000, 2120):  # each a near copy of the one before, and of no common one
        link[7 * i % 60] = f"y{i}"
        docs.append((i, " ".join(link)))
    want = brute(docs, 5, 80, 100)
    got = {r.doc_id: r.components for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    groups = {}
    for d, c in want.items():
        groups.setdefault(c, set()).add(d)
    found = {}
    for d, names in got.items():
        found.setdefault(tuple(names) or d, set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values())) and max(map(len, groups.values())) >= 1050


def test_wrapped_passages(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    wrapped = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    docs = []
    for i in range(0, 40, 4):
        passage, edited = fresh(60), fresh(60)
        other = list(edited)
        other[30] = "changed"
        docs += [(i, " ".join(fresh(10) + passage + fresh(10))), (i + 1, wrapped(fresh(13) + passage + fresh(11), 11))]
        docs += [(i + 2, wrapped(edited, 9 + i % 3) + "\n\n" + " ".join(fresh(30))), (i + 3, " ".join(fresh(30)) + "\n\n" + wrapped(other, 19 + i % 4))]
    got = {r.doc_id: r for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i in range(0, 40, 4):
        assert got[i].n_repeats and got[i + 1].removed_words >= 20
        assert got[i + 2].components == got[i + 3].components != [] and got[i + 3].removals == "30:90"


def test_words_equal_plain_splitting():
    rng = random.Random(13)
    texts = [None, b"", b" \n", b"A\nb\n\n c\x0b\x0cd\r\n", b"x" * 64 + b" " + b"x" * 65 + b"\t" + b"x" * 66, b"\x00 \x00\x00"]
    texts += [bytes(rng.choice(b"aB \n\t\x00\x85\xa0") for _ in range(rng.randrange(200))) for _ in range(300)]
    words, of_word = substring_dedup.Words(texts), {}
    lines = iter([(a, b) for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True) if a < b])
    for t, first, last in zip(texts, words.first.tolist(), words.last.tolist(), strict=True):
        plain = [x.split() for x in (t or b"").lower().split(b"\n")]
        flat = [w for x in plain for w in x]
        assert last - first == len(flat) and words.inside[first:last].all()
        assert all(of_word.setdefault(w, h) == h for w, h in zip(flat, words.values[first:last].tolist(), strict=True))
        for x in filter(None, plain):
            assert next(lines) == (first, first := first + len(x))
    assert next(lines, None) is None and len(set(of_word.values())) == len(of_word) and words.inside.sum() == (words.last - words.first).sum()


def test_what_is_stored_and_joined_by_prefixes(spark, monkeypatch):
    rng = random.Random(14)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    hub, docs = fresh(60), []
    for i in range(40):  # one large group, and 40 pairs of near copies
        for base, at in ((hub, (0,)), (fresh(60), (1, 2))):
            for k in at:
                w = list(base)
                if k != 1 and (i or k):
                    w[rng.randrange(60)] = f"x{i}"
                docs.append((3 * i + k, " ".join(w)))
    rows, plain = [], substring_dedup.prefixes
    monkeypatch.setattr(substring_dedup, "prefixes", lambda sets, *rest: rows.append(sets.count()) or plain(sets, *rest))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.components for r in repeated_passages(df).collect()}
    assert 16 < rows[0] < 60  # not the 80 lines of short bands, whose pairs are compared at once
    want, found, groups = brute(docs, 5, 80, 100), {}, {}
    for d, c in want.items():
        groups.setdefault(c, set()).add(d)
        found.setdefault(tuple(got[d]), set()).add(d)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values())) and len(groups) == 41
    units = substring_dedup._units(df.select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("_text")))
    assert units.count() == 2 * len(docs)  # its line and one row of all pieces


def test_bands():
    bands, rows = tuned_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = {"en": "the and of with this from that is not".split(), "de": "der und nicht mit von ein das ist".split()}
    rows = []
    for i in range(60):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang]) + str(rng.randrange(100)) * (j % 3 == 0) for j in range(60)), lang, f"s{i % 3}", 0))
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "12 34", "en", "s0", 0), (102, rows[1][1] + " password=abcdef123456", rows[1][2], "s1", 0)]
    rows += [(5, rows[5][1], rows[5][2], "s2", 0), (5, rows[6][1] + " und nicht mit", rows[5][2], None, None), (None, rows[7][1] + " das ist", "de", "s1", 0), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, out, str(tmp_path)).collect(), docs.schema)
        seen.append(out)
        assert out.columns == docs.columns
    kept = {r.doc_id for r in seen[1].collect()}
    assert 101 not in {r.doc_id for r in seen[0].collect()} and {100, 102}.isdisjoint(kept)
    assert kept == set(range(60)) - {6}  # the second row of 5 is like 6, the nameless one like 7
    assert seen[1].count() == 60 and sorted(r.text for r in seen[1].where("doc_id = 5").collect()) == sorted([rows[5][1], rows[6][1] + " und nicht mit"])
    tokens = corpus_pipeline.run(spark, str(tmp_path))
    assert tokens.count() == seen[3].count() and {r.doc_id for r in tokens.collect()} == {r.doc_id for r in seen[3].collect()}
