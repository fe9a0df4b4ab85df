import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom import queries
from matchloom.functions import similarity as S
from matchloom.functions import text as T
from matchloom.operators import blocking, cache, evaluation, features, modeling, quality, ranking, training
from matchloom.plans import pipelines
from matchloom.sources import tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_clean_rules(spark):
    c = lambda v: one(spark, T.clean_text(F.col("v")), v=v)
    assert c("Müller Private Limited, 2nd St.") == "muller pvt ltd second street"
    assert c("unlimited Co") == "unlimited company"
    assert c(None) == "" and c("  ") == ""


def test_lexical_rules_work_inside_words(spark):
    c = lambda v: one(spark, T.clean_lexical(F.col("v")), v=v)
    assert c("Unlimited Company") == "unltd co"
    assert c("private  limited 12B") == "private ltd 12 b"
    assert one(spark, T.skeleton(F.col("v")), v="acme trading") == "cmtrdng"


def test_folding_is_letter_by_letter(spark):
    rng = random.Random(3)
    letters = [*T._LETTERS, *map(chr, range(32, 127)), "東", "😀", "\u0301", *" " * 200]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(500)]
    alone = lambda c: T._LETTERS.get(c, "" if unicodedata.category(c) == "Mn" else c)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold(F.col("t")), T.clean_lexical(F.col("t"))).collect()
    for t, folded, clean in rows:
        assert folded == "".join(map(alone, t))
        e = re.sub("[^a-z0-9 ]+", " ", re.sub("[^\x00-\x7f]", " ", folded).lower())
        for what, to in T.LEXICAL_RULES:
            e = e.replace(what, to)
        e = re.sub("([0-9])([a-z])", r"\1 \2", re.sub("([a-z])([0-9])", r"\1 \2", e))
        assert clean == " ".join(e.split())


def test_null_words(spark):
    c = lambda v: one(spark, T.without_null_words(F.col("v")), v=v)
    assert [c(v) for v in (" Hello ", "NaN", "None", None, "NA")] == ["Hello", "", "", "", "NA"]


def test_id_list(spark):
    assert one(spark, T.id_list(F.col("v")), v="a1, b,,0 ,10") == ["a1", "b", "0", "10"]
    assert one(spark, T.id_list(F.col("v")), v=None) == []


def test_labelled_text(spark):
    f = T.labelled_text(*map(F.col, "abcde"))
    assert one(spark, f, a="Acme", b="1 Main", c="Oslo", d="nan", e="NO") == "Name: Acme | Address: 1 Main, Oslo, NO"
    assert one(spark, f, a="", b=None, c="none", d="", e="") == "Entity: Unknown"


def test_numbers(spark):
    assert one(spark, T.pin_code(F.col("v")), v="12 road 560001") == "560001"
    assert one(spark, T.pin_code(F.col("v")), v="1234567") is None
    assert one(spark, T.house_number(F.col("v")), v="main 12 road 7") == "12"


def test_ratios():
    assert S.indel_ratio("", "") == 100 and S.indel_ratio("abc", "abc") == 100
    assert S.indel_ratio("abcd", "acd") == pytest.approx(600 / 7)
    assert S.token_sort_ratio("b a", "a b") == 100
    assert S.token_set_ratio("", "a") == 0 and S.token_set_ratio("a b c", "a b") == 100
    assert S.partial_ratio("bcd", "abcde") == 100 and S.partial_ratio("", "a") == 0 and S.partial_ratio("", "") == 100


def test_lcs_against_table():
    r = random.Random(5)
    for _ in range(300):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert S.lcs_length(a, b) == t[-1][-1]


def test_measures_are_symmetric_and_bounded():
    r = random.Random(6)
    for _ in range(300):
        a, b = (" ".join("".join(r.choices("abcd", k=r.randint(1, 5))) for _ in range(r.randint(0, 4))) for _ in range(2))
        for f, top in ((S.indel_ratio, 100), (S.token_sort_ratio, 100), (S.token_set_ratio, 100), (S.partial_ratio, 100), (S.jaro_winkler, 1), (S.jaro_winkler_gated, 1)):
            assert 0 <= f(a, b) <= top + 1e-9
            assert f(a, b) == pytest.approx(f(b, a))


def test_jaro_winkler_known_values():
    assert S.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler_gated("abcdef", "azzzzz") == pytest.approx(0.444444, abs=1e-6)
    assert S.jaro_winkler("abcdef", "azzzzz") == pytest.approx(0.5, abs=1e-6)


def test_cascade_scale(spark):
    df = spark.createDataFrame([(-0.1,), (0.1,)], "s double")
    get = lambda legacy: [r[0] for r in df.select(S.cascade_score(F.col("s"), F.lit(0.0), F.lit(0.0), legacy_scale=legacy)).collect()]
    assert get(True) == pytest.approx([0.27, 0.06]) and get(False) == pytest.approx([0.0, 0.06])


def test_capped_is_inclusive(spark):
    t = spark.createDataFrame([("x", "a", i) for i in range(3)] + [("x", "b", i) for i in range(4)], "country string, token string, id long")
    assert {r.token for r in blocking.capped(t, 3).collect()} == {"a"}


def test_house_blocks_are_within_token_blocks(spark):
    rows = [(i, "x", f"{i % 4} main {'ab'[i % 2]}") for i in range(12)]
    d = spark.createDataFrame(rows, "id long, country string, name string")
    tokens = blocking.exploded(d, "id", "country", T.tokens(F.col("name")))
    house = d.select("country", T.house_number(F.col("name")).alias("token"), "id").where("token <> ''")
    all_pairs = {(r.query, r.candidate) for r in blocking.block_pairs(tokens, tokens, 12).collect()}
    assert {(r.query, r.candidate) for r in blocking.block_pairs(house, house, 12).collect()} <= all_pairs


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_against_brute_force(spark, kind):
    r = random.Random(7)
    rows = [(i, [float(r.choice((-1, 0, 1))) for _ in range(3)], i % 3) for i in range(40)] + [(99, [0.0] * 3, 1)]  # many ties
    rows = [(i if kind == "long" else f"S2-{i}", v, c) for i, v, c in rows]
    v = spark.createDataFrame(rows, f"id {kind}, vector array<double>, c int")
    size = lambda x: sum(y * y for y in x) ** 0.5
    for key in (None, "c"):
        want = []
        for i, x, c in rows:
            near = [(-round(sum(a * b for a, b in zip(x, y, strict=True)) / (size(x) * size(y)) if size(x) * size(y) else 0.0, 6), j) for j, y, d in rows if j != i and (key is None or c == d)]
            want += [(i, j, -s + 0.0, k + 1) for k, (s, j) in enumerate(sorted(near)[:4])]
        for rows_a_block in (7, 4096):
            got = blocking.nearest_blocked(v, v, 4, key, rows_a_block).select("query", "candidate", "sim", "rank").collect()
            assert sorted((q, c, s + 0.0, k) for q, c, s, k in got) == sorted(want)


def test_f_beta_cases(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "query long")
    p = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 5)], "query long, candidate long")
    t = spark.createDataFrame([(0, 1), (0, 3), (2, 7)], "query long, candidate long")
    # 0: precision 2/3 and recall 1; 1: wrong; 2: missed; 3: rightly empty
    assert evaluation.macro_f_beta(q, p, t).first()["macro_f"] == pytest.approx((0.714286 + 0 + 0 + 1) / 4, abs=1e-5)


def test_sweep_is_the_scalar_metric(spark):
    r = random.Random(8)
    rows = [(q, c, r.choice((0.1, 0.5, 0.55, 0.9, r.random())), int(r.random() < 0.4)) for q in range(9) for c in range(r.randint(0, 5))]
    s = spark.createDataFrame(rows, "query long, candidate long, prob double, label int")
    extra = {2: 1}  # a true candidate that blocking missed
    counts = spark.createDataFrame([(q, sum(x[3] for x in rows if x[0] == q) + extra.get(q, 0)) for q in range(10)], "query long, n_true long")
    q = counts.select("query")
    t = s.where("label = 1").select("query", "candidate").unionByName(spark.createDataFrame([(2, 99)], "query long, candidate long"))
    grid = [0.1, 0.5, 0.55, 0.9, 0.95]
    for row in evaluation.sweep(s, counts, grid).collect():
        assert row.macro_f == evaluation.macro_f_beta(q, ranking.decide_threshold(s, row.threshold), t).first()["macro_f"]


def test_ownership_is_unique(spark):
    p = spark.createDataFrame([(1, 7, 0.9), (2, 7, 0.9), (3, 7, 0.4), (3, 8, 0.3)], "query long, candidate long, prob double")
    assert sorted(map(tuple, ranking.decide_ownership(p, 0.35).collect())) == [(1, 7, 0.9)]


def test_triplets_never_repeat_the_positive(spark):
    pool = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b")], "id long, country string")
    pairs = spark.createDataFrame([(q, c) for q in range(6) for c in (*range(5), 9)], "query long, candidate long")
    got = training.triplets(pairs, pool).collect()
    assert len(got) == 30 and all(r.negative != r.candidate and r.negative < 5 for r in got)


def test_issues(spark):
    rows = [(0, "S1-1", "S2-1,S2-1"), (1, "S1-1", ""), (2, "S1-2", "S1-9,x,S3-5"), (3, "S1-9", "a,,b")]
    lists = spark.createDataFrame(rows, "row long, id string, members string")
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    valid = spark.createDataFrame([("S2-1",)], "id string")
    assert {r.rule: r.n for r in quality.issues(lists, need, valid).collect()} == {"duplicate_row": 1, "repeated_member": 1, "self_match": 1, "bad_prefix": 4, "missing_row": 1, "unexpected_row": 1, "unknown_member": 1}


def test_file_problems(spark):
    lines = spark.createDataFrame([(0, "a,b"), (1, "x\ty"), (2, "z"), (3, " ")], "number long, value string")
    assert {tuple(r) for r in quality.file_problems(lines, ("a", "b")).collect()} == {("comma_header", 1), ("row_without_tab", 1)}
    assert [r.rule for r in quality.file_problems(lines.limit(0), ("a", "b")).collect()] == ["empty_file"]


def test_tsv_keeps_stray_quotes_and_guards_lines(spark, tmp_path):
    path = tmp_path / "x.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Acme\t1 Main\t\nS1-2\tB"c\t\tUS\n')
    df = tables.guarded(spark, tables.read_tsv(spark, str(path)), [str(path)])
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", '"Acme', "1 Main", ""), ("S1-2", 'B"c', "", "US")]
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(path), ("nowhere",))


def test_aliases_and_old_truth_layout(spark):
    df = spark.createDataFrame([("", "S2-7", "Acme", "1 Main", "Oslo")], "entity_id string, id string, name string, address string, city string")
    assert tuple(tables.aliased(df).first())[:3] == ("S2-7", "Acme", "1 Main")
    old = spark.createDataFrame([("a", "S2-1", "S3-1"), ("b", "None", "S3-2"), ("c", "", None)], "s1_id string, s2_id string, s3_id string")
    assert [r.members for r in tables.read_lists(old, "s1_id", "matched").orderBy("query").collect()] == [["S2-1", "S3-1"], ["S3-2"], []]


def test_prior_for_one_class(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, label int")
    assert {r.prob for r in modeling.fit_reranker(df, ["x"]).transform(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        modeling.fit_reranker(df, ["x"], strict=True)


def test_features_of_a_missing_record(spark):
    d = spark.createDataFrame([(1, "acme inc", "1 main", "", "1", "cmnc", 0)], "id long, name string, address string, pin string, house string, skeleton string, source int")
    p = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4)], "query long, candidate long, sim double").withColumn("cosine", F.col("sim"))
    rows = {r.candidate: r for r in features.features_19(features.with_fields(p, d, d)).collect()}
    assert rows[1].name_ratio == 100 and rows[2].name_empty == 1 and rows[1].pin == -1 and rows[1].gap_next == 0.1 and rows[2].gap_next == 0


def test_ownership_and_triplets_of_string_ids(spark):
    p = spark.createDataFrame([("S1-2", "S2-7", 0.9), ("S1-10", "S2-7", 0.9), ("S1-3", "S2-8", 0.3)], "query string, candidate string, prob double")
    assert [tuple(r) for r in ranking.decide_ownership(p, 0.35).collect()] == [("S1-10", "S2-7", 0.9)]
    pool = spark.createDataFrame([(f"S2-{i}", "a") for i in range(5)] + [("S3-9", "b")], "id string, country string")
    pairs = spark.createDataFrame([(f"S1-{q}", c) for q in range(6) for c in (*(f"S2-{i}" for i in range(5)), "S3-9")], "query string, candidate string")
    got = training.triplets(pairs, pool, fallback="a").collect()
    assert len(got) == 36 and all(r.negative != r.candidate and r.negative.startswith("S2-") for r in got)
    assert len({r.negative for r in got}) == 5


def test_capped_keeps_no_more_than_it_must(spark):
    tokens = spark.createDataFrame([("x", "hot", i) for i in range(50)] + [("x", "rare", 3)], "country string, token string, id long")
    assert [r.token for r in blocking.capped(tokens, 10).collect()] == ["rare"]
    assert "WindowGroupLimit" in blocking.capped(tokens, 10)._jdf.queryExecution().executedPlan().toString()
    assert {r.token for r in blocking.without_hot(tokens, tokens, 10).collect()} == {"rare"}


def test_short_names_fall_back(spark):
    q, p = (spark.createDataFrame(rows, "id string, country string, name string") for rows in ([("S1-1", "x", "ibm")], [("S2-1", "x", "ibm"), ("S2-2", "x", "ibmx")]))
    none = spark.createDataFrame([], "query string, candidate string")
    assert [tuple(r) for r in blocking.prefix_fallback(q, p, none, 10).collect()] == [("S1-1", "S2-1")]


def test_fallback_pairs_are_not_shuffled(spark, sf):
    """One bucket with all records: lists of rows are dealt out, pairs come of them where they are written."""
    q = spark.range(3000).selectExpr("id", "'x' country", "'aei' name")
    p = spark.range(5000).selectExpr("id", "'x' country", "'aei' name")
    pairs = blocking.prefix_fallback(q, p, spark.createDataFrame([], "query long, candidate long"), 10**6)
    for df in (pairs, queries.short_names(spark, sf)):
        assert df._jdf.queryExecution().executedPlan().toString().split("Exchange")[0].count("Generate") == 2
    tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 3000 * 5000 and len(tasks) > 1


def test_fallback_of_repeated_and_empty_records(spark):
    names = [None, "", "a", "abcde1", "abcde2", "abcd", "bcdefg"]
    rows = [(f"S1-{i % 7}" if i % 19 else None, (None, "x", "y")[i % 3] if i % 4 else "x", names[i * i // 5 % 7]) for i in range(80)]
    q, p = (spark.createDataFrame(r, "id string, country string, name string") for r in (rows, [("S2" + (i or "S1-9")[2:], c, n) for i, c, n in rows]))
    hit = spark.createDataFrame([("S1-3", "S2-1")], "query string, candidate string")
    key = lambda r: (r[1], None if r[2] is None else r[2][:5])
    met = [(a[0], b[0], a[2], b[2]) for a in q.collect() for b in p.collect() if None not in key(a) and key(a) == key(b) and a[0] != "S1-3"]
    told = lambda rows: sorted(map(tuple, rows), key=repr)
    several = {r[:2] for r in met for s in met if r[:2] == s[:2] and r[2][:5] != s[2][:5]}
    assert len(several) > 3
    for cap in (100, 10**6):
        assert told(blocking.prefix_fallback(q, p, hit, cap).collect()) == told({r[:2] for r in met})
    assert told(blocking.prefix_fallback(q, p, hit, 100, fields=("name",)).select("query", "candidate", "left_name", "right_name").collect()) == told(met)


def test_meetings_of_short_lists(spark):
    rows = lambda name, n: spark.createDataFrame([("x", "hot" if i % 5 else f"t{i % 3}", i) for i in range(n)], f"country string, token string, {name} long")
    q, p = rows("query", 40), rows("candidate", 70)
    want = sorted(map(tuple, q.join(p, ["country", "token"]).select("query", "candidate").collect()))
    for size in (1, 7, 32, 10**6):
        assert sorted(map(tuple, blocking.meetings(q, p, size).collect())) == want


def _table_ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return 100.0 if not a and not b else 200.0 * t[-1][-1] / (len(a) + len(b))


def _table_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 100.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join(filter(None, [both, " ".join(sorted(z))])) for z in (x - y, y - x))
    return max(_table_ratio(one, two), *([_table_ratio(both, one), _table_ratio(both, two)] if both else [0.0]))


def _table_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    a, b = sorted((a, b), key=len)
    ways = [(a, b)] if len(a) < len(b) else [(a, b), (b, a)]
    return max(_table_ratio(x, y[max(0, i) : i + len(x)]) for x, y in ways for i in range(1 - len(x), len(y)))


def _table_jaro(a, b):
    """Classic Jaro-Winkler, straight from the definition."""
    reach, used, ours = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            ours.append(c)
    theirs = [b[j] for j in sorted(used)]
    m, k = len(ours), 0
    j = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(ours, theirs, strict=True)) / 2) / m) / 3 if m else 0.0
    while k < min(4, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return j + k * 0.1 * (1 - j)


def test_measures_against_tables():
    r = random.Random(12)
    for _ in range(200):
        a, b = (" ".join("".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(r.randint(0, 4))) for _ in range(2))
        assert S.indel_ratio(a, b) == pytest.approx(_table_ratio(a, b))
        assert S.token_sort_ratio(a, b) == pytest.approx(_table_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
        assert S.token_set_ratio(a, b) == pytest.approx(_table_set(a, b))
        assert S.partial_ratio(a, b) == pytest.approx(_table_partial(a, b))
        assert S.jaro_winkler(a, b) == pytest.approx(_table_jaro(a, b))


def test_features_against_definitions(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choices("abcde", k=r.randint(1, 6)))
    text = lambda: " ".join(word() for _ in range(r.randint(0, 3)))
    record = lambda: (text(), text(), r.choice(("", "12345", "54321")), r.choice(("", "1", "2")), r.choice(("", "bcd")), r.randint(0, 1))
    rows = [(f"S1-{k // 4}", f"S2-{k}", round(r.random(), 3), *record(), *record()) for k in range(40)]
    names = [f"{s}_{c}" for s in ("left", "right") for c in features.FIELDS]
    kinds = ["string"] * 5 + ["int"]
    d = spark.createDataFrame(rows, "query string, candidate string, sim double, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds * 2, strict=True))).withColumn("cosine", F.col("sim"))
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    by_gram = lambda x, y: jac(set(x.split()), set(y.split())) if min(len(x), len(y)) < 3 else jac(grams(x), grams(y))
    tri = lambda x, y: -1 if not x or not y else int(x == y)
    same = lambda x, y: int(bool(x) and x == y)
    ratio = lambda x, y: min(len(x), len(y)) / max(len(x), len(y)) if x or y else 0.0
    found = {k: {row.candidate: row for row in f(d).collect()} for k, f in ((8, features.features_8), (11, features.features_11), (12, features.features_12), (19, features.features_19))}
    for q, c, sim, n, a, pin, house, skel, _, m, b, pin2, house2, skel2, source2 in rows:
        want8 = (_table_jaro(n, m), jac(set(n.split()), set(m.split())), by_gram(n, m), jac(set(a.split()), set(b.split())), by_gram(a, b), tri(pin, pin2), sim, source2)
        assert tuple(found[8][c])[2:] == pytest.approx(want8, abs=1e-6)
        want11 = (_table_ratio(n, m) / 100, _table_ratio(a, b) / 100, _table_set(n, m) / 100, _table_set(a, b) / 100, same(pin, pin2), same(house, house2), int(skel == skel2), 0, 0, 0, 0)
        assert tuple(found[12][c])[2:] == pytest.approx((sim, *want11), abs=1e-6)
        assert tuple(found[11][c])[-11:] == pytest.approx(want11, abs=1e-6)
        group = sorted(((-x[2], x[1]) for x in rows if x[0] == q))
        at = group.index((-sim, c))
        rank = (sim, at, -group[0][0], -group[0][0] - sim, sim + group[at + 1][0] if at + 1 < len(group) else 0.0)
        want19 = (S.jaro_winkler_gated(n, m), _table_ratio(n, m), _table_set(n, m), _table_ratio(" ".join(sorted(n.split())), " ".join(sorted(m.split()))), _table_partial(n, m), _table_ratio(a, b), _table_set(a, b), _table_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), tri(pin, pin2), tri(house, house2), source2, ratio(n, m), ratio(a, b), int(not n or not m))
        assert tuple(found[19][c])[2:] == pytest.approx((*rank, *want19), abs=1e-6)


def test_models_learn_what_the_features_say(spark):
    rows = [(f"S1-{k // 5}", f"S2-{k}", float(k % 5 == 0), float(k % 3), int(k % 5 == 0), k // 5 % 4) for k in range(200)]
    d = spark.createDataFrame(rows, "query string, candidate string, x double, y double, label int, fold int")
    model = modeling.fit_reranker(d.withColumn("valid", F.col("fold") == 0), ["x", "y"], iterations=4, validation="valid")
    scored = model.transform(d)
    assert scored.where("(prob > 0.5) <> (label = 1)").count() == 0 and model.importances()["x"] > 0.9
    staged = features.with_context(modeling.out_of_fold(d, ["x", "y"], "fold", 4, iterations=3)).withColumnRenamed("prob", "stage1")
    wide = ["x", "y", "stage1", "relative_rank", "best_gap", "support"]
    out = modeling.fit_reranker(staged, wide, iterations=3).transform(staged)
    assert out.count() == 200 and out.where("(prob > 0.5) <> (label = 1)").count() == 0
    curve = modeling.fit_calibration(scored)
    assert modeling.calibrated(curve, scored).where("abs(calibrated - label) > 0.01").count() == 0


def test_scorer_that_runs_out_of_memory(spark):
    def scorer(left, right):
        if len(left) > 2 or "bad" in left:
            raise MemoryError
        return [float(len(a)) for a in left]

    d = spark.createDataFrame([(f"S1-{k}", f"S2-{k}", "bad" if k == 3 else "x" * k, "y") for k in range(9)], "query string, candidate string, left string, right string").coalesce(1)
    assert {r.query: r.prob for r in modeling.scored_pairs(d, scorer).collect()} == {f"S1-{k}": 0.0 if k == 3 else float(k) for k in range(9)}


def test_patient_encoder():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(texts) > 1 or calls.count(1) == 1:
            raise OSError
        return np.ones((1, 2))

    assert cache.patient(flaky, tries=2, wait=0)(["a", "b"]).shape == (2, 2) and calls == [2, 2, 1, 1, 1]


def test_guard_counts_a_header_for_each_file(spark, tmp_path):
    d = spark.createDataFrame([(f"S1-{i}", "a", "b", "") for i in range(9)], "entity_id string, business_name string, business_address string, country string")
    tables.write_lists(d.select("entity_id", "business_name").repartition(3), str(tmp_path / "x"), "entity_id", "business_name")
    assert tables.guarded(spark, tables.read_tsv(spark, str(tmp_path / "x"), ("entity_id",)), [str(tmp_path / "x")]).count() == 9
    with pytest.raises(ValueError):
        tables.guarded(spark, d.limit(2), [str(tmp_path / "x")])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_lexical_run(spark, kind):
    r = random.Random(9)
    name = (lambda i: i) if kind == "long" else lambda i: f"S1-{i}" if i < 100 else f"S{2 + i % 2}-{i}"
    words = ["".join(r.choices("bcdfglmnprst", k=2)) + r.choice("aeio") + "".join(r.choices("klmnrst", k=2)) for _ in range(60)]
    own = [(name(i), " ".join(r.sample(words, 3)), f"{r.randint(1, 99)} {r.choice(words)} road", "US") for i in range(40)]
    copies = [(name(100 + i), n.replace("a", "e", 1), a, c) for i, (_, n, a, c) in enumerate(own) if i % 2]
    others = [(name(200 + i), " ".join(r.sample(words, 3)), f"{r.randint(1, 99)} {r.choice(words)} road", "US") for i in range(30)]
    make = lambda rows: tables.enrich(spark.createDataFrame(rows, f"id {kind}, business_name string, business_address string, country string"))
    q, p = make(own), make(copies + others)
    truth = spark.createDataFrame([(name(i), name(100 + i)) for i in range(40) if i % 2], f"query {kind}, candidate {kind}")
    s = pipelines.Settings(top_k=10, cap=30, iterations=3, folds=2, grid=[0.2, 0.5, 0.8])
    candidates = pipelines.lexical_candidates(q, p, s)
    result = pipelines.rerank(candidates, q, p, truth, s)
    assert result.recall.first()["recall"] >= 0.9
    found = {(x.query, x.candidate) for x in result.matches.collect()}
    assert found <= {(x.query, x.candidate) for x in candidates.collect()} and len({c for _, c in found}) == len(found)
    dense = pipelines.cascade_candidates(q, p, cache.hashing_encoder(), pipelines.Settings(cascade_in=6, cascade_out=2))
    assert dense.groupBy("query").count().where("count > 2").count() == 0
    assert pipelines.dense_candidates(q, p, cache.hashing_encoder(), pipelines.Settings(top_k=3)).count() == 120


def test_model_and_facts_survive_saving(spark, tmp_path):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)] * 3, "x double, label int")
    model = modeling.fit_reranker(df, ["x"], iterations=2)
    model.save(str(tmp_path / "model"))
    again = modeling.Reranker.load(str(tmp_path / "model"))
    assert again.transform(df).select("prob").distinct().count() > 1 and model.importances() == {"x": 1.0}
    modeling.save_run(df.agg(F.count("*").alias("n_queries")), str(tmp_path / "facts"), threshold=0.5)
    assert spark.read.json(str(tmp_path / "facts")).first().threshold == 0.5


def test_saved_models_are_found_by_precedence(spark, tmp_path):
    df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)] * 3, "x double, label int")
    model = modeling.fit_reranker(df, ["x"], iterations=2, subsample=0.85, features="0.85")
    for place in ("a/best-1", "b/best-2", "b/last"):
        model.save(str(tmp_path / place))
    (tmp_path / "a" / "last").mkdir()  # no model
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    found = lambda *patterns: modeling.find_saved(spark, roots, list(patterns)).rsplit("/", 2)[1:]
    assert found("last", "best-*") == ["b", "last"] and found("best-*") == ["a", "best-1"]
    assert modeling.Reranker.load(modeling.find_saved(spark, roots, ["best-*"])).importances() == {"x": 1.0}
    with pytest.raises(FileNotFoundError):
        found("none")


def test_text_pairs_have_both_texts(spark):
    pairs = spark.createDataFrame([("q1", "p1"), ("q1", "p2"), ("q2", "p1"), ("q3", "p1")], "query string, candidate string")
    q = spark.createDataFrame([("q1", "a"), ("q2", " "), ("q3", None)], "id string, text string")
    p = spark.createDataFrame([("p1", "b")], "id string, text string")
    assert [tuple(r) for r in training.text_pairs(pairs, q, p).collect()] == [("q1", "p1", "a", "b")]


def test_files_are_found_below_a_root(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.tsv").write_text("entity_id\n")
    assert [p.rsplit("/", 1)[1] for p in tables.find_files(spark, str(tmp_path), "x.tsv")] == ["x.tsv"]
    with pytest.raises(FileNotFoundError):
        tables.find_files(spark, str(tmp_path), "y.tsv")


def test_canonical_text_is_the_clean_fields(spark):
    df = tables.enrich(spark.createDataFrame([("Acme Co.", "12 St. James Rd", " us ")], "business_name string, business_address string, country string"))
    text = df.select(T.entity_string(F.col("business_name"), F.col("business_address"), F.col("country")).alias("x"), T.clean_text(F.col("business_name")).alias("n"), T.clean_text(F.col("business_address")).alias("a")).first()
    assert text.x == f"[US] {text.n} | {text.a}"
    assert quality.examples(df, "country") == [" us "]
