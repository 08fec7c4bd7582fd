"""Small fixtures for preparation, predicates, mining, checks, repair and generation."""

import collections
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions import logic, text
from veritab.operators import checks, generate, mining, predicates, prepare, profile, report, rules, windows
from veritab.operators.predicates import Field, Predicate
from veritab.operators.rules import Rule


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_windows_of_two(spark):
    d = spark.createDataFrame([("a", 1, 10), ("a", 2, 11), ("b", 1, 20), ("b", 2, 21)], "flow string, t int, x int")
    w = windows.context_windows(d, ["flow"], ["t"], 2)
    assert rows(w, "x_ctx0", "x_ctx1") == [(10, 11), (20, 21)]
    assert windows.families(w.columns)["x"] == ["x_ctx0", "x_ctx1"]


def test_incomplete_columns_go(spark):
    d = spark.createDataFrame([(1, 10, "u"), (2, None, " ")], "x int, y int, s string")
    kept, gone = prepare.drop_incomplete(d, ["x"])
    assert kept.columns == ["x"] and gone == {"y": "missing values", "s": "blank values"}
    with pytest.raises(ValueError):
        prepare.drop_incomplete(d, ["y"])


def test_map_rules_take_the_first_match(spark):
    d = spark.createDataFrame([(80,), (443,), (10000,), (55000,)], "p long")
    r = [{"in": [80, 443], "value": 1}, {"default": True, "value": 9}, {"range": (1024, 49151), "value": 2}]
    assert [x[0] for x in d.select(prepare.by_rules(F.col("p"), T.LongType(), r)).collect()] == [1, 1, 2, 9]


def test_population_deviation_of_a_row(spark):
    d = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (None, 4.0)], "a double, b double")
    assert [x[0] for x in d.select(logic.row_std(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_two_valued_logic(spark):
    d = spark.createDataFrame([(1,), (None,)], "x int")
    got = d.select(logic.ne(F.col("x"), 1), ~logic.eq(F.col("x"), 1), logic.gt(F.col("x"), 0)).collect()
    assert [tuple(r) for r in got] == [(False, False, True), (True, True, False)]


def test_predicate_groups():
    fields = [Field("Bytes", "integer", ("size",), additions=(20, 40)), Field("Duration", "real", ("time",), constants=(0.1,)), Field("Class", "categorical", (), constants=(71000,))]
    texts = {p.text for p in predicates.distinct(predicates.field_constant(fields, [">=", "<="]) + predicates.field_field(fields, ["<="]) + predicates.summed_fields(fields, ["<="]))}
    assert "Duration <= 0.1" in texts
    assert not any("Class" in t or ("Bytes" in t and "Duration" in t) for t in texts)
    seq = [Field("seq", "integer", ("sequence",), additions=(1,)), Field("ack", "integer", ("sequence",)), Field("len", "integer", ("size",))]
    assert {"(seq + len) <= ack", "(seq + 1) <= ack"} <= {p.text for p in predicates.summed_fields(seq, ["<="])}


def minimal_sets(sigs, n, most):
    found = []
    for k in range(1, most + 1):
        for c in itertools.combinations(range(n), k):
            if all(set(c) & set(s) for s in sigs) and not any(set(f) <= set(c) for f in found):
                found.append(c)
    return sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_covers_against_brute_force(spark, seed):
    rng = random.Random(seed)
    sigs = [sorted(rng.sample(range(6), rng.randint(1, 4))) for _ in range(6)]
    d = spark.createDataFrame([(s, 1) for s in sigs], "sig array<int>, w long")
    got = sorted(tuple(r[0]) for r in mining.minimal_covers(d, 3).collect())
    assert got == minimal_sets(sigs, 6, 3)


def test_mined_rule_holds(spark):
    d = spark.createDataFrame([(10, 1, 5), (11, 2, 6), (20, 3, 7), (21, 4, 8)], "Bytes int, Packets int, Mtu int")
    ps = [Predicate("Bytes > Mtu", lambda: logic.gt(F.col("Bytes"), F.col("Mtu"))), Predicate("Packets > Mtu", lambda: logic.gt(F.col("Packets"), F.col("Mtu")))]
    clauses = mining.clause_text(mining.minimal_covers(mining.signatures(d, ps), 2), ps)
    assert [r.rule for r in clauses.collect()] == ["Bytes > Mtu"]
    assert rules.counterexamples(d, [], ps[0].column).count() == 0


def test_tautologies_go(spark):
    ps = [Predicate("a > 1", lambda: F.lit(True), ("a", ">", "1")), Predicate("a <= 1", lambda: F.lit(True), ("a", "<=", "1"))]
    d = spark.createDataFrame([([0, 1],), ([0],)], "clause array<int>")
    assert [r[0] for r in mining.without_tautologies(d, ps).collect()] == [[0]]


def test_tree_finds_the_split(spark):
    d = spark.createDataFrame([([0, 1, 2], 5), ([1, 2], 5), ([0], 5), ([], 5)], "sig array<int>, w long")
    leaves = {tuple(r.path): (r.w, r.share) for r in mining.entropy_tree(d, 2, 2).collect()}
    assert leaves == {(1,): (10, 1.0), (-2,): (10, 0.0)}
    assert {(tuple(r.path), r.implies) for r in mining.tree_rules(mining.entropy_tree(d, 2, 2), 2).collect()} == {((1,), 2), ((-2,), -3)}


def test_quantiles_round_half_even(spark):
    d = spark.createDataFrame([(10,), (20,), (30,), (40,)], "x int")
    assert {r.label: r.value for r in profile.quantiles(d, ["x"], [0.5, 0.9]).collect()} == {"p50": 25.0, "p90": 37.0}


def book(period, **over):
    base = dict(CompanyId="c", Industry="i", PeriodIndex=period, Revenue=1000, COGS=600, GrossProfit=400, Purchases=600, Cash_Begin=50, Cash_End=50, Inventory_Begin=100, Inventory_End=100, AccountsReceivable=100, TotalAssets=1000, TotalLiabilities=400, TotalEquity=600)
    return base | over


def test_finance_checks_and_repair(spark):
    good = [book(p) for p in range(1, 7)]
    bad = [book(1), book(2, COGS=700), book(3, TotalAssets=1300), book(4, Inventory_Begin=111, Inventory_End=111), book(5, Cash_Begin=51, Inventory_Begin=111, Inventory_End=111, AccountsReceivable=300), book(6, Inventory_Begin=111, Inventory_End=900, Purchases=1389)]
    bands = spark.createDataFrame([("i", 500, 2000)], "Industry string, low_bp int, high_bp int")
    frame = lambda x: spark.createDataFrame([tuple(r.values()) for r in x], list(x[0]))
    assert checks.finance_violations(frame(good), bands, ["PeriodIndex"]).count() == 0
    found = {(r.PeriodIndex, r.rule_id) for r in checks.finance_violations(frame(bad), bands, ["PeriodIndex"]).collect()}
    assert found == {(2, "R01"), (2, "R05"), (3, "R02"), (4, "R03"), (5, "R04"), (5, "R07"), (6, "R06")}
    fixed = checks.repaired(frame(bad))
    left = {r.rule_id for r in checks.finance_violations(fixed.where("PeriodIndex < 4"), bands, ["PeriodIndex"]).collect()}
    assert not left & {"R01", "R02", "R05"}
    assert {(r.PeriodIndex, r.column) for r in checks.cell_changes(frame(bad), fixed, ["PeriodIndex"], ["COGS", "GrossProfit", "TotalLiabilities", "Inventory_Begin", "Cash_Begin"]).collect()} == {(2, "COGS"), (3, "TotalLiabilities"), (4, "Inventory_Begin"), (5, "Cash_Begin")}


def test_flow_rules(spark):
    d = spark.createDataFrame([(0, "TCP", "a", "1", "b", "80", 1, 60, "......"), (1, "UDP", "a", "1", "b", "80", 1, 60, ".A...."), (2, "TCP", "a", "1", "b", "80", 2, 10, ""), (3, "UDP", "a", "1", "8.8.8.8", "53", 1, 60, ""), (4, "UDP", None, "1", "b", "53", 1, 1, "S")], "i int, Proto string, SrcIpAddr string, SrcPt string, DstIpAddr string, DstPt string, Packets int, Bytes int, Flags string")
    assert rows(rules.violations(d, checks.flow_rules(), ["i"]), "i", "rule_id") == [(1, "N01"), (2, "N02"), (3, "N03"), (4, "N04")]


def test_numbers_and_slots(spark):
    d = spark.createDataFrame([("grew 12.5% to 1,234 in Q3, {{who}}",), (None,)], "t string")
    assert [r[0] for r in d.select(text.number_tokens(F.col("t"))).collect()] == [["12.5", "1,234"], []]
    assert d.select(text.fill_slots(F.col("t"), {"who": F.lit("we")})).first()[0].endswith("we")
    assert d.select(text.open_slots(F.col("t"))).first()[0] == ["who"]


def test_number_tokens_against_python(spark):
    """Signs and percent signs aren't taken; letters of any script beside a number make it no number."""
    pattern = re.compile(r"(?<![\w.,])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?![\w])")
    rng = random.Random(2)
    texts = ["12.5% up", "第3季 3", "é5 5é 5 é", "-7 +8 x9 9x _1 1_", "1,234,567.89 12,34 1.2.3 .5 5.", "v1.0 (2) 3% 4,000", "٣ ٤x", ""]
    texts += ["".join(rng.choice("0123,.% -ax第é_") for _ in range(14)) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", text.number_tokens(F.col("t")).alias("n")).collect():
        assert r.n == list(dict.fromkeys(m[0] for m in pattern.finditer(r.t))), r.t


def test_windows_without_keys(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), i) for i in range(300)]
    d = spark.createDataFrame(rows, "t int, i int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for size, stride, block in ((2, 1, 1_000_000), (3, 2, 50), (7, 3, 10), (5, 1, 2)):
        got = sorted(tuple(r) for r in windows.context_windows(d, [], ["t", "i"], size, stride, ["i"], block_rows=block).collect())
        assert got == sorted(tuple(r[1] for r in ordered[k : k + size]) for k in range(0, len(ordered) - size + 1, stride))
    three = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "t int, x int")
    assert sorted(map(tuple, windows.context_windows(three, [], [], 2).collect())) == [(1, 2, 10, 20), (2, 3, 20, 30)]
    assert windows.context_windows(three.limit(0), [], ["t"], 2).count() == 0


def test_fields_from_a_table(spark):
    d = spark.createDataFrame([(10, "TCP"), (20, "TCP"), (30, "UDP")], "Bytes int, Proto string")
    fields = [predicates.Field("Bytes", "integer", ("size",)), predicates.Field("Proto", "categorical"), predicates.Field("Late", "boolean")]
    assert [f.name for f in predicates.select_fields(fields, pattern="B|P", kinds=["integer", "categorical"])] == ["Bytes", "Proto"]
    assert [f.name for f in predicates.select_fields(fields, roles=["size", "time"])] == ["Bytes"] and predicates.select_fields(fields, names=["x"]) == []
    made = predicates.profiled(d, fields[:2], (0.5, 0.9))
    assert made[0].constants == (20.0, 28.0) and made[0].labels == ("p50", "p90") and made[1].constants == ("TCP",) and made[1].labels == ("top1",)
    assert [p.text for p in predicates.field_constant(made, ["<="])] == ["Bytes <= p50", "Bytes <= p90"]
    assert [r[0] for r in d.select(predicates.field_constant(made[1:], ["="])[0].column).collect()] == [True, True, False]
    assert predicates.profiled(d, fields[1:2], whole_domain=True)[0].constants == ("TCP", "UDP")
    # equality: one kind, or a category with a string; a truth value meets no number
    assert predicates.field_field(fields, ["="]) == []
    known = [Rule("a", logic.le(F.col("Bytes"), 1), "Bytes <= 1", ("Bytes",)), Rule("b", logic.le(F.col("Gone"), 1), "Gone <= Bytes", ("Gone", "Bytes"))]
    assert predicates.unknown_fields(known, d.columns) == {"Gone <= Bytes": ["Gone"]}


def test_clause_support_and_three_literals(spark):
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(6), rng.randint(0, 4))) for _ in range(60)]
    sigs = spark.createDataFrame([(s, n) for s, n in collections.Counter(map(tuple, sets)).items()], "sig array<int>, w long")
    found = mining.minimal_covers(sigs.where(F.size("sig") > 0), 3)
    brute, with_evidence = [], [set(s) for s in sets if s]
    for size in (1, 2, 3):
        for c in itertools.combinations(range(6), size):
            if all(s & set(c) for s in with_evidence) and not any(set(b) < set(c) for b in brute):
                brute.append(c)
    assert sorted(tuple(r.clause) for r in found.collect()) == sorted(brute)
    clauses = spark.createDataFrame([(list(c),) for size in (1, 2, 3) for c in itertools.combinations(range(6), size)], "clause array<int>")
    for r in mining.clause_support(clauses, sigs, len(sets)).collect():
        assert abs(r.support - sum(bool(set(s) & set(r.clause)) for s in sets) / len(sets)) < 1e-12


def test_words_of_rules(spark):
    d = spark.createDataFrame([("a2 * 2.5 <= 10 or kind = 'v3 7'", "x, y；z　w", "info"), (None, None, "error")], "rule string, tags string, level string")
    one, none = d.select(text.constants(F.col("rule")).alias("c"), text.tags(F.col("tags")).alias("t"), text.keywords(F.col("rule"), {"KIND": "sort"}).alias("k")).collect()
    assert one.c == [2.5, 10.0] and one.t == ["x", "y", "z", "w"] and one.k == ["a2", "10", "or", "kind", "v3", "sort"]
    assert none.c == none.t == none.k == []
    assert report.of_level(d, "all").count() == 2 and [r.level for r in report.of_level(d, "error").collect()] == ["error"]
    made = windows.window_fields([predicates.Field("x", "integer", ("size",))], 2)
    assert [(f.name, f.roles) for f in made] == [("x_ctx0", ("size", "window")), ("x_ctx1", ("size", "window"))]


def test_generated_rows_obey(spark):
    d = spark.createDataFrame([("alpha", 1, 1), ("beta", 2, 2)], "c string, x int, y int")
    r = [Rule("a", logic.implies(logic.eq(F.col("c"), "alpha"), logic.eq(F.col("x"), 1))), Rule("b", logic.le(F.col("x"), F.col("y")))]
    made = generate.generated_under_rules(d, ["c", "x", "y"], r, 20)
    assert made.count() == 20 and {tuple(x) for x in made.select("c", "x", "y").collect()} <= {("alpha", 1, 1), ("beta", 2, 2)}
    assert math.isclose(1.0, rules.satisfaction(made, r).agg(F.min("satisfaction")).first()[0])


def test_overrides(spark):
    a = spark.createDataFrame([("N1", "x"), ("N2", "y")], "rule_id string, text string")
    b = spark.createDataFrame([("N1", "z"), ("M1", "w")], "rule_id string, text string")
    assert rows(rules.override(a, b), "rule_id", "text", "origin") == [("M1", "w", "manual"), ("N1", "z", "manual"), ("N2", "y", "learned")]


def test_shapes_of_choices(spark):
    from veritab.operators.generate import shaped

    choices = [("a", 10), ("b", 40), ("c", 10), ("d", 40)]
    d = spark.createDataFrame([(choices,)], "x array<struct<value: string, n: long>>")
    of = lambda **kw: [(r.value, round(r.weight, 6)) for r in d.select(shaped(F.col("x"), **kw)).first()[0]]
    assert of() == [("b", 40), ("d", 40), ("a", 10), ("c", 10)]
    assert of(temperature=0.5) == [("b", 1600), ("d", 1600), ("a", 100), ("c", 100)]
    assert of(top_k=3) == [("b", 40), ("d", 40), ("a", 10)] and of(sample=False) == [("b", 40)]
    assert of(top_p=0.3) == [("b", 40)] and of(top_p=0.5) == [("b", 40), ("d", 40)] and of(top_p=0.99) == of()
    assert len(of(top_k=2, top_p=0.9)) == 2


def test_completion(spark):
    from veritab.operators.generate import completed, transitions

    d = spark.createDataFrame([("a", 1, "x")] * 3 + [("a", 2, "y"), ("b", 3, None)], "k string, n int, t string")
    counts, cols = transitions(d, ["k", "n", "t"]), ["k", "n", "t"]
    given = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    made = completed(given, counts, cols, samples=50)
    rows = [tuple(r) for r in made.select(*cols).collect()]
    assert len(rows) == 100 and set(rows) == {("a", "1", "x"), ("a", "2", "y"), ("b", "3", None)}
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in completed(given, counts, cols, samples=50).select(*cols).collect())
    assert {tuple(r) for r in completed(given, counts, cols, sample=False).select(*cols).collect()} == {("a", "1", "x"), ("b", "3", None)}
    with pytest.raises(ValueError):
        completed(d.select("n"), counts, cols)


def test_vocabulary_and_missing_columns(spark):
    from veritab.operators.generate import from_row_tokens, row_tokens, vocabulary

    d = spark.createDataFrame([("a", -12), ("b", 7)], "k string, n int").withColumn("t", row_tokens(["n"], ["k"], ["k", "n"], 2))
    back = from_row_tokens(F.col("t"), ["n"], ["k", "n", "other"])
    assert [tuple(r) for r in d.select(back["k"], back["n"].cast("int"), back["other"]).collect()] == [("a", -12, None), ("b", 7, None)]
    assert [r.token for r in vocabulary(d, "t").orderBy("token_id").collect()] == sorted(["<BOS>", "<EOS>", "<END_FIELD>", "<FIELD::k>", "<FIELD::n>", "k=a", "k=b", "+", "-", "0", "1", "2", "7"])


def test_templates_and_labels():
    fields = [predicates.Field("x_ctx0", "integer", ("size",), constants=(1, 2), labels=("p50", "")), predicates.Field("x_ctx1", "integer", ("size",)), predicates.Field("y_ctx0", "string")]
    assert windows.select_families(fields) == {"x": ["x_ctx0", "x_ctx1"], "y": ["y_ctx0"]}
    assert windows.select_families(fields, kinds=["integer"], roles=["size", "time"]) == {"x": ["x_ctx0", "x_ctx1"]} and windows.select_families(fields, name="y", kinds=["integer"]) == {}
    assert predicates.labelled_constants(fields, [predicates.Field("x", "integer", constants=(5, 6), labels=("top1", "top1"))]) == {"fields": {"x_ctx0": {"p50": 1}}, "families": {"x": {"top1": 5}}}
    predicates.check_shape([], constant=[])
    for wrong in ((None, []), ([],), ([], [], [])):
        with pytest.raises(ValueError):
            predicates.check_shape(*wrong)


def test_terms():
    a, b = predicates.Field("a", "integer", ("size",), scalars=(2,), additions=(1,)), predicates.Field("b", "integer", ("size",))
    c = predicates.Field("c", "integer", ("time",))
    left = predicates.scaled_terms([a, b]) + predicates.sum_terms([a, b, c])
    right = predicates.field_terms([a, b, c]) + predicates.constant_terms([3, "s"])
    assert {p.text for p in predicates.term_term(left, right, ["<="])} == {"(a * 2) <= b", "(a * 2) <= c", "(a + 1) <= b", "(a * 2) <= 3", "(a + 1) <= 3", "(a + b) <= 3"}


def test_terms_of_one_kind():
    """A truth value isn't compared with a string, and a number without a group not with one that has a group."""
    b, s, x, y = (predicates.Field(*f) for f in (("b", "boolean"), ("s", "string"), ("x", "real"), ("y", "real", ("size",))))
    k, i = predicates.Field("k", "categorical"), predicates.Field("i", "integer", ("time",))
    terms = predicates.field_terms([b, s, x, y, k, i])
    texts = lambda op: {p.text for p in predicates.term_term(terms, terms, [op])}
    assert texts("=") == {"s = k", "k = s", "x = i", "i = x", "y = i", "i = y"} and texts("<=") == set()
    assert {p.text for p in predicates.term_term(predicates.field_terms([b, x, s]), predicates.constant_terms([True, 1, 2.5, "v"]), ["=", "<"])} == {
        "b = True", "x = 1", "x < 1", "x = 2.5", "x < 2.5", "s = 'v'",
    }


def test_selector_and_right_sides():
    fields = windows.window_fields([predicates.Field("srcBytes", "integer", ("size",)), predicates.Field("Proto", "categorical")], 2)
    fields += [predicates.Field("rate", "real", ("size", "derived"))]
    named = lambda **k: [f.name for f in predicates.select_fields(fields, **k)]
    assert named(pattern="Bytes") == ["srcBytes_ctx0", "srcBytes_ctx1"] and named(pattern="^Bytes") == []
    assert named(derived=True) == ["rate"] and named(derived=False, window=False) == [] and named(window=False) == ["rate"]
    assert named(family="Proto", exclude=["Proto_ctx0"]) == ["Proto_ctx1"] and named(names=["rate", "gone", "Proto_ctx1"]) == ["rate", "Proto_ctx1"]
    left, right = predicates.select_fields(fields, family="srcBytes"), predicates.select_fields(fields, roles=["size"])
    assert [p.text for p in predicates.field_field(left[:1], ["<"], right)] == ["srcBytes_ctx0 < srcBytes_ctx1", "srcBytes_ctx0 < rate"]
    assert [p.text for p in predicates.field_field(left[:1], ["="], left[:1], same_field=True)] == ["srcBytes_ctx0 = srcBytes_ctx0"]


@pytest.mark.parametrize("block", [1_000_000, 40, 3])
def test_windows_of_a_hot_key(spark, block):
    """Nine of ten rows under one key, null keys, ties and null order keys."""
    rng = random.Random(4)
    rows = [(rng.choice([1] * 18 + [2, None]), rng.choice([None, *range(30)]), i) for i in range(400)]
    d = spark.createDataFrame(rows, "k long, t int, i int").repartition(3)
    for size, stride in ((2, 1), (5, 3)):
        got = sorted(tuple(r) for r in windows.context_windows(d, ["k"], ["t", "i"], size, stride, ["i"], block_rows=block).collect())
        want = []
        for key in (1, 2, None):
            own = [i for _, _, i in sorted((r[1] is None, r[1] or 0, r[2]) for r in rows if r[0] == key)]
            want += [tuple(own[j : j + size]) for j in range(0, len(own) - size + 1, stride)]
        assert got == sorted(want)


def test_codes(spark):
    d = spark.createDataFrame([("", 1), ("-", 2), ("+1", 3), ("-12.3", 4), ("-12.34", 5), ("1", 6), ("+1x", 7), ("+12.345", 8), ("+.1", 9), (None, 10)], "p string, i int")
    low, high = text.prefix_interval(F.col("p"), 2, 2, True)
    fits = text.prefix_fits(F.col("p"), 2, 2, True)
    ok = {r.i: (float(r[1]), float(r[2])) for r in d.where("i < 6").select("i", low, high).collect()}
    assert ok == {1: (0.0, 99.99), 2: (-99.99, 0.0), 3: (10.0, 19.99), 4: (-12.39, -12.3), 5: (-12.34, -12.34)}
    assert {r.i for r in d.where(fits).collect()} == {1, 2, 3, 4, 5}
    whole = d.select("i", text.prefix_fits(F.col("p"), 2).alias("f")).where("f").collect()
    assert {r.i for r in whole} == {1, 6}
    n = spark.createDataFrame([(1.25, -12, None), (-999.99996, 7, None), (None, None, None)], "x double, y int, z double")
    assert [tuple(r) for r in profile.number_codecs(n, ["x", "y", "z"]).collect()] == [("x", True, 4, 2), ("y", True, 2, 0), ("z", False, 1, 0)]


def test_evidence_of_added_files(spark, tmp_path):
    rng = random.Random(2)
    ps = [Predicate(f"x > {k}", lambda k=k: logic.gt(F.col("x"), k), ("x", ">", str(k))) for k in (2, 5, 7)]
    rows = lambda df: sorted((tuple(r.sig), r.w) for r in df.collect())
    for part in range(3):
        spark.createDataFrame([(rng.randint(0, 9),) for _ in range(50)], "x int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = rows(mining.file_signatures(spark, f"file://{tmp_path}/in/*.parquet", ps, f"file://{tmp_path}/kept"))
        assert got == rows(mining.signatures(spark.read.parquet(f"{tmp_path}/in"), ps))
        runs = spark.read.parquet(f"{tmp_path}/kept/*/files").groupBy("run").count().collect()
        assert [r["count"] for r in runs] == [1] * (part + 1)


@pytest.mark.parametrize("n", [0, 1, 61, 62, 63, 125])
def test_signatures_of_many_predicates(spark, n):
    d = spark.createDataFrame([(0,), (3,), (3,), (None,)], "v int")
    ps = [predicates.Predicate(str(k), lambda k=k: F.coalesce(F.col("v") % (k + 2) == 1, F.lit(None))) for k in range(n)]
    want = {}
    for v in (0, 3, 3, None):
        sig = tuple(k for k in range(n) if v is not None and v % (k + 2) == 1)
        want[sig] = want.get(sig, 0) + 1
    assert {tuple(r.sig): r.w for r in mining.signatures(d, ps, keep_empty=True).collect()} == want
    assert {tuple(r.sig): r.w for r in mining.signatures(d, ps).collect()} == {k: v for k, v in want.items() if k}


def test_quantiles_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    xs = [float(x) for x in rng.integers(0, 40, 501)]
    rows = [(x, None, int(x) * 7) for x in xs] + [(None, None, None)]
    d = spark.createDataFrame(rows, "x double, none double, k int")
    points = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 1.0]
    got = {(r.column, r.label): r.value for r in profile.quantiles(d, ["x", "none", "k"], points).collect()}
    assert len(got) == 21
    for p in points:
        label = f"p{round(p * 100):g}"
        assert abs(got["x", label] - np.quantile(xs, p)) < 1e-9 and got["none", label] is None
        assert got["k", label] == float(np.rint(np.quantile([x * 7 for x in xs], p)))


def test_cover_search_ends_after_a_size(spark):
    sigs = spark.createDataFrame([([0, 1],), ([0, 2],), ([1, 2, 3],)], "sig array<int>")
    all_ = {tuple(r.clause) for r in mining.minimal_covers(sigs, 3).collect()}
    assert all_ == {(0, 1), (0, 2), (0, 3), (1, 2)}
    assert {tuple(r.clause) for r in mining.minimal_covers(sigs, 3, most_rules=1).collect()} == all_
    assert mining.minimal_covers(sigs, 1, most_rules=1).isEmpty()


@pytest.mark.parametrize("partition", [["k"], []])
def test_small_blocks_make_few_ranges(spark, monkeypatch, partition):
    """The driver's sample and statuses grow with the ranges: these follow the shuffle partitions and the rows, not the blocks."""
    made, staged = [], windows.staged
    monkeypatch.setattr(windows, "staged", lambda df: made.append(df.rdd.getNumPartitions()) or staged(df))
    d = spark.range(600).select((F.col("id") % 2).alias("k"), "id")
    got = windows.context_windows(d, partition, ["id"], 3, 1, ["id"], block_rows=5)
    step = 2 if partition else 1
    assert sorted(map(tuple, got.collect())) == [(i, i + step, i + 2 * step) for i in range(600 - 2 * step)]
    assert len(made) == 1 and made[0] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert windows._ranges(d, 36_000_000, 500) == 36 and windows._ranges(d, 36_000_000, 20_000_000) == 2
