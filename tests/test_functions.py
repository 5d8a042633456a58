"""Hand-made rows for the cases in which semantics are easily lost: ties, flat groups, empty sides, odd texts."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as ft
from rankloom.functions import vectors as fv
from rankloom.operators import metrics, providers, ranking, sampling, stats


def one(spark, **columns):
    return spark.range(1).select([c.alias(n) for n, c in columns.items()]).first()


def strings(*items):
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def test_ties_take_the_lower_id_and_share_a_competition_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 3.0), (4, 1.0), (5, None), (6, float("nan"))], "id int, s double")
    rows = df.select("id", ranking.position([], "s", "id").alias("pos"), ranking.competition([], "s").alias("comp")).collect()
    assert {r.id: r.pos for r in rows if r.id < 5} == {2: 1, 3: 2, 1: 3, 4: 4}
    assert {r.pos for r in rows if r.id > 4} == {5, 6}
    flat = df.where("id < 5").select("id", ranking.competition([], "s").alias("comp"), ranking.average_rank([], "s").alias("avg"))
    assert {r.id: (r.comp, r.avg) for r in flat.collect()} == {1: (3, 2.0), 2: (1, 3.5), 3: (1, 3.5), 4: (4, 1.0)}


def test_flat_group_by_policy(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "g int, x double")
    for policy, want in (("null", None), ("eps", 0.0), ("zero", 0.0)):
        rows = ranking.zscore(df, "x", ["g"], "z", policy).collect()
        assert {r.z for r in rows if r.g == 1} == {want}
        assert sorted(round(r.z, 6) for r in rows if r.g == 2) == [-1.0, 1.0]
    assert ranking.zscore(df.where("g = 9"), "x", [], "z").collect() == []


def test_single_value_has_no_spread(spark):
    row = spark.createDataFrame([(4.0,)], "x double").agg(stats.std_or_zero("x").alias("s")).first()
    assert row.s == 0.0


def test_alpha_zero_does_not_see_the_direction(spark):
    a, p = F.lit(0.3), F.lit(9.0)
    assert one(spark, x=ranking.fuse(a, p, F.lit(0.0)), y=ranking.fuse(a, p, F.lit(1.0)))[:] == (0.3, 9.0)


def test_match_family(spark):
    al, answer = strings("pol", "", "Poland "), F.lit("in poland.")
    assert one(spark, a=ft.matches_long(answer, al), b=ft.matches_first3(answer, al), c=ft.matches_any(answer, al), d=ft.matches_bounded(answer, al))[:] == (True, True, True, True)
    assert one(spark, a=ft.matches_long(answer, strings("pol")), b=ft.matches_first3(answer, strings("", " ", "x", "pol")), c=ft.matches_any(F.lit("x"), strings("")), d=ft.matches_bounded(F.lit("policy"), strings("pol")))[:] == (False, False, True, False)
    assert one(spark, a=ft.matches_bounded(F.lit("it is  42."), strings("42")), b=ft.matches_bounded(F.lit("it is 423"), strings("42")), c=ft.matches_bounded(F.lit("cost a+b"), strings("a+b")), d=ft.matches_any(answer, strings()))[:] == (True, False, True, False)


@pytest.mark.parametrize("text, want", [("1,234.5 mg", 1234.5), ("none", None), ("-7", -7.0), ("+3,", 3.0), ("", None), (None, None), ("v2.10.3", 2.1)])
def test_first_number(spark, text, want):
    assert one(spark, x=ft.first_number(F.lit(text).cast("string"))).x == want


@pytest.mark.parametrize("text, want", [("0.85", (0.85, True)), ("1.0", (1.0, True)), ("score .5", (0.5, True)), ("7", (0.5, False)), ("10", (0.5, False)), ("1.5", (0.5, False)), ("", (0.5, False)), ("a 0, b", (0.0, True))])
def test_judge_score(spark, text, want):
    assert one(spark, j=ft.judge_score(F.lit(text))).j[:] == want


def test_number_label(spark):
    f = lambda p, others=(30.1,): one(spark, x=ft.number_label(F.lit(p).cast("double"), F.lit(30.0), F.array(*map(F.lit, others)))).x
    assert [f(30.00001), f(30.1), f(31.0), f(None), f(30.0, (30.0,))] == ["correct", "misled", "other", "other", "correct"]


def test_spans(spark):
    t = F.lit("Die Éire, der EIRE")
    span = lambda *n, **how: one(spark, s=ft.earliest_span(t, strings(*n), **how)).s
    assert span("Éire")[:] == (4, 8)
    assert span("éire", fold=True)[:] == (4, 8) and span("éire") is None
    assert span("eire", "der", fold=True)[:] == (10, 13)
    assert span("", "Die", "Di")[:] == (0, 3)
    assert span("er", bounded=True) is None and span("der", bounded=True)[:] == (10, 13)
    assert span() is None


def test_packing(spark):
    pack = lambda *p, most=3: one(spark, c=ft.pack(strings(*p), most)).c
    assert pack("a b", "c", "d e f g", "h") == ["a b c", "d e f g", "h"]
    assert pack() == [] and pack("a b c d e") == ["a b c d e"]
    assert pack("a", "b", "c", most=1) == ["a", "b", "c"]


def test_html_and_prompts(spark):
    page = '<p>a<script>var t="</p>";</script> b &amp;lt; &quot;c&quot;</p><!-- x --><style>p{}</style>\n d'
    assert one(spark, t=ft.html_text(F.lit(page))).t == 'a b &lt; "c" d'
    assert one(spark, t=ft.numbered(strings("x", "y"))).t == "[1] x\n[2] y"
    assert one(spark, a=ft.safe_id(F.lit("org/model/x")), b=ft.head_words(F.lit(" a  b c"), 2), c=ft.quoted_list(F.lit("['a', \"it's\"]")))[:] == ("org__model__x", "a b", ["a", "it's"])


def test_vectors(spark):
    a, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    row = one(spark, d=fv.dot(a, a), n=fv.norm(a), u=fv.unit(a), z=fv.unit(zero), c=fv.cosine(a, zero), e=fv.unit(zero, 1e-8), g=fv.gather(a, F.array(F.lit(1), F.lit(0))), m=fv.argmax(a), s=fv.sign_score(F.lit(0.0)), ok=fv.finite(F.array(F.lit(1.0), F.lit(float("nan")))))
    assert row[:] == (25.0, 5.0, [0.6, 0.8], None, None, [0.0, 0.0], [4.0, 3.0], 1, 0.5, False)
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "g int, vec array<double>")
    got = fv.segment_mean(df, "vec", ["g"], spark.createDataFrame([(1,), (2,)], "g int"), 2).collect()
    assert {(r.g, r.i): r.v for r in got} == {(1, 0): 2.0, (1, 1): 3.0, (2, 0): 0.0, (2, 1): 0.0}


def test_split_is_by_key_and_stable(spark):
    df = spark.createDataFrame([(k % 10, k) for k in range(60)], "key int, x int")
    for seed in (7, 42):
        rows = sampling.grouped_split(df, "key", seed).collect()
        train, test = ({r.key for r in rows if r.split == s} for s in ("train", "test"))
        assert len(train) == 8 and len(test) == 2 and not train & test
        assert {r.x: r.split for r in rows} == {r.x: r.split for r in sampling.grouped_split(df.repartition(5), "key", seed).collect()}


def test_balance_and_folds(spark):
    df = spark.createDataFrame([("a" if k < 7 else "b", k) for k in range(10)], "y string, id int")
    assert {r.y: r["count"] for r in sampling.balance(df, ["y"], 1, "id").groupBy("y").count().collect()} == {"a": 3, "b": 3}
    assert sorted(r["count"] for r in sampling.folds(df, "y", "id", 1, 3).groupBy("y", "fold").count().collect()) == [1, 1, 1, 2, 2, 3]
    ids = sampling.dense_ids(spark.createDataFrame([(c,) for c in "dbacab"], "t string"), "t", "i")
    assert sorted(map(tuple, ids.collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_auroc_and_balanced_accuracy(spark):
    df = spark.createDataFrame([("up", k, float(k), k > 2) for k in (1, 2, 3, 4)] + [("flat", k, 1.0, k > 2) for k in (1, 2, 3, 4)] + [("one", 1, 1.0, True)], "g string, id int, s double, y boolean")
    assert {r.g: r.auroc for r in stats.auroc(df, ["g"], "s", "y").collect()} == {"up": 1.0, "flat": 0.5, "one": None}
    assert {r.g: r.balanced for r in stats.best_balanced(df.where("g = 'up'"), ["g"], "s", "y", "id").collect()} == {"up": 1.0}


def test_percentile_is_linear(spark):
    means = spark.range(1, 11).select(F.col("id").cast("double").alias("mean"))
    row = stats.interval(means, []).first()
    assert row.lo == pytest.approx(1.225) and row.hi == pytest.approx(9.775)


def test_wilcoxon(spark):
    df = spark.createDataFrame([("mix", float(x)) for x in (1, 2, -3, 4, 0)] + [("zero", 0.0)] * 3, "g string, d double")
    rows = {r.g: r for r in stats.wilcoxon(df, ["g"], "d").collect()}
    assert (rows["mix"].w_plus, rows["mix"].w_minus) == (2 + 3 + 5 + 0.5, 4 + 0.5)
    assert rows["zero"].p == 1.0 and 0 < rows["mix"].p < 1


def test_bootstrap_draws_as_often_as_there_are_units(spark):
    draws = sampling.resample_counts(spark.range(1), 20, 50, 3)
    assert {r.n for r in draws.groupBy("b").agg(F.sum("w").alias("n")).collect()} == {50}
    distinct = [r.n for r in draws.groupBy("b").agg(F.count("*").alias("n")).collect()]
    assert 0.5 < sum(distinct) / len(distinct) / 50 < 0.75


def test_best_takes_the_lower_on_a_tie(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (1, 5, 0.5), (1, 10, 0.1)], "g int, a int, s double")
    assert metrics.best(df, ["g"], "a", F.col("s"), "best_a").first()[:2] == (1, 3)


def test_provider_sees_each_text_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def provider(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "a", None, "c"])], "id int, prompt string")
    cache = spark.createDataFrame([("c", "cached")], "prompt string, answer string")
    rows = {r.id: r.answer for r in providers.generate(df, "prompt", provider, cache).collect()}
    assert rows == {0: "A", 1: "B", 2: "A", 3: None, 4: "cached"}  # a null prompt stays, unanswered
    assert sorted(open(log).read().split()) == ["a", "b"]


def test_hashed_normal_looks_normal(spark):
    row = spark.range(4000).select(fv.hashed_normal(F.lit(1), F.col("id")).alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(row.m) < 0.06 and abs(row.s - 1) < 0.05 and not math.isnan(row.s)
