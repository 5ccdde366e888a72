"""The table-driven grammars."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import numbers, text

#: The largest number of a field, and how it is written before the number.
LEVELS = {"level": 100, "equipment1_level": 100, "equipment3_level": 100, "potential_hp": 25, "potential_attack": 25, "potential_heal": 25, "ex": 5, "basic": 10, "passive": 10, "sub": 10}
TIERS = {"equipment1": 10, "equipment2": 10, "equipment3": 10, "gear": 2}
SKILLS = {"ex", "basic", "passive", "sub"}


def labels():
    """(text, field, value) from the rule: a prefix of the field's family, then one or two digits up to the field's maximum."""
    for field, most in {**LEVELS, **TIERS, "bond": 100}.items():
        own = {"Lv", "LV.", "lv,"} if field in LEVELS else {"T", "t"} if field in TIERS else {""}
        if field.startswith("potential_"):
            own.add("")
        for prefix in ("", "Lv", "LV.", "lv,", "T", "t", "Lv:", "x"):
            for n in (0, 1, 9, most, most + 1, 99, 100):
                yield f"{prefix}{n}", field, n if prefix in own and 0 < n <= min(most, 99) else None
            yield f"{prefix}0{most % 10 or 1}", field, None  # a leading zero
            yield f" {prefix}1\t", field, 1 if prefix in own else None
            yield from ((f"{prefix}1{after}", field, None) for after in ("-", " 2", "\n3", "x"))
        yield "max", field, (5 if field == "ex" else 10) if field in SKILLS else None
        yield "", field, None


def quantities():
    """(text, value, displayed, status) from the rule: a sign or none, then a whole number, in groups of three or not, or a short
    one of thousands."""
    for sign in ("", "x", "X", "×"):
        for n in (0, 7, 10, 999, 1000, 54_321, 1_000_000):
            yield f"{sign}{n}", n, n, "exact"
            yield f"{sign}{n:,}", n, n, "exact"
        for k, n in (("1k", 1000), ("70K", 70_000), ("2.5k", 2500), ("3.25K", 3250), ("1.125k", 1125)):
            yield f"{sign}{k}", None, n, "abbreviated"
        for bad in ("", "007", "12,34", "1234,567", "1,2345", "4.5", "0k", "1.2345k", ".5k", "k", "5kk", "5 k", "5m", "-5", "5x", f"{sign}5" if sign else "+5"):
            yield f"{sign}{bad}", None, None, "unreadable"
    yield None, None, None, "unreadable"


def test_fields(spark):
    cases = list(labels())
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i int, t string, f string")
    got = dict(df.select("i", text.parse_field(F.col("t"), F.col("f"))).collect())
    assert [(c, got[i]) for i, c in enumerate(cases) if got[i] != c[2]] == []


def test_quantities(spark):
    cases = list(quantities())
    df = spark.createDataFrame([(i, q[0]) for i, q in enumerate(cases)], "i int, t string")
    got = {r.i: (r.value, r.displayed, r.status) for r in df.select("i", text.parse_quantity(F.col("t")).alias("q")).select("i", "q.*").collect()}
    assert [(c, got[i]) for i, c in enumerate(cases) if got[i] != c[1:]] == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tiers(spark):
    cases = {f"{sign}{n:{width}}": n if sign in "Tt" and sign and 1 <= n <= 10 and len(f"{n:{width}}") == len(str(n)) else None for sign in ("T", "t", "", "x", "TT") for n in range(13) for width in ("", "02")}
    df = spark.createDataFrame(sorted(cases.items(), key=str), "shown string, tier int")
    assert df.where(~text.parse_tier(F.col("shown")).eqNullSafe(F.col("tier"))).collect() == []


def test_collapse(spark):
    r = random.Random(1)
    charset = ["", "a", "b", "c"]
    rows = [([r.randint(0, 3) for _ in range(n)], [r.random() for _ in range(n)]) for n in range(1, 30)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, ids array<int>, scores array<double>")
    got = {x.i: (x.t, x.s) for x in df.select("i", text.collapsed(F.col("ids"), F.array(*map(F.lit, charset))).alias("t"), text.collapsed_score(F.col("ids"), F.col("scores")).alias("s")).collect()}
    for i, (ids, scores) in enumerate(rows):
        runs = [k for k in range(len(ids)) if ids[k] and (k == 0 or ids[k] != ids[k - 1])]
        assert got[i] == ("".join(charset[ids[k]] for k in runs), min((scores[k] for k in runs), default=None))


@pytest.mark.parametrize(
    ("url", "same"),
    [("HTTP://A.Example/x?b=2&a=1#f", "http://a.example/x?b=2&a=1"), ("https://a.example", "https://a.example/"), ("ftp://a.example/", None), ("https://u:p@a.example/", None), ("https:///x", None), (None, None)],
)
def test_urls(spark, url, same):
    assert one(spark, text.normalized_url(F.lit(url).cast("string"))) == same


@pytest.mark.parametrize(("name", "safe"), [("a/b.json", True), ("/a", False), ("a//b", False), ("a/../b", False), ("a/con.txt", False), ("a/b.", False), ("ä", False), ("COM1", False)])
def test_names(spark, name, safe):
    assert one(spark, text.safe_name(F.lit(name))) is safe


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("image10", "Image2", "image1b", "2", "10")], "n string")
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n")), "n").collect()] == ["2", "10", "image1b", "Image2", "image10"]


def test_padding_and_rounding(spark):
    assert one(spark, text.padded("segment_", F.lit(7), 3)) == "segment_007"
    assert one(spark, text.padded("segment_", F.lit(12345), 3)) == "segment_12345"
    assert [one(spark, F.bround(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_numbers(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, numbers.expected_amount(F.lit(2), F.lit(5), F.lit(9))) == 3.5
    assert one(spark, numbers.expected_amount(F.lit(None).cast("int"), F.lit(5), F.lit(9))) == 9
    assert one(spark, numbers.expected_amount(*[F.lit(None).cast("int")] * 3)) == 1
    assert one(spark, numbers.default_chance(F.lit(0.0))) == 0
    assert one(spark, numbers.back_off(F.lit(300.0), F.lit(40))) == 86400
    assert one(spark, numbers.back_off(F.lit(300.0), F.lit(1), F.lit(503), F.lit(900.0))) == 900
    assert one(spark, numbers.retry_after(F.lit("120"), F.lit(0))) == 120
    assert one(spark, numbers.retry_after(F.lit("Thu, 01 Jan 1970 00:02:00 GMT"), F.lit(20))) == 100
    assert sum(one(spark, numbers.softmax(v(1.0, 2.0, 3.0)))) == pytest.approx(1)
    assert one(spark, numbers.argmax(v(1.0, 3.0, 3.0))) == 1
    assert one(spark, numbers.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(2**-0.5)
    assert one(spark, numbers.normalized_correlation(v(1.0, 2.0, 3.0), v(2.0, 4.0, 6.0))) == pytest.approx(1)
    assert one(spark, numbers.iso_utc(F.lit(0.0))) is None
    assert one(spark, numbers.iso_utc(F.lit(86400.0))) == "1970-01-02T00:00:00+00:00"


def test_language_of_a_process():
    assert text.language_of({"LANG": "ja_JP.UTF-8"}) == "jp"
    assert text.language_of({"LC_ALL": "C", "LANG": "zh_CN"}) == "cn"
    assert text.language_of({"LC_ALL": "Korean_Korea.949", "LANG": "ja_JP"}) == "kr"
    assert text.language_of({"LANG": "de_DE.UTF-8"}) == text.language_of({}) == "en"
