from decimal import Decimal

from pyspark.sql import functions as F

from cohortforge.functions import expr as X
from conftest import rows


def one(spark, col, data, schema):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(col.alias("out")).collect()]


def test_oracle_concat_null_is_empty_and_empty_is_null(spark):
    out = one(spark, X.oracle_concat("a", "b"), [("x", None), (None, None), ("", ""), ("x", "y")],
              "a string, b string")
    assert out == ["x", None, None, "xy"]


def test_nosp_all_blank_is_null(spark):
    out = one(spark, X.nosp("a"), [(" a b ",), ("   ",), (None,)], "a string")
    assert out == ["ab", None, None]


def test_match_key_cut_before_blank_removal_and_state_outside_upper(spark):
    data = [("mary ann", "smith", "12 Oak Street Apt 4", "ca"),
            ("Bob", None, "1 Elm", "NY"),
            ("  ", None, "   ", None)]
    df = spark.createDataFrame(data, "f string, l string, a string, s string")
    k12 = [r[0] for r in df.select(X.match_key("f", "l", "a", 12, "s")).collect()]
    # substr(addr,1,12) = '12 Oak Stree' -> '12OakStree'; state appended as is
    assert k12 == ["MARYANNSMITH12OAKSTREEca", "BOB1ELMNY", None]
    k8 = [r[0] for r in df.select(X.match_key("f", "l", "a", 8)).collect()]
    assert k8 == ["MARYANNSMITH12OAKS", "BOB1ELM", None]
    raw = [r[0] for r in df.select(X.match_key("f", "l", "a", 8, upper=False)).collect()]
    assert raw[0] == "maryannsmith12OakS"


def test_amount_band_edges(spark):
    data = [(Decimal("-1"),), (Decimal("0"),), (Decimal("100"),), (Decimal("100.50"),),
            (Decimal("5000"),), (Decimal("5000.01"),), (None,), (Decimal("1100"),)]
    out = one(spark, X.amount_band("v"), data, "v decimal(18,2)")
    assert out == [None, "a0 to 100", "a0 to 100", "b101 to 200", "r4001 to 5000",
                   "s5000 Higher", None, "k1001 to 1200"]


def test_pet_mix_classes(spark):
    data = [(0, 2, 0, 0), (3, 0, 0, 0), (0, 0, 1, 0), (1, 1, 0, 0), (1, 0, 0, 1),
            (0, 1, 1, 0), (1, 1, 0, 1), (0, 0, 0, 0)]
    out = one(spark, X.pet_mix(), data, "dogs int, cats int, avian int, exoticothers int")
    assert out == list(X.PET_MIX_LABELS)


def test_term_band_no_else(spark):
    out = one(spark, X.term_band("t"), [(-1,), (0,), (3,), (4,), (5,), (6,), (None,)], "t int")
    assert out == [None, "0", "1 to 3", "4 to 5", "4 to 5", "5 Higher", None]


def test_household_band_and_pet_cap_treat_null_differently(spark):
    data = [(0,), (1,), (6,), (7,), (9,), (None,)]
    assert one(spark, X.household_size_band("n"), data, "n bigint") == [7, 1, 6, 7, 7, 7]
    assert one(spark, X.pet_count_cap("n"), data, "n bigint") == [0, 1, 6, 7, 7, None]


def test_wellcare_and_cancer_flags(spark):
    data = [(99, 0), (144, 1), (264, None), (0, 0), (None, None)]
    df = spark.createDataFrame(data, "vrcc int, cancer int")
    got = [tuple(r) for r in df.select(X.wellcare_type("vrcc"), X.cancer_flag("cancer")).collect()]
    assert got == [("VRCC", "N"), ("Core", "Y"), ("Premier", "Y"), (None, "N"), (None, "Y")]


def test_product_class_and_patterns(spark):
    data = [("I250",), ("I250G",), ("M100",), (None,)]
    assert one(spark, X.product_class("p"), data, "p string") == ["I250 (Reg/I250G)"] * 2 + ["M100", None]
    assert one(spark, X.like_any("p", ["M%", "I%"]), data, "p string") == [True, True, True, None]
    emails = [("a@b",), ("a.b",), ("ab",), (None,)]
    assert one(spark, X.loose_email("e"), emails, "e string") == [True, True, False, None]


def test_paid_per_claim_half_up_and_zero_guard(spark):
    data = [(Decimal("10.01"), 2), (Decimal("0.01"), 2), (Decimal("5.00"), 0), (None, 3),
            (Decimal("1.00"), 3)]
    out = one(spark, X.paid_per_claim("p", "n"), data, "p decimal(18,2), n bigint")
    assert out == [Decimal("5.01"), Decimal("0.01"), None, None, Decimal("0.33")]


def test_species_flag_null_is_zero(spark):
    data = [("C",), ("E",), ("R",), (None,)]
    assert one(spark, X.species_flag("s", ("E", "R")), data, "s string") == [0, 1, 1, 0]
    assert one(spark, X.species_flag("s", ("C",)), data, "s string") == [1, 0, 0, 0]
