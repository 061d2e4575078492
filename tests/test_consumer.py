import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from cohortforge.plans import consumer as C
from conftest import rows


def _demo(table, data):
    return table("demographics", [dict(zip(("firstname", "lastname", "addr", "statealpha", "age"), r))
                                  for r in data])


def test_link_consumers_fan_out_and_unmatched(table):
    demo = _demo(table, [("mary", "smith", "12 Oak Street", "CA", "A45"),
                         ("bob", "jones", "1 Elm", "NY", "A30"),
                         ("  ", None, None, None, "A20")])
    ts = dt.datetime(2012, 3, 4, 15, 30)
    ent = table("entity_address_master", [
        dict(enty_code="I1", enty_group_code="INSURED", enty_first_name="MARY", enty_last_name="SMITH",
             enty_address1="12 OAK STREET", enty_state="CA", enty_created_on=ts),
        dict(enty_code="I2", enty_group_code="INSURED", enty_first_name="MARY", enty_last_name="SMITH",
             enty_address1="12 OAK STREET XX", enty_state="CA", enty_created_on=ts),
        dict(enty_code="I3", enty_group_code="AGENT", enty_first_name="BOB", enty_last_name="JONES",
             enty_address1="1 ELM", enty_state="NY", enty_created_on=ts),
        dict(enty_code="I4", enty_group_code="INSURED", enty_first_name="bob", enty_last_name="jones",
             enty_address1="1 Elm", enty_state="NY", enty_created_on=ts)])
    out = C.link_consumers(demo, ent)
    got = rows(out, "insured_code", "create_date", "firstname")
    # mary matches two insured codes (12-char cut), bob only matches an AGENT row and a
    # lower-case INSURED row (no upper on that side): unmatched, as is the blank consumer
    assert got == [("I1", dt.date(2012, 3, 4), "mary"), ("I2", dt.date(2012, 3, 4), "mary"),
                   (None, None, "  "), (None, None, "bob")]
    assert out.columns[:4] == ["insured_code", "create_date", "source_str", "full_name"]


def test_person_totals_direct_keeps_people_without_policy(spark, table):
    demo = _demo(table, [("Ann", "Lee", "5 Pine Road", "WA", "A50"), ("Zed", "Q", "9 Nowhere", "WA", "A60")])
    ct8 = C.consumer_keys(demo, 8, with_state=False)
    fin = spark.createDataFrame(
        [(1, "I1", 2, "ANN", "LEE", "5 PINE ROAD", 2, 0, D("10.00"), D("7.01"), D("8.00"),
          D("0"), D("0"), D("0"), D("100.00"), None),
         (2, "I1", 3, "ANN", "LEE", "5 PINE ROXX", 1, 1, D("5.00"), D("5.00"), D("5.00"),
          D("3"), D("3"), D("3"), D("50.00"), D("1.00"))],
        "policyid bigint, insured_code string, policy_renew_no int, insured_fname string, "
        "insured_lname string, insured_address1 string, medicalclaimcount bigint, "
        "welcareclaimcount bigint, medicalclaimamount decimal(18,2), medicalpaidamount decimal(18,2), "
        "medicaleligibleamount decimal(18,2), welcareclaimamount decimal(18,2), "
        "welcarepaidamount decimal(18,2), welcareeligibleamount decimal(18,2), premium decimal(18,2), "
        "fees decimal(18,2)")
    tot = C.person_totals_direct(ct8, fin)
    got = {r.unique_id: r for r in tot.collect()}
    ann = got["ANNLEE5PINER"]
    assert (ann.max_renew, ann.med_claim_cnt, ann.med_paid_amt, ann.premium, ann.fees) == \
        (3, 3, D("12.01"), D("150.00"), D("1.00"))
    zed = got["ZEDQ9NOWHER"]
    assert (zed.max_insured_code, zed.med_claim_cnt, zed.premium) == (None, None, None)
    prof = C.person_profile(tot, ct8)
    p = {r.firstname: r for r in prof.collect()}
    assert p["Ann"].ppmc == D("4.00") and p["Ann"].ppwc == D("3.00")
    assert p["Zed"].ppmc is None and p["Ann"].age == "50"
