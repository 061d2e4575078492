import datetime as dt

from cohortforge.plans import consumer as C
from cohortforge.plans import reports as R
from conftest import rows

TS = dt.datetime(2012, 1, 1, 9)


def _ent(table, data):
    return table("entity_address_master", [
        dict(enty_code=c, enty_group_code=g, enty_first_name=f, enty_last_name=l, enty_address1=a,
             enty_state="CA", enty_created_on=TS) for c, g, f, l, a in data])


def _demo(table, data):
    return table("demographics", [dict(firstname=f, lastname=l, addr=a, statealpha=s)
                                  for f, l, a, s in data])


def test_key_duplicates_and_distinct(table):
    demo = _demo(table, [("Ann", "Lee", "1 Oak St", "CA"), ("ANN", "LEE", "1 Oak St", "CA"),
                         ("Bo", "Z", "2 Elm", "NY"), (None, None, None, None), (" ", None, "", None)])
    assert rows(R.consumer_key_duplicates(demo)) == [("ANNLEE1OAKSTCA", 2), (None, 2)]
    # the NULL key counts once among distinct keys
    assert R.consumer_key_distinct(demo).first()[0] == 3
    ent = _ent(table, [("I1", "INSURED", "ANN", "LEE", "1 OAK STREET"),
                       ("I2", "INSURED", "ANN", "LEE", "1 OAK STXX"),
                       ("I3", "AGENT", "ANN", "LEE", "1 OAK ST"),
                       ("I4", "INSURED", "BO", "Z", "2 ELM")])
    # 8-character cut: '1 OAK ST' for I1 and I2 -> one duplicated key; agents are ignored
    assert rows(R.insured_key_duplicates(ent)) == [("ANNLEE1OAKST", 2)]
    assert R.insured_key_distinct(ent).first()[0] == 2


def test_policy_counts_partition_insureds(table):
    insured = table("dim_insured", [dict(insured_dwid=i, insured_code=f"I{i}") for i in (1, 2, 3)]
                    + [dict(insured_dwid=None, insured_code="IX")])
    pets = table("policy_pet", [dict(policy_no="P1", insured_dwid=1), dict(policy_no="P2", insured_dwid=1),
                                dict(policy_no="P3", insured_dwid=2), dict(policy_no="P4", insured_dwid=None)])
    assert rows(R.policy_counts(insured, pets)) == [("I1", 2), ("I2", 1)]
    # I3 and the NULL dwid have no policy
    assert R.insureds_without_policy(insured, pets).first()[0] == 2
    assert rows(R.insureds_with_many_policies(insured, pets)) == [(1, 2)]


def test_match_counts(table):
    demo = _demo(table, [("Ann", "Lee", "1 Oak St", "CA"), ("Bo", "Z", "2 Elm", "NY"),
                         ("Cy", "Q", "3 Pine", "WA")])
    ent = _ent(table, [("I1", "INSURED", "ANN", "LEE", "1 OAK ST"), ("I2", "INSURED", "ANN", "LEE", "1 OAK ST"),
                       ("I4", "INSURED", "BO", "Z", "2 ELM")])
    insured = table("dim_insured", [dict(insured_dwid=1, insured_code="I1"),
                                    dict(insured_dwid=4, insured_code="I4")])
    pets = table("policy_pet", [dict(policy_no="P1", insured_dwid=1)])
    # Ann matches I1 (with policy) -> 1 row, Bo's I4 has no policy -> 1 unmatched row, Cy -> 1 row
    assert R.matches_with_policy(demo, ent, insured, pets).first()[0] == 3
    assert R.insured_entities_with_policy(ent, insured, pets).first()[0] == 1
    assert rows(R.consumers_with_many_codes(demo, ent)) == [("ANNLEE1OAKST", 2)]


def test_policies_mapped_and_scores(spark, table):
    link = spark.createDataFrame([("K1", 1), ("K1", 2), ("K2", 2), ("K3", 9)],
                                 "source_str string, policyid bigint")
    final = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "policyid bigint, x string")
    csat = table("csat", [dict(policyid=1, nps=5), dict(policyid=2, nps=None)])
    assert R.policies_mapped(link, final).first()[0] == 2
    assert R.people_with_score(link, final, csat).first()[0] == 1


def test_link_policies_expands_terms(table):
    demo = _demo(table, [("Ann", "Lee", "1 Oak St", "CA"), ("Bo", "Z", "2 Elm", "NY")])
    ent = _ent(table, [("I1", "INSURED", "ANN", "LEE", "1 OAK ST")])
    ent = ent.withColumn("enty_state", ent["enty_state"])
    ct = C.link_consumers(demo, ent, key_len=8, with_state=False)
    header = table("policy_header", [dict(policyid=1, policy_no="P1", insured_code="I1"),
                                     dict(policyid=2, policy_no="P1", insured_code="I1")])
    pid = C.link_policies(ct, header)
    assert rows(pid, "policyid", "policy_no", "insured_code", "firstname") == \
        [(1, "P1", "I1", "Ann"), (2, "P1", "I1", "Ann")]
