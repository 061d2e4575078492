import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as C  # noqa: E402
from tests.llm.tests_brute import near_classes  # noqa: E402


def test_stages_over_a_planted_table(spark, tmp_path):
    src = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    labels = spark.read.parquet(f"{src}/labels.parquet")
    extra = spark.createDataFrame(
        [(900_000, None, "en", "s", 0), (900_001, "", "en", "s", 0), (900_002, "12 34 !!", "en", "s", 8),
         (900_003, "idiot moron scum worthless trash", "en", "s", 32),
         (900_004, "the thing is that other a.b@c.de on the them and", "en", "s", 48)], docs.schema)
    out = str(tmp_path)
    docs.unionByName(extra).write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    frames, kept = {}, spark.read.parquet(f"{out}/documents.parquet")
    for name, step in C.STAGES:
        columns = kept.columns
        step(spark, kept, out).write.parquet(f"{out}/{name}")
        frames[name] = spark.read.parquet(f"{out}/{name}")
        if name != "packing":
            assert frames[name].columns == columns
        kept = frames[name]
    ids = {n: {r.doc_id for r in f.select("doc_id").distinct().collect()} for n, f in frames.items()}
    assert 900_003 not in ids["toxicity"] and 900_004 in ids["toxicity"]
    assert not {900_000, 900_001, 900_002} & ids["language"]
    before = {r.doc_id: r.text for r in frames["language"].collect()}
    assert len(ids["language"]) > 0.98 * len(ids["toxicity"]) - 3
    # one document of each brute-force class stays
    classes = near_classes(before)
    assert ids["near_duplicates"] == {min(c) for c in classes}
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    after = {r.doc_id: r for r in frames["personal_data"].collect()}
    assert after[900_004].text.count("[EMAIL]") == 1 and after[900_004].n_chars == 48 - len("a.b@c.de") + len("[EMAIL]")
    assert not any(email.search(r.text) for r in after.values())
    assert all(r.text == before[i] for i, r in after.items() if "[" not in r.text)
    assert ids["packing"] == ids["near_duplicates"]


def test_run_over_an_empty_table(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{src}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    assert C.ORACLE_SQL is None and len(C.STAGES) == 5


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    long = " ".join(f"the other thing with that number{k}" for k in range(25_000))
    rows = [(800_000, long, "en", "s", len(long)), (800_001, "call the office of that thing +1 234 567 8901 with them", "en", "s", 55),
            (800_001, "the very same number of that thing with other words in it", "en", "s", 55),
            (800_002, "twice the same row of that thing with them and other", "en", "s", 51),
            (800_002, "twice the same row of that thing with them and other", "en", "s", 51),
            (None, "no number for that other thing with them in the house", "en", "s", 53), (800_003, None, None, None, None)]
    extra = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name in ("row_number", "length_before", "ROW_NUMBER_", "__row", "__was", "score", "label", "h"):
        extra = extra.selectExpr("*", f"'x' AS `{name}`")
    out = str(tmp_path)
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    kept, columns = extra, extra.columns
    for k, (name, step) in enumerate(C.STAGES):
        step(spark, kept, out).write.parquet(f"{out}/{name}")
        kept = spark.read.parquet(f"{out}/{name}")
        assert name == "packing" or kept.columns == columns
        if name == "language":
            there = [r.doc_id for r in kept.filter("doc_id >= 800000 or doc_id is null").collect()]
            assert sorted(there, key=str) == [800_000, 800_001, 800_001, 800_002, 800_002, None]
        if name == "near_duplicates":
            there = [r.doc_id for r in kept.filter("doc_id >= 800000 or doc_id is null").collect()]
            assert sorted(there, key=str) == [800_000, 800_001, 800_001, 800_002, None]
        if name == "personal_data":
            said = [r for r in kept.filter("doc_id = 800001").collect() if "[PHONE]" in r.text]
            assert len(said) == 1 and said[0].n_chars == 55 - len("+1 234 567 8901") + len("[PHONE]")
            assert kept.filter("doc_id = 800000").first().text == long
    assert kept.filter("doc_id = 800000").agg({"length": "sum"}).first()[0] > 150_000
