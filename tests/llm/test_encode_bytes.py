from pyspark.sql import functions as F

from cohortforge.llm import id_store, word_tokens
from cohortforge.llm.shipping import ship

DEF = word_tokens.load_definition(word_tokens.public_vocabulary())


def test_store_is_the_same_however_much_is_encoded_at_a_time(spark, monkeypatch, tmp_path):
    assert id_store.ENCODE_BYTES >= 16 << 20
    docs = ship(spark).range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat_ws(
        " ", F.lit("some Words,"), F.col("id").cast("string"), F.lit("again!"))).alias("text"))
    seen = []
    for k, most in enumerate((id_store.ENCODE_BYTES, 100)):
        monkeypatch.setattr(id_store, "ENCODE_BYTES", most)
        id_store.write_store(docs, f"{tmp_path}/{k}", DEF)
        seen.append(sorted(tuple(r) for r in id_store.read_store(spark, f"{tmp_path}/{k}").collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 300
