from maskwright.plans.schema import PSEUDONYMIZE, FieldFact
from maskwright.operators.transform import FieldPlan
from maskwright.sources.vault import Vault
from maskwright.streaming.incremental import pseudonymize_stream


def test_batches_share_one_vault(spark, tmp_path):
    root = f"file://{tmp_path}"
    plans = [FieldPlan("stream", FieldFact("name", "C", 20), PSEUDONYMIZE)]
    for part in (["a b", "c d", "", None], ["a b", "e f"]):
        spark.createDataFrame([(p,) for p in part], "name string").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("name string").parquet(f"{root}/in")
        pseudonymize_stream(stream, plans, f"{root}/vault", f"{root}/out", f"{root}/check").awaitTermination()
    mapped = {r["original_value"]: r["pseudonym_value"] for r in Vault.open(spark, f"{root}/vault").read("text_mappings").collect()}
    assert set(mapped) == {"a b", "c d", "e f"}
    got = [r["name"] for r in spark.read.parquet(f"{root}/out").collect()]
    assert sorted(got, key=str) == sorted(["", None, mapped["a b"], mapped["a b"], mapped["c d"], mapped["e f"]], key=str)
