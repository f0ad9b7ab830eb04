from sievework.plans import pipeline

DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,1 @@\n-{}\n+{}\n"


def test_all_records_of_a_vulnerability(spark):
    rows = [(2, "V", DIFF.format("old line 2", "new line 2")), (1, "V", DIFF.format("old line 1", "new line 1")), (3, "V", None)]
    known = spark.createDataFrame(rows, "knowledge_key long, vuln_id string, patch_diff string")
    known = known.selectExpr("*", "cast(knowledge_key as string) desc_text")
    r = pipeline.one_each(known).first()
    assert r.patch_diff == DIFF.format("old line 1", "new line 1") + "\n" + DIFF.format("old line 2", "new line 2") and r.desc_text == "3"
    assert {(r.role, r.content) for r in pipeline.reference_blocks(known).collect()} == {("vuln", "old line 2"), ("fix", "new line 2")}
