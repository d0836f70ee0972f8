"""The registered body scan reads whole documents."""

import json

from tidewatch.functions import decoding
from tidewatch.plans.queries import QUERIES


def test_late_patterns_count(spark, tmp_path):
    late = "a=" + "word " * 4000 + "<script"
    # doc_id % 5 chooses the type of the body; 0 is JSON. A form is searched in its values only.
    spark.createDataFrame([(i, late) for i in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["body_hits"] for r in QUERIES["body_scan"](spark, str(tmp_path)).collect()}
    assert got == {i: 1 for i in range(5)}


def test_whole_json_parses_and_the_cut_is_optional():
    # The key would count if the body did not parse.
    body = json.dumps({"<script": "word " * 4000, "b": "alert("})
    assert decoding.scan_text("application/json", body, ["<script", "alert("], None) == 1
    assert decoding.scan_text("text/xml", "x" * 10_240 + "<script", ["<script"], 10_240) == 0
