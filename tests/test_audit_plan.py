"""An audit's plan doesn't grow with its detectors."""

from pyspark.sql import functions as F

from corpusloom.detector import DETECTORS, Corpus, Rule, audit
from corpusloom.operators.findings import calibrated, postprocessed, reported, union_findings


def test_detectors_run_by_themselves(spark):
    text = "# A\nTODO: describe\nA word is any symbol\nLook at http:/broken.example/x"
    files = spark.createDataFrame([("u", "README.md", "readme", text), ("v", "README.md", "readme", "License: MIT"), ("w", "a.md", "text", None)], "unit_id string, relative_path string, kind string, text string")
    some = [d for d in DETECTORS if d.name in ("structure", "placeholders")]
    more = Rule("wider", lambda c: some[0].detect(c).withColumn("ordinal", F.lit(7)))
    corpus = Corpus(files)
    kept, dropped = audit(corpus, (*some, more))
    want, gone = postprocessed(calibrated(union_findings([d.detect(corpus) for d in (*some, more)])))
    rows = lambda x: sorted(map(repr, x.collect()))
    assert len(rows(kept)) >= 5
    assert (rows(kept), kept.columns) == (rows(reported(want)), reported(want).columns)
    assert rows(dropped) == rows(gone)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    # the tables of findings with and without the ordinal, each read twice, and nothing of the files
    assert plan.count("Relation [") == 4 and "LogicalRDD" not in plan
