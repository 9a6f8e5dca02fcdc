"""Units on disk, resources, dependencies, context and stored verdicts."""

import json
import struct

from pyspark.sql import functions as F

from corpusloom.detector import Corpus, audit
from corpusloom.operators import context, dependencies, readability, resources, sinks, verdicts
from corpusloom.operators.lines import lines
from corpusloom.sources import files as source
from corpusloom.streaming import lines as streaming

from .test_detectors import files, found


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def put(root, **texts):
    for path, text in texts.items():
        p = root / path.replace("__", "/")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_units_and_files(spark, tmp_path):
    for path, data in {"a/README.md": "# A\r\nx", "a/build/y.md": "no", "a/tests/t.txt": "t", "wrap/inner/check-list.yml": "q: 1", "wrap/inner/n.txt": "привет".encode("cp1251"), "plain/x.md": "x", "a/pic.png": b"\x89PNG"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data.encode() if isinstance(data, str) else data)
    u = source.units(source.listing(spark, str(tmp_path)))
    assert found(u, "name", "relative_path") == [("a", "a"), ("inner", "wrap/inner")]
    got = found(source.files(spark, str(tmp_path)), "relative_path", "kind", "text")
    assert got == [("README.md", "readme", "# A\nx"), ("check-list.yml", "checklist", "q: 1"), ("n.txt", "text", "привет"), ("tests/t.txt", "test", "t")]


def test_structure_and_resources(spark):
    paths = rows(spark, "unit_id string, relative_path string", ("u", "README.md"), ("u", "data/a.csv"), ("v", "check-list.yml"), ("v", "VM guide.md"))
    assert found(resources.structure(paths), "unit_id", "issue_type") == [("u", "missing_checklist"), ("v", "missing_readme")]
    x = lines(files(spark, ("u", "task.md", "text", "Open the given dump.pcap\nThe given a.csv\nSave to result.json\nLoad b.csv from https://x.example\nopen b.csv\ncd /opt/tool/bin\nAnalyze the provided archive")))
    assert found(resources.missing_resources(x, paths), "quote") == [("dump.pcap",)]
    assert found(resources.unconfirmed_paths(x, paths), "quote") == [("/opt/tool/bin",)]
    assert found(resources.resources_without_artifact(x, paths), "quote") == [("archive",)]
    assert found(resources.guides_without_image(paths), "unit_id") == [("v",)]


def test_dependencies(spark):
    package = json.dumps({"dependencies": {"react": "^17.0.0", "left-pad": "*"}, "engines": {"node": ">=12 <14"}})
    f = files(spark, ("u", "package.json", "text", package), ("u", "requirements.txt", "text", "Flask==1.0.0\n# no\n-r x\nrequests[socks]>=2 ; python_version>'3'"), ("u", "Dockerfile", "text", "FROM python\nFROM reg.example:5000/a/b:1.2"), ("u", "pyproject.toml", "text", "[project]\nrequires-python='>=3.8,<3.10'\ndependencies=['numpy~=1.20']"), ("v", "package.json", "text", "{bad"))
    d = dependencies.candidates(f)
    got = found(d, "ecosystem", "name", "spec")
    assert got == [("docker", "python", "latest"), ("docker", "reg.example:5000/a/b", "1.2"), ("npm", "left-pad", "*"), ("npm", "node", ">=12 <14"), ("npm", "react", "^17.0.0"), ("pypi", "Flask", "==1.0.0"), ("pypi", "numpy", "~=1.20"), ("pypi", "python", ">=3.8,<3.10"), ("pypi", "requests", ">=2")]
    schema = "ecosystem string, name string, latest_version string, source_url string, checked_at timestamp, license_spdx string, required_python string, peer_dependencies map<string,string>, engines map<string,string>"
    registry = rows(spark, schema, ("pypi", "flask", "2.0.1", "s", None, None, ">=3.10", None, None), ("npm", "left-pad", "1.0.0", "s", None, None, None, {"react": "^18.0.0", "vue": "*"}, {"node": ">=16"}), ("docker", "python", "3", "s", None, None, None, None, None), ("npm", "react", "18.0.0", "s", None, None, None, None, None))
    assert found(dependencies.freshness(d, registry), "quote", "issue_type") == [("Flask ==1.0.0", "outdated"), ("left-pad *", "unbounded"), ("numpy ~=1.20", "no_snapshot"), ("python latest", "latest_tag"), ("react ^17.0.0", "checked"), ("reg.example:5000/a/b 1.2", "no_snapshot"), ("requests >=2", "no_snapshot")]
    assert found(dependencies.compatibility(d, registry), F.element_at("extra", "dependency"), F.element_at("extra", "related_dependency")) == [("Flask", "python"), ("left-pad", "node"), ("left-pad", "react"), ("left-pad", "vue")]


def test_version_overlap(spark):
    pairs = [("^17.0.0", "^18.0.0", False), ("^17.0.0", ">=17.2", True), (">=3.8,<3.10", ">=3.10", False), ("*", "1.0", True), ("1.2 || 2", "3", True), ("~1.2", "1.3.0", False), ("==1.2.3", "1.2.3", True), ("^0.2.0", "0.3.0", False)]
    df = rows(spark, "a string, b string, want boolean", *pairs)
    assert all(r["got"] == r["want"] for r in df.withColumn("got", dependencies.may_overlap(F.col("a"), F.col("b"))).collect())


def test_availability(spark):
    values = rows(spark, "unit_id string, file_path string, line_start int, value string, quote string", ("u", "f", 1, "https://www.api.cloud.example/x", "q"), ("u", "f", 2, "Docker Hub", "q"), ("u", "f", 3, "other", "q"), ("u", "f", 4, "lib-core", "q"))
    rules = rows(spark, "ord int, pattern string, target string, status string, reason string, source string, updated_at string", (0, "cloud.example", "s", "unavailable", "r", None, None), (1, "docker", "t", "limited", "r", None, None), (2, "lib-*", "p", "manual_review", "r", None, None), (3, "other", "p", "nonsense", "r", None, None))
    assert found(dependencies.availability(values, rules), "line_start", "severity", "verdict") == [(1, "major", "warning"), (2, "minor", "warning"), (4, "info", "unknown")]


def test_context(spark):
    f = files(spark, ("u", "README.md", "readme", "Use the customer data of our stakeholder\nKPI: revenue\nf(1, 2); // {1: 2, 3: 4}\nsee PEP 8\nthe unit test dataset"), ("u", "src/a.js", "text", "f(1,2) // {3:4, 1:2, 5:0}\ng(1) // 2"), ("u", "src/b.js", "text", "g(1); // 2"), ("v", "README.md", "readme", "the toy dataset"))
    x = lines(f)
    assert found(context.market_fit(x, f), "unit_id", "verdict") == [("u", "pass")]
    assert found(context.call_outputs(x), "file_path", F.element_at("extra", "call")) == [("README.md", "f(1,2)")]
    assert found(context.foreign_materials(x, f), F.element_at("extra", "tech_lang")) == [("python",)]


def test_fact_claims(spark):
    text = "## Theory\nPython 3.12 was released in 2023 and is supported until 2028.\nYou must install Python 3.12 before 2024 to be able to start.\n## Task 1\nThe standard was published in 1999 by the committee of experts.\n# Theory heading of 2020 that is long enough to count"
    assert found(context.fact_claims(lines(files(spark, ("u", "README.md", "readme", text)))), "line_no") == [(2,)]


def test_pictures_and_artifacts(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 360) + b"Author: Me\n"
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 20, 30) + b"\x01\x01\x01\x00"
    df = rows(spark, "unit_id string, relative_path string, content binary", ("u", "a.png", png), ("u", "b.jpg", jpg), ("u", "c.gif", b"GIF"))
    assert found(source.image_inventory(df), "relative_path", "width", "height") == [("a.png", 640, 360), ("b.jpg", 30, 20), ("c.gif", None, None)]
    df = rows(spark, "unit_id string, relative_path string, content binary", ("u", "d/x.pcap", b"\x00\x01GET /Index\x02ab"), ("u", "log.txt", "Some  Text".encode()))
    assert found(source.artifact_text(df), "ref", "text") == [("d/x.pcap", "get /index"), ("log.txt", "some text"), ("x.pcap", "get /index")]


def test_gold_and_rules(spark, tmp_path):
    put(tmp_path, **{"g.json": json.dumps({"items": [{"unit_id": "u", "Критерий": "Ссылки", "severity": "Высокая", "Строка": "7"}]}), "r.json": json.dumps({"rules": [{"pattern": "a", "status": "limited", "reason": "x"}, {"pattern": "", "status": "limited", "reason": "x"}, {"pattern": "b", "status": "?", "reason": "x"}]})})
    assert [tuple(r) for r in source.read_gold(spark, str(tmp_path / "g.json")).collect()] == [("u", "links", "major", None, 7)]
    assert found(source.read_rules(spark, str(tmp_path / "r.json")), "ord", "pattern") == [(0, "a")]


def test_stored_verdicts(spark):
    usage = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cost_usd:double>"
    x = rows(spark, f"unit_id string, relative_path string, model string, cache_hit boolean, usage {usage}, response string", ("u", "README.md", "m", False, (1, 2, 3, 0.5), '{"findings":[{"verdict":"Outdated","confidence":"80%","quote":"old tool","line":1},{"verdict":"fail","confidence":"high","quote":"absent","line":1}]}'), ("u", "README.md", "m", True, (9, 9, 9, 9.0), '{"verdict":"?","confidence":0}'))
    v = verdicts.verdict_rows(x)
    assert found(v, "verdict", "confidence") == [("fail", 0.9), ("warning", 0.8)]
    assert found(verdicts.anchored(v, lines(files(spark, ("u", "README.md", "readme", "An  Old tool here")))), "quote") == [("old tool",)]
    assert found(verdicts.usage(x), "model", "calls", "cache_hits", "total_tokens") == [("all", 2, 1, 3), ("m", 2, 1, 3)]


def test_report_and_audit(spark):
    f = files(spark, ("u", "README.md", "readme", "# A\n# A\nTODO\nhttps//x.example/y"))
    kept, dropped = audit(Corpus(f))
    report = sinks.report_rows(kept)
    assert report.columns == list(sinks.REPORT) and dropped.count() == 0
    assert {r["issue_type"] for r in report.collect()} == {"duplicate_heading", "duplicate_anchor", "placeholder", "broken_url_syntax", "missing_checklist", "no_project_license"}


def test_stream_equals_batch(spark, tmp_path):
    f = files(spark, ("u", "README.md", "readme", "TODO\nfine\nhttps//x.example/y"), ("v", "README.md", "readme", "lorem ipsum"))
    f.write.parquet(str(tmp_path / "in"))
    streaming.write_findings(streaming.read_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert found(spark.read.parquet(str(tmp_path / "out")), "unit_id", "issue_type") == [("u", "broken_url_syntax"), ("u", "placeholder"), ("v", "placeholder")]


def bytes_read(df):
    """The sizes of the files that a query's scans have opened with their contents."""
    df.collect()

    def leaves(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return leaves(plan.executedPlan())
        if hasattr(plan, "plan") and kind.endswith("QueryStageExec"):
            return leaves(plan.plan())
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        return [x for c in children for x in leaves(c)] if children else [plan]

    scans = [x for x in leaves(df._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "FileSourceScanExec"]
    return sum(x.metrics().apply("filesSize").value() for x in scans if "content" in [x.output().apply(i).name() for i in range(x.output().size())])


def test_only_wanted_files_are_opened(spark, tmp_path):
    """Pictures, archives and ignored folders aren't opened; a unit whose own folder is named like an ignored one is."""
    wanted = {"p1/README.md": "one", "p1/src/a.txt": "x = 1", "p2/README.md": "two", "p2/build.md": "b"}
    for path, text in wanted.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    for path in ("p1/node_modules/big.md", "p1/shot.png", "p2/.git/config.txt", "p2/src/__pycache__/a.txt", "p2/dump.zip"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"y" * 100_000)
    df = source.files(spark, str(tmp_path))
    assert {r["text"] for r in df.collect()} == set(wanted.values())
    assert bytes_read(source.files(spark, str(tmp_path))) == sum(map(len, wanted.values()))
    (tmp_path / ".venv").mkdir()
    (tmp_path / ".venv/README.md").write_text("odd")
    hidden = {r["text"] for r in source.files(spark, str(tmp_path)).collect()}
    assert set(wanted.values()) <= hidden <= {*wanted.values(), "odd"}


def test_editorial_in_artifacts_and_java(spark):
    """Diagrams that weren't read as text are looked at line by line; the rule on ASP.NET needs a Java file."""
    rows = lines(files(spark, ("j", "README.md", "readme", "We use ASP.NET here"), ("u", "README.md", "readme", "We use ASP.NET here")))
    paths = spark.createDataFrame([("j", "src/A.java"), ("u", "a.cs")], "unit_id string, relative_path string")
    got = found(readability.editorial(rows, readability.java_units(paths)), "unit_id", "issue_type")
    assert got == [("j", "wording")]
    bad = "the COMANY of it"
    own = [("u", "d/a.drawio", b"<x>\n" + bad.encode() + b"\xff\n", 30), ("u", "b.SVG", bad.encode(), 30), ("u", "big.xml", bad.encode(), 2_000_000), ("u", "seen.xml", bad.encode(), 30), ("u", "c.md", bad.encode(), 30)]
    contents = spark.createDataFrame([(u, p, bytearray(c), n) for u, p, c, n in own], "unit_id string, relative_path string, content binary, size_bytes long")
    x = readability.artifact_lines(contents, spark.createDataFrame([("u", "Seen.xml")], "unit_id string, relative_path string"))
    assert found(x, "relative_path", "line_no", "line") == [("b.SVG", 1, bad), ("d/a.drawio", 1, "<x>"), ("d/a.drawio", 2, bad)]
    assert {r["file_path"] for r in readability.editorial(rows, None, x).collect()} == {"b.SVG", "d/a.drawio"}


def test_language_by_name(spark):
    paths = spark.createDataFrame([("u", "a.py"), ("v", "README.md"), ("w", "x.md")], "unit_id string, relative_path string")
    units = spark.createDataFrame([("u", "Java_x"), ("v", "A1_Maze_Java"), ("w", "plain")], "unit_id string, name string")
    assert found(context.unit_language(paths, units), "unit_id", "language") == [("u", "python"), ("v", "java")]
