"""Declared dependencies against a snapshot of registries, and where things are available."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pattern
from .findings import findings
from .lines import first_in, lines, top_n

GROUPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: Availability patterns with a wildcard that are tried on every value.
WILDCARDS = 1000
CANDIDATE = "unit_id string, file_path string, ecosystem string, name string, spec string, line_start int, grp string"


def package_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def _file_name(path: Column) -> Column:
    return F.lower(F.substring_index(path, "/", -1))


def npm_candidates(files: DataFrame) -> DataFrame:
    """package.json: four groups and engines.node."""
    x = files.where(_file_name(F.col("relative_path")) == "package.json")
    pairs = "map<string,string>"
    schema = ", ".join(f"`{g}` {pairs}" for g in (*GROUPS, "engines"))
    x = x.withColumn("j", F.from_json("text", schema))
    parts = [F.transform(F.map_entries(F.coalesce(F.col(f"j.{g}"), F.create_map().cast(pairs))), _entry(g)) for g in GROUPS]
    node = F.when(F.coalesce(F.try_element_at(F.col("j.engines"), F.lit("node")), F.lit("")) != "", F.array(F.struct(F.lit("node").alias("name"), F.col("j.engines")["node"].alias("spec"), F.lit("engine").alias("grp")))).otherwise(F.array().cast("array<struct<name:string,spec:string,grp:string>>"))
    x = x.select("unit_id", F.col("relative_path").alias("file_path"), F.explode(F.concat(*parts, node)).alias("e"))
    return x.select("unit_id", "file_path", F.lit("npm").alias("ecosystem"), F.trim("e.name").alias("name"), F.trim("e.spec").alias("spec"), F.lit(1).alias("line_start"), "e.grp")


def _entry(group: str):
    return lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.lit(group).alias("grp"))


def requirement_parts(line: Column) -> Column:
    """struct<name, spec> of one requirement; null without a name."""
    bare = F.regexp_replace(F.trim(F.substring_index(line, ";", 1)), r"\[[^\]]+\]", "")
    rule = r"^([A-Za-z0-9_.-]+)\s*(.*)$"
    return F.when(bare.rlike(rule), F.struct(F.regexp_extract(bare, rule, 1).alias("name"), F.trim(F.regexp_extract(bare, rule, 2)).alias("spec")))


def requirements_candidates(files: DataFrame) -> DataFrame:
    name = _file_name(F.col("relative_path"))
    x = lines(files.where((name == "requirements.txt") | name.startswith("requirements-")))
    x = x.withColumn("t", F.trim("line")).where("t <> '' and not t like '#%' and not t like '-%' and not t like '.%'").withColumn("r", requirement_parts(F.col("t"))).where("r is not null")
    return x.select("unit_id", F.col("relative_path").alias("file_path"), F.lit("pypi").alias("ecosystem"), "r.name", "r.spec", F.col("line_no").alias("line_start"), F.lit("requirements").alias("grp"))


def docker_candidates(files: DataFrame) -> DataFrame:
    x = lines(files.where(_file_name(F.col("relative_path")) == "dockerfile"))
    rule = r"(?i)^\s*FROM\s+(\S+)"
    image = F.substring_index(F.regexp_extract("line", rule, 1), "@", 1)
    x = x.where(F.col("line").rlike(rule)).withColumn("image", image)
    tagged = F.substring_index("image", "/", -1).contains(":")
    name = F.when(tagged, F.regexp_replace("image", ":[^:]*$", "")).otherwise(F.col("image"))
    spec = F.when(tagged, F.substring_index("image", ":", -1)).otherwise("latest")
    return x.select("unit_id", F.col("relative_path").alias("file_path"), F.lit("docker").alias("ecosystem"), name.alias("name"), F.when(spec == "", "latest").otherwise(spec).alias("spec"), F.col("line_no").alias("line_start"), F.lit("base_image").alias("grp"))


def pyproject_candidates(files: DataFrame) -> DataFrame:
    """pyproject.toml: requires-python and the project's dependencies; a file that isn't TOML gives nothing."""

    def parse(batches):
        for batch in batches:
            out = []
            for unit_id, path, text in zip(batch["unit_id"], batch["relative_path"], batch["text"], strict=True):
                try:
                    project = tomllib.loads(text or "").get("project")
                except tomllib.TOMLDecodeError:
                    continue
                project = project if isinstance(project, dict) else {}
                python = project.get("requires-python")
                if isinstance(python, str) and python.strip():
                    out.append((unit_id, path, "runtime", "python " + python.strip()))
                out += [(unit_id, path, "dependencies", str(d)) for d in project.get("dependencies") or []]
            yield pd.DataFrame(out, columns=["unit_id", "file_path", "grp", "line"])

    x = files.where(_file_name(F.col("relative_path")) == "pyproject.toml").select("unit_id", "relative_path", "text").mapInPandas(parse, "unit_id string, file_path string, grp string, line string")
    x = x.withColumn("r", requirement_parts(F.col("line"))).where("r is not null")
    return x.select("unit_id", "file_path", F.lit("pypi").alias("ecosystem"), "r.name", "r.spec", F.lit(1).alias("line_start"), "grp")


def candidates(files: DataFrame) -> DataFrame:
    """All declared dependencies, the first of each (ecosystem, name, spec, group) of a unit."""
    x = npm_candidates(files).unionByName(requirements_candidates(files)).unionByName(pyproject_candidates(files)).unionByName(docker_candidates(files))
    x = x.withColumn("_k", package_key(F.col("name")))
    return first_in(x, ["unit_id", "ecosystem", "_k", "spec", "grp"], ["file_path", "line_start", "name"]).drop("_k")


def version(text: Column) -> Column:
    """array<int> of three numbers, which orders as versions do; null if the text doesn't start with one."""
    rule = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?"
    t = F.trim(text)
    part = lambda k: F.coalesce(F.regexp_extract(t, rule, k).try_cast("int"), F.lit(0))
    return F.when(t.rlike(rule), F.array(part(1), part(2), part(3)))


def exact_version(spec: Column) -> Column:
    rule = r"^(?:==)?\s*v?(\d+(?:\.\d+){0,2})$"
    return F.when(F.trim(spec).rlike(rule), version(F.regexp_extract(F.trim(spec), rule, 1)))


def is_unbounded(spec: Column) -> Column:
    low = F.lower(F.trim(spec))
    return low.isin("", "*", "latest") | ~low.rlike(r"\d")


def version_range(spec: Column) -> Column:
    """struct<low, high>: the versions from low up to, not including, high that simple constraints leave; null for no limits or alternatives."""
    s = F.trim(spec)
    rule = r"^(>=|>|<=|<|===?|=|~=|\^|~)?\s*v?(\d+(?:\.\d+){0,2})"
    kind = "struct<low:array<int>,high:array<int>>"

    def one(p: Column) -> Column:
        op, v = F.regexp_extract(p, rule, 1), version(F.regexp_extract(p, rule, 2))
        none = F.lit(None).cast("array<int>")
        next_patch = F.array(v[0], v[1], v[2] + 1)
        next_minor = F.array(v[0], v[1] + 1, F.lit(0))
        caret = F.when(v[0] > 0, F.array(v[0] + 1, F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), v[1] + 1, F.lit(0)))
        low = F.when(op.isin("<", "<="), none).otherwise(v)
        high = F.when(op.isin(">=", ">"), none).when(op.isin("<", "<="), v).when(op == "^", caret).when(op.isin("~", "~="), next_minor).otherwise(next_patch)
        return F.when(p.rlike(rule), F.struct(low.alias("low"), high.alias("high")).cast(kind))

    parts = F.filter(F.transform(F.split(s, "[, ]+"), one), lambda p: p.isNotNull())
    lows = F.filter(F.transform(parts, lambda p: p["low"]), lambda v: v.isNotNull())
    highs = F.filter(F.transform(parts, lambda p: p["high"]), lambda v: v.isNotNull())
    limited = ~(s.isin("", "*", "latest") | s.contains("||"))
    return F.when(limited, F.struct(F.array_max(lows).alias("low"), F.array_min(highs).alias("high")))


def may_overlap(a: Column, b: Column) -> Column:
    """Whether some version may satisfy both specs; true if one of them can't be read."""
    x, y = version_range(a), version_range(b)
    apart = lambda high, low: F.coalesce(high <= low, F.lit(False))
    return F.when(x.isNull() | y.isNull(), True).otherwise(~apart(x["high"], y["low"]) & ~apart(y["high"], x["low"]))


def _quote() -> Column:
    return F.concat("name", F.when(F.col("spec") != "", F.concat(F.lit(" "), F.col("spec"))).otherwise(""))


def freshness(declared: DataFrame, registry: DataFrame, per_unit: int = 50) -> DataFrame:
    """Findings for each declared dependency: no snapshot, latest tag, no limit, older pin, or fine; the first per_unit of a unit."""
    x = top_n(declared, ["unit_id"], ["file_path", "line_start", "ecosystem", "name", "spec", "grp"], per_unit).where(~F.col("grp").isin("engine", "runtime"))
    r = registry.select("ecosystem", package_key(F.col("name")).alias("_k"), F.col("latest_version").alias("latest"), F.col("source_url"), F.col("checked_at"), F.lit(True).alias("known"))
    x = x.withColumn("_k", package_key(F.col("name"))).join(r, ["ecosystem", "_k"], "left")
    old = F.coalesce(exact_version(F.col("spec")) < version(F.coalesce("latest", F.lit(""))), F.lit(False))
    rung = F.when(F.col("known").isNull(), "no_snapshot").when((F.col("ecosystem") == "docker") & (F.col("spec") == "latest"), "latest_tag").when(is_unbounded(F.col("spec")) & ~F.lower("name").isin("python", "node"), "unbounded").when(old, "outdated").otherwise("checked")
    ladder = {"no_snapshot": ("info", "unknown", 0.45), "latest_tag": ("minor", "warning", 0.8), "unbounded": ("info", "unknown", 0.7), "outdated": ("minor", "warning", 0.85), "checked": ("info", "pass", 0.75)}
    x = x.withColumn("rung", rung)
    pick = lambda k: F.coalesce(*(F.when(F.col("rung") == n, F.lit(v[k])) for n, v in ladder.items()))
    return findings(
        x.select(
            "unit_id", "file_path", "line_start", F.col("line_start").alias("line_end"), _quote().alias("quote"), F.col("source_url").alias("source"), "checked_at", F.col("latest").alias("latest_version"),
            F.lit("technology_freshness").alias("criterion"), pick(0).alias("severity"), pick(1).alias("verdict"), pick(2).alias("confidence"),
            F.lit("dependency_freshness_checker").alias("checker_name"), F.col("rung").alias("issue_type"), (F.col("rung") != "checked").alias("needs_human_review"), F.create_map(F.lit("ecosystem"), "ecosystem").alias("extra"),
        )
    )


def compatibility(declared: DataFrame, registry: DataFrame) -> DataFrame:
    """Findings for conflicts: a missing or disjoint peer dependency, and node or python requirements that exclude the project's."""
    d = declared.withColumn("_k", package_key(F.col("name")))
    r = registry.select("ecosystem", package_key(F.col("name")).alias("_k"), "required_python", "peer_dependencies", "engines")
    x = d.join(r, ["ecosystem", "_k"])
    specs = d.groupBy("unit_id", "ecosystem", "_k").agg(F.max_by("spec", F.struct("file_path", "line_start", "grp")).alias("declared"))
    peers = x.where("ecosystem = 'npm'").select("unit_id", "file_path", "line_start", "name", "spec", "ecosystem", F.explode("peer_dependencies").alias("related", "required")).withColumn("_k", package_key(F.col("related")))
    peers = peers.join(specs, ["unit_id", "ecosystem", "_k"], "left").where(F.col("declared").isNull() | ~may_overlap(F.col("declared"), F.col("required")))
    peers = peers.select("unit_id", "file_path", "line_start", "name", "spec", "related", "required", F.coalesce("declared", F.lit("")).alias("declared"))
    parts = [peers]
    for ecosystem, name, required in (("npm", "node", F.try_element_at("engines", F.lit("node"))), ("pypi", "python", F.col("required_python"))):
        own = d.where((F.col("ecosystem") == ecosystem) & (F.col("_k") == name)).groupBy("unit_id").agg(F.min_by("spec", F.struct("file_path", "line_start")).alias("declared"))
        y = x.where((F.col("ecosystem") == ecosystem) & (F.col("_k") != name)).withColumn("required", required).where("required is not null").join(own, "unit_id").where(~may_overlap(F.col("declared"), F.col("required")))
        parts.append(y.select("unit_id", "file_path", "line_start", "name", "spec", F.lit(name).alias("related"), "required", "declared"))
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return findings(
        x.select(
            "unit_id", "file_path", "line_start", F.col("line_start").alias("line_end"), _quote().alias("quote"),
            F.lit("technology_freshness").alias("criterion"), F.lit("major").alias("severity"), F.lit("warning").alias("verdict"), F.lit(0.8).alias("confidence"),
            F.lit("dependency_freshness_checker").alias("checker_name"), F.lit("dependency_conflict").alias("issue_type"), F.lit(True).alias("needs_human_review"),
            F.create_map(F.lit("dependency"), "name", F.lit("related_dependency"), "related", F.lit("declared_spec"), "declared", F.lit("required_spec"), "required").alias("extra"),
        )
    )


def availability_key(value: Column) -> Column:
    """A link's host, or the value itself, in lower case without www."""
    low = F.lower(F.trim(value))
    host = F.when(low.rlike("^https?:"), F.try_parse_url(low, F.lit("HOST")))
    return F.regexp_replace(F.coalesce(host, F.regexp_replace(low, r"\s+", " ")), r"^www\.", "")


def availability(values: DataFrame, rules: DataFrame) -> DataFrame:
    """values (unit_id, file_path, line_start, value, quote) against rules (ord, pattern, status, reason, source): the first rule that matches a value.

    Distinct values are matched once. Plain patterns are joined by the value, the domains above it and its words; only
    patterns with a wildcard, at most WILDCARDS, are tried on every value.
    """
    distinct = values.select("value").distinct().withColumn("v", availability_key(F.col("value"))).where("v <> ''")
    p = rules.where(F.col("pattern").isNotNull() & (F.trim("pattern") != "") & F.col("status").isin("unavailable", "limited", "manual_review") & (F.trim(F.coalesce("reason", F.lit(""))) != "")).withColumn("p", availability_key(F.col("pattern")))
    rule = F.struct("pattern", "status", "reason", "source", "updated_at").alias("rule")
    labels = F.split("v", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    forms = F.array_distinct(F.concat(above, F.split("v", "[^a-zа-я0-9.+#-]+")))
    hit = distinct.select("value", F.explode(forms).alias("p")).join(p.where(~F.col("p").contains("*")).select("p", "ord", rule), "p").select("value", "ord", "rule")
    mask = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("p", r"([^\w*])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    wild = p.where(F.col("p").contains("*")).select("ord", mask.alias("mask")).limit(WILDCARDS + 1).collect()
    if len(wild) > WILDCARDS:
        raise ValueError(f"more than {WILDCARDS} patterns with a wildcard")
    if wild:
        found = F.filter(F.array(*(F.when(F.col("v").rlike(r["mask"]), F.lit(r["ord"])) for r in wild)), lambda o: o.isNotNull())
        hit = hit.unionByName(distinct.select("value", F.explode(found).alias("ord")).join(p.select("ord", rule), "ord").select("value", "ord", "rule"))
    hit = hit.groupBy("value").agg(F.min_by("rule", "ord").alias("rule"))
    x = values.join(hit, "value").withColumn("_v", F.lower("value")).dropDuplicates(["unit_id", "file_path", "_v", "line_start"])
    severity = F.when(F.col("rule.status") == "unavailable", "major").when(F.col("rule.status") == "limited", "minor").otherwise("info")
    return findings(
        x.select(
            "unit_id", "file_path", "line_start", F.col("line_start").alias("line_end"), "quote", F.col("rule.source").alias("source"), F.col("rule.status").alias("support_status"),
            F.lit("technology_freshness").alias("criterion"), severity.alias("severity"), F.when(F.col("rule.status") == "manual_review", "unknown").otherwise("warning").alias("verdict"), F.lit(0.85).alias("confidence"),
            F.lit("regional_availability_checker").alias("checker_name"), F.lit("regional_availability").alias("issue_type"), F.lit(True).alias("needs_human_review"),
            F.create_map(F.lit("matched_value"), "value", F.lit("matched_pattern"), "rule.pattern").alias("extra"),
        )
    )


def technology_candidates(entities: DataFrame, per_unit: int = 12) -> DataFrame:
    """unit_id, value, file_path, line_start: technologies and versions to look up, each once a unit, the first per_unit in file order.

    A value whose first word is the first word of an earlier one is the same technology.
    """
    x = entities.where(F.col("entity_type").isin("technology", "version"))
    root = F.lower(F.regexp_extract("value", pattern(r"^\s*([\w.+#]+)"), 1))
    x = first_in(x.withColumn("root", root), ["unit_id", "root"], ["file_path", "line_start", "value"])
    return top_n(x, ["unit_id"], ["file_path", "line_start", "value"], per_unit).select("unit_id", "value", "file_path", "line_start")
