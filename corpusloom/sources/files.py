"""Project folders as tables: units, text files, gold sheets, rules, artifacts, pictures."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..materialize import written

# Which files and folders count.
SUFFIXES = ("md", "txt", "yml", "yaml", "json", "csv", "toml", "lock", "xml", "gradle")
BARE_NAMES = ("changelog", "dockerfile", "go.mod", "license", "pipfile")
IGNORED = (".git", ".idea", ".vscode", ".venv", "__pycache__", "node_modules")
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"
IGNORED_TOP = ("build", "dist")
MARKERS = ("readme.md", "readme_rus.md", "readme_uzb.md", "check-list.yml", "check-list.yaml")
MARKER_DIRS = ("materials", "tests", "src", "misc")
MANIFESTS = ("package.json", "package-lock.json", "requirements.txt", "requirements-dev.txt", "pyproject.toml", "poetry.lock", "pipfile", "pipfile.lock", "dockerfile", "pom.xml", "build.gradle", "build.gradle.kts", "go.mod")
GOLD_COLUMNS = {"unit_id": ("unit_id", "ID единицы"), "criterion": ("criterion", "Критерий"), "severity": ("severity", "Критичность"), "file_path": ("file_path", "Файл"), "line_start": ("line_start", "Строка")}
CRITERION_LABELS = {"актуальность": "actuality", "ссылки": "links", "версии и технологии": "technology_freshness", "факты, определения, примеры": "facts", "точность и корректность": "correctness", "грамотность и читаемость текста": "readability", "качество изображений": "image_quality"}
SEVERITY_LABELS = {"критическая": "critical", "высокая": "major", "средняя": "minor", "справочно": "info"}


# the characters of bytes 0x80 to 0xFF in either encoding; 0x98 has none in the second
_LATIN1 = bytes(b for b in range(0x80, 0x100) if b != 0x98).decode("latin-1")
_CP1251 = bytes(b for b in range(0x80, 0x100) if b != 0x98).decode("cp1251")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def plain_path(root: str) -> str:
    """Without scheme and outer slashes."""
    return re.sub(SCHEME, "", root.rstrip("/")).lstrip("/")


def below(path: Column, root: str) -> Column:
    """A path of a file below root, relative to it; the scheme doesn't matter, nor colons in names or a port."""
    return F.regexp_replace(F.regexp_replace(path, SCHEME, ""), rf"^/*\Q{plain_path(root)}\E/*", "")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and length of every file; contents aren't read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return x.select(below(F.col("path"), root).alias("path"), "length")


def unit_roots(paths: DataFrame) -> DataFrame:
    """root, relative to the scanned folder ('' for itself): the folder itself if it looks like a unit, else its children that do or whose only folder does, else itself."""
    x = paths.withColumn("parts", F.split("path", "/")).withColumn("depth", F.size("parts"))
    # what stands directly in each of the folders that may be roots: the scanned one, its children, their children
    found = []
    for d in (0, 1, 2):
        inside = x.where(F.col("depth") > d)
        root = F.array_join(F.slice("parts", F.lit(1), F.lit(d)), "/") if d else F.lit("")
        item = F.lower(F.get("parts", F.lit(d)))
        is_dir = F.col("depth") > d + 1
        mark = F.when(is_dir, item.isin(*MARKER_DIRS)).otherwise(item.isin(*MARKERS))
        dirs = F.collect_set(F.when(is_dir & ~item.startswith("."), F.get("parts", F.lit(d))))
        found.append(inside.groupBy(root.alias("root")).agg(F.max(mark).alias("is_unit"), dirs.alias("dirs")).withColumn("level", F.lit(d)))
    top = found[0].where("is_unit").select("root")
    child = found[1].join(found[0].where("is_unit").select(F.lit(1).alias("_")), F.lit(True), "left_anti")
    whole = child.where("is_unit").select("root")
    only = child.where("not is_unit and size(dirs) = 1").select(F.concat("root", F.lit("/"), F.get("dirs", F.lit(0))).alias("root"))
    inner = found[2].where("is_unit").join(only, "root").select("root")
    units = top.union(whole).union(inner)
    none = found[0].select("root").join(units.select(F.lit(1).alias("_")).limit(1), F.lit(True), "left_anti")
    return units.union(none)


def unit_id(root: Column, label: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), r"(?U)[^\w]+", "-"), "^-+|-+$", "")
    relative = F.when(root == "", ".").otherwise(root)
    return F.concat(F.when(slug == "", "content").otherwise(slug), F.lit("__"), F.substring(F.sha1(relative), 1, 8))


def units(paths: DataFrame, label: str = "content") -> DataFrame:
    """unit_id, name, relative_path, branch of each unit in a listing."""
    x = unit_roots(paths)
    own = F.when(F.col("root") == "", F.lit(label)).otherwise(name(F.col("root")))
    branch = F.when(F.size(F.split("root", "/")) > 1, F.element_at(F.split("root", "/"), -2))
    return x.select(unit_id(F.col("root"), own).alias("unit_id"), own.alias("name"), F.col("root").alias("relative_path"), branch.alias("branch"))


def is_text_file(path: Column) -> Column:
    base = F.lower(name(path))
    return F.regexp_extract(base, r"\.([^.]+)$", 1).isin(*SUFFIXES) | base.isin(*BARE_NAMES)


def is_ignored(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))) | F.get(parts, F.lit(0)).isin(*IGNORED_TOP)


def file_kind(path: Column) -> Column:
    """The kind by the path inside the unit; the first rule counts."""
    base, low = F.lower(name(path)), F.lower(path)
    return F.when(base.startswith("readme"), "readme").when(base.startswith("check-list"), "checklist").when(base.isin(*MANIFESTS), "dependency_manifest").when(low.contains("material"), "material").when(F.concat(F.lit("/"), low).contains("/tests/"), "test").otherwise("text")


def decoded(content: Column) -> Column:
    """UTF-8 if it is, else cp1251 if all its bytes are, else UTF-8 with replacements; line ends become newlines."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    cp1251 = ~F.hex(content).rlike("^(?:..)*98")
    text = F.when(utf8, content.cast("string")).when(cp1251, F.translate(F.decode(content, "iso-8859-1"), _LATIN1, _CP1251)).otherwise(F.make_valid_utf8(content.cast("string")))
    return F.regexp_replace(text, r"\r\n?", "\n")


def files(spark: SparkSession, root: str, max_bytes: int = 2_000_000) -> DataFrame:
    """unit_id, relative_path, kind, text, size_bytes of the text files below root.

    Paths are listed and units found without a look into any file. Then only files are opened whose size, name and folders
    allow it: these conditions are on file metadata, by which Spark leaves files out when it plans the scan.
    """
    u = written(units(listing(spark, root), root.rstrip("/").rsplit("/", 1)[-1]).select("unit_id", "relative_path"))
    # a unit's own folder, two levels down at most, may have the name of an ignored one; if none does, such folders are closed wherever they are
    odd = u.where(F.arrays_overlap(F.split("relative_path", "/"), F.array(*map(F.lit, IGNORED)))).take(1)
    # the metadata's path is encoded as a URL, which leaves the number of folders as it is
    folders = F.slice(F.split(F.regexp_replace(F.regexp_replace("_metadata.file_path", SCHEME, ""), "^/+", ""), "/"), len([x for x in plain_path(root).split("/") if x]) + (3 if odd else 1), 10_000)
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    x = x.where(is_text_file(F.col("_metadata.file_name")) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED))))
    x = x.withColumn("path", below(F.col("path"), root))
    # a unit's folder is the scanned one, a child of it or a child's child, so each path has three names to look up
    parts = F.split("path", "/")
    keys = (F.lit(""), F.when(F.size(parts) > 1, F.get(parts, F.lit(0))), F.when(F.size(parts) > 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))))
    for d, key in enumerate(keys):
        x = x.withColumn(f"_k{d}", key).join(u.select(F.col("unit_id").alias(f"_u{d}"), F.col("relative_path").alias(f"_k{d}"), F.col("relative_path").alias(f"_p{d}")), f"_k{d}", "left")
    x = x.withColumns({"unit_id": F.coalesce("_u2", "_u1", "_u0"), "unit_path": F.coalesce("_p2", "_p1", "_p0")}).where("unit_id is not null")
    own = F.when(F.col("unit_path") == "", F.col("path")).otherwise(F.expr("substring(path, char_length(unit_path) + 2)"))
    x = x.withColumn("relative_path", own).where(~is_ignored(F.col("relative_path")))
    return x.select("unit_id", "relative_path", file_kind(F.col("relative_path")).alias("kind"), decoded(F.col("content")).alias("text"), F.col("length").alias("size_bytes"))


def labelled(value: Column, table: dict[str, str]) -> Column:
    low = F.lower(F.trim(value.cast("string")))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), low), low)


def gold_rows(rows: DataFrame) -> DataFrame:
    """unit_id, criterion, severity, file_path, line_start of a gold table with English or Russian column names and labels."""

    def pick(key: str) -> Column:
        have = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.col(f"`{c}`").cast("string")) for c in GOLD_COLUMNS[key] if c in rows.columns]
        return F.coalesce(*have) if have else F.lit(None).cast("string")

    line = F.regexp_extract(F.trim(pick("line_start")), r"^(\d+)(?:\.0*)?$", 1)
    return rows.select(
        F.coalesce(pick("unit_id"), F.lit("")).alias("unit_id"), F.coalesce(labelled(pick("criterion"), CRITERION_LABELS), F.lit("")).alias("criterion"),
        labelled(pick("severity"), SEVERITY_LABELS).alias("severity"), pick("file_path").alias("file_path"), F.when(line != "", line.cast("int")).alias("line_start"),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold table from CSV with a header, or from JSON: a list, or an object with items."""
    if path.lower().endswith(".csv"):
        return gold_rows(spark.read.option("header", True).option("multiLine", True).csv(path))
    x = spark.read.option("multiLine", True).json(path)
    return gold_rows(x.select(F.explode("items").alias("i")).select("i.*") if "items" in x.columns else x)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Availability rules (ord, pattern, target, status, reason, source, updated_at) from JSON, in order, without incomplete ones."""
    one = "struct<pattern:string,target:string,status:string,reason:string,source:string,updated_at:string>"
    text = spark.read.option("wholetext", True).text(path)
    rules = F.coalesce(F.from_json("value", f"struct<rules:array<{one}>>")["rules"], F.from_json("value", f"array<{one}>"))
    x = text.select(F.posexplode(rules).alias("ord", "r")).select("ord", "r.*")
    x = x.withColumns({c: F.trim(c) for c in ("pattern", "reason")}).withColumns({"status": F.lower(F.trim("status")), "target": F.lower(F.trim(F.coalesce("target", F.lit("service"))))})
    return x.where((F.col("pattern") != "") & (F.col("reason") != "") & F.col("status").isin("unavailable", "limited", "manual_review"))


def read_gold_sheet(rows: DataFrame, project: str = "Проект", problem: str = "Проблема", details: str = "Детали") -> DataFrame:
    """project, problem, details, row_number of a sheet's rows that say anything; a project holds for the rows below it that name none. rows need an `ordinal`."""
    clean = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    x = rows.select("ordinal", clean(project).alias("project"), clean(problem).alias("problem"), clean(details).alias("details"))
    return x.where("project <> '' and (problem <> '' or details <> '')").select("project", "problem", "details", (F.col("ordinal") + 2).cast("int").alias("row_number"))


def printable_runs(data: bytes, least: int = 4) -> str:
    return " ".join(m.decode("ascii") for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, data))


def artifact_text(artifacts: DataFrame, text_suffixes: tuple[str, ...] = ("txt", "log", "csv", "json", "xml", "md", "yml", "yaml")) -> DataFrame:
    """artifacts (unit_id, relative_path, content) -> unit_id, ref, text: lower case, single spaces; by path and by name."""

    def run(batches):
        for batch in batches:
            texts = []
            for path, data in zip(batch["relative_path"], batch["content"], strict=True):
                data = bytes(data or b"")
                texts.append(data.decode("utf-8", "ignore") if path.lower().rsplit(".", 1)[-1] in text_suffixes else printable_runs(data))
            yield pd.DataFrame({"unit_id": batch["unit_id"], "relative_path": batch["relative_path"], "text": [" ".join(t.lower().split()) for t in texts]})

    x = artifacts.select("unit_id", "relative_path", "content").mapInPandas(run, "unit_id string, relative_path string, text string")
    low = F.lower("relative_path")
    x = x.select("unit_id", F.explode(F.array_distinct(F.array(low, name(low)))).alias("ref"), "relative_path", "text")
    body = F.array_sort(F.collect_list(F.struct("relative_path", "text")))
    return x.groupBy("unit_id", "ref").agg(body.alias("b")).select("unit_id", "ref", F.array_join(F.transform("b", lambda b: b["text"]), " ").alias("text"))


def picture_size(data: bytes) -> tuple[int, int] | None:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xC3:
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 + size
    return None


INVENTORY = "unit_id string, relative_path string, width int, height int, author string, copyright string, license string, has_c2pa boolean"


def image_inventory(images: DataFrame) -> DataFrame:
    """images (unit_id, relative_path, content) -> sizes of PNG and JPEG, and hints at author, copyright and licence in the first 80 kB."""
    keys = {"author": "author|creator|artist", "copyright": "copyright|rights", "license": "license|licence"}

    def hint(text: str, words: str) -> str | None:
        for w in words.split("|"):
            m = re.search(rf"{w}\s*[:=]\s*([^\n\r\x00]{{1,180}})", text, re.I)
            if m:
                return m[1].strip()
        return None

    def run(batches):
        for batch in batches:
            rows = []
            for u, p, data in zip(batch["unit_id"], batch["relative_path"], batch["content"], strict=True):
                data = bytes(data or b"")
                size, text = picture_size(data) or (None, None), data[:80_000].decode("utf-8", "ignore")
                rows.append((u, p, *size, *(hint(text, w) for w in keys.values()), "c2pa" in text.lower() or "content credentials" in text.lower()))
            out = pd.DataFrame(rows, columns=["unit_id", "relative_path", "width", "height", *keys, "has_c2pa"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return images.select("unit_id", "relative_path", "content").mapInPandas(run, INVENTORY)


def compacted(cache: DataFrame) -> DataFrame:
    """The latest record of each (namespace, cache_key)."""
    w = W.partitionBy("namespace", "cache_key").orderBy(F.desc("checked_at"))
    return cache.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """cache with the keys of fresh replaced."""
    return cache.join(fresh.select("namespace", "cache_key").distinct(), ["namespace", "cache_key"], "left_anti").unionByName(compacted(fresh))
